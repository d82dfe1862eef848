"""What each of five quality filters removes in every order of application, with exact copies found by radix tries.

Copies of whole texts: a task inserts the texts of a flush into a compressed trie that keeps the least id at every
terminal, so a text leaves a flush once. The flushes' texts are range-partitioned by a prefix that is longer where many
texts begin alike, and sorted by it; a task then builds one trie per prefix, and a traversal gives the least id of each
text. Any other row with that text is a duplicate. Every row's five verdicts make a mask; masks are counted per part of
the corpus, at most 32 each, and all 120 orders are read off those counts.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
MIN_WORDS = 200
LEAST_DISTINCT, MOST_CAPITALS = 50, 2  # percent of words, of code points
MARKS = "[#$%&*|]"
WORD = r"[^\x20\x09-\x0D]+"

FLUSH_BYTES = 16 << 20
#: A prefix is lengthened by STEP when the different texts that begin with it hold more bytes than a partition should:
#: its share of the input, within these bounds. MOST_CELLS bounds the list of such prefixes, which is broadcast, 8 bytes each.
LEAST_CELL, CELL_BYTES, MOST_CELLS = 1 << 20, 64 << 20, 1 << 20
FIRST_PREFIX, STEP = 32, 8


class TextTrie:
    """Whole texts as a radix trie. A node is ``[label, children by first byte, value]``; values are least (id, ...)."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]

    def insert(self, text: bytes, value: tuple) -> bool:
        """Keeps the lesser value of a text; True if the text is new."""
        node, at = self.root, 0
        while text.startswith(node[0], at):
            at += len(node[0])
            if at == len(text):
                fresh = node[2] is None
                node[2] = value if fresh else min(node[2], value)
                return fresh
            child = node[1].get(text[at])
            if child is None:
                node[1][text[at]] = [text[at:], {}, value]
                return True
            node = child
        shared = common_length(node[0], text, at)
        rest = [node[0][shared:], node[1], node[2]]
        node[:] = [node[0][:shared], {rest[0][0]: rest}, None]
        at += shared
        if at == len(text):
            node[2] = value
        else:
            node[1][text[at]] = [text[at:], {}, value]
        return True

    def terminals(self) -> Iterator[tuple[bytes, tuple]]:
        """Every text with its value."""
        waiting = [(self.root, b"")]
        while waiting:
            node, before = waiting.pop()
            text = before + node[0]
            if node[2] is not None:
                yield text, node[2]
            waiting.extend((child, text) for child in node[1].values())


def common_length(label: bytes, text: bytes, at: int) -> int:
    """How many bytes of the label the text has from ``at`` on."""
    lo, width = 0, 16
    while label[lo:lo + width] == text[at + lo:at + lo + width] and lo < len(label):
        lo, width = lo + width, width * 2
    hi = min(lo + width, len(label), len(text) - at)
    lo = min(lo, hi)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if label[lo:mid] == text[at + lo:at + mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def crowded_prefixes(docs: DataFrame) -> tuple[list[tuple[int, frozenset[int]]], int]:
    """Prefix lengths with the CRC-32 of the prefixes of that length which too many bytes of different texts share.

    Also returns the bytes of all texts. Copies count once here, so a group of copies never looks crowded.
    """
    texts = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    share = total // int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = max(LEAST_CELL, min(CELL_BYTES, share), total // MOST_CELLS)
    levels, length = [], FIRST_PREFIX
    while True:
        start = F.crc32(F.substring("text", 1, length))
        sizes = texts.groupBy(start.alias("start"), F.xxhash64("text").alias("id")).agg(F.max(F.octet_length("text")).alias("size"))
        crowded = sizes.groupBy("start").agg(F.sum("size").alias("size")).filter(F.col("size") > limit).select("start")
        found = frozenset(r.start for r in crowded.collect())
        if not found:
            return levels, total
        levels.append((length, found))
        texts = texts.filter(F.octet_length("text") > length).withColumn("start", start).join(
            F.broadcast(texts.sparkSession.createDataFrame([(s,) for s in found], "start long")), "start", "left_semi").select("text")
        length *= STEP


def prefix_of(text: bytes, levels: list[tuple[int, frozenset[int]]]) -> bytes:
    """The text's start, as long as its neighbourhood needs. Equal texts have equal starts."""
    length = FIRST_PREFIX
    for length_here, crowded in levels:
        length = length_here
        if len(text) <= length or zlib.crc32(text[:length]) not in crowded:
            return text[:length]
        length *= STEP
    return text[:length]


def first_of_flush(levels: list, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every distinct text of a flush with its prefix and least id."""
    trie, held = TextTrie(), 0

    def rows() -> pa.RecordBatch:
        found = list(trie.terminals())
        return pa.RecordBatch.from_arrays(
            [pa.array([prefix_of(text, levels) for text, _ in found], pa.binary()), pa.array([text for text, _ in found], pa.large_binary()).cast(pa.binary()),
             pa.array([value[0] for _, value in found], kind), pa.array([value[1] for _, value in found], pa.int64()),
             pa.array([value[2] for _, value in found], pa.int64())], ["prefix", "text", "doc_id", "k1", "k2"])

    for batch in batches:
        kind = batch.schema.field("doc_id").type
        for text, *value in zip(*(batch.column(c) for c in ("text", "doc_id", "k1", "k2"))):
            whole = text.as_py()
            if trie.insert(whole, tuple(v.as_py() for v in value)):
                held += len(whole)
            if held >= FLUSH_BYTES:
                yield rows()
                trie, held = TextTrie(), 0
    if held or trie.root[2]:
        yield rows()


def first_of_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least id of every text, from rows sorted by prefix."""
    trie, now, kind = TextTrie(), None, None

    def rows() -> pa.RecordBatch:
        found = [value for _, value in trie.terminals()]
        return pa.RecordBatch.from_arrays(
            [pa.array([v[0] for v in found], kind), pa.array([v[1] for v in found], pa.int64()),
             pa.array([v[2] for v in found], pa.int64())], ["doc_id", "k1", "k2"])

    done: list[pa.RecordBatch] = []
    for batch in batches:
        kind = batch.schema.field("doc_id").type
        for prefix, text, *value in zip(*(batch.column(c) for c in ("prefix", "text", "doc_id", "k1", "k2"))):
            if prefix.as_py() != now:
                done.append(rows())
                trie, now = TextTrie(), prefix.as_py()
                if len(done) >= 4096:
                    yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                    done = []
            trie.insert(text.as_py(), tuple(v.as_py() for v in value))
    if kind is not None:
        yield from pa.Table.from_batches([*done, rows()]).combine_chunks().to_batches()


def with_text_key(docs: DataFrame) -> DataFrame:
    """Adds 128 bits of hash over the text, null as empty, for joining verdicts back."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({"k1": F.xxhash64(text), "k2": F.xxhash64(F.lit(13), text)})


def first_copies(docs: DataFrame) -> DataFrame:
    """``doc_id, k1, k2``: for every distinct text of rows with an id, the least id and the key of the text."""
    levels, total = crowded_prefixes(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = with_text_key(docs.filter("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // CELL_BYTES + 1)
    return (
        texts.select(F.col("text").cast("binary").alias("text"), "doc_id", "k1", "k2")
        .mapInArrow(lambda batches: first_of_flush(levels, batches), f"prefix binary, text binary, doc_id {kind}, k1 long, k2 long")
        .repartitionByRange(parts, "prefix").sortWithinPartitions("prefix")
        .mapInArrow(first_of_all, f"doc_id {kind}, k1 long, k2 long")
    )


def text_failures(text: Column) -> Column:
    """Bits 1, 2, 4, 8 for the filters A to D that a text fails."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    points = F.char_length(text).cast("long")
    capitals = points - F.char_length(F.translate(text, string.ascii_uppercase, ""))
    failed = [n < MIN_WORDS, distinct * 100 < n * LEAST_DISTINCT, capitals * 100 > points * MOST_CAPITALS, text.rlike(MARKS)]
    mask = F.lit(0)
    for k, bad in enumerate(failed):
        mask = mask + F.when(bad, 1 << k).otherwise(0)
    return mask


def failure_masks(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns and ``mask`` per row: bit k is set if the row fails filter k of A to E.

    E: the text, null as empty, is that of a row with a smaller id. A row without an id is smaller than none and has no
    smaller ones, so it never fails E; rows that share the least id of a text all pass it.
    """
    judged = with_text_key(docs).select(
        F.struct(*columns).alias("row"), "doc_id", "k1", "k2", text_failures(F.coalesce("text", F.lit(""))).alias("failed"))
    first = first_copies(docs).select("doc_id", "k1", "k2", F.lit(True).alias("is_first"))
    copy = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    return judged.join(first, ["doc_id", "k1", "k2"], "left").select(
        "row.*", (F.col("failed") + F.when(copy, 1 << 4).otherwise(0)).alias("mask"))


def audit(masks: DataFrame, part: str) -> DataFrame:
    """One row per part, order of the five filters and step, from rows with ``mask``, ``good`` and ``toxic``.

    The counts per part and mask are at most 32 rows a part; the orders are read off these. A document that fails m
    filters is removed by each of them in 120 / m of the 120 orders, which is what ``shapley`` adds up.
    """
    cells = masks.groupBy(F.coalesce(part, F.lit("")).alias("part"), "mask").agg(
        F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("good"), F.sum(F.col("toxic").cast("long")).alias("toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    orders = F.lit(" ".join("".join(p) for p in permutations(FILTERS)))
    steps = parts.withColumn("filter_order", F.explode(F.split(orders, " "))).withColumn(
        "step", F.explode(F.array(*[F.lit(k) for k in range(1, 6)])))
    earlier = F.col("filter_order").substr(F.lit(1), F.col("step") - 1)
    letter = F.col("filter_order").substr(F.col("step"), F.lit(1))
    bits = {c: F.lit(1 << k) for k, c in enumerate(FILTERS)}
    before, this = F.lit(0), F.lit(0)
    for c, bit in bits.items():
        before = before + F.when(earlier.contains(c), bit).otherwise(0)
        this = this + F.when(letter == c, bit).otherwise(0)
    steps = steps.withColumns({"before": before, "this": this})
    fails = lambda c: c["mask"].bitwiseAND(F.col("this")) != 0
    came = lambda c: c["mask"].bitwiseAND(F.col("before")) == 0

    def total(which, of: str = "n", times=None) -> Column:
        return F.aggregate(F.filter("cells", which), F.lit(0).cast("long"),
                           lambda acc, c: acc + c[of] * (times(c) if times else 1))

    return steps.select(
        "part", "filter_order", "step",
        total(lambda c: came(c) & ~fails(c)).alias("kept"),
        total(lambda c: came(c) & fails(c)).alias("removed"),
        total(lambda c: ~came(c) & fails(c)).alias("redundant"),
        total(lambda c: c["mask"] == F.col("this")).alias("unique_fails"),
        total(lambda c: came(c) & fails(c), "good").alias("good_lost"),
        total(lambda c: came(c) & fails(c), "toxic").alias("toxic_lost"),
        total(fails, times=lambda c: (F.lit(120) / F.bit_count(c["mask"])).cast("long")).alias("shapley"))


def audit_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of all rows per source, with what is lost by ``labels`` (``doc_id, quality, toxic``).

    A null source is the part "", like an empty one. A null text is empty and so is a copy of any empty text. A row
    without a label, or without an id, is neither good nor toxic; repeated labels of an id count if any says so. Repeated
    rows are counted each. Very long texts are inserted whole. An empty table has no parts and no rows. Other columns
    are not read.
    """
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    masks = failure_masks(docs.select("doc_id", "text", "source"), ["doc_id", "source"])
    return audit(masks.join(marks, "doc_id", "left").select(
        "source", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")), "source")
