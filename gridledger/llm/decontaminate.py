"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ten consecutive item words. Symbols are words; a block is three of them. The shift table
holds, for each block, how far a window end may move when the block stands there: blocks that no pattern contains move
it past themselves, so most words are never looked at. Where the shift is zero, the hash of the last block selects a
bucket of patterns, their first word is compared, then whole word sequences, byte by byte.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridledger.llm.textbytes import (
    alnum_bytes, chunks, flat, lower_ascii, mix, row_starts, rows_with_text, spans, text_of, word_hashes,
)
from gridledger.session import ensure_checkpoint_dir

WINDOW = 10
BLOCK = 3
SLOTS = 1 << 18
LANE = 64
PATTERN_BYTES = 4 << 20


def block_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words that end at each index; the first entries, which lack words, are unused."""
    out = np.zeros(words.shape, np.uint64)
    for back in range(width - 1, -1, -1):
        out[width - 1:] = mix(out[width - 1:] + words[width - 1 - back:len(words) - back])
    return out


def item_words(text: str | None) -> list[bytes]:
    """The words of an item, lower-cased, in order."""
    if not text:
        return []
    column = pa.array([text])
    data, bounds = flat(column)
    data = lower_ascii(data)
    starts, ends, _ = spans(data, bounds, alnum_bytes())
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def hash_words(words: list[bytes]) -> np.ndarray:
    """The hashes that ``word_hashes`` gives the same words inside a text."""
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    return word_hashes(data, ends - np.array([len(w) for w in words], np.int64), ends)


def compile_patterns(items: list[tuple[int, str | None]]) -> list[dict]:
    """One search table per pattern length: shift table, patterns sorted by the hash of their last block, first words.

    Null ids and items without words are left out. A window that several items share is one pattern.
    """
    owners: dict[tuple[bytes, ...], set] = {}
    for item_id, text in items:
        words = item_words(text) if item_id is not None else []
        width = min(WINDOW, len(words))
        for at in range(len(words) - width + 1 if width else 0):
            owners.setdefault(tuple(words[at:at + width]), set()).add(str(item_id))
    tables = []
    for width in sorted({len(p) for p in owners}):
        patterns = [p for p in owners if len(p) == width]
        block = min(BLOCK, width)
        hashes = hash_words([w for p in patterns for w in p]).reshape(len(patterns), width)
        shift = np.full(SLOTS, width - block + 1, np.int64)
        for end in range(block - 1, width):
            found = block_hashes(hashes[:, end - block + 1:end + 1].T, block)[-1]
            np.minimum.at(shift, (found % np.uint64(SLOTS)).astype(np.int64), width - 1 - end)
        last = block_hashes(hashes[:, width - block:].T, block)[-1]
        order = np.argsort(last, kind="stable")
        tables.append({
            "width": width, "block": block, "shift": shift, "last": last[order], "first": hashes[order, 0],
            "texts": [b" ".join(patterns[i]) for i in order], "owners": [sorted(owners[patterns[i]]) for i in order],
        })
    return tables


def search(table: dict, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate (last word, pattern) pairs of one table; many cursors move at once, each over its own lane of ends."""
    width, block = table["width"], table["block"]
    none = np.zeros(0, np.int64)
    lows, highs = first[:-1] + width - 1, first[1:]
    lanes = np.maximum(-(-(highs - lows) // LANE), 0)
    if not lanes.sum():
        return none, none
    nth = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    cursor = np.repeat(lows, lanes) + nth * LANE
    stop = np.minimum(cursor + LANE, np.repeat(highs, lanes))
    blocks = block_hashes(words, block)
    slots = (blocks % np.uint64(SLOTS)).astype(np.int64)
    ends = []
    while len(cursor):
        step = table["shift"][slots[cursor]]
        ends.append(cursor[step == 0])
        cursor = cursor + np.maximum(step, 1)
        on = cursor < stop
        cursor, stop = cursor[on], stop[on]
    ends = np.concatenate(ends)
    low = np.searchsorted(table["last"], blocks[ends], "left")
    counts = np.searchsorted(table["last"], blocks[ends], "right") - low
    at = np.repeat(ends, counts)
    pattern = np.arange(counts.sum()) + np.repeat(low - (np.cumsum(counts) - counts), counts)
    same = words[at - width + 1] == table["first"][pattern]
    return at[same], pattern[same]


def find_hits(tables: list[dict], done: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to ``hits`` (a bit per word) and ``items`` (ids) what the tables find in each text; ``done``: drops texts."""
    member = alnum_bytes()
    for batch in batches:
        own = "text" in batch.schema.names
        for part in chunks(batch):
            data, bounds = flat(text_of(part))
            data = lower_ascii(data)
            starts, ends, rows = spans(data, bounds, member)
            first = row_starts(rows, part.num_rows)
            hashes = word_hashes(data, starts, ends)
            hit = np.zeros(len(starts) + 1, np.int64)
            found: dict[int, set] = {}
            raw = data.tobytes()
            for table in tables:
                width = table["width"]
                for last, pattern in zip(*(x.tolist() for x in search(table, hashes, first))):
                    at = last - width + 1
                    if b" ".join([raw[starts[i]:ends[i]] for i in range(at, last + 1)]) == table["texts"][pattern]:
                        hit[at] += 1
                        hit[last + 1] -= 1
                        found.setdefault(int(rows[at]), set()).update(table["owners"][pattern])
            hit = np.cumsum(hit)[:-1] > 0
            bits, items = [], []
            for row, (old, names) in enumerate(zip(part.column("hits"), part.column("items"))):
                mine = np.packbits(hit[first[row]:first[row + 1]])
                before = old.as_py()
                bits.append((mine | np.frombuffer(before, np.uint8) if before else mine).tobytes())
                items.append(sorted(found.get(row, set()) | set(names.as_py() or [])))
            n_hit = [int(np.unpackbits(np.frombuffer(b, np.uint8)).sum()) for b in bits]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), *([pa.nulls(part.num_rows, pa.string()) if done else part.column("text")] if own else []),
                 pa.array(np.diff(first), pa.int64()), pa.array(n_hit, pa.int64()), pa.array(bits, pa.binary()), pa.array(items, pa.list_(pa.string()))],
                batch.schema.names)


def scan(docs: DataFrame, benchmark: DataFrame, columns: list[str]) -> DataFrame:
    """``doc`` (a struct of the named columns), ``n_words, n_hit, items`` for every row of ``docs``, in one pass.

    The patterns reach the tasks inside the function, so they are taken in blocks of at most ``PATTERN_BYTES`` of item
    text, measured first. A larger benchmark takes one pass per block, each continuing the result of the last, which
    is checkpointed. Texts are read whole; null has no words. Documents are never shuffled.
    """
    named = benchmark.select("item_id", "text").filter("item_id IS NOT NULL AND text IS NOT NULL")
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(2 * size / PATTERN_BYTES)) if size > PATTERN_BYTES else 1
    state = rows_with_text(docs, columns).withColumns({
        "n_words": F.lit(0).cast("long"), "n_hit": F.lit(0).cast("long"), "hits": F.lit(None).cast("binary"),
        "items": F.lit(None).cast("array<string>")})
    schema = state.schema
    for block in range(blocks):
        if block:
            ensure_checkpoint_dir(docs.sparkSession)
            state = state.checkpoint()
        mine = named.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else named
        tables = compile_patterns([(r.item_id, r.text) for r in mine.collect()])
        done = block == blocks - 1
        state = state.mapInArrow(lambda batches, t=tables, done=done: find_hits(t, done, batches), schema)
    return state.select("doc", "n_words", "n_hit", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows without any occurrence of a benchmark window; columns unchanged, repeated rows kept."""
    return scan(docs, benchmark, docs.columns).filter("n_hit = 0").select("doc.*")


def decontaminate_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: words, words inside occurrences, items found, and whether there are any."""
    found = scan(docs, benchmark, ["doc_id"])
    items = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return found.select(
        F.col("doc.doc_id").alias("doc_id"), "n_words", "n_hit", F.size(items).cast("long").alias("n_items"),
        F.sha2(F.encode(F.concat_ws(",", items), "UTF-8"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))
