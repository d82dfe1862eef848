"""Reversible line dedup: exact reference counts of line keys, and sharded cuckoo filters of the repeated ones.

An index counts, for every line key, the documents that hold it. A shard of the index is a slice of that table and a
cuckoo filter of the keys that enough documents hold. Inserting documents adds to the counts and puts keys that cross the
threshold into their shard's filter; deleting documents takes the counts back and removes the keys that fall below it,
which a cuckoo filter allows, so insertions and deletions in any order end where they began. Lookups ask the filter first
and confirm in the exact table, so a false positive of the filter drops nothing.

Keys travel as packed blocks. A task numbers the distinct keys of a flush of documents, sends each shard one block with
their counts, and gets back the numbers of those that are repeated. The blocks are written once: counting and lookup
read the same numbering, whatever task is run again. A line that a third of all documents hold is one entry per flush.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridledger.llm.packed import (
    ANSWER, BLOCK, BLOCK_SCHEMA, DIRECTORY, FLUSH_SCHEMA, block_rows, expand, flush_number, from_gaps, gaps, passed,
    side_rows, squeeze,
)
from gridledger.session import new_work_path

MIN_DOCS = 10
MIN_CHARS = 1
FLUSH_LINES = 1 << 18
LEAST_SHARDS = 32
BYTES_PER_LINE, SHARD_LINES = 50, 1 << 18
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
NO_KEY = np.uint32(0xFFFFFFFF)

SLOTS, KICKS, FULL = 4, 500, 0.85
COUNTS_SCHEMA = "shard int, k1 long, k2 long, before long, after long"
FILTER_SCHEMA = "shard int, cells binary"


class CuckooFilter:
    """16-bit fingerprints in buckets of four. A key has two buckets, each found from the other and the fingerprint."""

    def __init__(self, cells: np.ndarray) -> None:
        self.cells = cells

    @classmethod
    def of(cls, k1: np.ndarray, k2: np.ndarray) -> CuckooFilter:
        """A filter of these keys, as small as they fit."""
        size = 1 << max(int(len(k1) / SLOTS / FULL), 1).bit_length()
        while True:
            made = cls(np.zeros((size, SLOTS), np.uint16))
            if made.insert(k1, k2):
                return made
            size *= 2

    def homes(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets."""
        mark = (k2.view(np.uint64) & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        first = (k1.view(np.uint64) & np.uint64(len(self.cells) - 1)).astype(np.int64)
        return mark, first, first ^ self.hop(mark)

    def hop(self, mark: np.ndarray) -> np.ndarray:
        return (mark.astype(np.int64) * 0x5BD1E995 >> 7) & (len(self.cells) - 1)

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> bool:
        """Puts the keys in; False if one finds no place, and the filter must be built anew, larger."""
        draw = np.random.default_rng(len(k1))
        for mark, one, two in zip(*(x.tolist() for x in self.homes(k1, k2))):
            for bucket in (one, two):
                free = np.flatnonzero(self.cells[bucket] == 0)
                if len(free):
                    self.cells[bucket, free[0]] = mark
                    break
            else:
                bucket = two
                for _ in range(KICKS):
                    slot = int(draw.integers(SLOTS))
                    mark, self.cells[bucket, slot] = int(self.cells[bucket, slot]), mark
                    bucket ^= int(self.hop(np.array([mark]))[0])
                    free = np.flatnonzero(self.cells[bucket] == 0)
                    if len(free):
                        self.cells[bucket, free[0]] = mark
                        break
                else:
                    return False
        return True

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Takes out keys that were put in; one fingerprint each."""
        for mark, one, two in zip(*(x.tolist() for x in self.homes(k1, k2))):
            bucket = one if (self.cells[one] == mark).any() else two
            self.cells[bucket, np.flatnonzero(self.cells[bucket] == mark)[0]] = 0

    def may_hold(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        mark, one, two = self.homes(k1, k2)
        return ((self.cells[one] == mark[:, None]) | (self.cells[two] == mark[:, None])).any(1)

    @classmethod
    def load(cls, value: bytes) -> CuckooFilter:
        return cls(expand(value, np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return squeeze(self.cells)


def line_key(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z in lower case."""
    return line.strip(SPACE).lower()


def shard_of(k2: np.ndarray, shards: int) -> np.ndarray:
    """From bits that the filters use for nothing else."""
    return ((k2.view(np.uint64) >> np.uint64(16)) % np.uint64(shards)).astype(np.int64)


def flush_lines(flush: int, shards: int, digests: list[bytes], docs: list, counts: list[int],
                which: list[int]) -> Iterator[pa.RecordBatch]:
    """One block per shard with a flush's distinct keys and the documents that hold each, and its directory."""
    keys = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    lines = np.array(which, np.uint32)
    owner = np.repeat(np.arange(len(counts)), counts)
    held = lines != NO_KEY
    pairs = np.unique(owner[held].astype(np.int64) << 32 | lines[held])
    n_docs = np.bincount(pairs & 0xFFFFFFFF, minlength=len(keys))
    shard = shard_of(np.ascontiguousarray(keys[:, 1]), shards)
    by = np.argsort(shard, kind="stable")
    if len(by):
        yield block_rows(flush, shard[by], {
            "a": (lambda v: np.ascontiguousarray(v).tobytes(), keys[by]), "b": (gaps, by),
            "c": (lambda v: squeeze(v.astype(np.int64)), n_docs[by])})
    yield side_rows(flush, shards, [
        (DIRECTORY, np.array(docs, np.int64).tobytes(), squeeze(np.array(counts, np.int64)), squeeze(lines))])


def pack_lines(shards: int, min_chars: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers: dict[bytes, int] = {}
    docs, counts, which, nth = [], [], [], 0
    for batch in batches:
        for k1, k2, text in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("text")):
            lines = (text.as_py() or "").encode().split(b"\n")
            for line in lines:
                key = line_key(line)
                if len(key) < min_chars or min_chars > 1 and len(key.decode()) < min_chars:
                    which.append(0xFFFFFFFF)
                else:
                    which.append(numbers.setdefault(hashlib.sha256(key).digest()[:16], len(numbers)))
            docs.append((k1, k2))
            counts.append(len(lines))
            if len(which) >= FLUSH_LINES:
                yield from flush_lines(flush_number(nth), shards, list(numbers), docs, counts, which)
                numbers, docs, counts, which, nth = {}, [], [], [], nth + 1
    if docs:
        yield from flush_lines(flush_number(nth), shards, list(numbers), docs, counts, which)


def keys_of(blocks: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both halves of all keys, end to end, and how many each block has."""
    each = [np.frombuffer(a.as_py(), np.int64).reshape(-1, 2) for a in blocks.column("a")]
    keys = np.concatenate([np.zeros((0, 2), np.int64), *each])
    return np.ascontiguousarray(keys[:, 0]), np.ascontiguousarray(keys[:, 1]), np.array([len(k) for k in each], np.int64)


def distinct(k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by key, and where a new key starts in it."""
    order = np.lexsort((k2, k1))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(k1[order]) != 0) | (np.diff(k2[order]) != 0)
    return order, np.flatnonzero(new)


def merge_counts(sign: int, key: tuple, known: pa.Table, blocks: pa.Table) -> pa.Table:
    """A shard's keys with the documents that held them before and hold them now."""
    b1, b2, _ = keys_of(blocks)
    k1 = np.concatenate([known.column("k1").to_numpy(), b1])
    k2 = np.concatenate([known.column("k2").to_numpy(), b2])
    old = np.concatenate([known.column("n_docs").to_numpy(), np.zeros(len(b1), np.int64)])
    change = np.concatenate([np.zeros(known.num_rows, np.int64), *(sign * expand(c.as_py(), np.int64) for c in blocks.column("c"))])
    order, at = distinct(k1, k2)
    if not len(order):
        return pa.table([pa.array([], t) for t in (pa.int32(), *[pa.int64()] * 4)], ["shard", "k1", "k2", "before", "after"])
    before = np.add.reduceat(old[order], at)
    after = before + np.add.reduceat(change[order], at)
    if (after < 0).any():
        raise ValueError("lines are deleted that were never inserted")
    first = order[at]
    return pa.table([pa.array(np.full(len(at), key[0].as_py(), np.int32)), pa.array(k1[first]), pa.array(k2[first]),
                     pa.array(before), pa.array(after)], ["shard", "k1", "k2", "before", "after"])


def move_keys(min_docs: int, key: tuple, filters: pa.Table, keys: pa.Table) -> pa.Table:
    """A shard's filter after the keys that crossed the threshold; built anew from the exact keys if it is full."""
    k1, k2 = keys.column("k1").to_numpy(), keys.column("k2").to_numpy()
    was, now = keys.column("before").to_numpy() >= min_docs, keys.column("after").to_numpy() >= min_docs
    left, come = was & ~now, now & ~was
    made = CuckooFilter.load(filters.column("cells")[0].as_py()) if filters.num_rows else None
    if made is not None:
        made.delete(k1[left], k2[left])
    if made is None or now.sum() > FULL * made.cells.size or not made.insert(k1[come], k2[come]):
        made = CuckooFilter.of(k1[now], k2[now])
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([made.dump()], pa.binary())], ["shard", "cells"])


def find_repeated(blocks: pa.Table, state: pa.Table) -> pa.Table:
    """For each flush, the numbers of the keys that its shard's filter may hold and its exact table does hold."""
    out = [passed(blocks)]
    asked = blocks.filter(pc.equal(blocks.column("kind"), BLOCK))
    cells = [c.as_py() for c in state.column("cells") if c.is_valid]
    if asked.num_rows and cells:
        k1, k2, sizes = keys_of(asked)
        maybe = np.flatnonzero(CuckooFilter.load(cells[0]).may_hold(k1, k2))
        exact = state.filter(pc.is_valid(state.column("k1")))
        both1 = np.concatenate([exact.column("k1").to_numpy(), k1[maybe]])
        both2 = np.concatenate([exact.column("k2").to_numpy(), k2[maybe]])
        order, at = distinct(both1, both2)
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(np.isin(np.arange(len(order)), at)) - 1
        repeated = np.zeros(len(k1), bool)
        repeated[maybe] = np.isin(group[exact.num_rows:], group[:exact.num_rows])
        edges = np.concatenate([[0], np.cumsum(sizes)])
        rows = [(flush.as_py(), gaps(from_gaps(b.as_py())[repeated[lo:hi]]))
                for flush, b, lo, hi in zip(asked.column("flush"), asked.column("b"), edges[:-1], edges[1:]) if repeated[lo:hi].any()]
        out.append(pa.table([
            pa.array([r[0] for r in rows], pa.int64()), pa.array(np.full(len(rows), ANSWER, np.int32)),
            pa.array([r[1] for r in rows], pa.binary()), pa.nulls(len(rows), pa.binary()), pa.nulls(len(rows), pa.binary())],
            ["flush", "kind", "a", "b", "c"]))
    return pa.concat_tables(out)


def lines_of_flush(table: pa.Table) -> pa.Table:
    """Numbers of repeated keys to one bit per line, for the documents that lose any."""
    kinds = table.column("kind").to_pylist()
    home = kinds.index(DIRECTORY)
    docs = np.frombuffer(table.column("a")[home].as_py(), np.int64).reshape(-1, 2)
    counts = expand(table.column("b")[home].as_py(), np.int64)
    which = expand(table.column("c")[home].as_py(), np.uint32)
    found = [from_gaps(table.column("a")[i].as_py()) for i, kind in enumerate(kinds) if kind == ANSWER]
    gone = np.zeros(int(which[which != NO_KEY].max(initial=0)) + 2, bool)
    for numbers in found:
        gone[numbers] = True
    drop = np.where(which == NO_KEY, False, gone[np.minimum(which, len(gone) - 1)])
    edges = np.concatenate([[0], np.cumsum(counts)])
    total = np.concatenate([[0], np.cumsum(drop)])
    some = np.flatnonzero(total[edges[1:]] > total[edges[:-1]])
    return pa.table([pa.array(docs[some, 0]), pa.array(docs[some, 1]),
                     pa.array([np.packbits(drop[edges[i]:edges[i + 1]]).tobytes() for i in some], pa.binary())], ["k1", "k2", "dropped"])


def cut_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_lines, n_dropped, kept = [], [], []
        for text, dropped in zip(batch.column("text"), batch.column("dropped")):
            lines = (text.as_py() or "").split("\n")
            gone = np.unpackbits(np.frombuffer(dropped.as_py() or b"", np.uint8), count=len(lines)).tolist() if dropped.is_valid else None
            n_lines.append(len(lines))
            n_dropped.append(sum(gone) if gone else 0)
            kept.append("\n".join(line for line, out in zip(lines, gone) if not out) if gone else text.as_py() or "")
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())],
            ["doc_id", "n_lines", "n_dropped", "kept_text"])


def row_keys(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and 128 bits of hash over both. Rows with equal keys are repeated rows and get equal results."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(12), "text", "doc_id").alias("k2"))


@dataclass(frozen=True)
class LineIndex:
    """What the documents inserted so far hold. ``counts``: key and documents; ``filters``: one cuckoo filter per shard.

    Every change makes a new index in shared storage; the old one stays as it was.
    """

    spark: SparkSession
    shards: int
    min_docs: int
    min_chars: int
    counts: DataFrame
    filters: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession, text_bytes: int = 0, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> LineIndex:
        """An index for about so many bytes of text, which set the number of its shards."""
        shards = max(LEAST_SHARDS, text_bytes // (BYTES_PER_LINE * SHARD_LINES) + 1)
        return cls(spark, int(shards), min_docs, min_chars, spark.createDataFrame([], COUNTS_SCHEMA), spark.createDataFrame([], FILTER_SCHEMA))

    def pack(self, docs: DataFrame) -> DataFrame:
        """The documents' lines as blocks for the shards, written once."""
        shards, min_chars = self.shards, self.min_chars
        return self.written(row_keys(docs).select("k1", "k2", "text").mapInArrow(
            lambda batches: pack_lines(shards, min_chars, batches), BLOCK_SCHEMA), "blocks")

    def insert(self, docs: DataFrame) -> LineIndex:
        return self.change(self.pack(docs), 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        """Takes documents out. Fails if a line of theirs was never inserted that often."""
        return self.change(self.pack(docs), -1)

    def change(self, blocks: DataFrame, sign: int) -> LineIndex:
        """The index with the packed documents added (1) or taken out (-1)."""
        min_docs = self.min_docs
        known = self.counts.filter("after > 0").select("shard", "k1", "k2", F.col("after").alias("n_docs"))
        asked = blocks.filter(F.col("kind") == BLOCK).select(F.col("bucket").alias("shard"), "a", "c")
        counts = self.written(known.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(
            lambda key, a, b: merge_counts(sign, key, a, b), COUNTS_SCHEMA), "counts")
        near = counts.filter((F.col("before") >= min_docs) | (F.col("after") >= min_docs))
        filters = self.written(self.filters.groupBy("shard").cogroup(near.groupBy("shard")).applyInArrow(
            lambda key, a, b: move_keys(min_docs, key, a, b), FILTER_SCHEMA), "filters")
        return replace(self, counts=counts, filters=filters)

    def repeated_lines(self, blocks: DataFrame) -> DataFrame:
        """``k1, k2, dropped``: one bit per line of the packed documents that lose any."""
        exact = self.counts.filter(F.col("after") >= self.min_docs).select("shard", "k1", "k2", F.lit(None).cast("binary").alias("cells"))
        state = exact.unionByName(self.filters, allowMissingColumns=True)
        answers = blocks.groupBy("bucket").cogroup(state.groupBy("shard")).applyInArrow(find_repeated, FLUSH_SCHEMA)
        return answers.groupBy("flush").applyInArrow(lines_of_flush, "k1 long, k2 long, dropped binary").dropDuplicates(["k1", "k2"])

    def kept(self, docs: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
        """``doc_id, n_lines, n_dropped, kept_text`` per row: without the lines whose key enough documents hold."""
        keyed = row_keys(docs)
        found = self.repeated_lines(self.pack(docs) if blocks is None else blocks)
        kind = docs.schema["doc_id"].dataType.simpleString()
        return keyed.join(found, ["k1", "k2"], "left").select("doc_id", "text", "dropped").mapInArrow(
            cut_lines, f"doc_id {kind}, n_lines long, n_dropped long, kept_text string")

    def written(self, rows: DataFrame, label: str) -> DataFrame:
        path = new_work_path(self.spark, f"lines-{label}")
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)


def drop_repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_text`` per row: all lines go whose key at least ``min_docs`` rows hold.

    A row counts once for a key however often it holds it; repeated rows count each. Lines whose key has fewer than
    ``min_chars`` code points stay. A null or empty text is one empty line. Rows with a null id take part like any other.
    Very long texts are read in one piece by one task. An empty table gives none. Other columns are not read.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    index = LineIndex.empty(spark, size, min_docs, min_chars)
    blocks = index.pack(docs)
    return index.change(blocks, 1).kept(docs, blocks)


def drop_repeated_lines_digest(docs: DataFrame) -> DataFrame:
    return drop_repeated_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))
