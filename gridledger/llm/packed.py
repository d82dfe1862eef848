"""Positions keyed by hash, shuffled as packed blocks, and their answers brought back to the documents.

A task numbers the items (windows, stretches) of its documents as they come and flushes them in groups. A flush goes
out as one block per bucket, holding the items whose hash falls there; the reducer of a bucket sees every item of a
hash and answers with item numbers. A flush's directory (documents and item counts) turns the numbers into places.
Blocks cost a few bytes per item beyond the hash, where rows of their own would cost three times as much.

Buckets number at least ``BUCKETS`` and grow with the input, so that one holds about ``BUCKET_ITEMS`` items.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridledger.llm.textbytes import mix

BUCKETS = 1024
BUCKET_ITEMS = 1 << 20
FLUSH_ITEMS = 1 << 20

BLOCK, KNOWN, DIRECTORY, ANSWER = 0, 1, 2, 3
BLOCK_SCHEMA = "bucket int, flush long, kind int, a binary, b binary, c binary, d binary"
FLUSH_COLUMNS = ["flush", "kind", "a", "b", "c"]
FLUSH_SCHEMA = "flush long, kind int, a binary, b binary, c binary"


def row_keys(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and 96 bits of hash over both. Rows with equal keys are repeated rows and get equal results."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.hash("text", "doc_id").alias("k2"))


def settled(keyed: DataFrame) -> DataFrame:
    """The rows of each partition in an order that a repeated task finds again, whichever way its shuffle blocks arrive."""
    return keyed.sortWithinPartitions("k1", "k2")


def bucket_count(docs: DataFrame, bytes_per_item: float) -> int:
    """Buckets for texts of this size."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(BUCKETS, int(size / bytes_per_item / BUCKET_ITEMS) + 1)


def squeeze(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def expand(value: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(value), kind)


def gaps(places: np.ndarray) -> bytes:
    """Ascending item numbers, packed as differences."""
    return squeeze(np.diff(places, prepend=0).astype(np.uint32))


def from_gaps(value: bytes) -> np.ndarray:
    return np.cumsum(expand(value, np.uint32), dtype=np.int64)


def low_bytes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each value."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def from_low_bytes(value: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(value, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel()


def flush_number(nth: int) -> int:
    """Names the nth flush of this task."""
    return (TaskContext.get().partitionId() << 24) + nth


def block_rows(flush: int, buckets: np.ndarray, columns: dict[str, tuple]) -> pa.RecordBatch:
    """One block row per bucket from items ordered by bucket; ``columns`` name a packing function and its values."""
    edges = np.flatnonzero(np.diff(buckets, prepend=-1, append=-1))
    made: dict[str, list] = {name: [] for name in "abcd"}
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
        for name in "abcd":
            pack, values = columns.get(name, (None, None))
            made[name].append(pack(values[lo:hi]) if pack else None)
    n = len(edges) - 1
    return pa.RecordBatch.from_arrays(
        [pa.array(buckets[edges[:-1]].astype(np.int32)), pa.array(np.full(n, flush)),
         pa.array(np.full(n, BLOCK, np.int32)), *(pa.array(made[name], pa.binary()) for name in "abcd")],
        ["bucket", "flush", "kind", "a", "b", "c", "d"])


def side_rows(flush: int, n_buckets: int, rows: list[tuple]) -> pa.RecordBatch:
    """Rows that only pass through the buckets on their way home: (kind, a, b, c)."""
    n = len(rows)
    home = int(mix(np.array([flush], np.uint64))[0]) % n_buckets
    cells = [pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3)]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, home, np.int32)), pa.array(np.full(n, flush)),
         pa.array([r[0] for r in rows], pa.int32()), *cells, pa.nulls(n, pa.binary())],
        ["bucket", "flush", "kind", "a", "b", "c", "d"])


def passed(table: pa.Table) -> pa.Table:
    """The rows that go home as they are."""
    import pyarrow.compute as pc

    return table.filter(pc.not_equal(table.column("kind"), BLOCK)).select(FLUSH_COLUMNS)


def merge_stretches(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches that the given ones cover; touching ones join."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    if not len(starts):
        return starts, ends
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)
    return starts[new], ends[last]
