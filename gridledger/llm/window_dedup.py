"""Repeated word sequences: Rabin-Karp hashes of every window of a fixed number of words, counted over the corpus.

A window's hash is the difference of two prefix sums over word hashes; 80 bits tell windows apart, 64 from one hash and
16 from a second one over other values of the words. Every window of every document is counted. A
task first counts its own: hashes it holds twice are known to repeat, and one of each goes out to tell the others. The
rest goes to the bucket of its hash, where hashes from several tasks meet. Windows that repeat merge into maximal
intervals of words, which are cut from the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridledger.llm.packed import (
    ANSWER, BLOCK, BLOCK_SCHEMA, DIRECTORY, FLUSH_ITEMS, FLUSH_SCHEMA, KNOWN, block_rows, bucket_count, expand,
    flush_number, from_gaps, from_low_bytes, gaps, low_bytes, merge_stretches, passed, row_keys, settled, side_rows,
    squeeze,
)
from gridledger.llm.textbytes import (
    chunks, flat, mix, prefix_hashes, row_starts, spans, stretch_hashes, unspaced_bytes, window_starts, word_hashes,
)

WINDOW = 35
HASH_BYTES = 7  # with the bucket number, of 1024 or more, these are all 64 bits
SECOND = np.uint64(1)  # what is added to word hashes before they are scrambled again for the second hash
BYTES_PER_WORD = 5.0


def text_windows(part: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes of all windows of a slice of texts, in order, and how many each text has."""
    data, bounds = flat(part.column("text"))
    starts, ends, rows = spans(data, bounds, unspaced_bytes())
    first = row_starts(rows, part.num_rows)
    at = window_starts(first, width)
    words = word_hashes(data, starts, ends)
    hashes = stretch_hashes(prefix_hashes(words), at, at + width)
    tails = stretch_hashes(prefix_hashes(mix(words + SECOND)), at, at + width)
    return hashes, tails.astype(np.uint16), np.maximum(np.diff(first) - width + 1, 0)


def flush_windows(flush: int, hashes: np.ndarray, tails: np.ndarray, keys: np.ndarray, counts: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    """Blocks of a flush's distinct hashes, the windows it knows to repeat, and its directory."""
    order = np.lexsort((tails, hashes))
    ordered, tail = hashes[order], tails[order]
    new = np.ones(len(ordered), bool)
    new[1:] = (ordered[1:] != ordered[:-1]) | (tail[1:] != tail[:-1])
    at = np.flatnonzero(new)
    sizes = np.diff(at, append=len(ordered))
    distinct, place, twice = ordered[at], order[at], sizes > 1
    bucket = (distinct % np.uint64(n)).astype(np.int64)
    by = np.lexsort((place, bucket))
    yield block_rows(flush, bucket[by], {
        "a": (lambda v: low_bytes(v, HASH_BYTES), (distinct // np.uint64(n))[by]), "b": (gaps, place[by]),
        "c": (lambda v: np.packbits(v).tobytes(), twice[by]),
        "d": (lambda v: v.astype("<u2").tobytes(), tail[at][by])})
    yield side_rows(flush, n, [
        (DIRECTORY, keys.tobytes(), squeeze(counts.astype(np.int64)), None),
        (KNOWN, gaps(np.sort(order[np.repeat(twice, sizes)])), None, None)])


def pack_windows(width: int, n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, tails, keys, counts, held, nth = [], [], [], [], 0, 0

    def flushed() -> Iterator[pa.RecordBatch]:
        return flush_windows(flush_number(nth), np.concatenate(hashes), np.concatenate(tails), np.concatenate(keys),
                             np.concatenate(counts), n)

    for batch in batches:
        for part in chunks(batch):
            found, tail, per_text = text_windows(part, width)
            some = np.flatnonzero(per_text)
            if not len(some):
                continue
            k = np.stack([part.column("k1").to_numpy(), part.column("k2").to_numpy().astype(np.int64)], 1)
            hashes.append(found), tails.append(tail), keys.append(k[some]), counts.append(per_text[some])
            held += len(found)
            if held >= FLUSH_ITEMS:
                yield from flushed()
                hashes, tails, keys, counts, held, nth = [], [], [], [], 0, nth + 1
    if held:
        yield from flushed()


def repeated_in_bucket(table: pa.Table) -> pa.Table:
    """For each flush, the item numbers whose hash another flush holds too, unless the flush knew."""
    out = [passed(table)]
    blocks = table.filter(pc.equal(table.column("kind"), BLOCK))
    if blocks.num_rows:
        each = [from_low_bytes(a.as_py(), HASH_BYTES) for a in blocks.column("a")]
        hashes = np.concatenate(each)
        tails = np.frombuffer(b"".join(blocks.column("d").to_pylist()), "<u2")
        order = np.lexsort((tails, hashes))
        same = (hashes[order][1:] == hashes[order][:-1]) & (tails[order][1:] == tails[order][:-1])
        again = np.zeros(len(hashes), bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        flags, at = [], 0
        for c, mine in zip(blocks.column("c"), each):
            flags.append(np.unpackbits(np.frombuffer(c.as_py(), np.uint8), count=len(mine)).astype(bool))
        known = np.concatenate(flags)
        # one flush that knows of a repeat is news to no one else; its own windows are answered already
        answer = again & ~known
        rows = []
        for flush, b, mine in zip(blocks.column("flush"), blocks.column("b"), each):
            told = answer[at:at + len(mine)]
            at += len(mine)
            if told.any():
                rows.append((flush.as_py(), gaps(from_gaps(b.as_py())[told])))
        out.append(pa.table([
            pa.array([r[0] for r in rows], pa.int64()), pa.array(np.full(len(rows), ANSWER, np.int32)),
            pa.array([r[1] for r in rows], pa.binary()), pa.nulls(len(rows), pa.binary()), pa.nulls(len(rows), pa.binary())],
            ["flush", "kind", "a", "b", "c"]))
    return pa.concat_tables(out)


def intervals_of_flush(width: int, table: pa.Table) -> pa.Table:
    """Item numbers of one flush to maximal word intervals per text."""
    kinds = table.column("kind").to_pylist()
    a = table.column("a")
    home = kinds.index(DIRECTORY)
    keys = np.frombuffer(a[home].as_py(), np.int64).reshape(-1, 2)
    counts = expand(table.column("b")[home].as_py(), np.int64)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    found = [from_gaps(a[i].as_py()) for i, kind in enumerate(kinds) if kind in (KNOWN, ANSWER)]
    items = np.unique(np.concatenate([np.zeros(0, np.int64), *found]))
    text = np.searchsorted(offsets, items, "right") - 1
    new = np.ones(len(items), bool)
    start = items - offsets[text]
    new[1:] = (text[1:] != text[:-1]) | (start[1:] > start[:-1] + width)
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:] - 1, len(items) - 1) if len(items) else lo
    which, first = np.unique(text[lo], return_index=True)
    pairs = np.stack([start[lo], start[hi] + width], 1)
    cut = np.append(first, len(lo))
    return pa.table(
        [pa.array(keys[which, 0]), pa.array(keys[which, 1].astype(np.int32)),
         pa.array([pairs[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:])], pa.binary())], ["k1", "k2", "intervals"])


def repeated_intervals(keyed: DataFrame, width: int, n: int) -> DataFrame:
    """``k1, k2, intervals`` (packed pairs of first and end word) of the texts that hold repeated windows."""
    blocks = keyed.select("k1", "k2", "text").mapInArrow(lambda batches: pack_windows(width, n, batches), BLOCK_SCHEMA)
    answers = blocks.groupBy("bucket").applyInArrow(repeated_in_bucket, FLUSH_SCHEMA)
    found = answers.groupBy("flush").applyInArrow(
        lambda table: intervals_of_flush(width, table), "k1 long, k2 int, intervals binary")
    return found.dropDuplicates(["k1", "k2"])


def cut_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    member = unspaced_bytes()
    for batch in batches:
        for part in chunks(batch):
            data, bounds = flat(part.column("text"))
            starts, ends, rows = spans(data, bounds, member)
            first = row_starts(rows, part.num_rows)
            raw, s, e = data.tobytes(), starts.tolist(), ends.tolist()
            removed, kept = [], []
            for row, packed in enumerate(part.column("intervals")):
                lo, hi = int(first[row]), int(first[row + 1])
                pairs = np.frombuffer(packed.as_py() or b"", np.int64).reshape(-1, 2)
                edges = [0, *pairs.ravel().tolist(), hi - lo]
                kept.append(b" ".join(raw[s[i]:e[i]] for x, y in zip(edges[::2], edges[1::2]) for i in range(lo + x, lo + y)))
                removed.append(int((pairs[:, 1] - pairs[:, 0]).sum()))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])


def remove_repeats(docs: DataFrame, width: int = WINDOW, from_files: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` per row: without the words of windows that also start elsewhere.

    Elsewhere is any other place of any row, the same row included; repeated rows therefore empty each other. Windows
    are judged on the input. A text with fewer words than a window, an empty or a null one loses nothing. Rows with a
    null id take part like any other. Only the two named columns are read.

    Windows are numbered in the order a task reads its rows, and a repeated task must number them alike. A scan of files
    does; say so by ``from_files``. Other inputs are sorted inside their partitions first.
    """
    keyed = row_keys(docs)
    found = repeated_intervals(keyed if from_files else settled(keyed), width, bucket_count(docs, BYTES_PER_WORD))
    return keyed.join(found, ["k1", "k2"], "left").select("doc_id", "text", "intervals").mapInArrow(
        cut_words, f"{docs.select('doc_id').schema.simpleString()[7:-1].replace('doc_id:', 'doc_id ')}, "
                   "n_words long, n_removed long, kept_text string")


def remove_repeats_digest(docs: DataFrame, from_files: bool = False) -> DataFrame:
    return remove_repeats(docs, from_files=from_files).select("doc_id", "n_words", "n_removed",
                                       F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))
