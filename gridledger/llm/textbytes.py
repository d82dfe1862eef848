"""Whole texts as flat byte arrays: words, word hashes and window hashes without a Python loop per word.

A word's hash adds up a scrambled value for each byte at its place in the word, so that no exchange of letters cancels, as
it can in a polynomial modulo 2**64. Hashes of stretches are such polynomials: ``cumsum(value * base**i)`` gives any
stretch by one difference, moved to a common origin by the inverse power (odd bases have one). Over word hashes their
values are scrambled already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
CHUNK_ROWS = 1 << 16
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def text_of(batch: pa.RecordBatch) -> pa.Array:
    """The texts: a column of their own, or a field of ``doc`` where the whole row travels there."""
    return batch.column("text") if "text" in batch.schema.names else batch.column("doc").field("text")


def rows_with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``doc`` (a struct of the named columns), and ``text`` unless that is one of them."""
    return docs.select(F.struct(*columns).alias("doc"), *(["text"] if "text" not in columns else []))


def chunks(batch: pa.RecordBatch, limit: int = CHUNK_BYTES, most: int = CHUNK_ROWS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``limit`` bytes of text, in ``most`` rows; a longer text is a slice alone."""
    sizes = pc.fill_null(pc.binary_length(text_of(batch)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = total[at - 1] if at else 0
        to = min(at + most, max(at + 1, int(np.searchsorted(total, before + limit, "right"))))
        yield batch.slice(at, to - at)
        at = to


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values end to end, and the offsets where each value starts; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), bounds - bounds[0]
    return np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]], bounds - bounds[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes unchanged."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def lower_latin(data: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of the Latin-1 block in lower case. Lengths stay as they are."""
    out = lower_ascii(data)
    capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    out[1:][capital] += 0x20
    return out


def alnum_bytes() -> np.ndarray:
    """Bytes of words made of digits, Latin letters and everything outside ASCII."""
    table = np.zeros(256, bool)
    table[48:58] = table[65:91] = table[97:123] = table[128:] = True
    return table


def unspaced_bytes() -> np.ndarray:
    """Every byte but the six ASCII white spaces."""
    table = np.ones(256, bool)
    table[9:14] = table[32] = False
    return table


def spans(data: np.ndarray, bounds: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of member bytes; no run crosses a row."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = member[data]
    fresh = np.zeros(n + 1, bool)
    fresh[bounds] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | fresh[1:n]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | fresh[1:n]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(bounds, starts, "right") - 1


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of a 64-bit value over the whole result."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def prefix_hashes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix polynomial hashes of a sequence, and the inverse powers that move a stretch to the origin."""
    n = len(values)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(BASE, n)[:n], out=prefix[1:])
    return prefix, powers(INVERSE, n)


def stretch_hashes(hashed: tuple[np.ndarray, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash per stretch; its length is part of it."""
    prefix, back = hashed
    return mix((prefix[ends] - prefix[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash per word, from its bytes, their places in it, and its length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    first = np.zeros(len(data), np.int64)
    first[starts] = starts
    place = (np.arange(len(data)) - np.maximum.accumulate(first)).astype(np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(mix((place << np.uint64(8) | data) * np.uint64(BASE) + np.uint64(INVERSE)), out=total[1:])
    return mix(total[ends] - total[starts] + (ends - starts).astype(np.uint64))


def first_of_equals(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Representatives of equal words, and for every word which of them it equals, byte by byte.

    Words meet by hash; one whose bytes differ from the first with its hash stands for itself.
    """
    _, once, which = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    size = ends - starts
    other = starts[once][which]
    differs = size != size[once][which]
    ask = np.flatnonzero(~differs & (other != starts))
    if len(ask):
        lengths = size[ask]
        begin = np.cumsum(lengths) - lengths
        step = np.arange(lengths.sum()) - np.repeat(begin, lengths)
        unlike = data[np.repeat(starts[ask], lengths) + step] != data[np.repeat(other[ask], lengths) + step]
        differs[ask[np.add.reduceat(unlike, begin) > 0]] = True
    alone = np.flatnonzero(differs)
    which[alone] = len(once) + np.arange(len(alone))
    return np.concatenate([once, alone]), which


def row_starts(rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Where each row's items start in an array ordered by row; one more entry closes the last."""
    return np.searchsorted(rows, np.arange(n_rows + 1))


def window_starts(first: np.ndarray, width: int) -> np.ndarray:
    """Item indexes where a window of ``width`` items starts that lies in one row."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    skipped = np.cumsum(counts) - counts
    return np.arange(counts.sum()) + np.repeat(first[:-1] - skipped, counts)


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` items lie in a stretch of ``width`` items from one of the starts."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + width, n), -1)
    return np.cumsum(steps[:n]) > 0
