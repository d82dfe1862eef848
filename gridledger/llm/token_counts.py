"""Greedy longest-match token counts by a linear automaton.

The vocabulary becomes a trie. Every node knows where matching goes on when the next byte doesn't fit (its failure
link) and how many tokens are then popped, both worked out beforehand. A word is read once, byte by byte; its token
count is the sum of the popped counts. No token is ever built.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridledger.llm.textbytes import chunks, first_of_equals, flat, mix, row_starts, spans, unspaced_bytes

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LONG_WORD = 512


@dataclass
class Automaton:
    """Trie edges in an open hash table (state * 256 + byte to state), failure links, popped-token counts."""

    keys: np.ndarray
    targets: np.ndarray
    fail: np.ndarray
    pops: np.ndarray


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Tokens of a rank file: one base64 token and its rank per line. Read on the driver."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


def build(vocabulary: list[bytes]) -> Automaton:
    """The automaton of a vocabulary. Single bytes that it lacks are added, so that every text has a count.

    A node that ends a token pops that token and goes back to the root. Any other takes its parent's pops and link,
    and follows links, adding their pops, until one can go on with the node's byte.
    """
    trie: list[dict[int, int]] = [{}]
    token = [False]
    for word in {w for w in vocabulary if w} | {bytes([b]) for b in range(256)}:
        at = 0
        for byte in word:
            if byte not in trie[at]:
                trie[at][byte] = len(trie)
                trie.append({})
                token.append(False)
            at = trie[at][byte]
        token[at] = True
    fail, pops = np.zeros(len(trie), np.int64), np.zeros(len(trie), np.int64)
    waiting = deque([0])
    while waiting:
        parent = waiting.popleft()
        for byte, node in trie[parent].items():
            waiting.append(node)
            if token[node]:
                pops[node] = 1
                continue
            link, popped = int(fail[parent]), int(pops[parent])
            while byte not in trie[link]:
                popped += int(pops[link])
                link = int(fail[link])
            fail[node], pops[node] = trie[link][byte], popped
    edges = np.array([(node << 8 | byte, to) for node, out in enumerate(trie) for byte, to in out.items()], np.int64)
    size = 1 << int(len(edges) * 3).bit_length()
    keys, targets = np.full(size, -1, np.int64), np.zeros(size, np.int64)
    left = np.arange(len(edges))
    slot = slots(edges[:, 0], size)
    while len(left):
        free = keys[slot] < 0
        keys[slot[free]] = edges[left[free], 0]
        won = keys[slot] == edges[left, 0]
        targets[slot[won]] = edges[left[won], 1]
        left, slot = left[~won], (slot[~won] + 1) % size
    return Automaton(keys, targets, fail, pops)


def slots(keys: np.ndarray, size: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64)) % np.uint64(size)).astype(np.int64)


def step(automaton: Automaton, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """The next state of each lane, -1 where the trie has no edge."""
    want = state << 8 | byte
    size = len(automaton.keys)
    slot = slots(want, size)
    out = np.full(len(want), -1, np.int64)
    left = np.arange(len(want))
    while len(left):
        seen = automaton.keys[slot]
        hit = seen == want[left]
        out[left[hit]] = automaton.targets[slot[hit]]
        on = ~hit & (seen >= 0)
        left, slot = left[on], (slot[on] + 1) % size
    return out


def advance(automaton: Automaton, state: np.ndarray, count: np.ndarray, byte: np.ndarray) -> None:
    """Reads one byte in every lane, in place: failing lanes pop and follow their links until they can go on."""
    to = step(automaton, state, byte)
    stuck = np.flatnonzero(to < 0)
    while len(stuck):
        count[stuck] += automaton.pops[state[stuck]]
        state[stuck] = automaton.fail[state[stuck]]
        to[stuck] = step(automaton, state[stuck], byte[stuck])
        stuck = stuck[to[stuck] < 0]
    state[:] = to


def count_words(automaton: Automaton, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Tokens of each word, read with a space before it. All words move on together, longest first."""
    length = ends - starts
    order = np.argsort(-length, kind="stable")
    starts, length = starts[order], length[order]
    state, count = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    if len(order):
        advance(automaton, state, count, np.full(len(order), 32, np.int64))
    lanes = np.searchsorted(-length, -np.arange(min(int(length[0]), LONG_WORD) if len(order) else 0), "left")
    for at, n in enumerate(lanes.tolist()):
        advance(automaton, state[:n], count[:n], data[starts[:n] + at].astype(np.int64))
    long = int((length > LONG_WORD).sum())
    if long:
        _count_long(automaton, data, starts[:long] + LONG_WORD, starts[:long] + length[:long], state, count)
    left = np.flatnonzero(state)
    while len(left):
        count[left] += automaton.pops[state[left]]
        state[left] = automaton.fail[state[left]]
        left = left[state[left] != 0]
    out = np.empty(len(order), np.int64)
    out[order] = count
    return out


def _count_long(automaton: Automaton, data: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                state: np.ndarray, count: np.ndarray) -> None:
    """The rest of very long words, one after the other."""
    used = automaton.keys >= 0
    edges = dict(zip(automaton.keys[used].tolist(), automaton.targets[used].tolist()))
    fail, pops = automaton.fail.tolist(), automaton.pops.tolist()
    for lane, (lo, hi) in enumerate(zip(starts.tolist(), ends.tolist())):
        at, n = int(state[lane]), int(count[lane])
        for byte in data[lo:hi].tobytes():
            to = edges.get(at << 8 | byte)
            while to is None:
                n += pops[at]
                at = fail[at]
                to = edges.get(at << 8 | byte)
            at = to
        state[lane], count[lane] = at, n


def count_texts(automaton: Automaton, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    member = unspaced_bytes()
    for batch in batches:
        for part in chunks(batch):
            data, bounds = flat(part.column("text"))
            starts, ends, rows = spans(data, bounds, member)
            first = row_starts(rows, part.num_rows)
            once, which = first_of_equals(data, starts, ends)
            total = np.concatenate([[0], np.cumsum(count_words(automaton, data, starts[once], ends[once])[which])])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), pa.array(np.diff(bounds), pa.int64()), pa.array(np.diff(first), pa.int64()),
                 pa.array(total[first[1:]] - total[first[:-1]], pa.int64())], ["doc", "n_bytes", "n_words", "n_tokens"])


def token_counts(docs: DataFrame, columns: list[str], vocabulary: list[bytes] | None = None) -> DataFrame:
    """``doc`` (the named columns), ``n_bytes, n_words, n_tokens`` per row. No shuffle.

    A word is a run of bytes without ASCII white space; it is read with one space before it, as the vocabulary's word
    starts have it, and cut greedily into the longest tokens. Null and empty texts have no words and no tokens. Words
    that a slice of texts repeats, byte for byte, are read once. Repeated rows get equal counts; very long texts are a
    slice of their own. An empty table gives none. The named columns travel in ``doc``, so they may clash with no other.
    """
    automaton = build(vocabulary if vocabulary is not None else read_vocabulary())
    rows = docs.select(F.struct(*columns).alias("doc"), "text")
    schema = f"doc {rows.schema['doc'].dataType.simpleString()}, n_bytes long, n_words long, n_tokens long"
    return rows.mapInArrow(lambda batches: count_texts(automaton, batches), schema)


def token_counts_digest(docs: DataFrame) -> DataFrame:
    return token_counts(docs, ["doc_id"]).select(F.col("doc.doc_id").alias("doc_id"), "n_bytes", "n_words", "n_tokens")
