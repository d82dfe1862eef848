"""The Merkle manifest, reversible line dedup and the filter audit, held against plain re-computation."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from helpers import SPACED, make_docs, prose

from gridledger.llm import filter_audit, line_dedup, merkle

FULL = "doc_id long, text string, lang string, source string, n_chars long, idx string, mask string, k1 string, part string"


def full_docs(spark, rows):
    """Documents from (id, text, lang, source, n_chars), with columns whose names operators use inside."""
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], FULL).repartition(3)


def h(*inputs):
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def plain_field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_leaf(doc_id, text, lang, source, n_chars):
    return h(*map(plain_field, (doc_id, source, lang, n_chars, text)))


def plain_tree(digests):
    """Levels from the leaves to the one node left."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def plain_siblings(levels, i):
    """(sibling or None, sibling stands left) per level."""
    out = []
    for level in levels[:-1]:
        out.append((level[i ^ 1] if i ^ 1 < len(level) else None, bool(i & 1)))
        i >>= 1
    return out


def plain_manifest(rows):
    by_lang = collections.defaultdict(list)
    for r in rows:
        by_lang[r[2]].append(r)
    order = sorted(by_lang, key=lambda lang: (lang is not None, (lang or "").encode()))
    trees = {lang: plain_tree([plain_leaf(*r) for r in sorted(by_lang[lang], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(*r)))])
             for lang in order}
    over = plain_tree([trees[lang][-1][0] for lang in order])
    out = []
    for at, lang in enumerate(order):
        for i, r in enumerate(sorted(by_lang[lang], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(*r)))):
            siblings = plain_siblings(trees[lang], i) + plain_siblings(over, at)
            hit = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded = plain_leaf(*r[:4], r[4] + 1) if hit else plain_leaf(*r)
            for sibling, left in siblings:
                folded = h(folded) if sibling is None else h(sibling, folded) if left else h(folded, sibling)
            root = over[-1][0]
            out.append((r[0], plain_leaf(*r), trees[lang][-1][0], root, h(*(s for s, _ in siblings if s)), folded, folded == root))
    return out


def manifest_rows():
    rows = [(i, prose(i, i % 9), ["de", "en", None, "Ü", ""][i % 5 if i % 3 else 0], "s", i) for i in range(1, 45)]
    return [*rows, (7, None, "lone", None, None), (None, "", "en", "s", 3), (None, None, None, None, None), (5, "x", "en", "s", None),
            (20, "same", "en", "s", 4), (20, "same", "en", "s", 4), (20, "other", "en", "s", 5), (99, "long " * 60_000, "de", "s", 1)]


def test_manifest_equals_plain_trees(spark):
    rows = manifest_rows()
    got = [tuple(r) for r in merkle.manifest_digest(full_docs(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(plain_manifest(rows), key=repr)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_one_row_and_none(spark):
    one = full_docs(spark, [(3, "t", None, "s", 1)])
    row = merkle.manifest_digest(one).collect()[0]
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == h("")
    assert merkle.manifest_digest(one.limit(0)).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 9])
def test_climb_reaches_the_root(n):
    levels = plain_tree([h(str(i)) for i in range(n)])
    for i in range(n):
        proof = "".join(s for s, _ in plain_siblings(levels, i) if s)
        assert merkle.climb(bytes.fromhex(levels[0][i]), bytes.fromhex(proof), [(i, n)]).hex() == levels[-1][0]


SPACE = " \t\n\v\f\r"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_lines(rows, least=10, min_chars=1):
    """(id, lines, dropped, kept text) per row."""
    keyed = [(i, (t or "").split("\n")) for i, t in rows]
    held = collections.Counter(k for _, lines in keyed for k in {line.strip(SPACE).translate(LOWER) for line in lines})
    gone = {k for k, n in held.items() if n >= least and len(k) >= min_chars}
    out = []
    for i, lines in keyed:
        kept = [line for line in lines if line.strip(SPACE).translate(LOWER) not in gone]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def line_rows(seed, n=60):
    draw = random.Random(seed)
    common = ["Cookie Notice", "\tcookie notice ", "ÄB", "äB", "", "  ", "a ", "a", "É", "x" * 300]
    return [(i, "\n".join(draw.choice([*common, f"own {i} {k}", f"shared {draw.randrange(30)}"]) for k in range(draw.randrange(1, 12))))
            for i in range(n)]


def found_lines(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_lines_equal_plain_counts(spark):
    rows = [*line_rows(1), (None, "Cookie notice"), (500, None), (501, ""), (502, "cookie notice\n" * 20_000), (7, line_rows(1)[7][1])]
    docs = make_docs(spark, rows)
    assert found_lines(line_dedup.drop_repeated_lines(docs)) == plain_lines(rows)
    assert found_lines(line_dedup.drop_repeated_lines(docs, 3, 4)) == plain_lines(rows, 3, 4)
    assert line_dedup.drop_repeated_lines(docs.limit(0)).collect() == []


def index_state(index):
    return sorted(tuple(r) for r in index.counts.filter("after > 0").select("k1", "k2", "after").collect())


def test_line_index_is_reversible(spark):
    first, second = line_rows(2, 40), [(i + 100, t) for i, t in line_rows(3, 30)]
    a, b = make_docs(spark, first), make_docs(spark, second)
    empty = line_dedup.LineIndex.empty(spark, min_docs=6)
    one = empty.insert(a)
    both = one.insert(b)
    assert found_lines(both.kept(a.union(b))) == plain_lines(first + second, 6)
    back = both.delete(b)
    assert index_state(back) == index_state(one)
    assert found_lines(back.kept(a)) == plain_lines(first, 6) == found_lines(one.kept(a))
    assert index_state(back.delete(a)) == []
    assert index_state(empty.insert(b).insert(a)) == index_state(both)
    with pytest.raises(Exception, match="never inserted"):
        one.delete(b)


def test_cuckoo_filter_inserts_and_deletes():
    draw = np.random.default_rng(5)
    k1, k2 = draw.integers(-2**62, 2**62, (2, 5000))
    cuckoo = line_dedup.CuckooFilter.of(k1[:4000], k2[:4000])
    assert cuckoo.may_hold(k1[:4000], k2[:4000]).all()
    assert cuckoo.may_hold(k1[4000:], k2[4000:]).mean() < 0.01
    cuckoo = line_dedup.CuckooFilter.load(cuckoo.dump())
    cuckoo.delete(k1[:3000], k2[:3000])
    assert cuckoo.may_hold(k1[3000:4000], k2[3000:4000]).all()
    assert cuckoo.may_hold(k1[:3000], k2[:3000]).mean() < 0.01
    assert (cuckoo.cells != 0).sum() == 1000


def test_filter_false_positives_drop_nothing(spark, monkeypatch):
    monkeypatch.setattr(line_dedup.CuckooFilter, "may_hold", lambda self, k1, k2: np.ones(len(k1), bool))
    rows = line_rows(4)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_lines(line_dedup.drop_repeated_lines(table)) == plain_lines(rows)


def plain_mask(text, doc_id, first):
    words, n = SPACED.findall(text), len(text)
    bad = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * n,
           bool(re.search("[#$%&*|]", text)), doc_id is not None and first.get(text, doc_id) < doc_id]
    return sum(1 << k for k, b in enumerate(bad) if b)


def plain_masks(rows):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    return [(i, s or "", plain_mask(t or "", i, first)) for i, t, s in rows]


def plain_audit(rows, good, toxic):
    out = collections.Counter()
    masks = plain_masks(rows)
    for part in {s for _, s, _ in masks}:
        mine = [(i, m) for i, s, m in masks if s == part]
        shapley = collections.Counter()
        for order in itertools.permutations(range(5)):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [(i, m) for i, m in left if m >> f & 1]
                left = [(i, m) for i, m in left if not m >> f & 1]
                shapley[f] += len(gone)
                out[part, order, step] = (len(left), len(gone), sum(m >> f & 1 for _, m in mine) - len(gone), sum(m == 1 << f for _, m in mine),
                                          sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
        for order in itertools.permutations(range(5)):
            for step, f in enumerate(order, 1):
                out[part, order, step] += (shapley[f],)
    return sorted((part, "".join("ABCDE"[f] for f in order), step, *row) for (part, order, step), row in out.items())


def audit_rows():
    rows = [(i, prose(i % 23, 150 + 10 * (i % 23)) + ["", " #", " ABC" * 40][i % 3], ["a", "b", None, ""][i % 4]) for i in range(90)]
    return [*rows, (None, "", "a"), (None, rows[0][1], "b"), (200, None, "b"), (201, "", None), (3, rows[3][1], "a"), (3, "w " * 500, "a"),
            (300, "start " * 9000 + "x", "b"), (301, "start " * 9000 + "y", "b"), (302, "start " * 9000, "a"), (303, "start " * 9000 + "x", "a")]


def test_audit_equals_all_orders(spark):
    rows = audit_rows()
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 5 == 0), "x") for i in range(0, 90, 2)] + [(4, 1, 1, "x"), (None, 1, 1, "x")],
                                   "doc_id long, quality int, toxic int, mask string")
    good, toxic = {i for i in range(0, 90, 2) if i % 3 == 0} | {4}, {i for i in range(0, 90, 2) if i % 5 == 0} | {4}
    docs = make_docs(spark, rows)
    got = sorted(tuple(r) for r in filter_audit.audit_digest(docs, labels).collect())
    assert got == plain_audit(rows, good, toxic)
    assert filter_audit.audit_digest(docs.limit(0), labels).collect() == []


def test_crowded_prefixes_get_longer(spark, monkeypatch):
    rows = [(i, "the same beginning of every document, " * 8 + f"{i % 40}", "a") for i in range(120)]
    docs = make_docs(spark, rows)
    monkeypatch.setattr(filter_audit, "LEAST_CELL", 1000)
    monkeypatch.setattr(filter_audit, "CELL_BYTES", 5000)
    levels, total = filter_audit.crowded_prefixes(docs)
    assert [n for n, _ in levels] == [32, 256] and total == sum(len(t) for _, t, _ in rows)
    assert len({filter_audit.prefix_of(t.encode(), levels) for _, t, _ in rows}) == 40
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = {r.doc_id for r in filter_audit.first_copies(table).collect()}
    assert first == set(range(40))


def test_trie_keeps_least_ids():
    draw = random.Random(9)
    texts = [bytes(draw.choice(b"ab") for _ in range(draw.randrange(40))) * draw.choice([1, 30]) for _ in range(3000)]
    trie, want = filter_audit.TextTrie(), {}
    for i, text in enumerate(texts):
        value = (draw.randrange(10_000), i)
        assert trie.insert(text, value) == (text not in want)
        want[text] = min(want.get(text, value), value)
    assert dict(trie.terminals()) == want
