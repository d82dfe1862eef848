"""Operators that compare documents or vectors with each other, held against plain re-computation."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF_DIR
from helpers import SPACED, alnum_words, collected, groups, make_docs, prose, shingle_counts, weighted_jaccard

from gridledger.llm import components, dart_minhash, packed, suffix_dedup, vector_dedup, window_dedup
from gridledger.llm.packed import ANSWER, from_gaps
from gridledger.llm.queries import QUERIES

SHORT = "repeated in the corpus but shorter than a window"
LINE = prose(99, 60)


def sha(value):
    return hashlib.sha256(value).hexdigest()


def corpus():
    """Nulls, blanks, repeated rows and ids, shared passages, overlapping repeats, one long text, one text of one letter."""
    rows = [(1, None), (2, ""), (3, " \n"), (4, LINE), (4, LINE), (5, f"{prose(1, 80)} {LINE}\n{prose(2, 50)}"),
            (6, f"{LINE[30:200]} é {LINE[10:120]}"), (7, prose(1, 80) + " " + prose(1, 80)), (8, "a" * 400), (9, "b" + "a" * 120),
            (None, LINE), (10, prose(5, 4000) + " " + LINE + " " + prose(1, 45)), (11, SHORT), (12, SHORT), (13, "ü" * 70),
            (14, prose(2, 50).replace(" ", "\t")), (0, prose(5, 300)), (-3, LINE[:49]), (15, LINE[:50])]
    return rows + [(100 + i, f"{prose(300 + i, 12)} {LINE} {prose(400 + i, 12)}") for i in range(25)]


def cut_windows(rows, width=35):
    count = collections.Counter()
    words = [SPACED.findall(text or "") for _, text in rows]
    for w in words:
        count.update(tuple(w[i:i + width]) for i in range(len(w) - width + 1))
    out = []
    for (doc_id, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - width + 1):
            if count[tuple(w[i:i + width])] > 1:
                gone |= set(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), sha(kept.encode())))
    return sorted(out, key=repr)


def cut_strings(rows, width=50):
    first = {}
    raw = [(text or "").encode() for _, text in rows]
    for (doc_id, _), b in zip(rows, raw):
        for i in range(len(b) - width + 1 if doc_id is not None else 0):
            first[b[i:i + width]] = min(doc_id, first.get(b[i:i + width], doc_id))
    out = []
    for (doc_id, _), b in zip(rows, raw):
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1 if doc_id is not None else 0):
            if first[b[i:i + width]] < doc_id:
                gone[i:i + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((doc_id, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept)))
    return sorted(out, key=repr)


WINDOW_COLUMNS = ("doc_id", "n_words", "n_removed", "kept_sha256")
STRING_COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def given(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]


def test_repeated_windows_of_the_documents(spark):
    assert collected(QUERIES["op8_repeated_windows"](spark, SF_DIR), *WINDOW_COLUMNS) == cut_windows(given(spark))


@pytest.mark.parametrize("flush", [window_dedup.FLUSH_ITEMS, 100])
def test_repeated_windows_of_awkward_rows(spark, monkeypatch, flush):
    monkeypatch.setattr(window_dedup, "FLUSH_ITEMS", flush)
    docs = make_docs(spark, corpus())
    assert collected(window_dedup.remove_repeats_digest(docs), *WINDOW_COLUMNS) == cut_windows(corpus())
    assert window_dedup.remove_repeats_digest(docs.limit(0)).count() == 0


def test_earlier_strings_of_the_documents(spark):
    assert collected(QUERIES["op5_earlier_strings"](spark, SF_DIR), *STRING_COLUMNS) == cut_strings(given(spark))


@pytest.mark.parametrize("hot, flush", [(suffix_dedup.HOT_STRETCHES, suffix_dedup.FLUSH_ITEMS), (1, 60)])
def test_earlier_strings_of_awkward_rows(spark, monkeypatch, hot, flush):
    monkeypatch.setattr(suffix_dedup, "HOT_STRETCHES", hot)
    monkeypatch.setattr(suffix_dedup, "FLUSH_ITEMS", flush)
    docs = make_docs(spark, corpus())
    assert collected(suffix_dedup.remove_earlier_digest(docs), *STRING_COLUMNS) == cut_strings(corpus())
    assert suffix_dedup.remove_earlier_digest(docs.limit(0)).count() == 0


@pytest.mark.parametrize("letters, seed", [(1, 0), (2, 1), (2, 2), (26, 3)])
def test_suffix_sort_orders_windows(letters, seed):
    data = np.random.default_rng(seed).integers(97, 97 + letters, 3000).astype(np.uint8)
    data[1500:1700] = data[200:400]
    suffixes = np.arange(len(data) - suffix_dedup.WINDOW + 1)
    order, klass = suffix_dedup.Suffixes(data).classes(suffixes)
    cut = [data[i:i + suffix_dedup.WINDOW].tobytes() for i in order]
    assert cut == sorted(cut)
    assert [b != a for a, b in zip(cut, cut[1:])] == (np.diff(klass) == 1).tolist()


def test_hash_ties_are_settled_on_the_bytes(monkeypatch):
    data = np.random.default_rng(5).integers(97, 99, 1000).astype(np.uint8)
    suffixes = np.arange(len(data) - suffix_dedup.WINDOW + 1)
    tied = suffix_dedup.Suffixes(data)
    monkeypatch.setattr(tied, "common", lambda a, b: np.full(len(a), suffix_dedup.WINDOW))
    order, klass = tied.classes(suffixes)
    cut = [data[i:i + suffix_dedup.WINDOW].tobytes() for i in order]
    assert cut == sorted(cut) and [b != a for a, b in zip(cut, cut[1:])] == (np.diff(klass) == 1).tolist()


def test_packing_is_an_exact_round_trip():
    values = np.random.default_rng(0).integers(0, 1 << 56, 1000).astype(np.uint64)
    assert (packed.from_low_bytes(packed.low_bytes(values, 7), 7) == values).all()
    places = np.sort(np.random.default_rng(1).choice(1 << 20, 500, replace=False))
    assert (packed.from_gaps(packed.gaps(places)) == places).all()
    lo, hi = packed.merge_stretches(np.array([5, 0, 20, 9]), np.array([9, 3, 25, 12]))
    assert (lo.tolist(), hi.tolist()) == ([0, 5, 20], [3, 12, 25])


def near_copies(rows):
    """Class per document by checking every pair of texts that shares a shingle."""
    shingled = [(i, shingle_counts(t)) for i, t in rows]
    linked = [(a, b) for n, (a, x) in enumerate(shingled) for b, y in shingled[:n] if x and y and weighted_jaccard(x, y) >= 0.8]
    return groups([i for i, _ in rows], linked)


def test_near_copies_of_the_documents(spark):
    rows = given(spark)
    expected = near_copies(rows)
    got = collected(QUERIES["op9_near_copies"](spark, SF_DIR), "doc_id", "class_id", "kept")
    assert got == sorted(((i, c, i == c) for i, c in expected.items()), key=repr)
    assert any(i != c for i, c in expected.items())


def edited(text, every):
    words = text.split()
    words[3::every] = ["edited"] * len(words[3::every])
    return " ".join(words)


def test_near_copies_of_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(dart_minhash, "BLOCK_MEMBERS", 8)
    base = prose(50, 400, 5000)
    rows = [(1, None), (2, ""), (3, "!?"), (4, "a b"), (5, "A, b."), (6, "a b c"), (7, base), (8, edited(base, 130)),
            (9, edited(base, 20)), (12, prose(51, 3000, 9000)), (11, prose(51, 3000, 9000) + " end"), (13, "na " * 500),
            (14, "na " * 490)]
    rows += [(100 + i, edited(base, 130) + f" tail{i}") for i in range(30)]
    docs = make_docs(spark, rows)
    expected = near_copies(rows)
    got = collected(dart_minhash.near_copies_digest(docs), "doc_id", "class_id", "kept")
    assert got == sorted(((i, c, i == c) for i, c in expected.items()), key=repr)
    assert expected[129] == 7 and expected[9] == 9 and expected[5] == 4 and expected[12] == 11 and expected[14] == 13
    kept = dart_minhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, c in expected.items() if i == c}


def test_near_copies_linked_by_a_base_only(spark, monkeypatch):
    rows = []
    for group in range(4):
        base = prose(200 + group, 1200, 50000).split()
        for i in range(41):
            words = list(base)
            for at in range(10, 10 + 24 * 11, 24) if i else ():
                words[at] = f"shared{at}"
            for at in random.Random(1000 * group + i).sample(range(300, 1190, 6), 14 if i else 0):
                words[at] = f"own{i}x{at}"
            rows.append((1000 * group + (i or 500), " ".join(words)))
    counted = [shingle_counts(t) for _, t in rows[:41]]
    assert min(weighted_jaccard(counted[0], c) for c in counted[1:]) > 0.8
    assert np.median([weighted_jaccard(a, b) for n, a in enumerate(counted[1:]) for b in counted[1:][:n]]) < 0.8
    expected = sorted(near_copies(rows).items(), key=repr)
    assert {c for _, c in expected} == {1, 1001, 2001, 3001}
    assert collected(dart_minhash.near_copies_digest(make_docs(spark, rows)), "doc_id", "class_id") == expected
    monkeypatch.setattr(dart_minhash, "BLOCK_MEMBERS", 8)
    assert collected(dart_minhash.near_copies_digest(make_docs(spark, rows)), "doc_id", "class_id") == expected


def test_every_pair_that_is_not_linked_meets_in_a_tile(spark, monkeypatch):
    monkeypatch.setattr(dart_minhash, "BLOCK_MEMBERS", 10)
    part = {v: 0 if v < 60 else 1 if v < 85 else v for v in range(110)}
    bands = {1: range(110), 2: range(60), 3: range(55, 90), 4: range(100, 110)}
    members = spark.createDataFrame([(b, v, len(vs)) for b, vs in bands.items() for v in vs], "band long, v long, n long")
    groups = spark.createDataFrame([(v, c) for v, c in part.items() if c != v], "v long, component long")
    classes = spark.createDataFrame([(v, bytes(2)) for v in part], "v long, few binary")
    tiles = {}
    for r in dart_minhash.cross_tiles(members, groups, classes).collect():
        assert r.component == part[r.v]
        tiles.setdefault((r.band, r.tile), []).append((r.v, r.block))
    met = {1: set(), 3: set()}
    for (band, _), texts in tiles.items():
        blocks = {b for _, b in texts}
        met[band] |= {(x, y) for x, a in texts for y, b in texts if x < y and (a != b or len(blocks) == 1)}
    for band, pairs in met.items():
        apart = {(x, y) for x in bands[band] for y in bands[band] if x < y and part[x] != part[y]}
        assert apart <= pairs


def test_linked_members_of_a_large_group_do_not_meet_again(spark, monkeypatch):
    base = prose(80, 400, 5000)
    for n in (600, 1200):
        monkeypatch.setattr(dart_minhash, "BLOCK_MEMBERS", 40)
        docs = make_docs(spark, [(i, f"{base} own{i}") for i in range(n)])
        rows = docs.select("doc_id", "text").mapInArrow(
            dart_minhash.sketch_texts, "doc_id long, v long, few binary, bands binary").select("v", "few", "bands").checkpoint()
        members = dart_minhash.band_members(rows).checkpoint()
        assert members.agg({"n": "max"}).first()[0] > n / 2
        shown = dart_minhash.candidates(members, rows)
        assert shown.filter("b IS NOT NULL").count() < 2 * members.count()
        linked = components.components(shown.filter("b IS NOT NULL").select("a", "b")).withColumnRenamed("id", "v")
        assert linked.select("component").distinct().count() == 1
        assert dart_minhash.cross_tiles(members, linked, rows).count() == 0
        if n == 600:
            assert {c for _, c in collected(dart_minhash.near_copies_digest(docs), "doc_id", "class_id")} == {0}


def test_near_copies_keep_one_of_repeated_rows(spark):
    text = prose(60, 50)
    rows = [(1, text), (1, text), (2, text), (None, "x y z"), (None, "x y z"), (None, None), (None, None), (3, None), (3, prose(61, 50))]
    kept = dart_minhash.drop_near_copies(make_docs(spark, rows))
    assert collected(kept, "doc_id", "text") == sorted(
        [(1, text), (None, "x y z"), (None, None), (None, None), (3, None), (3, prose(61, 50))], key=repr)
    assert dart_minhash.drop_near_copies(make_docs(spark, rows).limit(0)).count() == 0


def test_sketches_estimate_weighted_similarity():
    draw = np.random.default_rng(3)
    elements = dart_minhash.mix(draw.integers(0, 1 << 60, 300).astype(np.uint64))
    x, y = draw.uniform(0.1, 4, 300), draw.uniform(0.1, 4, 300)
    y[:200] = x[:200]
    agree = []
    for salt in range(8):
        salted = dart_minhash.mix(elements + np.uint64(salt))
        one = dart_minhash.sketch(np.zeros(300, np.int64), salted, x, 1)
        two = dart_minhash.sketch(np.zeros(300, np.int64), salted, y, 1)
        agree.append((one == two).mean())
    assert abs(np.mean(agree) - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.05


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    draw = random.Random(seed)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 140)]
    edges += [(500, 500 + i) for i in range(1, 30)] + [(7, 7)]
    expected = groups({x for e in edges for x in e}, edges)
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: expected[n] for e in edges if e[0] != e[1] for n in e}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_links(vectors):
    usable = [(i, np.array(v, float)) for i, v in vectors
              if v and None not in v and np.isfinite(v).all() and np.abs(v).max() > 0]
    units = [v / np.linalg.norm(v) for _, v in usable]
    close = np.array([[len(x) == len(y) and x @ y >= 0.9 for y in units] for x in units])
    np.fill_diagonal(close, False)
    ids = [i for i, _ in usable]
    reach = groups(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(close))])
    links = dict(zip(ids, close.sum(1).tolist()))
    return {i: (links.get(i, 0), reach.get(i, i)) for i, _ in vectors}


def clustered(n, spread, seed):
    """Vectors around few centres; the spread puts many pairs near the threshold."""
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(max(n // 12, 1), 16))
    return (centres[draw.integers(0, len(centres), n)] + draw.normal(size=(n, 16)) * spread).astype(np.float32)


@pytest.mark.parametrize("block", [vector_dedup.BLOCK, 3])
def test_vector_links(spark, monkeypatch, block):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    monkeypatch.setattr(vector_dedup, "COUNTED", 1)
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(300, 0.06, 1))]
    rows += [(1000 + i, rows[5][1]) for i in range(20)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] * 16), (2004, [None] + [1.0] * 15),
             (2005, [float("inf")] + [1.0] * 15), (2006, [1.0, 2.0]), (2007, [x * 1e30 for x in rows[5][1]])]
    rows += [(3000, [1.0, 0.0, 0.1]), (3001, [1.0, 0.0, 0.1]), (3002, [1.0, 0.05, 0.0]), (3003, [-1.0, 0.0, 0.0]), (3004, [2.5]), (3005, [7.0])]
    frame = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<float>, label int, v int")
    expected = plain_links([(i, None if v is None else [x if x is None else np.float32(x) for x in v]) for i, v in rows])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.vector_links(frame).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in expected.items()}
    assert vector_dedup.vector_links(frame.limit(0)).count() == 0
    assert vector_dedup.vector_links(frame.filter("vec_id >= 2000 AND vec_id < 2005")).filter("n_links <> 0 OR NOT kept").count() == 0


def test_vector_recall_at_the_threshold(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(1500, 0.28, 2))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    expected = plain_links([(i, np.float32(v).tolist()) for i, v in rows])
    got = {r.vec_id: r.n_links for r in vector_dedup.vector_links(frame).collect()}
    assert all(got[i] <= n for i, (n, _) in expected.items())
    assert sum(got.values()) >= 0.97 * sum(n for n, _ in expected.values()) > 500


def pairs_with_common_mean(mean_cosine, n, wide=64, seed=4):
    """Vectors of that mean cosine with each other, each followed by a partner at cosine 0.905."""
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, wide)) / np.sqrt(wide)
    x = x * np.sqrt(1 - mean_cosine) + np.sqrt(mean_cosine) * np.eye(wide)[0]
    x /= np.linalg.norm(x, axis=1)[:, None]
    off = draw.normal(size=(n, wide))
    off -= (off * x).sum(1)[:, None] * x
    y = 0.905 * x + np.sqrt(1 - 0.905 ** 2) * off / np.linalg.norm(off, axis=1)[:, None]
    return x, y


@pytest.mark.parametrize("mean_cosine", [0.0, 0.5])
@pytest.mark.parametrize("bits", [8, 18])
def test_vector_recall_with_a_common_mean(spark, monkeypatch, mean_cosine, bits):
    monkeypatch.setattr(vector_dedup, "substring_bits", lambda vectors: bits)
    pairs = pairs_with_common_mean(mean_cosine, 800)
    rows = [(i, v.tolist()) for i, v in enumerate(np.stack(pairs, 1).reshape(-1, 64).astype(np.float32))]
    units = np.array([v for _, v in rows])
    units /= np.linalg.norm(units, axis=1)[:, None]
    expected = (units @ units.T >= 0.9).sum(1) - 1
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in vector_dedup.vector_links(frame).collect()}
    assert all(got[i] <= n for i, n in enumerate(expected))
    assert sum(got.values()) >= 0.97 * expected.sum() >= 1500


def test_members_of_every_table_width_shuffle_less_than_two_kilobytes():
    """By the formulas that size the tables; the components of near vectors come on top."""
    for vectors in (1e4, 1e6, 1e8):
        width = vector_dedup.substring_bits(int(vectors))
        tables = vector_dedup.table_count(width)
        assert vector_dedup.member_type(width, tables).itemsize * tables < 2000
        assert vectors / 2 ** width < 3 * vector_dedup.OCCUPANCY


def test_short_codes_and_tiles():
    draw = np.random.default_rng(9)
    for total in (60, 128, 300):
        bits = draw.integers(0, 2, (50, total)).astype(np.uint8)
        codes = vector_dedup.short_codes(bits)
        away = np.bitwise_count(codes[:, None, :] ^ codes[None, :, :]).sum(2)
        assert (away == (bits[:, None, :128] != bits[None, :, :128]).sum(2)).all()
    entry, block = draw.integers(0, 4, 200), draw.integers(0, 3, 200)
    each, other = np.repeat(np.arange(200), 3), np.tile(np.arange(3), 200)
    low, high = np.minimum(block[each], other), np.maximum(block[each], other)
    met = [tuple(sorted((each[i], each[j]))) for _, left, right, same in vector_dedup.each_tile(
        entry[each], low, high, block[each]) for x, i in enumerate(left) for j in (right[x + 1:] if same else right)]
    assert sorted(met) == [(a, b) for a in range(200) for b in range(a + 1, 200) if entry[a] == entry[b]]


def test_vectors_of_the_table(spark):
    found = QUERIES["op7_near_vectors"](spark, SF_DIR).collect()
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select("vec_id", "embedding").collect()
    units = np.array([r.embedding for r in rows], float)
    units /= np.linalg.norm(units, axis=1)[:, None]
    links = dict(zip((r.vec_id for r in rows), ((units @ units.T >= 0.9).sum(1) - 1).tolist()))
    assert {r.vec_id: r.n_links for r in found} == links


def balanced_pair():
    """Two words that polynomials modulo 2**64 can't tell apart, whatever their base."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomials_confuse(spark):
    one, other = balanced_pair()
    start = prose(11, 34)
    docs = make_docs(spark, [(1, f"{start} {one}"), (2, f"{start} {other}")])
    assert collected(window_dedup.remove_repeats(docs), "doc_id", "n_removed") == [(1, 0), (2, 0)]
    docs = make_docs(spark, [(1, f"a b c d {one}"), (2, f"a b c d {other}"), (3, f"a b c d {one}")])
    assert collected(dart_minhash.near_copies_digest(docs), "doc_id", "class_id") == [(1, 1), (2, 2), (3, 1)]


def test_words_are_lower_cased_in_shingles_only():
    assert alnum_words("A-b É") == ["a", "b", "É"]


def test_windows_of_one_hash_are_told_apart_by_the_second():
    def flush(number, hashes, tails):
        keys, counts = np.array([[number, 0]], np.int64), np.array([len(hashes)])
        return list(window_dedup.flush_windows(
            number, np.array(hashes, np.uint64), np.array(tails, np.uint16), keys, counts, 1))

    batches = flush(1, [5, 5, 6, 5], [1, 2, 3, 3]) + flush(2, [5, 6, 5], [2, 4, 4])
    answers = window_dedup.repeated_in_bucket(pa.Table.from_batches(batches)).to_pylist()
    told = {r["flush"]: from_gaps(r["a"]).tolist() for r in answers if r["kind"] == ANSWER}
    assert told == {1: [1], 2: [0]}


def test_order_of_rows_in_a_shuffled_input_does_not_number_the_windows(spark):
    docs = make_docs(spark, corpus()).repartition(3, "doc_id")
    plan = window_dedup.remove_repeats_digest(docs)._jdf.queryExecution().toString()
    assert "Sort [k1" in plan
    assert collected(window_dedup.remove_repeats_digest(docs), *WINDOW_COLUMNS) == cut_windows(corpus())
    assert collected(window_dedup.remove_repeats_digest(docs, from_files=True), *WINDOW_COLUMNS) == cut_windows(corpus())
