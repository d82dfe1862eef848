"""Mixing, sharding and the pipeline."""

import collections
import math
import zlib

import pytest
from conftest import SF_DIR
from helpers import SPACED, alnum_words, collected, groups, make_docs, prose, shingle_counts, weighted_jaccard

import corpus_pipeline
from gridledger.llm import mixing, shards
from gridledger.llm.queries import QUERIES


def plain_targets(sizes):
    """Share by weight; what a full source can't hold is shared again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while left > 1e-9 and open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if target[s] + share * weight[s] >= 3 * sizes[s]}
        if not full:
            for s in open_:
                target[s] += share * weight[s]
            break
        for s in full:
            left -= 3 * sizes[s] - target[s]
            target[s] = 3.0 * sizes[s]
        open_ -= full
    return target


def test_mix_is_near_its_targets(spark):
    sf_dir = SF_DIR.replace("sf0.001", "sf0.1")
    rows = QUERIES["op10_mix"](spark, sf_dir).collect()
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source").collect()}
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in rows:
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        assert r.taken <= 3 * r.size
    for s, wanted in plain_targets(sizes).items():
        assert target[s] == pytest.approx(wanted)
        assert taken[s] == pytest.approx(wanted, rel=0.15)
    assert sum(taken.values()) == pytest.approx(sum(sizes.values()), rel=0.03)
    again = QUERIES["op10_mix"](spark, sf_dir).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 1, "c": 1}, {"a": 1, "b": 1, "c": 500, "d": 2, None: 7}, {"a": 0, "b": 5, "c": 0}, {"a": 4}, {"a": 0},
    {"B": 10, "a": 10, "é": 10, "z": 10, None: 10}, {"a": 3, "b": 6, "c": 9, "d": 300, "e": 1, "f": 1}])
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(frame).collect()}
    assert got == pytest.approx(plain_targets(sizes))
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_mix_of_awkward_rows(spark):
    rows = [(1, None, "a"), (2, "", None), (3, "one two", "b"), (3, "one two", "b"), (None, "three", None), (4, prose(1, 9000), "a"),
            (5, "x y z", "b")]
    docs = make_docs(spark, rows)
    found = mixing.mix_digest(docs).collect()
    assert collections.Counter((r.doc_id, r.size) for r in found) == collections.Counter(
        (i, len(SPACED.findall(t or ""))) for i, t, _ in rows)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    copies = collections.Counter(r.doc_id for r in mixed.collect())
    assert copies[4] == next(r.taken for r in found if r.doc_id == 4) // 9000
    assert copies[3] % 2 == 0
    assert mixing.mix_digest(docs.limit(0)).count() == 0


def test_mix_plan_is_native(spark):
    plan = QUERIES["op10_mix"](spark, SF_DIR)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_shards_of_the_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    rows = QUERIES["op4_shards"](spark, SF_DIR).collect()
    text = {r.doc_id: r.text.encode() for r in docs}
    assert len(rows) == len(text)
    for r in rows:
        assert (r.size, r.text_crc32, r.law) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id]), "key")
        assert r.grown_shard in (r.shard, 16)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_are_even_and_stable(spark):
    ids = spark.range(40_000).selectExpr("id AS doc_id", "CAST(NULL AS STRING) AS text")
    rows = shards.shard_digest(ids).collect()
    per = collections.Counter(r.shard for r in rows)
    assert set(per) == set(range(16)) and max(per.values()) < shards.expected_largest(40_000, 16) * 1.05
    moved = sum(r.shard != r.grown_shard for r in rows)
    assert 0.8 < moved / (40_000 / 17) < 1.2
    wider = {r.doc_id: r.shard for r in shards.shard_digest(ids, 17).collect()}
    assert all(wider[r.doc_id] == r.grown_shard for r in rows)


def test_shards_follow_weights(spark):
    ids = spark.range(30_000).selectExpr("id AS doc_id")
    count = {w: collections.Counter(r["shard"] for r in shards.with_shard(ids, list(w)).collect())
             for w in ((1.0, 2.0, 3.0), (1.0, 2.0, 6.0), (1.0, 0.0, 1.0))}
    assert [round(count[1.0, 2.0, 3.0][s] / 5000, 1) for s in range(3)] == [1.0, 2.0, 3.0]
    assert count[1.0, 0.0, 1.0][1] == 0
    before, after = ({r.doc_id: r.shard for r in shards.with_shard(ids, w).collect()} for w in ([1.0, 2.0, 3.0], [1.0, 2.0, 6.0]))
    assert all(after[i] in (s, 2) for i, s in before.items())


def test_shards_of_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(shards, "RUN", 7)
    rows = [(1, None), (1, ""), (None, "x"), (None, "x"), (2, "é" * 30_000)] + [(3, "same")] * 50 + [(3, "other")]
    found = shards.shard_digest(make_docs(spark, rows)).collect()
    assert collections.Counter((r.doc_id, r.size) for r in found) == collections.Counter(
        (i, len((t or "").encode()) + 1) for i, t in rows)
    slots = collections.defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in found if r.doc_id == 3}) == 1
    docs = make_docs(spark, rows)
    assert shards.with_shard(docs).columns == [*docs.columns, "shard"]
    assert shards.shard_digest(docs.limit(0)).count() == 0


def test_pipeline_stages_against_plain_steps(spark):
    """Each stage on its own input: what it must drop, keep and repeat."""
    sf_dir = SF_DIR.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "minhash_near_dedup", "decontamination", "mixing", "sharding"]

    def step(name):
        nonlocal docs
        before = docs.collect()
        docs = stages[name](spark, docs, sf_dir).checkpoint()
        seen[name] = len(before), docs.count()
        return before, docs.collect()

    before, after = step("toxicity")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    wrong = sum((r.doc_id in kept) == (labels[r.doc_id] == 1) for r in before if r.doc_id in labels)
    assert docs.columns == columns and wrong <= 0.02 * len(labels)

    before, after = step("minhash_near_dedup")
    shingled = [(r.doc_id, shingle_counts(r.text)) for r in before]
    shared = collections.defaultdict(list)
    for i, s in shingled:
        for x in s or ():
            shared[x].append(i)
    by = dict(shingled)
    pairs = {(a, b) for ids in shared.values() for n, b in enumerate(ids) for a in ids[:n]}
    classes = groups([i for i, _ in shingled], [p for p in pairs if weighted_jaccard(by[p[0]], by[p[1]]) >= 0.8])
    assert docs.columns == columns and {r.doc_id for r in after} == {i for i, c in classes.items() if i == c}

    before, after = step("decontamination")
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        words = alnum_words(r.text)
        windows |= {tuple(words[i:i + 10]) for i in range(len(words) - 9)}
    clean = {r.doc_id for r in before if not windows & {tuple(w[i:i + 10]) for w in [alnum_words(r.text)] for i in range(len(w) - 9)}}
    assert docs.columns == columns and {r.doc_id for r in after} == clean

    before, after = step("mixing")
    copies = collections.Counter(r.doc_id for r in after)
    assert docs.columns == columns and max(copies.values()) <= 3 and set(copies) <= {r.doc_id for r in before}
    assert math.isclose(sum(len(SPACED.findall(r.text)) for r in after), sum(len(SPACED.findall(r.text)) for r in before), rel_tol=0.1)

    before, after = step("sharding")
    assert len(after) == len(before) and {r.shard for r in after} == set(range(16))
    assert len({(r.doc_id, r.shard) for r in after}) == len({r.doc_id for r in after})


def test_pipeline_of_awkward_and_empty_tables(spark, folder):
    rows = [(1, None), (2, ""), (3, prose(1, 2000)), (3, prose(1, 2000)), (None, "x"), (4, "only one"), (4, "only one")]
    for name, data in (("some", rows), ("none", [])):
        sf_dir = f"{folder}/{name}"
        make_docs(spark, data or [(0, "")]).limit(len(data)).write.parquet(f"{sf_dir}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
        spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
        found = corpus_pipeline.run(spark, sf_dir)
        assert found.columns[-1] == "shard"
        ids = collections.Counter(r.doc_id for r in found.collect())
        assert set(ids) <= {i for i, _ in data}
