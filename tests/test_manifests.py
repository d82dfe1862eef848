"""Published sets, the upsert sink and counts of late rows, with runs that die in between."""

import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from gridledger.sources import manifests as M
from gridledger.streaming import runner as R


def outputs(spark, n, broken=False):
    def fail():
        raise RuntimeError("no")

    return {"a": lambda: spark.range(n), "b": fail if broken else lambda: spark.range(n * 10), "c": lambda: None}


def test_a_set_is_published_as_a_whole(spark, folder):
    assert M.read(spark, folder) is None
    assert M.publish(spark, folder, outputs(spark, 2), required=["a", "b"]) == {"a": "written", "b": "written", "c": "skipped"}
    assert M.publish(spark, folder, outputs(spark, 3, broken=True), required=["a", "b"])["a"] == "withheld"
    assert (M.published(spark, folder, "a").count(), M.published(spark, folder, "b").count()) == (2, 20)
    with pytest.raises(FileNotFoundError):
        M.published(spark, folder, "c")
    assert M.publish(spark, folder, outputs(spark, 4, broken=True), required=["a"])["b"] == "failed"
    assert M.published(spark, folder, "a").count() == 4
    with pytest.raises(FileNotFoundError):
        M.published(spark, folder, "b")


def test_versions_expire_with_their_manifests(spark, folder):
    for n in range(1, 6):
        M.publish(spark, folder, {"a": lambda n=n: spark.range(n)}, keep=3)
    assert M.numbers(spark, folder) == [3, 4, 5]
    assert len(os.listdir(f"{folder}/data")) == 3
    os.makedirs(f"{folder}/data/000000000009-dead/a.parquet")
    assert M.expire(spark, folder, 3) == ["data/000000000009-dead/a.parquet"]
    assert M.published(spark, folder, "a").count() == 5
    with pytest.raises(FileExistsError):
        M.commit(spark, folder, 5, {})
    with pytest.raises(ValueError):
        M.expire(spark, folder, 0)


def batch_of(spark, pairs):
    return spark.createDataFrame(pairs, "k string, v int")


def data_files(folder):
    return sum(len([n for n in names if n.endswith(".parquet")]) for _, _, names in os.walk(folder))


def test_upserts_keep_one_row_per_key(spark, folder):
    want = {}
    for number in range(30):
        pairs = [(f"k{(number * 7 + i) % 11}", number) for i in range(3)] + [(None, number)]
        want.update(pairs)
        R.upsert_batch(batch_of(spark, pairs), number, folder, ["k"], buckets=4)
    schema = batch_of(spark, []).schema
    assert rows(R.read_upserted(spark, folder, schema)) == sorted(want.items(), key=repr)
    assert data_files(folder) <= 2 * 4
    R.upsert_batch(batch_of(spark, [("k1", -1)]), 29, folder, ["k"])
    assert rows(R.read_upserted(spark, folder, schema)) == sorted(want.items(), key=repr)


def test_a_batch_that_dies_before_its_manifest_changes_nothing(spark, folder, monkeypatch):
    schema = batch_of(spark, []).schema
    R.upsert_batch(batch_of(spark, [("a", 1), ("b", 1)]), 0, folder, ["k"], buckets=2)

    def die(*args):
        raise OSError("killed")

    with monkeypatch.context() as broken:
        broken.setattr(M, "commit", die)
        with pytest.raises(OSError, match="killed"):
            R.upsert_batch(batch_of(spark, [("a", 2)]), 1, folder, ["k"])
    assert rows(R.read_upserted(spark, folder, schema)) == [("a", 1), ("b", 1)]
    R.upsert_batch(batch_of(spark, [("a", 2)]), 1, folder, ["k"])
    assert rows(R.read_upserted(spark, folder, schema)) == [("a", 2), ("b", 1)]
    assert R.read_upserted(spark, f"{folder}/nothing", schema).count() == 0


def test_late_rows_of_many_batches_are_counted(spark, folder):
    listener = R.LateRows(f"{folder}/late")
    spark.streams.addListener(listener)
    try:
        def feed(names):
            for name in names:
                # one row in time that moves the watermark, one far behind it
                spark.createDataFrame([(f"2024-01-{1 + name // 24:02d} {name % 24:02d}:00:00", 1), ("2023-01-01 00:00:00", 1)], "t string, n int").select(
                    F.col("t").cast("timestamp").alias("t"), "n").coalesce(1).write.parquet(f"{folder}/in/{name:04d}")

        def run():
            stream = spark.readStream.schema("t timestamp, n int").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
            counts = stream.withWatermark("t", "1 minute").groupBy(F.window("t", "1 hour")).agg(F.count("*").alias("n"))
            R.append_available(counts.select(F.col("window.start").alias("at"), "n"), folder)

        feed(range(8))
        run()
        first = R.late_counts(spark, f"{folder}/late").agg(F.sum("late_rows")).first()[0]
        feed(range(8, 12))
        run()
        both = R.late_counts(spark, f"{folder}/late").agg(F.sum("late_rows")).first()[0]
    finally:
        spark.streams.removeListener(listener)
    assert first == 6 and both == 10  # rows are late by the watermark of the batch before, so not in the first two
