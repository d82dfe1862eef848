"""Damaged files, log tails and failing sources on real folders."""

import gzip
import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import rows
from pyspark.sql import functions as F

from gridledger.operators import sets as S
from gridledger.sources import footers
from gridledger.sources import log_tail as G
from gridledger.sources import tables as B
from gridledger.streaming import windows as W


def files_of(path):
    return sorted(f"{path}/{n}" for n in os.listdir(path) if n.endswith(".parquet"))


def cut_in_half(path):
    with open(path, "rb") as f:
        data = f.read()
    with open(path, "wb") as f:
        f.write(data[:len(data) // 2])


def test_one_damaged_file_among_good_ones(spark, folder):
    spark.range(90).repartition(3).write.parquet(f"{folder}/wind.parquet")
    spark.range(50).repartition(2).write.parquet(f"{folder}/solar.parquet")
    bad = files_of(f"{folder}/wind.parquet")[1]
    lost = pq.ParquetFile(bad).metadata.num_rows
    cut_in_half(bad)
    tables, files = B.load_checked(spark, folder)
    assert set(tables) == {"solar"} and tables["solar"].count() == 50
    assert [os.path.basename(r.path) for r in files.filter("error IS NOT NULL").collect()] == [os.path.basename(bad)]
    assert rows(footers.footer_summary(files)) == [("solar", 2, 0, 50), ("wind", 3, 1, 90 - lost)]
    kept = B.load_entities(spark, folder, damaged="file")
    assert kept["wind"].count() == 90 - lost and set(kept) == {"wind", "solar"}
    assert {r.table_name for r in B.footer_checked_summary(files, ["solar", "wind"]).collect()} == {"solar", "wind"}
    with pytest.raises(RuntimeError, match="kwk"):
        B.footer_checked_summary(files, ["kwk"])
    with pytest.raises(ValueError, match="damaged"):
        B.load_checked(spark, folder, damaged="row")


def test_bytes_lost_from_the_middle_are_noticed(folder):
    path = f"{folder}/t.parquet"
    pq.write_table(pa.table({"x": list(range(100_000))}), path, compression=None)
    with open(path, "rb") as f:
        data = f.read()
    with open(path, "wb") as f:
        f.write(data[:4] + data[-(len(data) // 4):])
    assert "lies outside the file" in footers.inspect(path, os.path.getsize(path))[3]


def test_a_file_with_another_type_is_damaged(spark, folder):
    spark.range(10).coalesce(1).write.parquet(f"{folder}/wind.parquet")
    spark.range(3).select(F.col("id").cast("string")).coalesce(1).write.mode("append").parquet(f"{folder}/wind.parquet")
    tables, files = B.load_checked(spark, folder)
    assert tables == {} and [r.error for r in files.filter("rows = 3").collect()] == ["column id is string, elsewhere int64"]
    assert B.load_entities(spark, folder, damaged="file")["wind"].count() == 10


def test_partitioned_table_without_its_damaged_file(spark, folder):
    path = f"{folder}/wind.parquet"
    spark.range(20).select("id", (F.col("id") % 2).cast("string").alias("Bundesland")).coalesce(1).write.partitionBy("Bundesland").parquet(path)
    cut_in_half(files_of(f"{path}/Bundesland=1")[0])
    kept = B.load_entities(spark, folder, damaged="file")["wind"]
    assert kept.count() == 10 and {r.Bundesland for r in kept.collect()} == {"0"}


def test_no_tables_at_all(spark, folder):
    assert B.load_checked(spark, folder) == ({}, None)


def ordered(frame):
    return [r.value for r in frame.orderBy("stretch", "line").collect()]


@pytest.mark.parametrize("ending", ["\n", ""])
def test_tail_equals_the_last_lines(spark, folder, monkeypatch, ending):
    monkeypatch.setattr(G, "BLOCK", 64)
    monkeypatch.setattr(G, "PIECE", 200)
    draw, everything = random.Random(4), []
    for k, suffix in enumerate(["log", "log.gz", "log", "log"]):
        lines = [f"{k} {i} " + "x" * draw.randrange(150) + draw.choice(["", "ü", "\r"]) for i in range([40, 30, 0, 25][k])]
        text = "".join(f"{line}\n" for line in lines)
        data = (text[:-1] + ending if text else "").encode()
        with open(f"{folder}/{k}.{suffix}", "wb") as f:
            f.write(gzip.compress(data) if suffix.endswith("gz") else data)
        everything += [line.rstrip("\r") for line in lines]
    for n in (1, 2, 24, 25, 26, 54, 56, 94, 95, 500):
        stretches = G.plan_tail(folder, n)
        got = [line.rstrip(b"\r\n").decode() for s in stretches for line in G.stretch_lines(s)]
        assert got == everything[-n:], n


def test_tail_source_on_spark(spark, folder):
    lines = [f"line {i}" for i in range(50_000)]
    with open(f"{folder}/a.log", "w") as f:
        f.write("\n".join(lines))
    with open(f"{folder}/_hidden", "w") as f:
        f.write("no\n")
    assert ordered(G.tail_lines(spark, folder, 12_345)) == lines[-12_345:]
    assert ordered(G.tail_lines(spark, f"{folder}/a.log", 3)) == lines[-3:]
    with open(f"{folder}/a.log", "w"):
        pass
    assert ordered(G.tail_lines(spark, folder, 3)) == []


def test_tail_reads_no_more_than_it_needs(folder):
    path = f"{folder}/big.log"
    with open(path, "w") as f:
        f.writelines(f"{i:060d}\n" for i in range(200_000))
    asked = []

    class Counted:
        def __init__(self, raw):
            self.raw = raw

        def seek(self, at):
            self.raw.seek(at)

        def read(self, n):
            asked.append(n)
            return self.raw.read(n)

    with open(path, "rb") as raw:
        assert G.line_starts(Counted(raw), os.path.getsize(path), 1000)[:2] == (1000, 199_000 * 61)
    assert sum(asked) <= G.BLOCK + 1 < os.path.getsize(path) / 10


def test_failing_sources_cost_only_themselves(spark, folder):
    good = spark.range(5).withColumn("s", F.lit("x"))
    landed, report = S.land_sources(spark, {
        "a": lambda: good, "b": lambda: good.select(F.raise_error(F.lit("gone")).alias("id")), "c": lambda: None,
        "d": lambda: 1 / 0}, folder)
    assert rows(report.select("source", "status", "rows")) == [
        ("a", "landed", 5), ("b", "failed", None), ("c", "empty", 0), ("d", "failed", None)]
    assert set(landed) == {"a"} and landed["a"].count() == 5
    assert "gone" in report.filter("source = 'b'").first().error


def test_day_window_moves_by_the_hour(spark):
    views = spark.createDataFrame([("2024-01-01 10:30:00",), ("2024-01-01 10:40:00",), ("2024-01-02 09:59:59",)], "t string").select(
        F.col("t").cast("timestamp_ntz").alias("time"))
    got = {str(r.window_end): r.hits for r in W.traffic_rolling(views, 1, slide="1 hour").collect()}
    assert got["2024-01-02 10:00:00"] == 3 and got["2024-01-02 11:00:00"] == 1 and got["2024-01-01 11:00:00"] == 2
    assert len(got) == 47
