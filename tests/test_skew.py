"""A third of all rows share one key: results must be whole and right all the same."""

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from gridledger.operators import aggregates as A
from gridledger.operators import joins as J
from gridledger.operators import ranking as L
from gridledger.operators import windows as W
from gridledger.plans.traffic import traffic_summary, visitor_profile
from gridledger.streaming.counters import counter_rate

N = 90_000


@pytest.fixture(scope="module")
def skewed(spark):
    """Every third row belongs to ``hot``, the others to a thousand keys."""
    i = F.col("id")
    return spark.range(0, N, 1, 8).select(
        F.when(i % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), i % 1000)).alias("k"),
        i.alias("n"), (i % 7).alias("kind"), F.timestamp_seconds(F.lit(1_704_067_200) + i).alias("ts"))


def test_latest_row(skewed):
    got = {r.k: r.n for r in W.latest_per_key(skewed, ["k"], "ts").collect()}
    # a key k<m> owns the numbers that are m modulo 1000 and no multiple of three
    assert len(got) == 1001 and got["hot"] == N - 3
    assert got["k1"] == max(i for i in range(1, N, 1000) if i % 3)


def test_modes(skewed):
    got = {r.k: r.m for r in A.mode_per_group(skewed, ["k"], "kind", "m").collect()}
    counts = {}
    for i in range(0, N, 3):
        counts[i % 7] = counts.get(i % 7, 0) + 1
    assert got["hot"] == min(counts, key=lambda v: (-counts[v], v)) and len(got) == 1001


def test_top_groups_and_semi_join(skewed):
    top = L.top_groups(skewed, ["k"], F.count("*"), "c", 2).collect()
    assert (top[0].k, top[0].c) == ("hot", N // 3)
    assert J.only_top_keys(skewed.withColumn("one", F.lit(1)), "k", "one", 1).count() == N // 3


def test_grouping_sets(skewed):
    got = A.grouping_sets(skewed, [["k", "kind"], ["k"], []], {"c": F.lit(1)})
    assert got.filter("level = 3").first().c == N
    assert got.filter("level = 1 AND k = 'hot'").first().c == N // 3
    assert got.filter("level = 0").agg(F.sum("c")).first()[0] == N


def test_quantile_of_a_heavy_value(skewed):
    heavy = skewed.select(F.when(F.col("k") == "hot", 0.0).otherwise(F.col("n").cast("double")).alias("v"))
    values = sorted(0.0 if i % 3 == 0 else float(i) for i in range(N))
    got = A.exact_quantile(heavy, "v", 0.5).first()
    middle = (values[N // 2 - 1] + values[N // 2]) / 2
    assert (got.n, got.value) == (N, middle)


def test_visitors(skewed):
    views = skewed.select(F.col("k").alias("ip"), F.col("ts").cast("timestamp_ntz").alias("time"),
                          F.lit("hub").alias("dashboard"),
                          F.when(F.col("kind") < 4, "Phone").otherwise("Desktop").alias("device"))
    hot = visitor_profile(views).filter("ip = 'hot'").first()
    assert (hot.hits, hot.device) == (N // 3, "Phone")
    summary = {(r.dimension, r.label): (r.hits, r.visitors) for r in traffic_summary(views).collect()}
    assert summary[("total", "all")] == (N, 1001) and summary[("dashboard", "hub")] == (N, 1001)


def test_counter_of_a_busy_series(skewed):
    samples = skewed.select(F.col("k").alias("series"), "ts", "n", F.col("n").cast("double").alias("value"))
    got = counter_rate(samples.filter("k = 'hot'"), "1 hour", "10 seconds", "n").orderBy("window_start").collect()
    assert sum(r.samples for r in got) == N // 3 and all(r.rate == pytest.approx(1.0) for r in got)
    assert got[0].window_start == dt.datetime(2024, 1, 1)


def test_branches_and_districts(spark, skewed):
    plz = skewed.select(F.col("k").alias("plz"), F.lit(1).cast("bigint").alias("units"), F.lit(0.5).alias("mw"))
    merged = J.merge_branches({"a": plz, "b": plz.filter("plz = 'hot'")}, "plz", ["units", "mw"])
    hot = merged.filter("plz = 'hot'").first()
    assert (hot.a_units, hot.b_units, hot.total_mw) == (N // 3, N // 3, N / 3)
    where = spark.createDataFrame([("hot", "A"), ("k1", "A")], "plz string, kreis string")
    meta = spark.createDataFrame([("A", 1000)], "kreis string, einwohner int")
    totals = plz.groupBy("plz").agg(F.sum("units").alias("units"), F.sum("mw").alias("mw"))
    assert rows(J.to_district(totals, where, meta).select("kreis", "units")) == [("A", N // 3 + 60)]
