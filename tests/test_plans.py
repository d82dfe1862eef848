"""What the physical plans must and must not contain."""

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridledger.functions.predicates import year_between
from gridledger.operators import units as U
from gridledger.plans.register import Register

QUERIES = entry.queries()
STREAMS = {"t01_traffic_windows", "t02_traffic_rolling", "t03_counter_rate_stream", "t04_gauge_ratio",
           "t06_match_count", "t08_probe_summary", "t10_latest_stream", "t11_ingest_snapshots",
           "t12_dedup_stream"}

#: Spark has no matching-block ratio, so a vectorised function scores the few candidates of a citation.
MATCHING_BLOCKS = {"q65_citation_links", "q65_citation_bands"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS))
def test_no_cross_join_and_no_python(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    python = () if name in MATCHING_BLOCKS else ("ArrowEvalPython",)
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas", *python):
        assert word not in plan, word


def test_state_names_are_joined_after_the_aggregate(spark):
    plan = plan_of(QUERIES["q02_state"](spark, SF_DIR))
    join, final = plan.index("BroadcastHashJoin"), plan.index("HashAggregate")
    assert join < final  # operators are listed from the top: the join is above the aggregate
    assert plan.count("/lineitem.parquet") == 1 and plan.count("/supplier.parquet") == 2


def test_union_branches_of_other_carriers_are_pruned(spark):
    units = U.units_all(Register(spark, SF_DIR).unit_tables, names=False)
    plan = plan_of(units.filter("energietraeger = 'Wind'").groupBy("plz").agg(F.sum("bruttoleistung_kw")))
    assert plan.count("FileScan") == 1
    assert "EqualTo(l_returnflag,R)" in plan and "EqualTo(l_linestatus,O)" in plan


def test_scans_read_only_what_they_need(spark):
    plan = plan_of(QUERIES["q16_hydro_top_mw"](spark, SF_DIR))
    schema = plan[plan.index("ReadSchema"):]
    assert "l_orderkey" not in schema and "l_shipdate" not in schema


def test_year_filters_reach_parquet(spark, folder):
    df = spark.sql("SELECT date'2020-01-01' + cast(id AS int) AS d, id FROM range(900)")
    df.write.parquet(f"{folder}/t")
    plan = plan_of(spark.read.parquet(f"{folder}/t").filter(year_between(F.col("d"), 2021, 2021)))
    assert "GreaterThanOrEqual(d,2021-01-01)" in plan and "LessThan(d,2022-01-01)" in plan


def test_rankings_do_not_sort_everything(spark):
    for name in ("q11_largest_onshore", "l02_l03_top_k", "q21_top_operators", "l07_most_recent"):
        assert "TakeOrderedAndProject" in plan_of(QUERIES[name](spark, SF_DIR)), name


def test_aggregates_combine_before_the_shuffle(spark):
    for name in ("q01_overview_kpi", "q29_bucket_matrix_gross", "s07_dedup", "w09_latest_per_key",
                 "j05_a29_visitor_profile", "q36_registration_delay"):
        assert "partial_" in plan_of(QUERIES[name](spark, SF_DIR)), name


def test_log_pattern_is_matched_once_per_line(spark):
    plan = plan_of(QUERIES["s24_access_log"](spark, SF_DIR))
    assert plan.count("regexp_replace") == 1 and "RLIKE" not in plan
