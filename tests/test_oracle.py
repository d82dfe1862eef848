"""Every query with SQL must give exactly the rows the SQL gives."""

import datetime as dt

import pytest
from conftest import SF_DIR

import __spark_entry__ as entry

QUERIES = entry.queries()
SQL = entry.oracle_sql()


def _plain(value):
    return value.isoformat() if isinstance(value, dt.datetime) else repr(value)


def _table(columns, fetched):
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    return order, sorted(tuple(_plain(r[i]) for i in at) for r in fetched)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    got = _table(df.columns, df.collect())
    cursor = duck.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert got == _table(columns, cursor.fetchall())


@pytest.mark.parametrize("zone", ["Asia/Tokyo", "America/New_York"])
@pytest.mark.parametrize("name", ["q54_traffic_summary", "q56_country_table", "q63_month_daily", "q52_price_now",
                                  "t01_traffic_windows", "t03_counter_rate", "p23_business_hour"])
def test_results_do_not_depend_on_the_session_zone(spark, duck, zone, name):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        test_query_matches_sql(spark, duck, name)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_every_query_has_sql_but_some_of_the_training_data():
    assert {q for q in set(QUERIES) - set(SQL) if not q.startswith("op")} <= {"pipeline"}


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_listing_is_capped(spark):
    assert tuple(QUERIES["l05_cap"](spark, SF_DIR).first()) == (1000, 1000)
