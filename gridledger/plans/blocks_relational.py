"""Joins, aggregations, windows, rankings and set operations, each run over whole tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridledger.catalog import DELAY_BINS
from gridledger.operators import aggregates as A
from gridledger.operators import joins as J
from gridledger.operators import ranking as L
from gridledger.operators import sets as S
from gridledger.operators import units as U
from gridledger.operators import windows as W
from gridledger.plans.register import Register
from gridledger.plans.registry import query
from gridledger.plans.series import zones
from gridledger.plans.shaping import (
    CHECKED_DELAYS,
    SQL_RENEWABLE,
    sql_class6,
    sql_ladder,
    sql_ladder_ord,
    units_and_mw,
)
from gridledger.plans.traffic import views, visitor_profile

# ------------------------------------------------------------------------------- union view, joins


@query("u01_units_all", """
    SELECT source_table, energietraeger, count(*) AS n, count(mastr_nr) AS ids,
           sum(bruttoleistung_kw) AS kw, sum(nettonennleistung_kw) AS net_kw, count(plz) AS plz,
           count(bundesland_name) AS named, count(gemeinde) AS gemeinde, sum(lat) AS lat, sum(lon) AS lon,
           min(inbetriebnahme_datum) AS first_day, count(betriebsstatus) AS status
    FROM units_all GROUP BY 1, 2""")
def unified_view(r: Register) -> DataFrame:
    """The union of eight separately read tables."""
    return U.units_all(r.unit_tables).groupBy("source_table", "energietraeger").agg(
        F.count("*").alias("n"), F.count("mastr_nr").alias("ids"),
        F.sum("bruttoleistung_kw").alias("kw"), F.sum("nettonennleistung_kw").alias("net_kw"),
        F.count("plz").alias("plz"), F.count("bundesland_name").alias("named"),
        F.count("gemeinde").alias("gemeinde"), F.sum("lat").alias("lat"), F.sum("lon").alias("lon"),
        F.min("inbetriebnahme_datum").alias("first_day"), F.count("betriebsstatus").alias("status"))


@query("j01_with_state", """
    SELECT NetzanschlusspunktMastrNummer AS mastr_nr, Bundesland, s.name AS bundesland_name
    FROM netzanschlusspunkte LEFT JOIN state_names s ON s.code = Bundesland""")
def named_grid_points(r: Register) -> DataFrame:
    points = r.table("netzanschlusspunkte").select(
        F.col("NetzanschlusspunktMastrNummer").alias("mastr_nr"), "Bundesland")
    return U.with_state(points, "Bundesland")


@query("j02_to_district", """
    SELECT d.kreis, count(*) AS units, round(sum(Bruttoleistung) / 1000, 6) AS mw,
           any_value(einwohner) AS einwohner, any_value(m.lat) AS lat, any_value(m.lon) AS lon,
           CASE WHEN any_value(einwohner) > 0
                THEN round(count(*) / any_value(einwohner) * 1000, 6) END AS per_1000
    FROM wind JOIN plz_district d ON d.plz = CASE WHEN length(Postleitzahl) < 5 THEN lpad(Postleitzahl, 5, '0') ELSE Postleitzahl END
    LEFT JOIN district_meta m ON m.kreis = d.kreis GROUP BY 1""")
def wind_districts(r: Register) -> DataFrame:
    out = J.to_district(J.by_plz(r.wind), r.plz_district, r.district_meta)
    return out.withColumns({"mw": F.round("mw", 6), "per_1000": F.round("per_1000", 6)})


@query("j03_merge_branches", """
    SELECT k AS c_custkey, coalesce(sum(n) FILTER (WHERE b = 'open'), 0)::BIGINT AS open_n,
           coalesce(sum(n) FILTER (WHERE b = 'done'), 0)::BIGINT AS done_n,
           coalesce(sum(n), 0)::BIGINT AS total_n
    FROM (SELECT c_custkey AS k, NULL AS b, 0 AS n FROM customer
          UNION ALL SELECT o_custkey, 'open', count(*) FROM orders WHERE o_orderstatus = 'O' GROUP BY 1
          UNION ALL SELECT o_custkey, 'done', count(*) FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
    GROUP BY 1""")
def merged_branches(r: Register) -> DataFrame:
    orders = r.source("orders").select(
        F.col("o_custkey").alias("c_custkey"), F.lit(1).cast("bigint").alias("n"), "o_orderstatus")
    branches = {"open": orders.filter("o_orderstatus = 'O'"), "done": orders.filter("o_orderstatus = 'F'")}
    return J.merge_branches(branches, "c_custkey", ["n"], base=r.source("customer"))


@query("j04_per_capita", """
    SELECT bundesland_name, mw, units, einwohner_mio, mw / einwohner_mio AS watt_per_capita
    FROM (SELECT bundesland_name, sum(bruttoleistung_kw) / 1000 AS mw, count(*) AS units FROM units_all
          WHERE bundesland_name IS NOT NULL GROUP BY 1) LEFT JOIN state_population USING (bundesland_name)""")
def whole_register_per_capita(r: Register) -> DataFrame:
    return J.per_capita(U.by_state(r.units, [], *units_and_mw()), r.state_population)


@query("j05_a29_visitor_profile", """
    SELECT ip, hits, device FROM (
        SELECT ip, device, sum(n) OVER (PARTITION BY ip)::BIGINT AS hits,
               row_number() OVER (PARTITION BY ip ORDER BY n DESC, device) AS i
        FROM (SELECT ip, device, count(*) AS n FROM page_views GROUP BY 1, 2)) WHERE i = 1""")
def profile_all_time(r: Register) -> DataFrame:
    return visitor_profile(views(r, days=100_000)).drop("last_seen")


@query("j06_with_zone", """
    SELECT event_type AS bzn, country, count(*) AS n
    FROM events LEFT JOIN (VALUES ('view', 'Deutschland'), ('click', 'France'), ('signup', 'Polska'),
                                  ('purchase', 'España')) z(k, country) ON k = event_type GROUP BY 1, 2""")
def events_with_zone(r: Register) -> DataFrame:
    counts = r.source("events").groupBy(F.col("event_type").alias("bzn")).agg(F.count("*").alias("n"))
    return J.with_dimension(counts, zones(r).select("bzn", "country"), "bzn")


@query("j08_only_top_keys", """
    SELECT l_suppkey, count(*) AS n FROM lineitem
    WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem GROUP BY 1 ORDER BY sum(l_quantity) DESC, l_suppkey LIMIT 7)
    GROUP BY 1""")
def top_suppliers_only(r: Register) -> DataFrame:
    kept = J.only_top_keys(r.source("lineitem").select("l_suppkey", "l_quantity"), "l_suppkey", "l_quantity", 7)
    return kept.groupBy("l_suppkey").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------------------- aggregations


@query("a03_buildout_monthly", """
    SELECT cast(date_trunc('month', inbetriebnahme_datum) AS date) AS month, energietraeger,
           count(*) AS new_units, sum(bruttoleistung_kw) / 1000 AS new_capacity_mw
    FROM units_all WHERE inbetriebnahme_datum IS NOT NULL GROUP BY 1, 2""")
def buildout_monthly(r: Register) -> DataFrame:
    return U.buildout_monthly(r.units)


@query("a04_capacity_by_plz", """
    SELECT plz, energietraeger, count(*) AS units, sum(bruttoleistung_kw) / 1000 AS bruttoleistung_mw,
           avg(lat) AS lat, avg(lon) AS lon
    FROM units_all WHERE plz IS NOT NULL AND lat IS NOT NULL GROUP BY 1, 2""")
def capacity_by_plz(r: Register) -> DataFrame:
    return U.capacity_by_plz(r.units)


@query("a05_size_classes_by_state", f"""
    SELECT bundesland_name, {sql_class6('bruttoleistung_kw')} AS size_class, count(*) AS units,
           sum(bruttoleistung_kw) / 1000 AS capacity_mw
    FROM units_all WHERE energietraeger = 'SolareStrahlungsenergie' GROUP BY 1, 2""")
def size_classes(r: Register) -> DataFrame:
    return U.solar_size_classes(r.units_of("solar"))


@query("a06_wind_specs", """
    SELECT Nabenhoehe AS nabenhoehe_m, Rotordurchmesser AS rotor_m, Bruttoleistung / 1000 AS mw,
           Bundesland AS bundesland_code FROM wind WHERE Nabenhoehe IS NOT NULL""")
def wind_specs(r: Register) -> DataFrame:
    return U.wind_specs(r.wind)


@query("a07_ee_quote_by_year", f"""
    SELECT cast(year(inbetriebnahme_datum) AS integer) AS year, sum(bruttoleistung_kw) / 1e6 AS total_gw,
           sum(bruttoleistung_kw) FILTER (WHERE energietraeger IN {SQL_RENEWABLE}) / 1e6 AS ee_gw
    FROM units_all WHERE year(inbetriebnahme_datum) BETWEEN 1990 AND 2100 GROUP BY 1""")
def ee_quote(r: Register) -> DataFrame:
    return U.ee_quote_by_year(r.units)


@query("a08_rollup_from_agg", """
    SELECT l_returnflag, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY 1""")
def rolled_up(r: Register) -> DataFrame:
    fine = r.source("lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    return A.rollup_from_agg(fine, ["l_returnflag"], ["q", "n"])


@query("a09_ratio", """
    SELECT o_orderpriority, round(count(*) FILTER (WHERE o_orderstatus = 'O') / count(*) * 100, 6) AS open_pct
    FROM orders GROUP BY 1""")
def open_share(r: Register) -> DataFrame:
    counts = r.source("orders").groupBy("o_orderpriority").agg(
        F.count_if(F.col("o_orderstatus") == "O").alias("a"), F.count("*").alias("b"))
    return counts.select("o_orderpriority",
                         F.round(A.ratio(F.col("a"), F.col("b"), 100), 6).alias("open_pct"))


@query("a12_n_distinct", """
    SELECT count(DISTINCT NameWindpark) AS parks,
           count(DISTINCT NameWindpark) + max(CASE WHEN NameWindpark IS NULL THEN 1 ELSE 0 END) AS parks_or_none
    FROM wind""")
def park_counts(r: Register) -> DataFrame:
    park = F.col("NameWindpark")
    return r.wind.agg(A.n_distinct(park).alias("parks"),
                      A.n_distinct(park, count_null=True).alias("parks_or_none"))


@query("a13_a30_means", """
    SELECT avg(s_acctbal) FILTER (WHERE s_acctbal > 0) > 0 AS positive,
           round(avg(s_acctbal) FILTER (WHERE s_acctbal > 0), 4) AS mean_positive,
           round(avg(s_acctbal / s_suppkey) FILTER (WHERE s_acctbal > 0 AND s_suppkey > 0), 4) AS mean_ratio
    FROM supplier""")
def positive_means(r: Register) -> DataFrame:
    balance, key = F.col("s_acctbal"), F.col("s_suppkey")
    mean = A.mean_positive(balance)
    return r.source("supplier").agg(
        (mean > 0).alias("positive"), F.round(mean, 4).alias("mean_positive"),
        F.round(A.mean_ratio(balance, key), 4).alias("mean_ratio"))


@query("a14_dominant", """
    SELECT event_type, n * 100.0e0 / total AS share_pct
    FROM (SELECT event_type, count(*) AS n, sum(count(*)) OVER () AS total FROM events GROUP BY 1)
    ORDER BY n DESC, event_type LIMIT 1""")
def dominant_event(r: Register) -> DataFrame:
    return A.dominant(r.source("events"), "event_type")


@query("a15_freq", "SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2")
def document_frequency(r: Register) -> DataFrame:
    return A.freq(r.source("documents"), "lang", "source")


@query("a16_grouping_sets", """
    SELECT l_returnflag, l_linestatus, cast(grouping(l_returnflag, l_linestatus) AS integer) AS level,
           count(*) AS n, sum(l_quantity) AS q
    FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""")
def line_grouping(r: Register) -> DataFrame:
    return A.grouping_sets(r.source("lineitem"), [["l_returnflag", "l_linestatus"], ["l_returnflag"], []],
                           {"n": F.lit(1), "q": F.col("l_quantity")})


@query("a17_with_grand_total", """
    SELECT l_linenumber, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2
    UNION ALL SELECT l_linenumber, 'Grand Total', count(*) FROM lineitem GROUP BY 1""")
def grand_totals(r: Register) -> DataFrame:
    return A.with_grand_total(r.source("lineitem"), ["l_linenumber"], "l_returnflag",
                              {"n": F.lit(1)})


@query("a19_pivot_sum", """
    SELECT cast(year(o_orderdate) AS integer) AS year,
           coalesce(sum(n) FILTER (WHERE q = 1), 0)::BIGINT AS Q1,
           coalesce(sum(n) FILTER (WHERE q = 2), 0)::BIGINT AS Q2,
           coalesce(sum(n) FILTER (WHERE q = 3), 0)::BIGINT AS Q3,
           coalesce(sum(n) FILTER (WHERE q = 4), 0)::BIGINT AS Q4
    FROM (SELECT *, quarter(o_orderdate) AS q, 1 AS n FROM orders) GROUP BY 1""")
def order_quarters(r: Register) -> DataFrame:
    day = F.col("o_orderdate")
    counts = r.source("orders").groupBy(F.year(day).alias("year"), F.quarter(day).alias("q")).agg(
        F.count("*").alias("n"))
    return A.pivot_sum(counts, ["year"], "q", [1, 2, 3, 4], "n", ["Q1", "Q2", "Q3", "Q4"])


@query("a22_unpivot", """
    SELECT l_linenumber, measure, amount FROM (
        SELECT l_linenumber, sum(l_quantity) AS "Menge", sum(l_linenumber * 1e0) AS "Zeilen"
        FROM lineitem GROUP BY 1)
    UNPIVOT (amount FOR measure IN ("Menge", "Zeilen"))""")
def long_measures(r: Register) -> DataFrame:
    wide = r.source("lineitem").groupBy("l_linenumber").agg(
        F.sum("l_quantity").alias("q"), F.sum(F.col("l_linenumber").cast("double")).alias("z"))
    return A.unpivot_measures(wide, ["l_linenumber"], {"q": "Menge", "z": "Zeilen"}, "measure", "amount")


@query("a23_crosstab", """
    SELECT turn, count(*) FILTER (WHERE role = 'user') AS user,
           count(*) FILTER (WHERE role = 'assistant') AS assistant,
           count(*) FILTER (WHERE role = 'system') AS system,
           count(*) FILTER (WHERE role IS NULL OR role NOT IN ('user', 'assistant', 'system')) AS other
    FROM conversations GROUP BY 1""")
def turns_by_role(r: Register) -> DataFrame:
    return A.crosstab(r.source("conversations"), "turn", "role", ["user", "assistant", "system"])


@query("a24_day_quantiles", """
    SELECT l_returnflag, count(*) AS n, quantile_cont(d, 0.5) AS median, quantile_cont(d, 0.25) AS p25,
           quantile_cont(d, 0.75) AS p75
    FROM (SELECT l_returnflag, date_diff('day', cast(o_orderdate AS date), cast(l_shipdate AS date)) AS d
          FROM lineitem JOIN orders ON o_orderkey = l_orderkey) GROUP BY 1""")
def shipping_delay(r: Register) -> DataFrame:
    lines = r.source("lineitem").select("l_orderkey", "l_returnflag", "l_shipdate")
    orders = r.source("orders").select("o_orderkey", "o_orderdate")
    days = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_returnflag", F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")).alias("days"))
    return A.day_quantiles(days, "l_returnflag", "days")


@query("a24_price_quartiles", """
    SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_extendedprice, 0.25), 6) AS p25,
           round(quantile_cont(l_extendedprice, 0.5), 6) AS median,
           round(quantile_cont(l_extendedprice, 0.75), 6) AS p75
    FROM lineitem GROUP BY 1""")
def price_quartiles(r: Register) -> DataFrame:
    """Three large groups with continuous values."""
    marks = {"p25": 0.25, "median": 0.5, "p75": 0.75}
    exact = A.group_quantiles(r.source("lineitem"), "l_returnflag", "l_extendedprice", marks)
    return exact.select("l_returnflag", "n", *[F.round(mark, 6).alias(mark) for mark in marks])


@query("a25_median", "SELECT count(*) AS n, round(median(l_extendedprice), 6) AS value FROM lineitem")
def median_price(r: Register) -> DataFrame:
    exact = A.exact_quantile(r.source("lineitem"), "l_extendedprice", 0.5)
    return exact.withColumn("value", F.round("value", 6))


@query("a26_histogram", """
    SELECT CASE WHEN value >= 220 THEN 220 ELSE floor(value / 20) * 20 END AS bin_lo, event_type, count(*) AS n
    FROM events WHERE value IS NOT NULL GROUP BY 1, 2""")
def value_histogram(r: Register) -> DataFrame:
    return A.histogram(r.source("events"), "value", 20, 200, F.col("event_type"))


@query("a27_edge_histogram", f"""
    SELECT {sql_ladder('d', CHECKED_DELAYS, '<=')} AS bin, {sql_ladder_ord('d', CHECKED_DELAYS, '<=')} AS bin_ord,
           l_linestatus, count(*) AS n
    FROM (SELECT date_diff('day', DATE '1998-06-01', cast(l_shipdate AS date)) AS d, l_linestatus FROM lineitem)
    GROUP BY 1, 2, 3""")
def date_bins(r: Register) -> DataFrame:
    days = r.source("lineitem").select(
        F.datediff(F.to_date("l_shipdate"), F.lit(dt.date(1998, 6, 1))).alias("d"), "l_linestatus")
    return A.edge_histogram(days, "d", DELAY_BINS, "l_linestatus")


@query("a28_log_histogram", """
    SELECT cast(floor(log10(l_extendedprice) * 5) AS integer) AS log_bin, count(*) AS n
    FROM lineitem WHERE l_extendedprice > 0 GROUP BY 1""")
def price_decades(r: Register) -> DataFrame:
    return A.log_histogram(r.source("lineitem"), "l_extendedprice", 5)


@query("a29_mode_per_group", """
    SELECT user_id, event_type FROM (
        SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS i
        FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)) WHERE i = 1""")
def modal_event(r: Register) -> DataFrame:
    return A.mode_per_group(r.source("events"), ["user_id"], "event_type", "event_type")


@query("a31_extremes", """
    SELECT max(o_totalprice) AS max_value, (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS max_label,
           min(o_totalprice) AS min_value, (SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1) AS min_label
    FROM orders""")
def order_extremes(r: Register) -> DataFrame:
    return A.extremes(r.source("orders"), "o_totalprice", "o_orderkey")


@query("a32_a33_guarded_rates", """
    SELECT c_nationkey, CASE WHEN people > 0 THEN round(jobs / people * 1000, 6) END AS per_1000,
           CASE WHEN people > 0 THEN round(jobs / people * 100, 6) END AS quote_vakanz_pct
    FROM (SELECT c_nationkey, count(*) FILTER (WHERE c_acctbal > 0) AS jobs,
                 count(*) FILTER (WHERE c_nationkey <> 9) AS people FROM customer GROUP BY 1)""")
def guarded_rates(r: Register) -> DataFrame:
    counts = r.source("customer").groupBy("c_nationkey").agg(
        F.count_if(F.col("c_acctbal") > 0).alias("jobs"),
        F.count_if(F.col("c_nationkey") != 9).alias("people"))
    jobs, people = F.col("jobs"), F.col("people")
    return counts.select(
        "c_nationkey", F.round(J.per_thousand(jobs, people), 6).alias("per_1000"),
        F.round(J.labour_ratios(jobs, people)["quote_vakanz_pct"], 6).alias("quote_vakanz_pct"))


@query("a34_linear_fit", """
    SELECT round(regr_slope(n, l_linenumber), 6) AS slope, round(regr_intercept(n, l_linenumber), 6) AS intercept,
           count(*) AS n
    FROM (SELECT l_linenumber, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2)""")
def count_fit(r: Register) -> DataFrame:
    counts = r.source("lineitem").groupBy("l_linenumber", "l_suppkey").agg(F.count("*").alias("c"))
    fit = A.linear_fit(counts, "l_linenumber", "c")
    return fit.withColumns({"slope": F.round("slope", 6), "intercept": F.round("intercept", 6)})


@query("a35_daily", """
    SELECT cast(ts AS date) AS day, count(*) AS n_units, sum(user_id)::BIGINT AS amount FROM events GROUP BY 1""")
def daily_events(r: Register) -> DataFrame:
    return A.daily(r.source("events"), F.to_date("ts"), F.col("user_id"))


@query("a36_recent", """
    SELECT o_orderpriority, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '2001-06-01 00:00:00') AS recent
    FROM orders GROUP BY 1""")
def recent_orders(r: Register) -> DataFrame:
    recent = A.recent(F.to_date("o_orderdate"), dt.date(2001, 7, 31), 60)
    return r.source("orders").groupBy("o_orderpriority").agg(recent.alias("recent"))


@query("a37_distinct_values", "SELECT DISTINCT Einspeisungsart FROM solar WHERE Einspeisungsart IS NOT NULL")
def feed_in_kinds(r: Register) -> DataFrame:
    return A.distinct_values(r.solar, "Einspeisungsart")


# ------------------------------------------------------------------------------- windows


@query("w01_w02_cumulative", """
    SELECT l_returnflag, month, q, sum(q) OVER (PARTITION BY l_returnflag ORDER BY month) AS cum_q
    FROM (SELECT l_returnflag, cast(date_trunc('month', l_shipdate) AS date) AS month, sum(l_quantity) AS q
          FROM lineitem GROUP BY 1, 2)""")
def running_quantity(r: Register) -> DataFrame:
    monthly = r.source("lineitem").groupBy(
        "l_returnflag", F.trunc(F.to_date("l_shipdate"), "MM").alias("month")).agg(F.sum("l_quantity").alias("q"))
    return W.cumulative(monthly, ["l_returnflag"], "month", "q", "cum_q")


@query("w03_w04_period_delta", """
    SELECT quarter, n, n - lag(n) OVER (ORDER BY quarter) AS n_delta,
           round((n - lag(n) OVER (ORDER BY quarter)) / lag(n) OVER (ORDER BY quarter), 6) AS n_delta_pct
    FROM (SELECT cast(date_trunc('quarter', o_orderdate) AS date) AS quarter, count(*) AS n FROM orders GROUP BY 1)""")
def order_deltas(r: Register) -> DataFrame:
    quarters = r.source("orders").groupBy(
        F.trunc(F.to_date("o_orderdate"), "quarter").alias("quarter")).agg(F.count("*").alias("n"))
    return W.period_delta(quarters, "quarter", ["n"]).withColumn("n_delta_pct", F.round("n_delta_pct", 6))


@query("w06_w07_shares", """
    SELECT year, o_orderstatus, n, round(n / sum(n) OVER (), 9) AS of_total,
           round(n * 100 / sum(n) OVER (PARTITION BY year), 6) AS of_year
    FROM (SELECT cast(year(o_orderdate) AS integer) AS year, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2)""")
def status_shares(r: Register) -> DataFrame:
    counts = r.source("orders").groupBy(F.year("o_orderdate").alias("year"), "o_orderstatus").agg(
        F.count("*").alias("n"))
    shares = W.pct_in_period(W.pct_of_total(counts, "n", "of_total"), "year", "n", "of_year")
    return shares.withColumns({"of_total": F.round("of_total", 9), "of_year": F.round("of_year", 6)})


@query("w08_rank_of", """
    SELECT * FROM (SELECT c_nationkey, n, cast(row_number() OVER (ORDER BY n DESC, c_nationkey) AS integer) AS rank
                   FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1)) WHERE c_nationkey = 7""")
def nation_rank(r: Register) -> DataFrame:
    counts = r.source("customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return W.rank_of(counts, "n", "c_nationkey", 7)


@query("w09_latest_per_key", """
    SELECT user_id, event_id, event_type, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_events(r: Register) -> DataFrame:
    events = r.source("events").select("user_id", "event_id", "event_type", "value", "ts")
    return W.latest_per_key(events, ["user_id"], "ts", "event_id").drop("ts")


# ------------------------------------------------------------------------------- ranking, sets


@query("l01_top_plz", """
    SELECT plz, energietraeger, count(*) AS units, sum(bruttoleistung_kw) / 1000 AS bruttoleistung_mw,
           avg(lat) AS lat, avg(lon) AS lon
    FROM units_all WHERE plz IS NOT NULL AND lat IS NOT NULL GROUP BY 1, 2
    HAVING sum(bruttoleistung_kw) IS NOT NULL
    ORDER BY bruttoleistung_mw DESC, plz, energietraeger LIMIT 5000""")
def top_plz(r: Register) -> DataFrame:
    return U.top_plz(r.units)


@query("l02_l03_top_k", """
    SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 40""")
def top_orders(r: Register) -> DataFrame:
    return L.top_k(r.source("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 40, ["o_orderkey"])


@query("l04_top_groups", """
    SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 20""")
def top_parts(r: Register) -> DataFrame:
    return L.top_groups(r.source("lineitem"), ["l_partkey"], F.count("*"), "n", 20)


@query("l05_cap", """
    SELECT least(count(*), 1000) AS listed, least(count(*), 1000) AS known FROM netzanschlusspunkte""")
def listing(r: Register) -> DataFrame:
    """How many rows are listed, and how many of them are rows of the table: any rows do, so no more can be said."""
    points = r.table("netzanschlusspunkte")
    columns = ["NetzanschlusspunktMastrNummer", "Netzbetreiber", "Spannungsebene", "Bundesland", "Gemeinde"]
    listed = L.cap(points.select(*columns), 1000)
    found = listed.join(points.select(*[F.col(c).alias(f"_{c}") for c in columns]).distinct(),
                        [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns], "left")
    return found.agg(F.count("*").alias("listed"), F.count("_NetzanschlusspunktMastrNummer").alias("known"))


@query("l06_order_by_label", """
    SELECT o_orderpriority, count(*) AS n, CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '1-URGENT' THEN 2
           ELSE 3 END AS label_ord FROM orders GROUP BY 1""")
def labelled_order(r: Register) -> DataFrame:
    counts = A.freq(r.source("orders"), "o_orderpriority")
    return L.order_by_label(counts, "o_orderpriority", ["5-LOW", "1-URGENT"], "o_orderpriority")


@query("l07_most_recent", """
    SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 200""")
def most_recent(r: Register) -> DataFrame:
    return L.most_recent(r.source("events"), "ts", 200, "event_id").select("event_id", "event_type")


@query("u02_append", """
    SELECT 'customer' AS kind, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_name FROM supplier""")
def all_names(r: Register) -> DataFrame:
    people = r.source("customer").select(F.lit("customer").alias("kind"), F.col("c_name").alias("name"))
    firms = r.source("supplier").select(F.lit("supplier").alias("kind"), F.col("s_name").alias("name"))
    return S.append([people, firms])


@query("u03_all_keys", """
    SELECT l_partkey AS k FROM lineitem UNION SELECT p_partkey FROM part UNION SELECT o_custkey FROM orders""")
def every_key(r: Register) -> DataFrame:
    return S.all_keys([r.source("lineitem").select(F.col("l_partkey").alias("k")),
                       r.source("part").select(F.col("p_partkey").alias("k")),
                       r.source("orders").select(F.col("o_custkey").alias("k"))], "k")


@query("u04_known_keys", """
    SELECT DISTINCT user_id AS c_custkey FROM events WHERE user_id IN (SELECT c_custkey FROM customer)""")
def known_users(r: Register) -> DataFrame:
    asked = r.source("events").select(F.col("user_id").alias("c_custkey"))
    return S.known_keys(asked, r.source("customer"), "c_custkey")


@query("u05_j09_only_in", """
    SELECT user_id AS k FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def users_without_supplier(r: Register) -> DataFrame:
    return S.only_in(r.source("events").select(F.col("user_id").alias("k")),
                     r.source("supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("k")), ["k"])
