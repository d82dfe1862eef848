"""Whole-register questions: totals, states, postcodes, build-out, renewable share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridledger.catalog import RENEWABLE, SIZE_CLASSES_6
from gridledger.functions.labels import size_class6
from gridledger.functions.predicates import (
    in_list_or_all,
    in_states,
    is_active,
    since_months,
    year_between,
)
from gridledger.operators import aggregates as A
from gridledger.operators import joins as J
from gridledger.operators import ranking as L
from gridledger.operators import units as U
from gridledger.operators import windows as W
from gridledger.plans.register import AS_OF, Register
from gridledger.plans.registry import query
from gridledger.plans.shaping import SQL_RENEWABLE, sql_class6, units_and_mw

@query("q01_overview_kpi", f"""
    SELECT count(*) AS units_total, sum(bruttoleistung_kw) / 1e6 AS capacity_gw,
           count(*) FILTER (WHERE energietraeger IN {SQL_RENEWABLE}) AS ee_units,
           sum(bruttoleistung_kw) FILTER (WHERE energietraeger IN {SQL_RENEWABLE}) / 1e6
               AS ee_capacity_gw,
           DATE '2001-08-15' AS as_of
    FROM units_all""")
def overview_kpi(r: Register) -> DataFrame:
    return U.kpi_overview(r.units, AS_OF)


@query("q02_carrier", """
    SELECT energietraeger, sum(bruttoleistung_kw) / 1000 AS mw, count(*) AS units
    FROM units_all WHERE bundesland_name IS NOT NULL GROUP BY 1""")
def capacity_by_carrier(r: Register) -> DataFrame:
    # straight from the units: rolling the state table up would add a second shuffle
    known = r.units.filter(U.in_known_state())
    return known.groupBy("energietraeger").agg(*units_and_mw())


@query("q02_state", """
    SELECT bundesland_name, energietraeger, count(*) AS units,
           sum(bruttoleistung_kw) / 1000 AS bruttoleistung_mw
    FROM units_all WHERE bundesland_name IS NOT NULL GROUP BY 1, 2""")
def capacity_by_state(r: Register) -> DataFrame:
    return U.capacity_by_state(r.units)


@query("q03_buildout_ten_years", """
    SELECT cast(date_trunc('month', inbetriebnahme_datum) AS date) AS month, energietraeger,
           sum(bruttoleistung_kw) / 1000 AS new_capacity_mw
    FROM units_all
    WHERE inbetriebnahme_datum >= DATE '1991-08-01'
    GROUP BY 1, 2""")
def buildout_recent(r: Register, months: int = 120) -> DataFrame:
    recent = r.units.filter(since_months(F.col("inbetriebnahme_datum"), AS_OF, months))
    return U.buildout_monthly(recent).select("month", "energietraeger", "new_capacity_mw")


_SOLAR_FLEET = """energietraeger = 'SolareStrahlungsenergie'
    AND bundesland_name IN ('Bayern', 'Hessen', 'Thüringen')
    AND inbetriebnahme_datum BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'
    AND betriebsstatus = 'InBetrieb'"""


def solar_fleet(r: Register, states=("Bayern", "Hessen", "Thüringen"), years=(1996, 2000),
                active: bool = True) -> DataFrame:
    fleet = r.units_of("solar").filter(
        in_states(F.col("bundesland_code"), states)
        & year_between(F.col("inbetriebnahme_datum"), *years))
    return fleet.filter(is_active(fleet)) if active else fleet


@query("q04_solar_summary", f"""
    SELECT count(*) AS units, sum(bruttoleistung_kw) / 1000 AS mw, avg(bruttoleistung_kw) AS avg_kw
    FROM units_all WHERE {_SOLAR_FLEET}""")
def solar_summary(r: Register, **filters) -> DataFrame:
    return A.fleet_summary(solar_fleet(r, **filters), "bruttoleistung_kw")


@query("q05_solar_size_classes", f"""
    SELECT {sql_class6('bruttoleistung_kw')} AS size_class, count(*) AS units,
           sum(bruttoleistung_kw) / 1000 AS mw,
           CASE size_class WHEN '0–10 kW' THEN 1 WHEN '10–30 kW' THEN 2 WHEN '30–100 kW' THEN 3
                WHEN '100–750 kW' THEN 4 WHEN '0.75–10 MW' THEN 5 ELSE 6 END AS label_ord
    FROM units_all WHERE {_SOLAR_FLEET} GROUP BY 1""")
def solar_size_classes(r: Register, **filters) -> DataFrame:
    classes = solar_fleet(r, **filters).groupBy(size_class6(F.col("bruttoleistung_kw")).alias("size_class"))
    return L.order_by_label(classes.agg(*units_and_mw()), "size_class",
                            [label for label, _ in SIZE_CLASSES_6])


@query("q06_solar_buildout_year", f"""
    SELECT cast(year(inbetriebnahme_datum) AS integer) AS year,
           sum(bruttoleistung_kw) / 1000 AS mw, count(*) AS units
    FROM units_all WHERE {_SOLAR_FLEET} GROUP BY 1""")
def solar_buildout_year(r: Register, **filters) -> DataFrame:
    return solar_fleet(r, **filters).groupBy(F.year("inbetriebnahme_datum").alias("year")).agg(*units_and_mw())


@query("q07_solar_top_plz", f"""
    SELECT plz, count(*) AS units, round(sum(bruttoleistung_kw) / 1000, 1) AS mw
    FROM units_all WHERE {_SOLAR_FLEET} AND plz IS NOT NULL
    GROUP BY 1 ORDER BY mw DESC NULLS LAST, plz LIMIT 30""")
def solar_top_plz(r: Register, **filters) -> DataFrame:
    by_plz = solar_fleet(r, **filters).filter(F.col("plz").isNotNull()).groupBy("plz").agg(
        F.count("*").alias("units"), F.round(F.sum("bruttoleistung_kw") / 1000, 1).alias("mw"))
    return L.top_k(by_plz, "mw", 30, ["plz"])


@query("q23_plz_map", """
    SELECT plz, energietraeger, count(*) AS units, sum(bruttoleistung_kw) / 1000 AS mw,
           avg(lat) AS lat, avg(lon) AS lon
    FROM units_all
    WHERE plz IS NOT NULL AND lat IS NOT NULL AND energietraeger IN ('Wind', 'Biomasse', 'Speicher')
    GROUP BY 1, 2 HAVING sum(bruttoleistung_kw) / 1000 >= 20""")
def plz_map(r: Register, min_mw: float = 20, carriers=("Wind", "Biomasse", "Speicher")) -> DataFrame:
    wanted = r.units.filter(in_list_or_all(F.col("energietraeger"), carriers))
    return U.capacity_by_plz(wanted).withColumnRenamed("bruttoleistung_mw", "mw").filter(F.col("mw") >= min_mw)


_MONTHLY = """
    SELECT cast(date_trunc('month', inbetriebnahme_datum) AS date) AS month, energietraeger,
           count(*) AS new_units, sum(bruttoleistung_kw) / 1000 AS new_capacity_mw
    FROM units_all WHERE inbetriebnahme_datum IS NOT NULL GROUP BY 1, 2"""


@query("q24_cumulative_buildout", f"""
    SELECT month, energietraeger, new_capacity_mw,
           round(sum(new_capacity_mw) OVER (PARTITION BY energietraeger ORDER BY month), 6) AS cum_mw
    FROM ({_MONTHLY}) WHERE year(month) BETWEEN 1996 AND 2000""")
def cumulative_buildout(r: Register) -> DataFrame:
    window = r.units.filter(year_between(F.col("inbetriebnahme_datum"), 1996, 2000))
    monthly = U.buildout_monthly(window).select("month", "energietraeger", "new_capacity_mw")
    running = W.cumulative(monthly, ["energietraeger"], "month", "new_capacity_mw", "cum_mw")
    return running.withColumn("cum_mw", F.round("cum_mw", 6))


@query("q25_buildout_yearly", f"""
    SELECT cast(year(month) AS integer) AS year, energietraeger, round(sum(new_capacity_mw), 6) AS mw
    FROM ({_MONTHLY}) GROUP BY 1, 2""")
def buildout_yearly(r: Register) -> DataFrame:
    monthly = U.buildout_monthly(r.units).select(
        F.year("month").alias("year"), "energietraeger", F.col("new_capacity_mw").alias("mw"))
    out = A.rollup_from_agg(monthly, ["year", "energietraeger"], ["mw"])
    return out.withColumn("mw", F.round("mw", 6))


@query("q26_state_league", """
    SELECT u.bundesland_name, u.mw, u.units, p.einwohner_mio, u.mw / p.einwohner_mio AS watt_per_capita
    FROM (SELECT bundesland_name, sum(bruttoleistung_kw) / 1000 AS mw, count(*) AS units
          FROM units_all WHERE energietraeger = 'SolareStrahlungsenergie'
            AND bundesland_name IS NOT NULL GROUP BY 1) u
    LEFT JOIN state_population p USING (bundesland_name)""")
def state_league(r: Register) -> DataFrame:
    return J.per_capita(U.by_state(r.units_of("solar"), [], *units_and_mw()), r.state_population)


@query("q27_ee_share_year", f"""
    SELECT cast(year(inbetriebnahme_datum) AS integer) AS year,
           sum(bruttoleistung_kw) / 1e6 AS total_gw,
           sum(bruttoleistung_kw) FILTER (WHERE energietraeger IN {SQL_RENEWABLE}) / 1e6 AS ee_gw,
           round(ee_gw / nullif(total_gw, 0) * 100, 6) AS ee_share_pct
    FROM units_all WHERE year(inbetriebnahme_datum) BETWEEN 1990 AND 2100 GROUP BY 1""")
def ee_share_year(r: Register) -> DataFrame:
    share = A.ratio(F.col("ee_gw"), F.col("total_gw"), 100)
    return U.ee_quote_by_year(r.units).withColumn("ee_share_pct", F.round(share, 6))


@query("q27_ee_share_state", f"""
    SELECT bundesland_name,
           coalesce(sum(bruttoleistung_kw) FILTER (WHERE energietraeger IN {SQL_RENEWABLE}), 0) / 1000
               AS ee_mw,
           sum(bruttoleistung_kw) / 1000 AS total_mw,
           round(ee_mw / nullif(total_mw, 0) * 100, 6) AS share
    FROM units_all WHERE bundesland_name IS NOT NULL GROUP BY 1""")
def ee_share_state(r: Register) -> DataFrame:
    renewable = F.col("energietraeger").isin(list(RENEWABLE))
    kw = F.col("bruttoleistung_kw")
    states = U.by_state(
        r.units, [], (F.coalesce(F.sum(F.when(renewable, kw)), F.lit(0.0)) / 1000).alias("ee_mw"),
        (F.sum(kw) / 1000).alias("total_mw"))
    return states.withColumn(
        "share", F.round(A.ratio(F.col("ee_mw"), F.col("total_mw"), 100), 6))
