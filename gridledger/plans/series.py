"""Electricity prices and irradiance from landed JSON responses."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridledger.functions.convert import epoch_to_local
from gridledger.functions.labels import price_band, rad_band
from gridledger.functions.predicates import business_hour
from gridledger.operators import aggregates as A
from gridledger.operators import projection as P
from gridledger.operators import windows as W
from gridledger.operators.sets import known_keys
from gridledger.operators.units import literal_table
from gridledger.plans.register import Register
from gridledger.plans.registry import query
from gridledger.sources.payloads import explode_current, explode_hourly, explode_prices

ZONES = [("view", "Deutschland", 51.0, 10.0), ("click", "France", 46.5, 2.5),
         ("signup", "Polska", 52.0, 19.0), ("purchase", "España", 40.0, -4.0)]
_ZONES = "(VALUES " + ", ".join(
    f"('{b}', '{c}', {lat!r}e0, {lon!r}e0)" for b, c, lat, lon in ZONES) + ") AS z(bzn, country, lat, lon)"
_BAND = ("CASE WHEN price IS NULL THEN 'missing' WHEN price < 0 THEN 'negative'"
         " WHEN price < 50 THEN 'low' WHEN price < 100 THEN 'medium' ELSE 'high' END")


def zones(r: Register) -> DataFrame:
    return literal_table(r.spark, ZONES, "bzn, country, lat, lon")


def prices(r: Register) -> DataFrame:
    """Hourly prices of all zones with their country; a zone without an entry keeps NULLs."""
    return explode_prices(r.price_payloads, ["bzn"]).join(F.broadcast(zones(r)), "bzn", "left")


_PRICES = f"""
    SELECT p.bzn, hour_utc, hour_utc + INTERVAL 1 HOUR AS ts, strftime(hour_utc + INTERVAL 1 HOUR, '%H:%M') AS hour,
           price, CASE WHEN p.bzn = 'view' THEN 'EUR / MWh' ELSE 'EUR/MWh' END AS unit,
           z.country, z.lat, z.lon
    FROM price_rows p LEFT JOIN {_ZONES} ON z.bzn = p.bzn"""
_LATEST = f"""
    SELECT * FROM ({_PRICES})
    QUALIFY row_number() OVER (PARTITION BY bzn ORDER BY hour_utc DESC) = 1"""


def latest_prices(r: Register) -> DataFrame:
    """The row of the newest instant per zone. Local time would repeat an hour when clocks go back."""
    return W.latest_per_key(prices(r), ["bzn"], "unix_seconds").drop("unix_seconds")


@query("q50_latest_price", f"""
    SELECT bzn, country, lat, lon, unit, hour, price, {_BAND} AS band FROM ({_LATEST})""")
def latest_price(r: Register) -> DataFrame:
    return latest_prices(r).select(
        "bzn", "country", "lat", "lon", "unit", "hour", "price",
        price_band(F.col("price")).alias("band"))


@query("q50_price_extremes", f"""
    SELECT max(price) AS max_value, arg_max(bzn, price) AS max_label,
           min(price) AS min_value, arg_min(bzn, price) AS min_label
    FROM ({_LATEST})""")
def price_extremes(r: Register) -> DataFrame:
    return A.extremes(latest_prices(r), "price", "bzn")


_NIGHTS = [("autumn", 300), ("spring", 90)]  # days from 1 January 2024 to the nights on which clocks change


@query("q50_latest_at_clock_change", " UNION ALL ".join(f"""
    SELECT '{night}' AS night, bzn, strftime((moved AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Berlin', '%H:%M') AS hour, price
    FROM (SELECT bzn, price, hour_utc + INTERVAL {days} DAY AS moved FROM price_rows
          WHERE hour_utc < TIMESTAMP '2024-01-01 02:00:00')
    QUALIFY row_number() OVER (PARTITION BY bzn ORDER BY moved DESC) = 1""" for night, days in _NIGHTS))
def latest_at_clock_change(r: Register) -> DataFrame:
    """Latest price when the first hours of the year lie on a clock-change night: 02:00 twice, or not at all."""
    early = explode_prices(r.price_payloads, ["bzn"]).filter(F.col("unix_seconds") < 1704067200 + 7200)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("night"), F.lit(d).alias("days")) for n, d in _NIGHTS]))
    nights = early.withColumn("on", each).select("*", "on.*")
    moved = nights.withColumn("unix_seconds", F.col("unix_seconds") + F.col("days") * 86400)
    hour = F.date_format(epoch_to_local(F.col("unix_seconds"), "Europe/Berlin"), "HH:mm").alias("hour")
    newest = W.latest_per_key(moved.select("night", "bzn", "unix_seconds", "price"), ["night", "bzn"], "unix_seconds")
    return newest.select("night", "bzn", hour, "price")


@query("q51_price_history", f"""
    SELECT bzn, country, strftime(ts, '%d.%m.%Y %H:%M') AS ts_label, price
    FROM ({_PRICES})
    WHERE bzn IN ('view', 'purchase') AND cast(ts AS date) BETWEEN DATE '2023-12-27' AND DATE '2024-01-26'""")
def price_history(r: Register, wanted=("view", "purchase", "atlantis"),
                  start: str = "2023-11-01", end: str = "2024-03-01",
                  today: dt.date = dt.date(2024, 1, 25)) -> DataFrame:
    """Known zones only, within the requested range once that has been clamped."""
    asked = literal_table(r.spark, [(start, end)], "s, e").selectExpr(
        "cast(s AS date) AS start", "cast(e AS date) AS end")
    usable = P.clamp_range(asked, today)
    keys = known_keys(literal_table(r.spark, [(z,) for z in wanted], "bzn"), zones(r), "bzn")
    day = F.to_date("ts")
    rows = prices(r).join(F.broadcast(keys), "bzn", "left_semi").filter(
        (day >= usable.select("clamped_start").scalar())
        & (day <= usable.select("clamped_end").scalar()))
    return rows.select("bzn", "country", F.date_format("ts", "dd.MM.yyyy HH:mm").alias("ts_label"),
                       "price")


_DAY = f"SELECT * FROM ({_PRICES}) WHERE cast(ts AS date) = DATE '2024-01-15'"


@query("q52_price_now", f"""
    SELECT bzn, coalesce(arg_max(price, hour_utc) FILTER (WHERE hour(ts) = 14), arg_max(price, hour_utc)) AS price_now,
           min(price) AS day_min, max(price) AS day_max
    FROM ({_DAY}) GROUP BY 1""")
def price_now(r: Register, day: dt.date = dt.date(2024, 1, 15), hour: int = 14) -> DataFrame:
    """Price of the current hour, or the day's last one where that hour is missing."""
    ts, price, instant = F.col("ts"), F.col("price"), F.col("unix_seconds")
    at_hour = F.max_by(price, F.when(F.hour(ts) == hour, instant))
    return prices(r).filter(F.to_date(ts) == F.lit(day)).groupBy("bzn").agg(
        F.coalesce(at_hour, F.max_by(price, instant)).alias("price_now"),
        F.min(price).alias("day_min"), F.max(price).alias("day_max"))


@query("q52_business_hours", f"""
    SELECT bzn, hour(ts) BETWEEN 7 AND 18 AS business_hour, count(*) AS hours,
           avg(price) AS mean_price
    FROM ({_PRICES}) GROUP BY 1, 2""")
def business_hours(r: Register) -> DataFrame:
    flag = business_hour(F.col("ts")).alias("business_hour")
    return prices(r).groupBy("bzn", flag).agg(
        F.count("*").alias("hours"), F.avg("price").alias("mean_price"))


# ------------------------------------------------------------------------------- irradiance


def current_payloads(r: Register) -> DataFrame:
    """One response per supplier site: an object, an array of two, or an error."""
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    watts = F.when(key % 7 == 0, F.lit("null")).otherwise((key * 13 % 900).cast("string"))
    one = F.format_string(
        '{"latitude":%d.5,"longitude":10.25,"current":{"shortwave_radiation":%s,"is_day":%d}}',
        key % 60, watts, key % 2)
    body = (
        F.when(nation == 9, F.lit('{"error":true,"reason":"rate limit"}'))
        .when(nation >= 15, F.concat(F.lit("["), one, F.lit(', {"latitude":1.0,"longitude":2.0}]')))
        .otherwise(one)
    )
    return r.source("supplier").select(key.alias("site"), body.alias("body"))


_CURRENT = """
    SELECT site, position, current_w_m2, is_day FROM (
        SELECT s_suppkey AS site, 0 AS position,
               CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE cast(s_suppkey * 13 % 900 AS double) END
                   AS current_w_m2, cast(s_suppkey % 2 AS integer) AS is_day
        FROM supplier WHERE s_nationkey <> 9
        UNION ALL
        SELECT s_suppkey, 1, NULL, NULL FROM supplier WHERE s_nationkey >= 15)"""
_RAD = ("CASE WHEN current_w_m2 IS NULL THEN 'missing' WHEN current_w_m2 < 50 THEN 'dark'"
        " WHEN current_w_m2 < 200 THEN 'dim' WHEN current_w_m2 < 500 THEN 'bright' ELSE 'strong' END")


@query("q53_irradiance_now", f"SELECT *, {_RAD} AS band FROM ({_CURRENT})")
def irradiance_now(r: Register) -> DataFrame:
    rows = explode_current(current_payloads(r), ["site"])
    return rows.withColumn("band", rad_band(F.col("current_w_m2")))


@query("q53_irradiance_sampled", f"""
    WITH numbered AS (
        SELECT s_suppkey AS site, row_number() OVER (ORDER BY s_suppkey) - 1 AS i,
               count(*) OVER () AS n FROM supplier)
    SELECT s.site, c.current_w_m2, {_RAD} AS band
    FROM (SELECT site FROM numbered WHERE i % cast(ceil(n / 40.0) AS bigint) = 0) s
    LEFT JOIN ({_CURRENT}) c ON c.site = s.site AND c.position = 0""")
def irradiance_sampled(r: Register, max_points: int = 40) -> DataFrame:
    """At most ``max_points`` evenly spaced sites, sampled before any response is built or parsed."""
    sampled = P.every_kth(current_payloads(r), max_points, ["site"])
    rows = explode_current(sampled, ["site"]).filter("position = 0").drop("position", "is_day")
    return sampled.select("site").join(rows, "site", "left").withColumn(
        "band", rad_band(F.col("current_w_m2")))


def hourly_payloads(r: Register) -> DataFrame:
    """Hourly response per zone and day."""
    rows = explode_prices(r.price_payloads, ["bzn"], tz="UTC")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm")
    days = rows.groupBy("bzn", F.to_date("ts").alias("day")).agg(F.sort_array(F.collect_list(
        F.struct(stamp.alias("t"), F.col("price").alias("v")))).alias("h"))  # at most 24 entries
    body = F.to_json(F.struct(F.struct(
        F.transform("h", lambda x: x["t"]).alias("time"),
        F.transform("h", lambda x: x["v"]).alias("shortwave_radiation")).alias("hourly")))
    return days.select("bzn", "day", body.alias("body"))


@query("q53_hourly_curve", """
    SELECT bzn, cast(hour_utc AS date) AS day, strftime(hour_utc, '%H:%M') AS hour,
           cast(row_number() OVER (PARTITION BY bzn, cast(hour_utc AS date) ORDER BY hour_utc) AS integer)
               AS hour_ord,
           price AS radiation
    FROM price_rows""")
def hourly_curve(r: Register) -> DataFrame:
    return explode_hourly(hourly_payloads(r), ["bzn", "day"])
