"""JSON responses landed as one text column, turned into rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridledger.functions.convert import epoch_to_local

PRICE_SCHEMA = "unix_seconds array<bigint>, price array<double>, unit string"
CURRENT_SCHEMA = ("array<struct<latitude: double, longitude: double, error: boolean,"
                  " current: struct<shortwave_radiation: double, is_day: int>>>")
HOURLY_SCHEMA = "hourly struct<time: array<string>, shortwave_radiation: array<double>>"
METRICS_SCHEMA = ("array<struct<metricName: string, value: string,"
                  " attributes: array<struct<DESC: string>>>>")
THEMES_SCHEMA = "map<string, struct<count: int, percentage: double, codes: array<string>>>"


def explode_prices(df: DataFrame, keys: Sequence[str], body: str = "body",
                   tz: str = "Europe/Berlin", default_unit: str = "EUR/MWh") -> DataFrame:
    """Parallel time and price arrays to one row per hour, in local time.

    A document without prices gives no rows; arrays of unequal length are padded with NULL and
    rows without a time are dropped.
    """
    parsed = df.withColumn("_p", F.from_json(body, PRICE_SCHEMA)).filter(F.size("_p.price") > 0)
    rows = parsed.select(
        *keys, F.explode(F.arrays_zip("_p.unix_seconds", "_p.price")).alias("_r"),
        F.coalesce("_p.unit", F.lit(default_unit)).alias("unit"),
    ).filter(F.col("_r.unix_seconds").isNotNull())
    local = epoch_to_local(F.col("_r.unix_seconds"), tz)
    return rows.select(
        *keys, F.col("_r.unix_seconds").alias("unix_seconds"), local.alias("ts"),
        F.date_format(local, "HH:mm").alias("hour"), F.col("_r.price").alias("price"), "unit")


def explode_current(df: DataFrame, keys: Sequence[str], body: str = "body") -> DataFrame:
    """Current readings: one object or an array of objects per response; errors give no rows."""
    text = F.trim(body)
    as_list = F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    items = df.withColumn("_items", F.from_json(as_list, CURRENT_SCHEMA))
    failed = F.exists("_items", lambda x: x["error"].isNotNull())
    rows = items.filter(~F.coalesce(failed, F.lit(True))).select(*keys, F.posexplode("_items"))
    return rows.select(
        *keys, F.col("pos").alias("position"),
        F.col("col.current.shortwave_radiation").alias("current_w_m2"),
        F.col("col.current.is_day").alias("is_day"))


def explode_hourly(df: DataFrame, keys: Sequence[str], body: str = "body") -> DataFrame:
    """Hourly curve: hour label, 1-based position, value."""
    parsed = df.withColumn("_h", F.from_json(body, HOURLY_SCHEMA)["hourly"])
    rows = parsed.select(*keys, F.posexplode(F.arrays_zip("_h.time", "_h.shortwave_radiation")))
    return rows.filter(F.col("col.time").isNotNull()).select(
        *keys, F.regexp_replace("col.time", "^.*T", "").alias("hour"),
        (F.col("pos") + 1).alias("hour_ord"),
        F.col("col.shortwave_radiation").alias("radiation"))


def parse_metrics(body: Column) -> Column:
    return F.from_json(body, METRICS_SCHEMA)


def pick_metric(metrics: Column, name: str) -> tuple[Column, Column]:
    """Value and period text of the first metric with that name; both NULL if there is none."""
    hit = F.try_element_at(F.filter(metrics, lambda m: m["metricName"] == name), F.lit(1))
    first = F.try_element_at(hit["attributes"], F.lit(1))
    return hit["value"].try_cast("double"), first["DESC"]


def explode_themes(df: DataFrame, body: str = "body", keys: Sequence[str] = ()) -> DataFrame:
    """Theme summary documents to one row per theme."""
    rows = df.select(*keys, F.explode(F.from_json(body, THEMES_SCHEMA)).alias("theme", "t"))
    return rows.select(*keys, "theme", F.col("t.count").alias("count"),
                       F.col("t.percentage").alias("percentage"))
