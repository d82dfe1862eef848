"""All register aggregates from one pass over the units.

``unit_cube`` folds the unit view to the grains of the published aggregates in one read: state,
carrier and size class; month and carrier; postcode and carrier. However many units there are, it
has a few thousand rows of the first two kinds and one per postcode and carrier of the third; the
aggregates are then sums over that small table instead of six more scans of the register.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridledger.catalog import CARRIERS, RENEWABLE
from gridledger.functions.labels import size_class6
from gridledger.operators.units import by_state, in_known_state, with_state


KEYS = ["bundesland_code", "energietraeger", "size_class", "month", "plz", "located"]
STATE = ["bundesland_code", "energietraeger", "size_class"]
MONTH = ["energietraeger", "month"]
PLACE = ["energietraeger", "plz", "located"]
GRAINS = (STATE, MONTH, PLACE)


def grain(keys: list[str]) -> Column:
    """Rows of the cube that were grouped by these keys."""
    left_out = sum(1 << (len(KEYS) - 1 - i) for i, k in enumerate(KEYS) if k not in keys)
    return F.col("grain") == left_out


def cube_rows(units: DataFrame, *more: str) -> DataFrame:
    """The units with the keys of all grains, the measures, and further columns."""
    state = F.when(in_known_state(), F.col("bundesland_code"))
    return units.select(
        state.alias("bundesland_code"), "energietraeger", "plz",
        F.trunc("inbetriebnahme_datum", "MM").alias("month"),
        size_class6(F.col("bruttoleistung_kw")).alias("size_class"),
        F.col("lat").isNotNull().alias("located"), "bruttoleistung_kw", "lat", "lon", *more,
    )


def unit_cube(units: DataFrame) -> DataFrame:
    """Partial sums of every grain leave a task at once; ``grain`` tells them apart."""
    sets = [[F.col(k) for k in keys] for keys in GRAINS]
    return cube_rows(units).groupingSets(sets, *[F.col(k) for k in KEYS]).agg(
        F.grouping_id().cast("int").alias("grain"),
        F.count("*").alias("n"), F.sum("bruttoleistung_kw").alias("kw"),
        F.sum("lat").alias("lat_sum"), F.sum("lon").alias("lon_sum"), F.count("lon").alias("lon_n"),
    )


def _units(name: str = "units") -> Column:
    return F.sum("n").alias(name)


def kpi_overview(cube: DataFrame, as_of: dt.date) -> DataFrame:
    renewable = F.col("energietraeger").isin(list(RENEWABLE))
    return cube.filter(grain(STATE)).agg(
        _units("units_total"), (F.sum("kw") / 1e6).alias("capacity_gw"),
        F.coalesce(F.sum(F.when(renewable, F.col("n"))), F.lit(0)).alias("ee_units"),
        (F.sum(F.when(renewable, F.col("kw"))) / 1e6).alias("ee_capacity_gw"),
        F.lit(as_of).alias("as_of"))


def capacity_by_state(cube: DataFrame) -> DataFrame:
    return by_state(cube.filter(grain(STATE)), ["energietraeger"], _units(),
                    (F.sum("kw") / 1000).alias("bruttoleistung_mw"))


def buildout_monthly(cube: DataFrame) -> DataFrame:
    return cube.filter(grain(MONTH) & F.col("month").isNotNull()).select(
        "month", "energietraeger", F.col("n").alias("new_units"), (F.col("kw") / 1000).alias("new_capacity_mw"))


def top_plz(cube: DataFrame, k: int = 5000) -> DataFrame:
    cells = cube.filter(grain(PLACE) & F.col("plz").isNotNull() & F.col("located")).select(
        "plz", "energietraeger", F.col("n").alias("units"), (F.col("kw") / 1000).alias("bruttoleistung_mw"),
        (F.col("lat_sum") / F.col("n")).alias("lat"), F.try_divide("lon_sum", "lon_n").alias("lon"))
    ranked = cells.filter(F.col("bruttoleistung_mw").isNotNull())
    return ranked.orderBy(F.desc("bruttoleistung_mw"), "plz", "energietraeger").limit(k)


def solar_size_classes(cube: DataFrame) -> DataFrame:
    classes = cube.filter(grain(STATE) & (F.col("energietraeger") == CARRIERS["solar"])).groupBy(
        "bundesland_code", "size_class").agg(_units(), (F.sum("kw") / 1000).alias("capacity_mw"))
    return with_state(classes).drop("bundesland_code")


def ee_quote_by_year(cube: DataFrame) -> DataFrame:
    renewable = F.col("energietraeger").isin(list(RENEWABLE))
    year = F.year("month")
    return cube.filter(grain(MONTH) & year.between(1990, 2100)).groupBy(year.alias("year")).agg(
        (F.sum("kw") / 1e6).alias("total_gw"),
        (F.sum(F.when(renewable, F.col("kw"))) / 1e6).alias("ee_gw"))
