"""The unified unit view over the power-unit tables, and the aggregates built on it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridledger.catalog import CARRIERS, RENEWABLE, STATES
from gridledger.functions.labels import size_class6
from gridledger.functions.predicates import year_between
from gridledger.operators.projection import col_or_null, col_or_null_sql, has_column


def literal_table(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A small constant table as a VALUES relation, so its size is known to the planner."""
    def literal(value) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, str):
            return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        if isinstance(value, float):
            return f"{value!r}D"
        return str(value)

    values = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


def state_lookup(spark: SparkSession) -> DataFrame:
    """The constant code -> name table: 17 rows, always safe to broadcast."""
    return literal_table(spark, list(STATES.items()), "code, name")


def with_state(df: DataFrame, code: str = "bundesland_code", name: str = "bundesland_name") -> DataFrame:
    lookup = F.broadcast(state_lookup(df.sparkSession).select(
        F.col("code").alias("_code"), F.col("name").alias(name)))
    return df.join(lookup, F.col(code) == F.col("_code"), "left").drop("_code")


# unified column -> (register column, type it is safely cast to)
_UNIT_SHAPE = {
    "mastr_nr": ("EinheitMastrNummer", None),
    "bruttoleistung_kw": ("Bruttoleistung", "double"),
    "nettonennleistung_kw": ("Nettonennleistung", "double"),
    "bundesland_code": ("Bundesland", None),
    "gemeinde": ("Gemeinde", None),
    "plz": ("Postleitzahl", None),
    "lon": ("Laengengrad", "double"),
    "lat": ("Breitengrad", "double"),
    "inbetriebnahme_datum": ("Inbetriebnahmedatum", "date"),
    "betriebsstatus": ("Betriebsstatus", None),
}


def unit_projection(df: DataFrame, source: str, carrier: str) -> DataFrame:
    """One power-unit table in the shape of the unified view; absent columns are NULL.

    ``source`` and ``carrier`` are SQL expressions: a literal, or an expression over the table.
    """
    shaped = [f"{col_or_null_sql(df, name, kind)} AS {out}"
              for out, (name, kind) in _UNIT_SHAPE.items()]
    return df.selectExpr(f"{source} AS source_table", f"{carrier} AS energietraeger", *shaped)


def _unified(parts: list[DataFrame], names: bool) -> DataFrame:
    """Union first, then, if names are wanted, one state join for all branches."""
    union = reduce(DataFrame.unionByName, parts)
    if not names:
        return union
    return with_state(union).select(
        "source_table", "energietraeger", "mastr_nr", "bruttoleistung_kw", "nettonennleistung_kw",
        "bundesland_code", "bundesland_name", "gemeinde", "plz", "lon", "lat",
        "inbetriebnahme_datum", "betriebsstatus",
    )


def units_all(tables: Mapping[str, DataFrame], names: bool = True) -> DataFrame | None:
    """Unified view of whichever power-unit tables exist; None when there are none.

    ``names=False`` leaves the state name out. Aggregates take that form and look the name up for
    their few result rows instead of for every unit.
    """
    parts = [unit_projection(tables[key], f"'{key}'", f"'{carrier}'")
             for key, carrier in CARRIERS.items() if key in tables]
    return _unified(parts, names) if parts else None


def units_all_tagged(tagged: DataFrame, entity: str, extra: Mapping[str, DataFrame],
                     names: bool = True) -> DataFrame:
    """The same view when several unit types live in one table with a type column: one scan of it."""
    arms = " ".join(f"WHEN '{key}' THEN '{carrier}'" for key, carrier in CARRIERS.items())
    parts = [unit_projection(tagged, entity, f"CASE {entity} {arms} END")]
    parts += [unit_projection(df, f"'{key}'", f"'{CARRIERS[key]}'") for key, df in extra.items()]
    return _unified(parts, names)


def _mw(col: str = "bruttoleistung_kw") -> Column:
    return F.sum(col) / 1000


def kpi_overview(units: DataFrame, as_of: dt.date) -> DataFrame:
    renewable = F.col("energietraeger").isin(list(RENEWABLE))
    kw = F.col("bruttoleistung_kw")
    return units.agg(
        F.count("*").alias("units_total"),
        (F.sum(kw) / 1e6).alias("capacity_gw"),
        F.count_if(renewable).alias("ee_units"),
        (F.sum(F.when(renewable, kw)) / 1e6).alias("ee_capacity_gw"),
        F.lit(as_of).alias("as_of"),
    )


def in_known_state(code: str = "bundesland_code") -> Column:
    return F.col(code).isin(list(STATES))


def by_state(units: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Aggregate per known state and further keys, on the code; name the result rows and drop those
    without a name. Unknown codes cost a few groups, which is less than a test on every unit."""
    grouped = units.groupBy("bundesland_code", *keys).agg(*aggs)
    return with_state(grouped).filter(F.col("bundesland_name").isNotNull()).drop("bundesland_code")


def capacity_by_state(units: DataFrame) -> DataFrame:
    return by_state(units, ["energietraeger"], F.count("*").alias("units"),
                    _mw().alias("bruttoleistung_mw"))


def buildout_monthly(units: DataFrame) -> DataFrame:
    return (
        units.filter(F.col("inbetriebnahme_datum").isNotNull())
        .groupBy(F.trunc("inbetriebnahme_datum", "MM").alias("month"), "energietraeger")
        .agg(F.count("*").alias("new_units"), _mw().alias("new_capacity_mw"))
    )


def capacity_by_plz(units: DataFrame) -> DataFrame:
    return (
        units.filter(F.col("plz").isNotNull() & F.col("lat").isNotNull())
        .groupBy("plz", "energietraeger")
        .agg(F.count("*").alias("units"), _mw().alias("bruttoleistung_mw"),
             F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    )


def top_plz(units: DataFrame, k: int = 5000) -> DataFrame:
    ranked = capacity_by_plz(units).filter(F.col("bruttoleistung_mw").isNotNull())
    return ranked.orderBy(F.desc("bruttoleistung_mw"), "plz", "energietraeger").limit(k)


def solar_size_classes(units: DataFrame) -> DataFrame:
    """Per state and class; units without a known state form one group with a NULL name."""
    known = F.when(in_known_state(), F.col("bundesland_code"))
    classes = (
        units.filter(F.col("energietraeger") == CARRIERS["solar"])
        .groupBy(known.alias("bundesland_code"),
                 size_class6(F.col("bruttoleistung_kw")).alias("size_class"))
        .agg(F.count("*").alias("units"), _mw().alias("capacity_mw"))
    )
    return with_state(classes).drop("bundesland_code")


def wind_specs(wind: DataFrame) -> DataFrame:
    """Hub height, rotor and rating per turbine; columns a release lacks are NULL, and without a
    hub-height column there is nothing to show."""
    height = col_or_null(wind, "Nabenhoehe", "double")
    given = col_or_null(wind, "Nabenhoehe").isNotNull()
    kept = wind.filter(given) if has_column(wind, "Nabenhoehe") else wind.limit(0)
    return kept.select(
        height.alias("nabenhoehe_m"),
        col_or_null(wind, "Rotordurchmesser", "double").alias("rotor_m"),
        (col_or_null(wind, "Bruttoleistung", "double") / 1000).alias("mw"),
        col_or_null(wind, "Bundesland").alias("bundesland_code"),
    )


def ee_quote_by_year(units: DataFrame) -> DataFrame:
    renewable = F.col("energietraeger").isin(list(RENEWABLE))
    kw = F.col("bruttoleistung_kw")
    return (
        units.filter(year_between(F.col("inbetriebnahme_datum"), 1990, 2100))
        .groupBy(F.year("inbetriebnahme_datum").alias("year"))
        .agg((F.sum(kw) / 1e6).alias("total_gw"),
             (F.sum(F.when(renewable, kw)) / 1e6).alias("ee_gw"))
    )
