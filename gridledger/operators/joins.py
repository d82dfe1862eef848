"""Joins of facts with small dimensions, always after the facts have been aggregated."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridledger.catalog import DISSOLVED_DISTRICTS, DISTRICT_ALIASES
from gridledger.functions.convert import norm_plz


def per_thousand(units: Column, people: Column) -> Column:
    return F.when(people > 0, units / people * 1000)


def by_plz(units: DataFrame, kw: str = "Bruttoleistung") -> DataFrame:
    """Units and megawatts per normalised postcode."""
    return (
        units.filter(F.col("Postleitzahl").isNotNull())
        .groupBy(norm_plz(F.col("Postleitzahl")).alias("plz"))
        .agg(F.count("*").alias("units"), (F.sum(F.col(kw).try_cast("double")) / 1000).alias("mw"))
    )


def to_district(plz_totals: DataFrame, plz_district: DataFrame, meta: DataFrame) -> DataFrame:
    """Postcode totals to districts with density; postcodes without a district are dropped."""
    districts = (
        plz_totals.join(plz_district, "plz", "inner")
        .groupBy("kreis")
        .agg(F.sum("units").alias("units"), F.sum("mw").alias("mw"))
    )
    return districts.join(meta, "kreis", "left").withColumn(
        "per_1000", per_thousand(F.col("units"), F.col("einwohner")))


def merge_branches(branches: Mapping[str, DataFrame], key: str, measures: Sequence[str],
                   base: DataFrame | None = None) -> DataFrame:
    """Several per-key summaries side by side, missing ones 0, with row totals.

    The branches are stacked and folded by one aggregate, so there is one shuffle however many
    branches there are. Keys of ``base`` appear even without any branch.
    """
    stacked = reduce(DataFrame.unionByName, [
        df.select(key, F.lit(name).alias("_branch"), *measures) for name, df in branches.items()
    ])
    if base is not None:
        blank = [F.lit(None).cast(stacked.schema[m].dataType).alias(m) for m in measures]
        stacked = stacked.unionByName(
            base.select(key, F.lit(None).cast("string").alias("_branch"), *blank))
    cells = [
        F.coalesce(F.sum(F.when(F.col("_branch") == name, F.col(m))), F.lit(0)).alias(f"{name}_{m}")
        for name in branches for m in measures
    ]
    merged = stacked.groupBy(key).agg(*cells)
    totals = {}
    for m in measures:
        terms = [F.col(f"{name}_{m}") for name in branches]
        totals[f"total_{m}"] = sum(terms[1:], terms[0])
    return merged.withColumns(totals)


def per_capita(by_state: DataFrame, population: DataFrame, mw: str = "mw") -> DataFrame:
    """Watts per inhabitant: megawatts per million people is the same number."""
    return by_state.join(population, "bundesland_name", "left").withColumn(
        "watt_per_capita", F.try_divide(F.col(mw), F.col("einwohner_mio")))


def with_dimension(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    return df.join(dim, key, "left")


def index_vs_capacity(index: DataFrame, capacity: DataFrame, meta: DataFrame) -> DataFrame:
    """Every district of an external index, with its capacity or 0."""
    solar = capacity.select("kreis", F.col("mw").alias("solar_mw"), F.col("units").alias("solar_units"))
    return (
        index.join(solar, "kreis", "left").join(meta, "kreis", "left")
        .withColumns({
            "solar_mw": F.coalesce("solar_mw", F.lit(0.0)),
            "solar_units": F.coalesce("solar_units", F.lit(0)),
        })
    )


def only_top_keys(df: DataFrame, key: str, measure: str, k: int) -> DataFrame:
    """Rows whose key is among the k largest by summed measure (ties by key). k rows are joined."""
    top = (
        df.groupBy(key).agg(F.sum(measure).alias("_m"))
        .filter(F.col(key).isNotNull())
        .orderBy(F.desc_nulls_last("_m"), key).limit(k)
    )
    return df.join(F.broadcast(top.select(key)), key, "left_semi")


def norm_district(df: DataFrame, name: str) -> DataFrame:
    """District name as the labour feed spells it; a dissolved district has none, and a note why."""
    original = F.col(name)
    alias = F.create_map(*[F.lit(x) for pair in DISTRICT_ALIASES.items() for x in pair])
    note = F.create_map(*[F.lit(x) for pair in DISSOLVED_DISTRICTS.items() for x in pair])
    return df.withColumns({
        "api_name": F.when(original.isin(list(DISSOLVED_DISTRICTS)), F.lit(None).cast("string"))
        .otherwise(F.coalesce(F.try_element_at(alias, original), original)),
        "ba_note": F.try_element_at(note, original),
    })


def labour_ratios(open_jobs: Column, employed: Column) -> dict[str, Column]:
    guarded = (employed > 0) & open_jobs.isNotNull()
    return {
        "beschaeftigte_tausend": employed / 1000,
        "quote_vakanz_pct": F.when(guarded, open_jobs / employed * 100),
        "recruiting_index": F.when(guarded, open_jobs / employed * 1000),
    }
