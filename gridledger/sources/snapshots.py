"""Dated snapshots: which one is newest, which are expired, what changed in their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridledger.operators.sets import only_in


def resolve_snapshot(catalog: DataFrame, pin: str | None = None, prefix: str = "data-") -> DataFrame:
    """The pinned snapshot, else the newest published one. One row, or none if nothing fits."""
    if pin is not None:
        return catalog.filter(F.col("tag") == pin).select("tag")
    usable = catalog.filter(F.col("tag").startswith(prefix) & ~F.col("draft") & ~F.col("prerelease"))
    newest = usable.agg(F.max_by("tag", F.struct("published_at", "tag")).alias("tag"))
    return newest.filter(F.col("tag").isNotNull())


def expired_snapshots(catalog: DataFrame, keep: int = 14) -> DataFrame:
    """Snapshots beyond the newest ``keep``. The catalogue has one row per release."""
    age = Window.orderBy(F.desc("published_at"), F.desc("tag"))
    return (catalog.withColumn("age_rank", F.row_number().over(age))
            .filter(F.col("age_rank") > keep).select("tag", "age_rank"))


def schema_table(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(entity, column) rows of a set of tables: metadata only, no data is read."""
    rows = [(key, column) for key, df in tables.items() for column in df.columns]
    return spark.createDataFrame(rows, "entity string, column string")


def record_schema(spark: SparkSession, tables: dict[str, DataFrame], folder: str, tag: str) -> DataFrame:
    """Store a snapshot's columns below ``folder`` and return the drift against the last stored one.

    The first snapshot has nothing to compare with: its drift is empty. A tag that is stored again replaces itself
    and is compared with the one before it. Tags sort by age, as dated tags do.
    """
    from gridledger.sources.tables import path_exists

    new = schema_table(spark, tables)
    stored = spark.read.parquet(folder).filter(F.col("tag") < tag) if path_exists(spark, folder) else None
    last = stored.agg(F.max("tag")).first()[0] if stored is not None else None
    old = new if last is None else stored.filter(F.col("tag") == last).select("entity", "column")
    drift = schema_drift(old, new).collect()  # one row per changed column, taken before the folder changes
    new.coalesce(1).write.mode("overwrite").parquet(f"{folder}/tag={tag}")
    return spark.createDataFrame(drift, "entity string, change string, column string")


def schema_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Columns that came or went, per entity."""
    keys = ["entity", "column"]
    added = only_in(new, old, keys).withColumn("change", F.lit("added"))
    removed = only_in(old, new, keys).withColumn("change", F.lit("removed"))
    return added.unionByName(removed).select("entity", "change", "column")


def drift_report(drift: DataFrame) -> DataFrame:
    """One row per entity and kind of change, its columns listed in order."""
    names = F.array_join(F.sort_array(F.collect_list("column")), ", ")
    return drift.groupBy("entity", "change").agg(
        F.count("*").alias("n_columns"), names.alias("columns"))
