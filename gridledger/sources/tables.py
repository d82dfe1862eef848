"""Loading and writing the register tables and the pre-computed aggregates."""

from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridledger.catalog import ENTITIES
from gridledger.operators import cube as C
from gridledger.operators.sets import load_summary
from gridledger.operators.units import wind_specs
from gridledger.session import new_work_path
from gridledger.sources import manifests as M
from gridledger.sources.footers import footer_summary, read_footers

log = logging.getLogger(__name__)


def union_evolving(dfs: Sequence[DataFrame]) -> DataFrame:
    """Batches whose columns grew over time; what a batch lacks is NULL."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def load_entities(spark: SparkSession, folder: str, merge_schema: bool = False, damaged: str = "table") -> dict[str, DataFrame]:
    """Every entity table that can be read, also as a temp view. One bad table stops nobody.

    The footers of all files are looked at first, see ``load_checked``. One load writes one schema, so footers are merged
    only on request.
    """
    return load_checked(spark, folder, merge_schema, damaged)[0]


def load_checked(spark: SparkSession, folder: str, merge_schema: bool = False,
                 damaged: str = "table") -> tuple[dict[str, DataFrame], DataFrame | None]:
    """The tables that can be read, and the report on their files; None if there are no files.

    ``damaged`` says what a damaged file takes along: its whole ``table``, or only the ``file`` itself.
    """
    if damaged not in ("table", "file"):
        raise ValueError("damaged must be 'table' or 'file'")
    present = [key for key in ENTITIES if path_exists(spark, f"{folder}/{key}.parquet")]
    for key in ENTITIES:
        if key not in present:
            log.warning("entity %s is missing", key)
    if not present:
        return {}, None
    footers = read_footers(spark, folder, present)
    # the partition column must stay text: state codes are labels, not numbers
    inference = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(inference)
    spark.conf.set(inference, "false")
    tables: dict[str, DataFrame] = {}
    try:
        for key in present:
            bad, path = footers.damaged.get(key, []), f"{folder}/{key}.parquet"
            if bad:
                log.warning("entity %s has %d damaged files, the first is %s", key, len(bad), bad[0])
            if key not in footers.good or bad and damaged == "table":
                log.warning("entity %s is unreadable", key)
                continue
            reader = spark.read.option("mergeSchema", str(merge_schema).lower())
            df = reader.option("basePath", path).parquet(*footers.good[key]) if bad else reader.parquet(path)
            df.createOrReplaceTempView(key)
            tables[key] = df
    finally:
        spark.conf.set(inference, before)
    log.info("%d of %d entities loaded", len(tables), len(ENTITIES))
    return tables, footers.files


def aggregate_plans(cube: DataFrame | None, tables: dict[str, DataFrame],
                    as_of: dt.date) -> dict[str, Callable[[], DataFrame | None]]:
    return {
        "kpi_overview": lambda: C.kpi_overview(cube, as_of),
        "capacity_by_state": lambda: C.capacity_by_state(cube),
        "buildout_monthly": lambda: C.buildout_monthly(cube),
        "capacity_by_plz_top5000": lambda: C.top_plz(cube),
        "solar_size_classes": lambda: C.solar_size_classes(cube),
        "wind_hub_height": lambda: wind_specs(tables["wind"]) if "wind" in tables else None,
        "ee_quote_by_year": lambda: C.ee_quote_by_year(cube),
    }


def write_aggregates(units: DataFrame, tables: dict[str, DataFrame], folder: str,
                     as_of: dt.date) -> dict[str, str]:
    """Write each aggregate as ZSTD Parquet; a failing one is reported and skipped.

    The units are read once, into a cube written next to the aggregates; the outputs read that. They are
    small, so they are started side by side.
    """
    base = f"{folder}/unit_cube.parquet"
    cube: DataFrame | None = None
    try:
        C.unit_cube(units).write.mode("overwrite").option("compression", "zstd").parquet(base)
        cube = units.sparkSession.read.parquet(base)
    except Exception as err:
        log.error("the unit cube failed: %s", str(err).splitlines()[0])

    def write(name: str, plan: Callable[[], DataFrame | None]) -> str:
        if cube is None and name != "wind_hub_height":
            return "failed"
        try:
            df = plan()
            if df is None:
                return "skipped"
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}.parquet")
            return "written"
        except Exception as err:
            log.error("aggregate %s failed: %s", name, str(err).splitlines()[0])
            return "failed"

    plans = aggregate_plans(cube, tables, as_of)
    with ThreadPoolExecutor(len(plans)) as pool:
        return dict(zip(plans, pool.map(write, plans, plans.values()), strict=True))


def publish_aggregates(units: DataFrame, tables: dict[str, DataFrame], root: str, as_of: dt.date, keep: int = 14) -> dict[str, str]:
    """Write all aggregates as one published version, from one read of the units; see ``manifests.publish``.

    Readers of ``published_agg`` see all of a version or all of the one before. The turbine table may be absent.
    """
    spark = units.sparkSession
    base = new_work_path(spark, "unit-cube")
    C.unit_cube(units).write.parquet(base)
    plans = aggregate_plans(spark.read.parquet(base), tables, as_of)
    return M.publish(spark, root, plans, [name for name in plans if name != "wind_hub_height"], keep)


def published_agg(spark: SparkSession, root: str, name: str) -> DataFrame:
    return M.published(spark, root, name)


def agg_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checked_summary(tables: dict[str, DataFrame], required: Sequence[str]) -> DataFrame:
    """Rows per table; raises when a required table is missing."""
    absent = [name for name in required if name not in tables]
    if absent:
        raise RuntimeError(f"required tables are missing: {', '.join(absent)}")
    return load_summary(tables).orderBy(F.col("table_name"))


def footer_checked_summary(files: DataFrame, required: Sequence[str]) -> DataFrame:
    """Files, damaged files and rows per table from the report of a load; raises when a required table has no rows to read."""
    summary = footer_summary(files)
    found = {r.table_name for r in summary.filter("files > damaged").select("table_name").collect()}
    absent = [name for name in required if name not in found]
    if absent:
        raise RuntimeError(f"required tables are missing: {', '.join(absent)}")
    return summary
