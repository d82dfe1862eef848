"""Set operations."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


def append(dfs: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)


def all_keys(dfs: Sequence[DataFrame], key: str) -> DataFrame:
    return append([df.select(key) for df in dfs]).distinct()


def known_keys(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Requested keys that the dimension knows."""
    return df.select(key).distinct().join(dim.select(key), key, "left_semi")


def only_in(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of a that b lacks."""
    return a.select(*keys).join(b.select(*keys), list(keys), "left_anti")


def union_sources(dfs: Sequence[DataFrame | None], dim: DataFrame, key: str) -> DataFrame | None:
    """All sources that delivered, with their dimension attached; None when none did."""
    delivered = [df for df in dfs if df is not None]
    return append(delivered).join(dim, key, "left") if delivered else None


def land_sources(spark: SparkSession, sources: Mapping[str, Callable[[], DataFrame | None]],
                 folder: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """What the sources deliver, and ``source, status, rows, error`` for each.

    Every source is a job of its own that writes below ``folder``, started side by side; one that fails, while it is
    planned or while it is read, costs only itself. ``status`` is landed, empty (nothing to read) or failed. A failed
    source leaves nothing, as a write counts only when it is committed.
    """
    def land(name: str) -> tuple[str, int | None, str | None]:
        try:
            df = sources[name]()
            if df is None:
                return "empty", 0, None
            seen = Observation()
            df.observe(seen, F.count("*").alias("rows")).write.parquet(f"{folder}/{name}")
            return "landed", seen.get["rows"], None
        except Exception as err:
            log.warning("source %s failed: %s", name, str(err).splitlines()[0])
            return "failed", None, str(err).splitlines()[0]

    with ThreadPoolExecutor(max(len(sources), 1)) as pool:
        done = dict(zip(sources, pool.map(land, sources), strict=True))
    landed = {name: spark.read.parquet(f"{folder}/{name}") for name, (status, *_) in done.items() if status == "landed"}
    report = spark.createDataFrame([(name, *row) for name, row in done.items()], "source string, status string, rows long, error string")
    return landed, report


def load_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table, one row each."""
    return append([
        df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name, df in tables.items()
    ])
