"""The whole load: zipped export to tables, tables to views and aggregates."""

from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gridledger.catalog import ENTITIES
from gridledger.operators import units as U
from gridledger.session import new_work_path
from gridledger.sources import register_xml as X
from gridledger.sources import tables as B

log = logging.getLogger(__name__)

UPDATED = "DatumLetzteAktualisierung"  # fixed value: when a record was last changed


def load_export(spark: SparkSession, archive: str, table_dir: str,
                only: Sequence[str] | None = None) -> DataFrame:
    """Load every entity the archive contains; one row per entity tells what happened.

    Per entity: stage the members, read, type, keep the last update of each id, write. ``records``
    counts what was read, ``damaged`` what could not be parsed or was cut short, ``rows`` what was written. The
    archive must be reachable by every executor.
    """
    report: list[tuple[str, int, int, int]] = []
    for key, entity in ENTITIES.items():
        if only and key not in only:
            continue
        staged = new_work_path(spark, f"staged-{key}")
        found = X.stage_members(spark, archive, entity, staged)
        if not found.columns:
            log.warning("entity %s: no record in members %s", key, entity.members)
            continue
        raw, read = X.read_entity(spark, staged, entity, found.columns)
        table = X.typed(raw, entity)
        ids = [c for c in entity.ids if c in table.columns]
        if len(ids) == len(entity.ids):
            table = X.dedup(table, ids, UPDATED if UPDATED in table.columns else None)
        written = Observation()
        X.write_entity(table.observe(written, F.count("*").alias("rows")), entity, table_dir)
        cut_short = sum(found.truncated.values())
        report.append((key, read.get["records"] + cut_short, read.get["damaged"] + cut_short, written.get["rows"]))
    return spark.createDataFrame(report, "entity string, records long, damaged long, rows long")


AGGREGATES = ("kpi_overview", "capacity_by_state", "buildout_monthly", "capacity_by_plz_top5000",
              "solar_size_classes", "wind_hub_height", "ee_quote_by_year")


def open_register(spark: SparkSession, table_dir: str, aggregate_dir: str | None = None) -> dict[str, DataFrame]:
    """Temp views for SQL: one per entity table, the state lookup, the unified view and its roll-ups,
    and ``agg_...`` for every aggregate that has been written."""
    tables = B.load_entities(spark, table_dir)
    U.state_lookup(spark).createOrReplaceTempView("bundesland")
    units = U.units_all(tables)
    coded = U.units_all(tables, names=False)
    if units is not None:
        units.createOrReplaceTempView("v_units_all")
        U.capacity_by_state(coded).createOrReplaceTempView("v_capacity_by_state")
        U.buildout_monthly(coded).createOrReplaceTempView("v_buildout_monthly")
        U.capacity_by_plz(coded).createOrReplaceTempView("v_capacity_by_plz")
    for name in AGGREGATES if aggregate_dir else ():
        if B.path_exists(spark, f"{aggregate_dir}/{name}.parquet"):
            B.agg_table(spark, aggregate_dir, name).createOrReplaceTempView(f"agg_{name}")
    return tables


def refresh_aggregates(spark: SparkSession, table_dir: str, aggregate_dir: str, as_of: dt.date) -> dict[str, str]:
    """Recompute all aggregates of a loaded register; raises when there is no unit table at all."""
    tables = B.load_entities(spark, table_dir)
    units = U.units_all(tables, names=False)
    if units is None:
        raise RuntimeError(f"no power-unit table below {table_dir}")
    return B.write_aggregates(units, tables, aggregate_dir, as_of)
