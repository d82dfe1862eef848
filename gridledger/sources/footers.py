"""What Parquet files say about themselves: a report per file from their footers, read by tasks, without data pages."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridledger.session import new_work_path
from gridledger.sources.register_xml import at_storage

FILE_SCHEMA = "path string, bytes long, rows long, groups int, types map<string,string>, error string"


class Footers(NamedTuple):
    """``files``: one row per file (``table_name, path, bytes, rows, groups, error``), on shared storage.
    ``damaged``: the paths with an error, by table. ``good``: the other ones."""

    files: DataFrame
    damaged: dict[str, list[str]]
    good: dict[str, list[str]]


def inspect(path: str, size: int) -> tuple[int | None, int | None, dict[str, str] | None, str | None]:
    """Rows, row groups and column types of a file, or what is wrong with it.

    A footer must parse, and every column chunk it names must lie inside the file.
    """
    try:
        store, target = at_storage(path)
        with store.open_input_file(target) as data:
            meta = pq.ParquetFile(data).metadata
            for g in range(meta.num_row_groups):
                group = meta.row_group(g)
                for c in range(group.num_columns):
                    chunk = group.column(c)
                    start = chunk.dictionary_page_offset or chunk.data_page_offset
                    if start < 4 or start + chunk.total_compressed_size > size:
                        return None, None, None, f"column {chunk.path_in_schema} of row group {g} lies outside the file"
            return meta.num_rows, meta.num_row_groups, {f.name: str(f.type) for f in meta.schema.to_arrow_schema()}, None
    except Exception as err:  # whatever a damaged file makes of the reader
        return None, None, None, f"{type(err).__name__}: {str(err).splitlines()[0] if str(err) else ''}"


def _inspect_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [inspect(p, n) for p, n in zip(batch["path"], batch["length"])]
        yield pd.DataFrame({
            "path": batch["path"], "bytes": batch["length"], "rows": pd.array([f[0] for f in found], "Int64"),
            "groups": pd.array([f[1] for f in found], "Int32"), "types": [f[2] for f in found], "error": [f[3] for f in found]})


def odd_types(files: DataFrame) -> DataFrame:
    """``path, odd``: files that hold a column in another type than most rows of their table."""
    columns = files.select("table_name", "path", "rows", F.explode("types").alias("column", "type"))
    votes = columns.groupBy("table_name", "column", "type").agg(F.sum("rows").alias("held"))
    first = F.row_number().over(Window.partitionBy("table_name", "column").orderBy(F.desc("held"), "type"))
    usual = votes.withColumn("place", first).filter("place = 1").select("table_name", "column", F.col("type").alias("usual"))
    odd = columns.join(usual, ["table_name", "column"]).filter("type <> usual")
    text = F.format_string("column %s is %s, elsewhere %s", "column", "type", "usual")
    return odd.groupBy("path").agg(F.min(text).alias("odd"))


def read_footers(spark: SparkSession, folder: str, names: Sequence[str]) -> Footers:
    """The footers of all files of the tables ``folder/name.parquet``. One pass of tasks over file tails.

    Only the paths come to the driver, as they do for any read of the tables.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(
        [f"{folder}/{name}.parquet" for name in names]).select("path", "length")
    seen = files.mapInPandas(_inspect_all, FILE_SCHEMA).withColumn(
        "table_name", F.regexp_extract("path", r"/([^/]+)\.parquet(?:/.*)?$", 1))
    raw = new_work_path(spark, "footers")
    seen.write.parquet(raw)
    seen = spark.read.parquet(raw)
    path = new_work_path(spark, "file-report")
    seen.join(odd_types(seen), "path", "left").select(
        "table_name", "path", "bytes", "rows", "groups", F.coalesce("error", "odd").alias("error")).write.parquet(path)
    report = spark.read.parquet(path)
    damaged: dict[str, list[str]] = {}
    good: dict[str, list[str]] = {}
    for row in report.select("table_name", "path", "error").toLocalIterator():
        (good if row.error is None else damaged).setdefault(row.table_name, []).append(row.path)
    return Footers(report, damaged, good)


def footer_summary(files: DataFrame) -> DataFrame:
    """Files, damaged files and rows per table; rows are those of the good files. No data page is read."""
    return files.groupBy("table_name").agg(
        F.count("*").alias("files"), F.count("error").alias("damaged"),
        F.coalesce(F.sum(F.when(F.col("error").isNull(), F.col("rows"))), F.lit(0)).alias("rows"))
