"""Picking up new register snapshots, each file once."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

from gridledger.streaming.runner import drain


def ingest_snapshots(spark: SparkSession, landing: str, schema: StructType, table: str,
                     checkpoint: str) -> None:
    """Append the files that arrived below ``landing/snapshot=YYYY-MM-DD`` since the last call.

    The checkpoint remembers which files were read and the sink which were written, so calling
    again, also after a crash, neither skips nor repeats one.
    """
    query = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 10_000).parquet(landing)
        .writeStream.partitionBy("snapshot").format("parquet").option("path", table)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    drain(query)
