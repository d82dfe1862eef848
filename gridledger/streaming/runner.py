"""Starting streams over files and landing their output as tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from gridledger.sources import manifests as M
from gridledger.sources.register_xml import at_storage

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Start queries with on-disk state, which large keyed state and custom state need."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


def stream_parquet(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    """Read a Parquet folder, or one Parquet file, as a stream."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory():
        return reader.parquet(path)
    folder, name = path.rsplit("/", 1)
    return reader.option("pathGlobFilter", name).parquet(folder)


def drain(query: StreamingQuery) -> StreamingQuery:
    """Wait for an available-now query; a failed one raises."""
    query.awaitTermination()
    return query


def late_rows(query: StreamingQuery) -> int:
    """Rows that came too late for their window, over the batches the query still reports on.

    Rows are counted as the stateful operator sees them: after partial aggregation.
    """
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def append_available(stream: DataFrame, work: str) -> StreamingQuery:
    """Process everything available and append the rows to Parquet exactly once.

    The file sink's own log decides which files count, so a restart after a lost executor or driver
    neither repeats nor loses rows.
    """
    with rocksdb_state(stream.sparkSession):
        query = (
            stream.writeStream.outputMode("append").format("parquet")
            .option("checkpointLocation", f"{work}/checkpoint").option("path", f"{work}/rows")
            .trigger(availableNow=True).start()
        )
    return drain(query)


def to_table(stream: DataFrame, work: str) -> DataFrame:
    """Process everything available and return the table the rows were appended to."""
    append_available(stream, work)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{work}/rows")


def upsert_batch(batch: DataFrame, number: int, root: str, keys: list[str], buckets: int = 16, keep: int = 2) -> None:
    """Merges a micro-batch into a table of the newest row per key: the batch's row wins.

    Keys lie in hashed buckets. Only the buckets that the batch touches are read and written anew, in a folder of the
    batch; one manifest then names all buckets, so readers see a batch as a whole. A batch that is repeated after its
    manifest changes nothing; one that died before it leaves the old version, and its remains are cleared. The number of
    buckets is fixed with the first batch.
    """
    spark = batch.sparkSession
    now = M.read(spark, root)
    if now is not None and now[0] >= number + 1:
        return
    held = dict(now[1]) if now else {}
    buckets = int(held.get("buckets", buckets))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    fresh = batch.withColumn("_bucket", bucket).persist()
    try:
        touched = sorted(r["_bucket"] for r in fresh.select("_bucket").distinct().collect())
        folder = f"{M.DATA}/{number + 1:012d}-{uuid.uuid4().hex[:8]}"
        old = [f"{root}/{held[str(b)]}" for b in touched if str(b) in held]
        merged = fresh
        if old:
            known = spark.read.schema(batch.schema).parquet(*old)
            kept = known.join(fresh.select(*keys), same_keys(known, fresh, keys), "left_anti")
            merged = kept.withColumn("_bucket", bucket).unionByName(fresh)
        if touched:
            merged.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{root}/{folder}")
        entries = {**held, **{str(b): f"{folder}/_bucket={b}" for b in touched}, "buckets": str(buckets)}
        M.commit(spark, root, number + 1, entries)
    finally:
        fresh.unpersist()
    M.expire(spark, root, keep)


def same_keys(old: DataFrame, new: DataFrame, keys: list[str]) -> Column:
    """Equal keys, nulls too."""
    return reduce(Column.__and__, [old[k].eqNullSafe(new[k]) for k in keys])


def read_upserted(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """The current rows of an upserted table; none before its first batch."""
    found = M.read(spark, root)
    paths = [f"{root}/{path}" for name, path in (found[1] if found else {}).items() if name != "buckets"]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def to_latest(stream: DataFrame, work: str, keys: list[str]) -> DataFrame:
    """Process everything available in update mode; return the newest version of each key.

    Batches are merged into a bucketed table, see ``upsert_batch``, so it holds each key once whatever their number.
    """
    def land(batch: DataFrame, number: int) -> None:
        upsert_batch(batch, number, f"{work}/latest", keys)

    with rocksdb_state(stream.sparkSession):
        query = (
            stream.writeStream.outputMode("update").foreachBatch(land)
            .option("checkpointLocation", f"{work}/checkpoint")
            .trigger(availableNow=True).start()
        )
    drain(query)
    return read_upserted(stream.sparkSession, f"{work}/latest", stream.schema)


class LateRows(StreamingQueryListener):
    """Counts rows that came too late, per query, batch and operator, into a folder of Parquet files.

    Register it on the session before queries start. Every progress event with late rows is one file named after its
    run and batch, so a batch that is reported again replaces itself, and counts outlive the query and the driver.
    Listener events are delivered after the batch, in order; ``settle`` waits for those on their way.
    """

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        late = [(str(p.id), p.name, p.batchId, nth, op.operatorName, op.numRowsDroppedByWatermark)
                for nth, op in enumerate(p.stateOperators) if op.numRowsDroppedByWatermark]
        if late:
            names = ["query_id", "query", "batch", "operator", "kind", "late_rows"]
            store, path = at_storage(self.folder)
            store.create_dir(path, recursive=True)
            draft, name = f"{path}/.{uuid.uuid4().hex}", f"{p.id}-{p.batchId:012d}.parquet"
            columns = list(zip(*late))
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64()]
            pq.write_table(pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names), draft, filesystem=store)
            store.move(draft, f"{path}/{name}")


LATE_SCHEMA = "query_id string, query string, batch long, operator int, kind string, late_rows long"


def settle(spark: SparkSession) -> None:
    """Waits until listeners have seen what has happened so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()


def late_counts(spark: SparkSession, folder: str) -> DataFrame:
    """What ``LateRows`` has counted, also in earlier runs of a query."""
    settle(spark)
    return spark.read.schema(LATE_SCHEMA).parquet(folder)
