"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 16
LAW = "key"
SLOT_GROUPS = 4096
RUN = 4096


def hash52(*columns: Column) -> Column:
    """A whole number below 2**52 from the MD5 of the values; null counts as no characters."""
    text = F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def rendezvous_shard(key: Column, weights: list[float]) -> Column:
    """The shard whose score ``-ln(u) / weight`` is least, with u in (0, 1) from a hash of key and shard.

    Each shard wins in proportion to its weight. A score depends on key, shard and weight alone, so a shard that is
    added or grows only takes rows to itself, and one that goes only gives its own away. Equal scores fall to the
    smaller number. With equal weights the logarithm drops out, and the largest hash wins.
    """
    if len(set(weights)) == 1:
        scores = [F.struct((-hash52(key, F.lit(s))).alias("score"), F.lit(s).alias("shard")) for s in range(len(weights))]
    else:
        def score(s: int) -> Column:
            unit = (hash52(key, F.lit(s)).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
            return -F.ln(unit) / F.lit(float(weights[s]))
        scores = [F.struct(score(s).alias("score"), F.lit(s).alias("shard"))
                  for s in range(len(weights)) if weights[s] > 0]
    if not scores:
        raise ValueError("at least one shard needs a positive weight")
    return (F.least(*scores) if len(scores) > 1 else scores[0])["shard"].cast("int")


def with_shard(docs: DataFrame, weights: list[float] | None = None, key: str = "doc_id") -> DataFrame:
    """The rows with a ``shard`` column (a column of that name is replaced). No shuffle.

    Rows of one key share a shard, null keys too; repeated rows stay repeated.
    """
    return docs.withColumn("shard", rendezvous_shard(F.col(key), weights or [1.0] * SHARDS))


def numbered(groups: DataFrame, values: list[str]) -> DataFrame:
    """Distinct rows with ``copies`` to ``copies`` rows each, with a gapless ``slot`` per shard.

    Slots are ordered by slot group (a hash of the values), then by the values. Only group totals meet: their count is
    bounded by shards times ``SLOT_GROUPS``. Inside a group the running sum sees distinct rows, so a key that a third
    of all rows carry is one row there; it turns into its copies afterwards, in runs that are dealt out evenly.
    """
    groups = groups.withColumn("part", (hash52(*(F.col(v) for v in values)) % SLOT_GROUPS).cast("int"))
    totals = groups.groupBy("shard", "part").agg(F.sum("copies").alias("filled"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", "part", F.coalesce(F.sum("filled").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "part").orderBy(*values).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        groups.withColumn("earlier", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
        .join(F.broadcast(offsets), ["shard", "part"])
        .withColumn("first", F.col("offset") + F.col("earlier"))
    )
    single = placed.filter("copies = 1").withColumn("slot", F.col("first"))
    runs = (
        placed.filter("copies > 1")
        .withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(RUN).cast("long"))))
        .repartition(F.col("run"), *(F.col(v) for v in values))
        .withColumn("copy", F.explode(F.sequence(F.col("run"), F.least(F.col("copies"), F.col("run") + RUN) - 1)))
        .withColumn("slot", F.col("first") + F.col("copy"))
    )
    columns = [*values, "shard", "slot"]
    return single.select(columns).unionByName(runs.select(columns))


def shard_digest(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Size, text checksum, shard, slot in the shard, and the shard under one shard more, per document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    groups = (
        sized.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
        .withColumn("shard", rendezvous_shard(F.col("doc_id"), [1.0] * shards))
    )
    return numbered(groups, ["doc_id", "size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        rendezvous_shard(F.col("doc_id"), [1.0] * (shards + 1)).alias("grown_shard"))


def expected_largest(rows: int, shards: int) -> float:
    """Rows that the fullest of equal shards holds, about: the mean and a normal tail."""
    mean = rows / shards
    return mean + math.sqrt(2 * mean * math.log(max(shards, 2)))
