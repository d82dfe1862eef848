"""Mix sources to target weights by repeating and dropping documents. DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridledger.session import new_work_path

MOST_REPEATS = 3
CYCLE = 3
SPACED = r"[^\x20\x09-\x0D]+"


def document_size(text: Column) -> Column:
    """Words between white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACED)), F.lit(0)).cast("long")


def unit_interval(*columns: Column) -> Column:
    """A number in [0, 1) that depends on the values alone: the first 32 bits of their MD5."""
    text = F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size`` to ``source, source_size, target``.

    Weights are 1, 2, 3, repeating in code-point order, null last. All targets share the total size by weight; a target
    stops at three times its source, and what it can't hold is reshared by weight. That ends at one level L with
    ``target = min(3 * size, L * weight)``. Sorted by ``3 * size / weight``, full sources are a prefix, so L follows
    from two running sums. One row per source goes through the window.
    """
    named = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("weight", ((F.row_number().over(named) - 1) % CYCLE + 1).cast("long"))
    ranked = ranked.withColumn("bound", F.lit(MOST_REPEATS) * F.col("source_size") / F.col("weight"))
    filled = Window.orderBy("bound", F.col("source").isNull(), "source")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    after = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    steps = (
        ranked.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("held", F.lit(MOST_REPEATS) * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(after))
        .withColumn("level", (F.col("total") - F.col("held")) / F.col("open_weight"))
    )
    level = F.max(F.when(F.col("level") <= F.col("bound"), F.col("level"))).over(everything)
    return steps.withColumn("final", level).select(
        "source", "source_size",
        F.when(F.col("final") >= F.col("bound"), (F.lit(MOST_REPEATS) * F.col("source_size")).cast("double"))
        .otherwise(F.col("final") * F.col("weight")).alias("target"),
    )


def with_copies(docs: DataFrame, key: str = "doc_id", seed: int = 0) -> DataFrame:
    """``doc`` (the row as it came), ``size, source_size, target, copies``: how often the mix takes each document.

    The rate of a source is target over size. A document is taken floor(rate) times, and once more with the fraction
    as probability; the draw is a hash of seed, key and text size, so reruns agree. Never more than three copies.
    Null or blank texts have size 0; a source without words has target 0 and takes none of its documents. Repeated
    rows draw alike. Extra columns travel inside ``doc``, whatever their names.

    The sum per source combines before the shuffle. The one row per source is written and read again, so the join knows
    its size before it starts: small, it is broadcast and the documents stay where they are; large, both sides shuffle
    and a hot source is split.
    """
    sized = docs.select(F.struct("*").alias("doc"), F.col("source").alias("from_source"),
                        document_size(F.col("text")).alias("size"))
    spark, path = docs.sparkSession, new_work_path(docs.sparkSession, "mix-targets")
    source_targets(sized.groupBy(F.col("from_source").alias("source")).agg(F.sum("size").alias("source_size"))
                   ).write.parquet(path)
    targets = spark.read.parquet(path)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    draw = unit_interval(F.lit(seed), F.col(f"doc.{key}"), F.col("size"))
    return (
        sized.join(targets, F.col("from_source").eqNullSafe(F.col("source")))
        .withColumn("rate", rate)
        .select("doc", "size", "source_size", "target",
                (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")).alias("copies"))
    )


def mix(docs: DataFrame, key: str = "doc_id", seed: int = 0) -> DataFrame:
    """The mixed rows themselves: each document as often as it is taken, columns unchanged."""
    taken = with_copies(docs, key, seed).filter("copies > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("doc.*")


def mix_digest(docs: DataFrame) -> DataFrame:
    """One row per document: ``taken`` is its size times its copies."""
    return with_copies(docs).select(F.col("doc.doc_id").alias("doc_id"), "size", "source_size", "target",
                                    (F.col("size") * F.col("copies")).alias("taken"))
