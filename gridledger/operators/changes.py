"""Cube cells patched by what changed between two snapshots, instead of folding the whole register again.

Two snapshots are compared as bags of rows, with a 128-bit hash of each row, in one shuffle. Rows that one snapshot
holds more often than the other are folded with that difference as their sign and weight; adding the result to the cube
before gives the cube after. Sums are decimals, so that what is added and later taken away leaves nothing behind, and
every sum has a count of its known values, so that one without any is NULL again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridledger.operators.cube import GRAINS, KEYS, cube_rows
from gridledger.sources import manifests as M

MEASURES = {"kw": "bruttoleistung_kw", "lat_sum": "lat", "lon_sum": "lon"}
SUM = "decimal(38,12)"


def with_print(rows: DataFrame) -> DataFrame:
    """The rows with a hash of all their columns: 128 bits, as two hashes from other starts. Absent values are part of
    it, and which they are; column order is not."""
    names = sorted(rows.columns)
    absent = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in names])
    halves = [F.xxhash64(F.lit(start), absent, *names).alias(start) for start in ("a", "b")]
    return rows.withColumn("print", F.struct(*halves))


def change_set(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of which the new snapshot has more or fewer, one for each hash, with ``times``: how many more it has;
    negative where it has fewer.

    An altered row is one row fewer and another one more. Rows equal in both are not in the result. Whole rows are
    shuffled, once: less than hashes first, and then both snapshots again to fetch the rows of some of them.
    """
    signed = old.withColumn("_sign", F.lit(-1)).unionByName(new.withColumn("_sign", F.lit(1)))
    return signed.groupBy(*old.columns).agg(F.sum("_sign").alias("times")).filter("times <> 0")


def changed_rows(old: DataFrame, new: DataFrame, changes: DataFrame) -> DataFrame:
    """One row per changed hash, with ``times``: from the new snapshot what came, from the old one what went.

    ``changes`` has the rows if it was made from whole snapshots, see ``change_set``; for one of hashes alone they are fetched.
    """
    if set(old.columns) <= set(changes.columns):
        return changes.select(*old.columns, "times")
    came = new.join(changes.filter("times > 0"), "print")
    went = old.join(changes.filter("times < 0"), "print")
    return came.unionByName(went).dropDuplicates(["print"])


def signed_cube(rows: DataFrame, times: Column | None = None) -> DataFrame:
    """Counts and sums per cell, each row taken as often as ``times`` says (once if it says nothing)."""
    weight = F.lit(1) if times is None else times
    exact = {out: F.col(c).cast("decimal(26,12)") for out, c in MEASURES.items()}
    if times is not None:
        exact = {out: value * times.cast("decimal(10,0)") for out, value in exact.items()}
    # each row is weighed before it is taken to all grains
    weighed = rows.select(*KEYS, weight.alias("_times"), *[value.alias(f"_{out}") for out, value in exact.items()],
                          *[F.when(F.col(c).isNotNull(), weight).otherwise(0).alias(f"_{out}_known") for out, c in MEASURES.items()])
    sums = [F.coalesce(F.sum(f"_{out}"), F.lit(0)).cast(SUM).alias(out) for out in MEASURES]
    known = [F.sum(f"_{out}_known").cast("long").alias(f"{out}_known") for out in MEASURES]
    return weighed.groupingSets([[F.col(k) for k in keys] for keys in GRAINS], *[F.col(k) for k in KEYS]).agg(
        F.grouping_id().cast("int").alias("grain"), F.sum("_times").cast("long").alias("n"), *sums, *known)


def patched(cube: DataFrame, delta: DataFrame) -> DataFrame:
    """The cube with the signed cells added; cells without units disappear."""
    totals = [F.sum(c).cast(SUM if c in MEASURES else "long").alias(c) for c in cube.columns if c not in (*KEYS, "grain")]
    return cube.unionByName(delta).groupBy(*KEYS, "grain").agg(*totals).filter("n <> 0")


def as_unit_cube(cube: DataFrame) -> DataFrame:
    """In the shape of ``cube.unit_cube``, which the published aggregates read."""
    sums = [F.when(F.col(f"{c}_known") > 0, F.col(c).cast("double")).alias(c) for c in MEASURES]
    return cube.select(*KEYS, "grain", "n", *sums, F.col("lon_sum_known").alias("lon_n"))


def advance(units: DataFrame, root: str, keep: int = 2) -> DataFrame:
    """Takes in the next snapshot of the unit view and returns its cube; see ``cube.unit_cube``.

    Kept below ``root`` and published together are the snapshot's rows, reduced to what the cube needs and written once,
    and the cube. The first snapshot is folded as a whole; later ones only where they differ from the one before. A run
    that dies publishes nothing, so the next one starts from the same state.
    """
    spark = units.sparkSession
    landed = M.land(with_print(cube_rows(units, "mastr_nr")), root, "rows")
    rows = spark.read.parquet(f"{root}/{landed}").drop("mastr_nr")
    if M.read(spark, root) is None:
        cube = signed_cube(rows)
    else:
        kept = M.published(spark, root, "rows").drop("print")  # hashed anew, whatever hash it was kept with
        before = with_print(kept).drop("mastr_nr")
        cube = patched(M.published(spark, root, "cube"),
                       signed_cube(changed_rows(before, rows, change_set(before, rows)), F.col("times")))
    done = M.publish(spark, root, {"cube": lambda: cube}, keep=keep, landed={"rows": landed})
    if set(done.values()) != {"written"}:
        raise RuntimeError(f"the snapshot is not taken in: {done}")
    return as_unit_cube(M.published(spark, root, "cube"))
