"""Aggregations, pivots, histograms and quantiles.

Everything here aggregates before it windows, so a hot key costs a map-side combine and not a
sorted partition. Pivots always name their columns.
"""

from __future__ import annotations

import datetime as dt
import math
import sys
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridledger.functions.labels import label_at, ladder
from gridledger.session import ensure_checkpoint_dir


def rollup_from_agg(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])


def ratio(num: Column, den: Column, factor: float = 1.0) -> Column:
    """Division that gives NULL for a zero or missing denominator."""
    return F.try_divide(num, F.nullif(den, F.lit(0).cast("double"))) * factor


def guarded_ratio(num: Column, den: Column) -> Column:
    """Ratio only where the denominator is positive."""
    return F.when(den > 0, num / den)


def fleet_summary(df: DataFrame, kw: str) -> DataFrame:
    return df.agg(F.count("*").alias("units"), (F.sum(kw) / 1000).alias("mw"),
                  F.avg(kw).alias("avg_kw"))


def largest(df: DataFrame, kw: str) -> DataFrame:
    return df.agg((F.max(kw) / 1000).alias("top_mw"))


def n_distinct(col: Column, count_null: bool = False) -> Column:
    """Exact distinct count; optionally a missing value counts as one more value."""
    n = F.count_distinct(col)
    return n + F.max(F.when(col.isNull(), 1).otherwise(0)) if count_null else n


def mean_positive(col: Column) -> Column:
    return F.avg(F.when(col > 0, col))


def mean_ratio(num: Column, den: Column) -> Column:
    """Mean of the per-row ratio over rows where both are positive."""
    return F.avg(F.when((num > 0) & (den > 0), num / den))


def freq(df: DataFrame, *cols: str, n: str = "n") -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias(n))


def dominant(df: DataFrame, col: str) -> DataFrame:
    """Most frequent category (ties: alphabetically first) and its share in percent."""
    counts = freq(df.filter(F.col(col).isNotNull()), col)
    first = F.struct(-F.col("n"), F.col(col))
    return counts.agg(F.min_by(col, first).alias(col),
                      (F.max("n") * 100.0 / F.sum("n")).alias("share_pct"))


def mode_per_group(df: DataFrame, keys: Sequence[str], col: str, out: str) -> DataFrame:
    """Modal value per group, ties alphabetically. Two combinable steps, no value list per group."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(col, F.struct(-F.col("_n"), F.col(col))).alias(out))


def grouping_sets(df: DataFrame, sets: Sequence[Sequence[str]], sums: Mapping[str, Column]) -> DataFrame:
    """Native grouping sets of summed columns, with a ``level`` id: which columns a row was grouped by.

    The rows are folded to the finest grain first, so only the folded rows are copied per set.
    """
    keys = list(dict.fromkeys(c for s in sets for c in s))
    fine = df.groupBy(*keys).agg(*[F.sum(col).alias(name) for name, col in sums.items()])
    grouped = fine.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(k) for k in keys])
    return grouped.agg(F.grouping_id().cast("int").alias("level"), *[F.sum(n).alias(n) for n in sums])


def with_grand_total(df: DataFrame, keys: Sequence[str], category: str, sums: Mapping[str, Column],
                     label: str = "Grand Total") -> DataFrame:
    """Detail rows per category plus one total row per remaining key."""
    grouped = grouping_sets(df, [[*keys, category], list(keys)], sums)
    return grouped.withColumn(
        category, F.when(F.col("level") > 0, F.lit(label)).otherwise(F.col(category))).drop("level")


def pivot_sum(df: DataFrame, rows: Sequence[str], column: str, values: Sequence, measure: str,
              names: Sequence[str] | None = None, other: str | None = None) -> DataFrame:
    """Wide form with a fixed list of columns, missing cells 0.

    Values that are not listed, NULL included, add up in the column ``other``; without one they fail the job, so that
    nothing is lost unseen.
    """
    names = list(names or [str(v) for v in values])
    listed = F.coalesce(F.col(column).isin(list(values)), F.lit(False))
    rest = F.col(measure) if other else F.raise_error(F.concat(
        F.lit(f"pivot on {column}: no column for "), F.coalesce(F.col(column).cast("string"), F.lit("NULL"))))
    kept = df.withColumn(measure, F.when(listed, F.col(measure)).otherwise(rest))
    cells = [
        F.coalesce(F.sum(F.when(F.col(column) == F.lit(v), F.col(measure))), F.lit(0)).alias(n)
        for v, n in zip(values, names, strict=True)
    ]
    if other:
        cells.append(F.coalesce(F.sum(F.when(~listed, F.col(measure))), F.lit(0)).alias(other))
    return kept.groupBy(*rows).agg(*cells)


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str], other: str = "other") -> DataFrame:
    """Counts per listed value, and of everything else."""
    listed = F.coalesce(F.col(column).isin(list(values)), F.lit(False))
    cells = [F.count_if(F.col(column) == F.lit(v)).alias(str(v)) for v in values]
    return df.groupBy(row).agg(*cells, F.count_if(~listed).alias(other))


def unpivot_measures(df: DataFrame, keys: Sequence[str], measures: dict[str, str], name: str,
                     value: str) -> DataFrame:
    """Long form; ``measures`` maps a column to the label it gets."""
    wide = df.select(*keys, *[F.col(c).alias(label) for c, label in measures.items()])
    return wide.unpivot(list(keys), list(measures.values()), name, value)


def bucket_matrix(df: DataFrame, kw: str, bounds: Sequence[tuple[str, float | None]]) -> DataFrame:
    """Units and megawatts per size bucket (a, b] with the grand total and each bucket's share."""
    position = ladder(F.col(kw), bounds, inclusive=True, ordinal=True)
    counts = df.groupBy(position.alias("bucket_ord")).agg(
        F.count("*").alias("units"), (F.sum(kw) / 1000).alias("mw"),
    ).withColumn("bucket", label_at(F.col("bucket_ord"), bounds))
    every = Window.partitionBy()  # at most one row per bucket reaches this window
    return counts.withColumns({
        "units_total": F.sum("units").over(every),
        "mw_total": F.sum("mw").over(every),
    }).withColumns({
        "units_share": ratio(F.col("units"), F.col("units_total")),
        "mw_share": ratio(F.col("mw"), F.col("mw_total")),
    })


def day_quantiles(df: DataFrame, key: str, days: str) -> DataFrame:
    """Exact interpolated median and quartiles of a whole-day count per group.

    Values are counted first, so a group shrinks to its distinct day counts (a few thousand)
    before ``percentile`` sees it, however many rows it has.
    """
    counts = df.groupBy(key, days).agg(F.count("*").alias("_n"))
    marks = F.percentile(F.col(days), F.array(F.lit(0.5), F.lit(0.25), F.lit(0.75)), F.col("_n"))
    return counts.groupBy(key).agg(marks.alias("_q"), F.sum("_n").alias("n")).select(
        key, "n", F.col("_q")[0].alias("median"), F.col("_q")[1].alias("p25"),
        F.col("_q")[2].alias("p75"))


def exact_quantile(df: DataFrame, value: str, q: float) -> DataFrame:
    """Exact interpolated quantile of a continuous column, without one task seeing all values.

    The column is read twice, whatever its size: once for its count and a bracket of approximate quantiles around the
    wanted rank (their error is bounded, the bracket is twice as wide), once to fold everything outside the bracket
    into two counts and to count each value inside. That band is checkpointed. It is then narrowed bin by bin, 1,024
    bins at a time, until one value is left; the driver sees bins only. A bracket that misses the rank raises.
    Returns (n, value).
    """
    spark, accuracy = df.sparkSession, 10_000
    margin = 2 / accuracy
    x = F.col("x")
    rows = df.select(F.col(value).cast("double").alias("x")).filter(x.isNotNull())
    marks = F.array(F.lit(max(0.0, q - margin)), F.lit(min(1.0, q + margin)))
    n, bracket, *ends = rows.agg(F.count("*"), F.percentile_approx(x, marks, F.lit(accuracy)), F.min(x), F.max(x)).first()
    if not n:
        return spark.range(1).select(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("double").alias("value"))
    low, high = ends if n < 2 * accuracy else bracket  # a small column's bracket may be narrower than two ranks
    ensure_checkpoint_dir(spark)
    side = F.when(x < low, -1).when(x > high, 1).otherwise(0)
    folded = rows.groupBy(side.alias("side"), F.when(side == 0, x).alias("x")).agg(F.count("*").alias("c")).checkpoint()
    size = {r.side: r.c for r in folded.groupBy("side").agg(F.sum("c").alias("c")).collect()}
    wanted = (n - 1) * q
    ranks = math.floor(wanted), math.ceil(wanted)
    below = size.get(-1, 0)
    if not below <= ranks[0] <= ranks[1] < below + size.get(0, 0):
        raise ArithmeticError(f"the bracket {low} to {high} misses rank {wanted} of {n}")
    band = folded.filter("side = 0").select("x", "c")
    at = [_value_at(band, low, high, rank - below) for rank in dict.fromkeys(ranks)]
    result = at[0] + (at[-1] - at[0]) * (wanted - ranks[0])
    return spark.range(1).select(F.lit(n).cast("bigint").alias("n"), F.lit(float(result)).alias("value"))


def _value_at(band: DataFrame, low: float, high: float, rank: int, bins: int = 1024) -> float:
    """The value at a rank of counted values, by counting bins of ever smaller width."""
    x = F.col("x")
    while low < high:
        place = F.least(F.floor((x - F.lit(low)) / F.lit((high - low) / bins)), F.lit(bins - 1))
        counted = band.filter(x.between(low, high)).groupBy(place.alias("bin")).agg(
            F.sum("c").alias("c"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("low")
        for r in counted.collect():
            if rank < r.c:
                low, high = r.low, r.high
                break
            rank -= r.c
    return low


def group_quantiles(df: DataFrame, key: str, value: str, marks: Mapping[str, float], broadcast_groups: int = 10_000,
                    final_rows: int = 100_000, bins: int = 1024) -> DataFrame:
    """Exact interpolated quantiles of a continuous column per group, without a task holding a group.

    ``marks`` names the quantiles: {"p25": 0.25, "median": 0.5}. Null and NaN values are left out; groups without
    others are absent; a null key is a group. The input is read twice. The first read gives counts and, from a mergeable
    sketch, a bracket around each wanted rank of each group. The second joins brackets to rows, folds what lies below a
    bracket into one count per task and counts each value inside. This band is checkpointed and narrowed for all groups
    at once, ``bins`` bins at a time, until no group has more than ``final_rows`` values at a rank; a window finds the
    values. Brackets are broadcast for groups that hold at least one in ``broadcast_groups`` rows, of which there can be
    no more than that; the rows of smaller groups are joined by key. A bracket that misses its rank raises.
    """
    spark, accuracy = df.sparkSession, 10_000
    margin, x, c = 2 / accuracy, F.col("x"), F.col("c")
    rows = df.select(F.struct(key).alias("g"), F.col(value).cast("double").alias("x")).filter(
        x.isNotNull() & ~F.isnan(x))
    edges = [edge for q in marks.values() for edge in (max(0.0, q - margin), min(1.0, q + margin))]
    ensure_checkpoint_dir(spark)
    groups = rows.groupBy("g").agg(
        F.count("*").alias("n"),
        F.percentile_approx(x, F.array(*[F.lit(e) for e in edges]), F.lit(accuracy)).alias("edges"),
        F.array(*[F.min(x), F.max(x)] * len(marks)).alias("ends"))
    # a rank between two values needs a bracket of more than two, which shares of a small group need not reach
    groups = groups.select("g", "n", F.when(F.col("n") < 2 * accuracy, F.col("ends")).otherwise(F.col("edges")).alias(
        "edges")).checkpoint()

    def target(at: int, mark: str, q: float, side: str) -> Column:
        wanted = (F.col("n") - 1) * F.lit(q)
        return F.struct(F.lit(mark).alias("mark"), F.lit(side).alias("side"),
                        (F.floor(wanted) if side == "low" else F.ceil(wanted)).cast("long").alias("rank"),
                        F.col("edges")[2 * at].alias("low"), F.col("edges")[2 * at + 1].alias("high"))

    targets = groups.select("g", "n", F.explode(F.array(*[
        target(at, mark, q, side) for at, (mark, q) in enumerate(marks.items()) for side in ("low", "high")])).alias("t"))
    brackets = groups.select("g", "n", F.array(*[
        F.struct(F.lit(mark).alias("mark"), F.col("edges")[2 * at].alias("low"), F.col("edges")[2 * at + 1].alias("high"))
        for at, mark in enumerate(marks)]).alias("b"))
    found, total = groups.agg(F.count("*"), F.sum("n")).first()
    if found <= broadcast_groups:
        met = rows.join(F.broadcast(brackets), "g")
    else:
        large = F.col("n") * broadcast_groups >= F.lit(total)
        met = rows.join(F.broadcast(brackets.filter(large)), "g", "left")
        met = met.filter("b is not null").unionByName(
            met.filter("b is null").select("g", "x").join(brackets.filter(~large), "g"))
    inside = F.explode(F.filter("b", lambda b: x <= b["high"])).alias("b")
    met = met.select("g", "x", inside).select(
        "g", F.col("b.mark").alias("mark"), F.when(x >= F.col("b.low"), x).alias("x"))
    counted = met.groupBy("g", "mark", "x").agg(F.count("*").alias("c")).checkpoint()
    below = counted.filter(x.isNull()).select("g", "mark", F.col("c").alias("below"))
    band = counted.filter(x.isNotNull())

    todo = targets.select("g", "n", "t.*").join(below, ["g", "mark"], "left").withColumn(
        "rank", F.col("rank") - F.coalesce("below", F.lit(0))).drop("below")
    while True:
        within = band.join(todo, ["g", "mark"]).filter(x.between(F.col("low"), F.col("high")))
        sizes = within.groupBy("g", "mark", "side").agg(F.count("*").alias("values"))
        if not (sizes.agg(F.max("values")).first()[0] or 0) > final_rows:
            break
        low, high = F.greatest("low", F.lit(-sys.float_info.max)), F.least("high", F.lit(sys.float_info.max))
        width = high / bins - low / bins
        place = F.when(width > 0, F.least(F.floor(x / width - low / width), F.lit(bins - 1))).otherwise(F.lit(0))
        cells = within.groupBy("g", "n", "mark", "side", "rank", place.alias("bin")).agg(
            F.sum("c").alias("c"), F.min("x").alias("low"), F.max("x").alias("high"))
        before = F.sum("c").over(Window.partitionBy("g", "mark", "side").orderBy("bin")) - c  # at most ``bins`` rows
        todo = cells.withColumn("before", before).filter(
            (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + c)).select(
            "g", "mark", "n", "side", (F.col("rank") - F.col("before")).alias("rank"), "low", "high").checkpoint()
    up_to = F.sum("c").over(Window.partitionBy("g", "mark", "side").orderBy("x"))
    hits = within.withColumn("up_to", up_to).filter(
        (F.col("rank") >= F.col("up_to") - c) & (F.col("rank") < F.col("up_to")))
    pairs = hits.groupBy("g").agg(*[
        F.max(F.when((F.col("mark") == mark) & (F.col("side") == side), x)).alias(f"{mark} {side}")
        for mark in marks for side in ("low", "high")])

    def between(mark: str, q: float) -> Column:
        low, high = F.col(f"{mark} low"), F.col(f"{mark} high")
        wanted = (F.col("n") - 1) * F.lit(q)
        missed = F.raise_error(F.lit(f"the bracket of {mark} misses its rank")).cast("double")
        return F.when(low.isNull() | high.isNull(), missed).otherwise(low + (high - low) * (wanted - F.floor(wanted)))

    named = groups.join(pairs, "g", "left")
    return named.select(F.col(f"g.{key}").alias(key), "n", *[between(mark, q).alias(mark) for mark, q in marks.items()])


def histogram(df: DataFrame, col: str, width: float, top: float, *categories: Column) -> DataFrame:
    """Counts per fixed-width bin up to ``top`` and one bin; what is larger is in the last bin, which is open."""
    low = F.least(F.floor(F.col(col) / width) * width, F.lit(top + width)).cast("double")
    return (
        df.filter(F.col(col).isNotNull())
        .groupBy(low.alias("bin_lo"), *categories)
        .agg(F.count("*").alias("n"))
    )


def edge_histogram(df: DataFrame, col: str, bins: Sequence[tuple[str, float | None]],
                   category: str) -> DataFrame:
    """Counts per (a, b] bin and class."""
    value = F.col(col)
    position = ladder(value, bins, inclusive=True, ordinal=True)
    return (
        df.filter(value.isNotNull()).groupBy(position.alias("bin_ord"), category)
        .agg(F.count("*").alias("n")).withColumn("bin", label_at(F.col("bin_ord"), bins))
    )


def log_histogram(df: DataFrame, col: str, per_decade: int = 10) -> DataFrame:
    """Counts of positive values per logarithmic bin."""
    bin_no = F.floor(F.log10(F.col(col)) * per_decade).cast("int")
    return (
        df.filter(F.col(col) > 0).groupBy(bin_no.alias("log_bin"))
        .agg(F.count("*").alias("n"))
    )


def extremes(df: DataFrame, value: str, label: str) -> DataFrame:
    """Largest and smallest value with the label it belongs to; ties go to the first label."""
    v, name = F.col(value), F.col(label)
    known = df.filter(v.isNotNull())
    return known.agg(
        F.max(v).alias("max_value"), F.min_by(name, F.struct(-v, name)).alias("max_label"),
        F.min(v).alias("min_value"), F.min_by(name, F.struct(v, name)).alias("min_label"),
    )


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                  F.regr_count(y, x).alias("n"))


def daily(df: DataFrame, day: Column, measure: Column) -> DataFrame:
    return df.groupBy(day.alias("day")).agg(F.count("*").alias("n_units"),
                                            F.sum(measure).alias("amount"))


def recent(col: Column, as_of: dt.date, days: int) -> Column:
    """How many dates fall into the last ``days`` days."""
    return F.count_if(F.coalesce(col >= F.lit(as_of - dt.timedelta(days=days)), F.lit(False)))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).filter(F.col(col).isNotNull()).distinct()
