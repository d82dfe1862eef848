"""Running totals, changes and shares over already aggregated series.

The windows sort periods, categories or districts, never raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cumulative(df: DataFrame, keys: Sequence[str], order: str, measure: str, out: str) -> DataFrame:
    """Running total; rows that share an order value share the total (the default frame)."""
    return df.withColumn(out, F.sum(measure).over(Window.partitionBy(*keys).orderBy(order)))


def period_delta(df: DataFrame, order: str, measures: Sequence[str],
                 percent: bool = True) -> DataFrame:
    """Change against the previous period, absolute and relative; the first period has none."""
    w = Window.orderBy(order)
    out = {}
    for m in measures:
        before = F.lag(m).over(w)
        out[f"{m}_delta"] = F.col(m) - before
        if percent:
            out[f"{m}_delta_pct"] = F.try_divide(F.col(m) - before, before.cast("double"))
    return df.withColumns(out)


def yoy_month(df: DataFrame, years: Sequence[int], months: Sequence[int], year: str, month: str,
              measure: str) -> DataFrame:
    """Every (year, month) cell with its change against the same month a year before.

    ``years`` and ``months`` are what is asked for; rows of other cells are no part of the answer. Cells without data
    are 0. The first year has no change, nor has a month that was 0 before.
    """
    grid = df.sparkSession.range(1).select(
        F.explode(F.lit(list(years))).alias(year)).select(
        year, F.explode(F.lit(list(months))).alias(month))
    cells = grid.join(df, [year, month], "left").withColumn(
        measure, F.coalesce(F.col(measure), F.lit(0.0)))
    before = F.lag(measure).over(Window.partitionBy(month).orderBy(year))
    return cells.withColumn(
        "vs_prev_year", F.try_divide(F.col(measure) - before, F.nullif(before, F.lit(0.0))))


def pct_of_total(df: DataFrame, measure: str, out: str) -> DataFrame:
    """Share of the grand total. For aggregated tables: the window sees every row."""
    total = F.sum(measure).over(Window.partitionBy()).cast("double")
    return df.withColumn(out, F.try_divide(F.col(measure), F.nullif(total, F.lit(0.0))))


def pct_in_period(df: DataFrame, period: str, measure: str, out: str) -> DataFrame:
    total = F.sum(measure).over(Window.partitionBy(period)).cast("double")
    return df.withColumn(out, F.try_divide(F.col(measure) * 100, F.nullif(total, F.lit(0.0))))


def rank_by(df: DataFrame, measure: str, tiebreak: str, out: str = "rank") -> DataFrame:
    """Position by descending measure; rows without a measure are left out."""
    w = Window.orderBy(F.desc(measure), tiebreak)
    return df.filter(F.col(measure).isNotNull()).withColumn(out, F.row_number().over(w))


def rank_of(df: DataFrame, measure: str, key: str, name: str) -> DataFrame:
    return rank_by(df, measure, key).filter(F.col(key) == name)


def latest_per_key(df: DataFrame, keys: Sequence[str], ts: str, tiebreak: str | None = None) -> DataFrame:
    """The newest row of each key, exactly one on ties: the one with the greatest other columns.

    One maximum over a struct: it combines before the shuffle and carries each row once.
    """
    first = [ts, tiebreak] if tiebreak else [ts]
    rest = [c for c in df.columns if c not in (*keys, *first)]
    newest = df.groupBy(*keys).agg(F.max(F.struct(*first, *rest)).alias("_row"))
    return newest.select(*keys, "_row.*").select(*df.columns)


def vs_prior_month(monthly: DataFrame, month: str, measures: Sequence[str]) -> DataFrame:
    """Totals of the month before and the change in percent. Months without rows are not skipped
    over: only the calendar month right before counts."""
    w = Window.orderBy(month)
    adjacent = F.lag(month).over(w) == F.add_months(F.col(month), -1)
    out = {}
    for m in measures:
        before = F.when(adjacent, F.lag(m).over(w))
        out[f"{m}_prior"] = before
        out[f"{m}_change_pct"] = F.try_divide((F.col(m) - before) * 100, F.nullif(before, F.lit(0)))
    return monthly.withColumns(out)


def prior_daily_mean(daily: DataFrame, day: str, measure: str) -> DataFrame:
    """Each month with the daily mean of the month before, the reference line of a month chart."""
    months = daily.groupBy(F.trunc(day, "MM").alias("month")).agg(F.avg(measure).alias("daily_mean"))
    w = Window.orderBy("month")
    adjacent = F.lag("month").over(w) == F.add_months(F.col("month"), -1)
    return months.withColumn("prior_daily_mean", F.when(adjacent, F.lag("daily_mean").over(w)))
