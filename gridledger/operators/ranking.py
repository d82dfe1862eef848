"""Sort and limit. Every order ends in a unique tie-break, so results do not depend on partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top_k(df: DataFrame, col: str, k: int, tiebreak: Sequence[str]) -> DataFrame:
    """The k largest, missing values last. Each task keeps k rows, then k rows are merged."""
    return df.orderBy(F.desc_nulls_last(col), *tiebreak).limit(k)


def top_groups(df: DataFrame, keys: Sequence[str], measure: Column, name: str, k: int) -> DataFrame:
    return top_k(df.groupBy(*keys).agg(measure.alias(name)), name, k, list(keys))


def cap(df: DataFrame, n: int) -> DataFrame:
    """Any n rows: a listing, not a ranking."""
    return df.limit(n)


def order_by_label(df: DataFrame, col: str, labels: Sequence[str], *then: str) -> DataFrame:
    """Sort by a custom label order; labels outside the list come last."""
    position = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(col))
    rank = F.when(position > 0, position).otherwise(F.lit(len(labels) + 1))
    return df.withColumn("label_ord", rank.cast("int")).orderBy("label_ord", *then)


def most_recent(df: DataFrame, ts: str, n: int, *tiebreak: str) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(ts), *tiebreak).limit(n)
