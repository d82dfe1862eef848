"""Row-level reshaping: tolerant projection, normalisers, scaling, sampling."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridledger.functions.convert import to_iso_date
from gridledger.functions.labels import all_of, known_or_null
from gridledger.session import ensure_checkpoint_dir


def column_named(df: DataFrame, name: str) -> str | None:
    """The column's own spelling of ``name``, compared without regard to case."""
    return next((c for c in df.columns if c.lower() == name.lower()), None)


def has_column(df: DataFrame, name: str) -> bool:
    return column_named(df, name) is not None


def col_or_null(df: DataFrame, name: str, cast: str | None = None) -> Column:
    """The column if the table has it, else a typed NULL; the optional cast never fails."""
    found = column_named(df, name)
    if found is None:
        return F.lit(None).cast(cast or "string")
    return F.col(found).try_cast(cast) if cast else F.col(found)


def col_or_null_sql(df: DataFrame, name: str, cast: str | None = None) -> str:
    """``col_or_null`` as SQL text, for wide ``selectExpr`` projections."""
    found = column_named(df, name)
    if found is None:
        return f"cast(NULL AS {cast or 'string'})"
    return f"try_cast(`{found}` AS {cast})" if cast else f"`{found}`"


def filter_if_present(df: DataFrame, name: str, values: Sequence | None) -> DataFrame:
    """Apply a membership filter only where the column exists and something was chosen."""
    found = column_named(df, name)
    if found is None or not values:
        return df
    return df.filter(F.col(found).cast("string").isin(list(values)))


def plausible(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Keep rows whose columns all lie within their ranges, ends included."""
    tests = [F.col(c).try_cast("double").between(lo, hi) for c, (lo, hi) in ranges.items()]
    return df.filter(all_of(tests))


_CAPACITY_COLUMNS = {
    # fixed values: names the capacity field has had, with the divisor to kWh
    "NutzbareSpeicherkapazitaet": 1.0,
    "NutzbareSpeicherkapazitaetInKWh": 1.0,
    "SpeicherKapazitaet": 1.0,
    "NutzbareSpeicherkapazitaetInWh": 1000.0,
    "NutzbareSpeicherkapazitaetWh": 1000.0,
}


def _looks_like_capacity(name: str) -> bool:
    low = name.lower()
    if "datum" in low or "reserve" in low:
        return False
    return ("nutzbar" in low and "kapaz" in low) or ("kwh" in low and "speicher" in low)


def storage_compat(df: DataFrame) -> DataFrame:
    """One ``NutzbareSpeicherkapazitaet`` in kWh, whatever the release called the field.

    Known names win in a fixed order; failing those, every column that mentions a storage
    capacity; failing that, columns that look like one. The chemistry column is added if absent.
    """
    sources = [
        (column_named(df, name), divisor)
        for name, divisor in _CAPACITY_COLUMNS.items()
        if has_column(df, name)
    ]
    if not sources:
        sources = [(c, 1.0) for c in df.columns if "speicherkapaz" in c.lower()]
    if not sources:
        sources = [(c, 1.0) for c in df.columns if _looks_like_capacity(c)]
    used = {name for name, _ in sources}
    values = [F.col(c).try_cast("double") / F.lit(divisor) for c, divisor in sources]
    capacity = F.coalesce(*values) if values else F.lit(None).cast("double")
    out = [F.col(c) for c in df.columns if c not in used]
    out.append(capacity.alias("NutzbareSpeicherkapazitaet"))
    if not has_column(df, "Batterietechnologie"):
        out.append(F.lit(None).cast("string").alias("Batterietechnologie"))
    return df.select(*out)


def mask_measures(df: DataFrame, measures: Mapping[str, str], chosen: Sequence[str],
                  total: str) -> DataFrame:
    """Zero the measures whose type is not chosen and recompute the total. Nothing chosen is all."""
    keep = set(chosen or measures)
    masked = {col: F.col(col) if kind in keep else F.lit(0).cast("bigint")
              for kind, col in measures.items()}
    out = df.withColumns(masked)
    terms = [F.col(c) for c in measures.values()]
    return out.withColumn(total, sum(terms[1:], terms[0]))


def event_date(df: DataFrame, registered: str = "Registrierungsdatum",
               commissioned: str = "Inbetriebnahmedatum") -> Column:
    """Registration date where it parses, else the commissioning date."""
    return F.coalesce(to_iso_date(col_or_null(df, registered)), col_or_null(df, commissioned, "date"))


def scenario(df: DataFrame, percent: float, count_col: str, capacity_col: str) -> DataFrame:
    """Uplift a count (rounded half to even) and a capacity by a percentage."""
    factor = 1 + percent / 100.0
    return df.withColumns({
        count_col: F.bround(F.col(count_col) * factor).cast("bigint"),
        capacity_col: F.col(capacity_col) * factor,
    })


def extract_features(df: DataFrame, text: str, category: str, known: Sequence[str]) -> DataFrame:
    """Text length, and the category with unknown values blanked."""
    return df.withColumns({
        "extract_length": F.length(F.col(text)),
        category: known_or_null(F.col(category), known),
    })


def with_ranges(df: DataFrame, **values: Column) -> DataFrame:
    """Smallest and largest value of the whole set on every row, for all measures in one scalar
    subquery: an extra aggregate, but no join. Each range is a struct column of the given name."""
    ranges = [F.struct(F.min(v).alias("lo"), F.max(v).alias("hi")).alias(n) for n, v in values.items()]
    found = df.withColumn("_found", df.select(F.struct(*ranges)).scalar())
    return found.withColumns({n: F.col(f"_found.{n}") for n in values}).drop("_found")


def _with_range(df: DataFrame, value: Column) -> DataFrame:
    return with_ranges(df, _range=value)


def scale_idx(df: DataFrame, col: str, out: str, steps: int = 100,
              low: float | None = None, high: float | None = None, known: str | None = None) -> DataFrame:
    """Position 1..steps of a value within a range, by default the range of the whole set.

    ``known`` names a column of ``with_ranges`` that already holds it.

    A missing value, or a range without width, has no position.
    """
    if known:
        ranged = df.withColumn("_range", F.col(known))
    elif low is None or high is None:
        ranged = _with_range(df, F.col(col))
    else:
        ranged = df.withColumn("_range", F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi")))
    lo, hi = F.col("_range.lo"), F.col("_range.hi")
    share = F.try_divide((F.col(col) - lo).cast("double"), (hi - lo).cast("double"))
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    index = F.floor(inside * (steps - 1) + 1).cast("int")
    return ranged.withColumn(out, F.when(share.isNotNull(), index)).drop("_range")


def rescale_sqrt(df: DataFrame, col: str, out: str, low: float = 6.0, high: float = 22.0,
                 known: str | None = None) -> DataFrame:
    """Square root of a value mapped linearly onto [low, high]; one single value sits in the middle.

    ``known`` names a column of ``with_ranges`` that already holds the range of the root.
    """
    root = F.sqrt(F.col(col))
    lo, hi = F.col("_range.lo"), F.col("_range.hi")
    share = F.coalesce(F.try_divide(root - lo, hi - lo), F.lit(0.5))
    placed = F.when(root.isNotNull(), low + share * (high - low))
    ranged = df.withColumn("_range", F.col(known)) if known else _with_range(df, root)
    return ranged.withColumn(out, placed).drop("_range")


def clamp_range(df: DataFrame, as_of: dt.date, start: str = "start", end: str = "end",
                max_days: int = 31) -> DataFrame:
    """Make requested date ranges usable: default week, start no later than end, end at most
    tomorrow, and no longer than ``max_days`` counted back from the end."""
    today = F.lit(as_of)
    missing = F.col(start).isNull() | F.col(end).isNull()
    last = F.least(F.greatest(F.col(start), F.col(end)), F.date_add(today, 1))
    too_long = F.datediff(last, F.col(start)) + 1 > max_days
    first = F.when(too_long, F.date_sub(last, max_days - 1)).otherwise(F.col(start))
    return df.withColumns({
        "clamped_start": F.when(missing, F.date_sub(today, 6)).otherwise(first),
        "clamped_end": F.when(missing, today).otherwise(last),
    })


def every_kth(df: DataFrame, max_n: int, order: Sequence[str]) -> DataFrame:
    """Every k-th row in key order, k the smallest step that leaves at most ``max_n`` rows.

    Only the keys are sorted: they are range-partitioned on the full order, numbered inside their
    partition, and shifted by the sizes of the partitions before. The numbered keys are
    checkpointed first so that both readings see the same partitions. At most ``max_n`` of them
    are then broadcast to pick the rows. ``order`` must be unique.
    """
    ensure_checkpoint_dir(df.sparkSession)
    numbered = (
        df.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumns({
            "_part": F.spark_partition_id(),
            "_pos": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)),
        })
        .checkpoint()
    )
    # one row per partition, so the window below sorts as many rows as the job had tasks
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = sizes.select(
        "_part",
        (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(Window.partitionBy()).alias("_total"),
    )
    step = F.greatest(F.lit(1), F.ceil(F.col("_total") / max_n))
    kept = (
        numbered.join(F.broadcast(offsets), "_part")
        .filter((F.col("_before") + F.col("_pos")) % step == 0)
        .select(*[F.col(c).alias(f"_kept_{c}") for c in order])
    )
    same = [F.col(c).eqNullSafe(F.col(f"_kept_{c}")) for c in order]
    return df.join(F.broadcast(kept), same, "left_semi")


def sample_n(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """Fixed-seed random sample of n rows. The draw depends on the key, not on the partitioning."""
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return df.withColumn("_draw", draw).orderBy("_draw", key).limit(n).drop("_draw")
