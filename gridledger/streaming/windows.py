"""Windowed counts and means. Pass a watermark for streams; batch tables need none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _marked(df: DataFrame, ts: str, watermark: str) -> DataFrame:
    return df.withWatermark(ts, watermark) if df.isStreaming else df


def _flat(df: DataFrame, window: str = "window") -> DataFrame:
    rest = [c for c in df.columns if c != window]
    return df.select(F.col(f"{window}.start").alias("window_start"),
                     F.col(f"{window}.end").alias("window_end"), *rest)


def traffic_windows(views: DataFrame, width: str, *by: str, ts: str = "time",
                    watermark: str = "1 hour") -> DataFrame:
    """Hits per tumbling window and page."""
    counts = _marked(views, ts, watermark).groupBy(F.window(ts, width), *by).agg(
        F.count("*").alias("hits"))
    return _flat(counts)


def traffic_rolling(views: DataFrame, days: int, ts: str = "time", watermark: str = "1 hour", slide: str = "1 day") -> DataFrame:
    """Hits over the last ``days`` days, recomputed every ``slide`` (a day or an hour).

    Hits are counted per slide first and the long windows add up those counts, so a view is not copied into every window
    it belongs to; a count is.
    """
    counts = _marked(views, ts, watermark).groupBy(F.window(ts, slide)).agg(F.count("*").alias("n"))
    rolling = counts.groupBy(F.window(F.window_time("window"), f"{days} days", slide).alias("w"))
    return _flat(rolling.agg(F.sum("n").alias("hits")), "w")


def gauge_ratio(samples: DataFrame, num: str, den: str, width: str, ts: str = "ts",
                watermark: str = "1 hour") -> DataFrame:
    """Mean of one gauge over the mean of another, per window."""
    means = _marked(samples, ts, watermark).groupBy(F.window(ts, width)).agg(
        F.avg(F.when(F.col("metric") == num, F.col("value"))).alias("num"),
        F.avg(F.when(F.col("metric") == den, F.col("value"))).alias("den"),
    ).filter(F.col("num").isNotNull() | F.col("den").isNotNull())
    ratio = F.try_divide(F.col("num"), F.nullif(F.col("den"), F.lit(0.0)))
    return _flat(means.withColumn("ratio", ratio).drop("num", "den"))


def match_count(lines: DataFrame, job: str, text: str, width: str, ts: str = "ts",
                watermark: str = "1 hour") -> DataFrame:
    """Lines of one job that contain a text, per window that has any.

    The condition is counted, not filtered on: every line moves the watermark, so a quiet job's
    windows close on time.
    """
    hit = (F.col("job") == job) & F.col("line").contains(text)
    counts = _marked(lines, ts, watermark).groupBy(F.window(ts, width)).agg(F.count_if(hit).alias("n"))
    return _flat(counts.filter(F.col("n") > 0))


def probe_summary(probes: DataFrame, width: str, ts: str = "ts", watermark: str = "1 hour") -> DataFrame:
    """Availability and mean duration per target and window."""
    groups = _marked(probes, ts, watermark).groupBy(F.window(ts, width), "target")
    return _flat(groups.agg(F.avg(F.col("success").cast("double")).alias("availability"),
                            F.avg("duration").alias("mean_duration"), F.count("*").alias("probes")))


def probe_means(probes: DataFrame, width: str, *by: str, ts: str = "ts", watermark: str = "1 hour") -> DataFrame:
    """Mean duration per window and any of target, phase and status code, with the probes behind it."""
    groups = _marked(probes, ts, watermark).groupBy(F.window(ts, width), *by)
    return _flat(groups.agg(F.avg("duration").alias("mean_duration"), F.count("*").alias("probes")))


def parse_logfmt(line: Column) -> Column:
    """key=value text to a map; values may be quoted; the first of a repeated key wins."""
    pairs = F.regexp_extract_all(line, F.lit(r'[A-Za-z_][\w.]*=(?:"[^"]*"|\S*)'), F.lit(0))
    keys = F.transform(pairs, lambda p: F.substring_index(p, "=", 1))
    values = F.transform(
        pairs, lambda p: F.btrim(F.substr(p, F.instr(p, "=") + 1), F.lit('"')))
    names = F.array_distinct(keys)
    return F.map_from_arrays(
        names, F.transform(names, lambda k: F.element_at(values, F.array_position(keys, k).cast("int"))))


def expiry_left(samples: DataFrame, keys: list[str], ts: str, expires: str) -> DataFrame:
    """Seconds until expiry, as of the newest sample of each target."""
    last = samples.groupBy(*keys).agg(F.max(F.struct(
        F.col(ts).alias("seen"), F.col(expires).alias("expires"))).alias("_last"))  # of equal times the later expiry
    newest = last.select(*keys, "_last.*")
    seconds = F.col("expires").cast("bigint") - F.col("seen").cast("bigint")
    return newest.withColumn("seconds_left", seconds)


def latest_stream(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Newest row per key; on a stream, in update mode, each batch emits the keys that moved."""
    rest = [c for c in df.columns if c not in (*keys, ts)]
    newest = df.groupBy(*keys).agg(F.max(F.struct(ts, *rest)).alias("_row"))
    return newest.select(*keys, "_row.*").select(*df.columns)


def dedup_stream(df: DataFrame, keys: list[str], ts: str, watermark: str = "2 hours") -> DataFrame:
    """Drop rows seen before: polls fetch hours again. State is kept for the watermark only.

    A table keeps the row with the least time per key, of equal times the one with the least values, whatever their order.
    """
    if not df.isStreaming:
        rest = [c for c in df.columns if c not in (*keys, ts)]
        first = df.groupBy(*keys).agg(F.min(F.struct(*[c for c in (ts, *rest) if c not in keys])).alias("_row"))
        return first.select(*keys, "_row.*").select(*df.columns)
    return df.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys)
