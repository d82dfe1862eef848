"""Rates of counters that only grow, except when they restart from zero.

Samples are first folded per series and short cell, then per window, so a window combines a bounded
number of cells. Tables fold a cell with a sorted window that spills, whatever it holds. Streams keep the
samples of an open cell as a list in keyed state: a batch appends its own samples and writes nothing else
again, and a timer sorts and folds the cell once, when the watermark closes it. A worker holds one closing
cell at a time, so choose cells short enough for the busiest series.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructType, TimestampType


def growth(value: Column, previous: Column) -> Column:
    """Increase since the previous sample. After a restart the new value is all there is."""
    return F.when(value >= previous, value - previous).when(previous.isNotNull(), value)


def _pairwise_growth(items: Column, first: str, last: str) -> Column:
    """Sum of the growth from each item's last value to the next item's first value."""
    later = F.slice(items, F.lit(2), F.size(items))
    earlier = F.slice(items, F.lit(1), F.size(items) - 1)
    steps = F.zip_with(later, earlier, lambda now, before: growth(now[first], before[last]))
    return F.aggregate(steps, F.lit(0.0), lambda total, step: total + step)


def _cells_of_table(samples: DataFrame, cell: str, ts: str, series: str, tiebreak: str, value: str) -> DataFrame:
    """One row per series and cell; samples are only sorted and summed, never listed."""
    timed = samples.select(series, F.window(ts, cell).alias("cell"), F.col(ts).alias("t"), F.col(tiebreak).alias("k"),
                           F.col(value).alias("v"))
    order = Window.partitionBy(series, "cell").orderBy("t", "k")
    stepped = timed.withColumns({"prev_t": F.lag("t").over(order), "prev_v": F.lag("v").over(order)})
    ends = stepped.groupBy(series, "cell").agg(
        F.min(F.struct("t", "k", "v")).alias("first"), F.max(F.struct("t", "k", "v", "prev_t", "prev_v")).alias("last"),
        F.sum(growth(F.col("v"), F.col("prev_v"))).alias("inner"), F.count("*").cast("int").alias("n"))
    return ends.select(
        series, (F.col("cell.end") - F.expr("INTERVAL 1 MICROSECOND")).alias("at"),
        F.struct(
            F.col("first.t").alias("first_t"), F.col("first.v").alias("first_v"), F.col("last.t").alias("last_t"),
            F.col("last.v").alias("last_v"), F.col("last.prev_t").alias("prev_t"), F.col("last.prev_v").alias("prev_v"),
            F.coalesce("inner", F.lit(0.0)).alias("inner"), F.col("n").alias("n"),
        ).alias("c"))


def fold_samples(samples: pd.DataFrame) -> dict:
    """First, last and last but one sample of a cell and the growth in between, by time (t), tie rule (k) and value (v)."""
    samples = samples.sort_values(["t", "k", "v"], kind="stable")
    t, v = samples["t"].to_numpy(), samples["v"].to_numpy(dtype=float)
    before, now = v[:-1], v[1:]
    steps = np.where(now >= before, now - before, np.where(np.isnan(before), np.nan, now))
    ends = {"first_t": t[0], "first_v": v[0], "last_t": t[-1], "last_v": v[-1],
            "prev_t": t[-2] if len(t) > 1 else None, "prev_v": v[-2] if len(t) > 1 else None,
            "inner": float(np.nansum(steps)), "n": len(t)}
    return {name: None if x is None or x != x else x for name, x in ends.items()}


class OpenCells(StatefulProcessor):
    """Keeps the samples of each (series, end of cell) until event time passes the end, then emits one row for the cell."""

    def __init__(self, tiebreak_type: str, columns: list[str]):
        self.tiebreak_type, self.columns = tiebreak_type, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.samples = handle.getListState(
            "samples", f"t array<bigint>, k array<{self.tiebreak_type}>, v array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """A batch adds one entry with its own samples; entries already stored are neither read nor written."""
        parts = list(rows)
        self.samples.appendValue(tuple(
            [None if x != x else x for part in parts for x in part[name].tolist()] for name in ("t", "k", "v")))
        self.handle.registerTimer(key[1] // 1000 - 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        parts = [pd.DataFrame({"t": t, "k": k, "v": v}) for t, k, v in self.samples.get()]
        self.samples.clear()
        if parts:
            at = pd.Timestamp(key[1] - 1, unit="us", tz="UTC")
            row = {self.columns[0]: key[0], "at": at, **fold_samples(pd.concat(parts))}
            yield pd.DataFrame([row], columns=self.columns).astype(
                {"first_t": "Int64", "last_t": "Int64", "prev_t": "Int64", "n": "int32",
                 "first_v": "float64", "last_v": "float64", "prev_v": "float64"})

    def close(self) -> None:
        pass


def _cells_of_stream(samples: DataFrame, cell: str, ts: str, series: str, tiebreak: str, value: str) -> DataFrame:
    """The same row per series and cell, once the watermark has passed the end of the cell."""
    fields = samples.schema
    window = F.window(ts, cell)
    timed = samples.withColumn("cell", window).select(
        series, F.unix_micros("cell.end").alias("until"), F.window_time("cell").alias("at"),
        F.unix_micros(F.col(ts)).alias("t"), F.col(tiebreak).alias("k"), F.col(value).cast("double").alias("v"))
    out = StructType().add(series, fields[series].dataType).add("at", TimestampType())
    for name in ("first_t", "first_v", "last_t", "last_v", "prev_t", "prev_v", "inner"):
        out = out.add(name, LongType() if name.endswith("_t") else DoubleType())
    out = out.add("n", IntegerType())
    cells = timed.groupBy(series, "until").transformWithStateInPandas(
        OpenCells(fields[tiebreak].dataType.simpleString(), out.names), out, "append", "eventTime",
        eventTimeColumnName="at")
    return cells.select(series, "at", F.struct(*[
        F.timestamp_micros(name).alias(name) if name.endswith("_t") else F.col(name) for name in out.names[2:]]).alias("c"))


def counter_rate(samples: DataFrame, width: str, cell: str, tiebreak: str, ts: str = "ts",
                 series: str = "series", value: str = "value", watermark: str = "1 hour") -> DataFrame:
    """Per series and window: increase, mean rate over the sampled span, rate of the last two samples.

    Restarts count as growth from zero. A window with a single sample has no rate. ``cell`` must
    divide ``width``.
    """
    if samples.isStreaming:
        folded = _cells_of_stream(samples.withWatermark(ts, watermark), cell, ts, series, tiebreak, value)
    else:
        folded = _cells_of_table(samples, cell, ts, series, tiebreak, value)
    windows = folded.groupBy(F.window("at", width).alias("w"), series).agg(
        F.sort_array(F.collect_list("c")).alias("c"))
    c, last = F.col("c"), F.element_at("c", -1)
    before = F.try_element_at("c", F.lit(-2))
    samples_n = F.aggregate(c, F.lit(0), lambda total, x: total + x["n"])
    inner = F.aggregate(c, F.lit(0.0), lambda total, x: total + x["inner"])
    increase = F.when(samples_n > 1, inner + _pairwise_growth(c, "first_v", "last_v"))
    prev_t = F.coalesce(last["prev_t"], before["last_t"])
    prev_v = F.when(last["prev_t"].isNotNull(), last["prev_v"]).otherwise(before["last_v"])

    def seconds(end: Column, start: Column) -> Column:
        return F.nullif((F.unix_micros(end) - F.unix_micros(start)) / 1e6, F.lit(0.0))

    return windows.select(
        series, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        samples_n.alias("samples"), increase.alias("increase"),
        F.try_divide(increase, seconds(last["last_t"], c[0]["first_t"])).alias("rate"),
        F.try_divide(growth(last["last_v"], prev_v), seconds(last["last_t"], prev_t)).alias("irate"))


def busy_pct(idle_rates: DataFrame) -> DataFrame:
    """100 minus the mean idle rate over all series of a window."""
    return idle_rates.groupBy("window_start").agg((100 - F.avg("rate") * 100).alias("busy_pct"))
