"""Streams must give what the same operator gives on the same rows as a table."""

import datetime as dt
import random

import pytest
from conftest import SF_DIR, rows
from pyspark.sql import functions as F

from gridledger.functions.convert import utc_instant
from gridledger.plans.register import Register
from gridledger.plans.streams import counter_samples, log_lines
from gridledger.streaming import counters as C
from gridledger.streaming import windows as W
from gridledger.streaming.ingest import ingest_snapshots
from gridledger.streaming.runner import append_available, late_rows, stream_parquet, to_latest, to_table


@pytest.fixture(scope="module")
def events(spark):
    return Register(spark, SF_DIR).source("events").withColumn("ts", utc_instant(F.col("ts")))


@pytest.fixture
def stream(spark, events, folder):
    """The events in time order over several files, one file per batch."""
    events.repartitionByRange(4, "ts").write.parquet(f"{folder}/in")
    return stream_parquet(spark, f"{folder}/in", events.schema, files_per_batch=1)


def closed(df, events, column="window_end"):
    last = events.agg(F.max("ts")).first()[0]
    return df.filter(F.col(column) <= F.lit(last - dt.timedelta(hours=1)))


@pytest.mark.parametrize("name, build", [
    ("windows", lambda e: W.traffic_windows(e, "1 hour", "event_type", ts="ts", watermark="60 days")),
    ("rolling", lambda e: W.traffic_rolling(e, 7, ts="ts", watermark="60 days")),
])
def test_nothing_closes_before_the_watermark(stream, events, folder, name, build):
    assert to_table(build(stream), f"{folder}/out").count() == 0
    assert build(events).count() > 0


@pytest.mark.parametrize("build", [
    lambda e: W.traffic_windows(e, "1 hour", "event_type", ts="ts"),
    lambda e: W.traffic_rolling(e, 7, ts="ts"),
    lambda e: W.gauge_ratio(e.withColumnRenamed("event_type", "metric"), "click", "view", "1 hour"),
    lambda e: W.match_count(log_lines(e), "error", "level=warn", "1 hour"),
    lambda e: W.probe_summary(e.select("ts", F.col("event_type").alias("target"),
                                       (F.col("value") < 50).alias("success"),
                                       F.floor("value").alias("duration")), "1 hour"),
    lambda e: C.counter_rate(counter_samples(e), "2 hours", "5 minutes", "event_id"),
], ids=["windows", "rolling", "gauge", "match", "probe", "counter"])
def test_stream_equals_table_where_windows_closed(spark, events, folder, build):
    events.coalesce(1).write.parquet(f"{folder}/in")
    one_file = stream_parquet(spark, f"{folder}/in", events.schema)
    got = to_table(build(one_file), f"{folder}/out")
    assert rows(got) == rows(closed(build(events), events)) and got.count() > 0


def test_latest_over_many_batches(stream, events, folder):
    build = lambda e: W.latest_stream(e.select("user_id", "ts", "event_id"), ["user_id"], "ts")
    assert rows(to_latest(build(stream), f"{folder}/out", ["user_id"])) == rows(build(events))


def test_repeated_polls_are_dropped(spark, events, folder):
    events.write.parquet(f"{folder}/in")
    events.write.mode("append").parquet(f"{folder}/in")
    twice = stream_parquet(spark, f"{folder}/in", events.schema)
    got = to_table(W.dedup_stream(twice, ["event_id", "ts"], "ts"), f"{folder}/out")
    assert got.count() == events.count() == W.dedup_stream(events.union(events), ["event_id", "ts"], "ts").count()


def test_late_rows_are_left_out_and_counted(spark, folder):
    def deliver(day, n):
        data = [(dt.datetime(2024, 1, day, 12, i), "x") for i in range(n)]
        df = spark.createDataFrame(data, "ts timestamp, k string")
        df.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        return df.schema

    schema = deliver(1, 3)
    build = lambda: W.traffic_windows(stream_parquet(spark, f"{folder}/in", schema), "1 hour", "k", ts="ts")
    to_table(build(), f"{folder}/out")
    deliver(5, 2)
    to_table(build(), f"{folder}/out")
    deliver(1, 7)  # four days late: one window's worth of rows
    assert late_rows(append_available(build(), f"{folder}/out")) == 1
    got = to_table(build(), f"{folder}/out")
    assert [r.hits for r in got.collect()] == [3]


def test_restart_neither_repeats_nor_loses(spark, events, folder):
    half = events.agg(F.expr("timestamp_micros(cast((unix_micros(min(ts)) + unix_micros(max(ts))) / 2 as bigint))")).first()[0]
    build = lambda: W.dedup_stream(stream_parquet(spark, f"{folder}/in", events.schema), ["event_id", "ts"], "ts")
    events.filter(F.col("ts") < half).coalesce(1).write.parquet(f"{folder}/in")
    to_table(build(), f"{folder}/out")
    events.filter(F.col("ts") >= half).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    to_table(build(), f"{folder}/out")
    got = to_table(build(), f"{folder}/out")
    assert rows(got.select("event_id")) == rows(events.select("event_id"))


def brute_rate(samples):
    """Increase and instant rate of one window's samples, restart-aware."""
    samples = sorted(samples)
    steps = [(b[2] - a[2]) if b[2] >= a[2] else b[2] for a, b in zip(samples, samples[1:])]
    if not steps:
        return None, None
    gap = (samples[-1][0] - samples[-2][0]).total_seconds()
    return sum(steps), (steps[-1] / gap if gap else None)


def test_counter_rate_against_brute_force(spark):
    random.seed(11)
    start = dt.datetime(2024, 1, 1)
    data, value = [], 0.0
    for i in range(1500):
        series = "hot" if i % 3 else random.choice(["a", "b"])
        value = 0.0 if random.random() < 0.01 else value + random.randint(0, 9)
        data.append((series, start + dt.timedelta(seconds=random.randint(0, 7200)), i, value))
    df = spark.createDataFrame(data, "series string, ts timestamp, n int, value double").repartition(4)
    got = {(r.series, r.window_start): r for r in C.counter_rate(df, "10 minutes", "1 minute", "n").collect()}
    windows = {}
    for series, ts, n, v in data:
        at = start + dt.timedelta(minutes=10 * int((ts - start).total_seconds() // 600))
        windows.setdefault((series, at), []).append((ts, n, v))
    assert set(got) == set(windows)
    for key, samples in windows.items():
        increase, instant = brute_rate(samples)
        row = got[key]
        assert row.samples == len(samples) and row.increase == increase
        assert (row.irate is None) == (instant is None) and (instant is None or row.irate == pytest.approx(instant))


def test_a_busy_cell_is_never_listed(spark):
    """A million samples of one series in one cell, with a restart every 1,000."""
    n = 1_000_000
    df = spark.range(n).select(
        F.lit("hot").alias("series"), F.timestamp_micros(F.col("id") * 60).alias("ts"), F.col("id").alias("n"),
        (F.col("id") % 1000).cast("double").alias("value"))
    rates = C.counter_rate(df, "10 minutes", "5 minutes", "n")
    plan = rates._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(struct" not in plan and plan.count("collect_list") == 1  # of folded cells
    row = rates.first()
    # a restart counts its new value, here 0
    assert (row.samples, row.increase) == (n, n - n // 1000)


def test_busy_share(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.7), (2, None)], "window_start int, rate double")
    assert dict(rows(C.busy_pct(df))) == {1: pytest.approx(20.0), 2: None}


def test_logfmt(spark):
    df = spark.createDataFrame([('a=1 msg="two words" a=2 empty= x.y=3',), ("nothing",)], "line string")
    got = [r[0] for r in df.select(W.parse_logfmt(F.col("line"))).collect()]
    assert got == [{"a": "1", "msg": "two words", "empty": "", "x.y": "3"}, {}]


def test_log_files_as_a_stream(spark, folder):
    from gridledger.sources.access_log import page_views, parse_access_log

    line = '1.2.3.4 - - [0{}/Jan/2024:03:04:05 +0000] "GET /karte HTTP/1.1" 200 5 "-" "X"'
    with open(f"{folder}/a.log", "w", encoding="utf-8") as f:
        f.write("\n".join([line.format(1)] * 3 + ["damaged", line.format(3)]) + "\n")
    lines = spark.readStream.option("pathGlobFilter", "*.log").text(folder)
    views = page_views(parse_access_log(lines)).withColumn("time", utc_instant(F.col("time")))
    got = to_table(W.traffic_windows(views, "1 day", "dashboard"), f"{folder}/out")
    assert [(r.dashboard, r.hits) for r in got.collect()] == [("karte", 3)]


def test_expiry(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", t, t + dt.timedelta(seconds=50)), ("a", t + dt.timedelta(seconds=10), t)],
                               "target string, ts timestamp, expires timestamp")
    assert W.expiry_left(df, ["target"], "ts", "expires").first().seconds_left == -10


def test_snapshots_are_ingested_once(spark, folder):
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-01")], "id int, snapshot string")

    def look():
        ingest_snapshots(spark, f"{folder}/in", df.schema, f"{folder}/t", f"{folder}/c")
        return spark.read.schema(df.schema).parquet(f"{folder}/t").count()

    df.write.partitionBy("snapshot").parquet(f"{folder}/in")
    assert look() == 2 and look() == 2
    df.limit(1).withColumn("snapshot", F.lit("2024-01-08")).write.mode("append").partitionBy("snapshot").parquet(f"{folder}/in")
    assert look() == 3


def test_table_dedup_keeps_the_first_by_time_then_value(spark):
    rows_ = [("a", 2, 1), ("a", 1, 9), ("a", 1, 5), ("b", 3, None), (None, 1, 1), (None, 1, 1)]
    for order in (rows_, rows_[::-1]):
        df = spark.createDataFrame(order, "k string, ts int, v int").repartition(3)
        got = W.dedup_stream(df, ["k"], "ts").collect()
        assert sorted(map(tuple, got), key=repr) == sorted([("a", 1, 5), ("b", 3, None), (None, 1, 1)], key=repr)


def counter_feed(spark, batches, per_batch):
    """One series, two cells of an hour; samples out of order over many files, and one that comes days late."""
    rng = random.Random(7)
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    samples = [("s", start + dt.timedelta(milliseconds=rng.randrange(7_200_000)), i, float(i * 13 % 997))
               for i in range(batches * per_batch)]
    closing = [("s", start + dt.timedelta(days=1), -1, 5.0), ("s", start + dt.timedelta(days=2), -2, 5.0),
               ("s", start + dt.timedelta(minutes=1), -3, 9.0), ("s", start + dt.timedelta(days=3), -4, 5.0)]
    parts = [samples[i * per_batch:(i + 1) * per_batch] for i in range(batches)] + [[row] for row in closing]
    schema = "series string, ts timestamp, k bigint, value double"
    return [spark.createDataFrame(part, schema) for part in parts], spark.createDataFrame(samples, schema)


def test_cells_collect_out_of_order_samples_and_leave_out_late_ones(spark, folder):
    parts, samples = counter_feed(spark, 6, 200)
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = stream_parquet(spark, f"{folder}/in", samples.schema, files_per_batch=1)
    got = to_table(C.counter_rate(stream, "2 hours", "1 hour", "k", watermark="3 hours"), f"{folder}/out")
    first = got.filter("window_start < '2024-01-01 02:00:00'")
    assert rows(first) == rows(C.counter_rate(samples, "2 hours", "1 hour", "k")) and first.count() == 1


def test_a_batch_writes_only_its_own_samples():
    import pandas as pd

    class State(list):
        def appendValue(self, value):
            self.append(value)

        def get(self):
            return iter(list(self))

    class Handle:
        def __init__(self):
            self.state, self.timers = State(), set()

        def getListState(self, name, schema):
            return self.state

        def registerTimer(self, at):
            self.timers.add(at)

    cells, handle = C.OpenCells("bigint", ["series", "at", "first_t", "first_v", "last_t", "last_v", "prev_t", "prev_v",
                                           "inner", "n"]), Handle()
    cells.init(handle)
    for batch in range(50):
        part = pd.DataFrame({"t": range(batch, 20_000, 50), "k": 0, "v": 1.0})
        assert list(cells.handleInputRows(("s", 3_600_000_000), iter([part]), None)) == []
    assert [len(t) for t, _, _ in handle.state] == [400] * 50 and handle.timers == {3_599_999}
    (cell,) = cells.handleExpiredTimer(("s", 3_600_000_000), None, None)
    assert (cell.n[0], cell.first_t[0], cell.last_t[0], cell.inner[0]) == (20_000, 0, 19_999, 0.0) and not handle.state


@pytest.mark.parametrize("values, inner", [([1.0, 4.0, 2.0], 5.0), ([None, 4.0, 5.0], 1.0), ([3.0, None, 5.0], 0.0)])
def test_folding_a_cell_is_what_the_sorted_window_gives(spark, values, inner):
    import pandas as pd

    folded = C.fold_samples(pd.DataFrame({"t": [0, 1, 2], "k": [0, 0, 0], "v": values}))
    table = spark.createDataFrame([("s", dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=t), 0, v)
                                   for t, v in enumerate(values)], "series string, ts timestamp, k bigint, value double")
    twin = C._cells_of_table(table, "1 hour", "ts", "series", "k", "value").first().c
    assert folded["inner"] == inner == twin.inner
    assert [folded[c] for c in ("first_v", "last_v", "prev_v", "n")] == [twin.first_v, twin.last_v, twin.prev_v, twin.n]
