"""Stream operators run to the end of the available input.

Each query reads its table as a file stream, lets the stream finish, and returns what the sink
holds. Windows still open at the end of the input are not in the sink, nor in the SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridledger.functions.convert import utc_clock, utc_instant
from gridledger.plans.register import Register, access_lines
from gridledger.plans.registry import query
from gridledger.session import new_work_path
from gridledger.sources.access_log import page_views, parse_access_log
from gridledger.streaming import counters as C
from gridledger.streaming import windows as W
from gridledger.streaming.ingest import ingest_snapshots
from gridledger.streaming.runner import stream_parquet, to_latest, to_table


def event_stream(r: Register) -> DataFrame:
    """The events as a stream, with event time as an instant."""
    events = stream_parquet(r.spark, r.path("events"), r.source("events").schema)
    return events.withColumn("ts", utc_instant(F.col("ts")))


def work(r: Register, label: str) -> str:
    return new_work_path(r.spark, f"stream-{label}")


def stamp(col: str) -> Column:
    return F.date_format(utc_clock(F.col(col)), "yyyy-MM-dd HH:mm:ss").alias(col)


def stamped(df: DataFrame) -> DataFrame:
    """Window bounds as UTC text."""
    return df.select(*[stamp(c) if c.startswith("window_") else F.col(c) for c in df.columns])


_CLOSED = "(SELECT max(ts) FROM events) - INTERVAL 1 HOUR"


def _window_sql(body: str, where: str = "true") -> str:
    return body.format(
        w="strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start,"
          " strftime(w + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end",
        src=f"(SELECT *, date_trunc('hour', ts) AS w FROM events WHERE {where})"
            f" WHERE w + INTERVAL 1 HOUR <= {_CLOSED}")


@query("t01_traffic_windows", """
    SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start,
           strftime(w + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, dashboard, count(*) AS hits
    FROM (SELECT *, date_trunc('hour', time) AS w FROM page_views)
    WHERE w + INTERVAL 1 HOUR <= (SELECT max(time) FROM page_views) - INTERVAL 1 HOUR
    GROUP BY w, dashboard""")
def traffic_windows(r: Register) -> DataFrame:
    """Raw log lines to hourly page counts, as a stream."""
    events = stream_parquet(r.spark, r.path("events"), r.source("events").schema)
    views = page_views(parse_access_log(access_lines(events)))
    views = views.withColumn("time", utc_instant(F.col("time")))
    return stamped(to_table(W.traffic_windows(views, "1 hour", "dashboard"), work(r, "traffic")))


@query("t01_traffic_days", """
    SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start,
           strftime(w + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end, count(*) AS hits
    FROM (SELECT *, date_trunc('day', time) AS w FROM page_views)
    WHERE w + INTERVAL 1 DAY <= (SELECT max(time) FROM page_views) - INTERVAL 1 HOUR
    GROUP BY w""")
def traffic_days(r: Register) -> DataFrame:
    """Raw log lines to daily counts over all pages, as a stream."""
    events = stream_parquet(r.spark, r.path("events"), r.source("events").schema)
    views = page_views(parse_access_log(access_lines(events)))
    views = views.withColumn("time", utc_instant(F.col("time")))
    return stamped(to_table(W.traffic_windows(views, "1 day"), work(r, "traffic-days")))


def _rolling_sql(days: int) -> str:
    return f"""
    WITH daily AS (SELECT cast(ts AS date) AS d, count(*) AS n FROM events
                   WHERE cast(ts AS date) + INTERVAL 1 DAY <= {_CLOSED} GROUP BY 1),
    ends AS (SELECT DISTINCT d + CAST(unnest(range(0, {days})) AS INTEGER) AS last_day FROM daily)
    SELECT strftime(last_day - {days - 1}, '%Y-%m-%d 00:00:00') AS window_start,
           strftime(last_day + 1, '%Y-%m-%d 00:00:00') AS window_end, sum(n)::BIGINT AS hits
    FROM ends JOIN daily ON d BETWEEN last_day - {days - 1} AND last_day
    WHERE last_day + INTERVAL 1 DAY <= {_CLOSED} GROUP BY last_day"""


def rolling(r: Register, days: int, slide: str = "1 day") -> DataFrame:
    return stamped(to_table(W.traffic_rolling(event_stream(r), days, ts="ts", slide=slide), work(r, f"rolling-{days}")))


@query("t02_traffic_rolling", _rolling_sql(7))
def traffic_week(r: Register) -> DataFrame:
    return rolling(r, 7)


@query("t02_traffic_rolling_day", f"""
    WITH hourly AS (SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM events
                    WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= {_CLOSED} GROUP BY 1),
    ends AS (SELECT DISTINCT h + to_hours(CAST(unnest(range(0, 24)) AS INTEGER)) AS last_hour FROM hourly)
    SELECT strftime(last_hour - INTERVAL 23 HOUR, '%Y-%m-%d %H:%M:%S') AS window_start,
           strftime(last_hour + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, sum(n)::BIGINT AS hits
    FROM ends JOIN hourly ON h BETWEEN last_hour - INTERVAL 23 HOUR AND last_hour
    WHERE last_hour + INTERVAL 1 HOUR <= {_CLOSED} GROUP BY last_hour""")
def traffic_day(r: Register) -> DataFrame:
    """The last 24 hours, moved by the hour."""
    return rolling(r, 1, "1 hour")


@query("t02_traffic_rolling_month", _rolling_sql(30))
def traffic_month(r: Register) -> DataFrame:
    return rolling(r, 30)


def counter_samples(events: DataFrame) -> DataFrame:
    """A counter per event type that grows with the event number and restarts every 500."""
    return events.select(F.col("event_type").alias("series"), "ts", "event_id",
                         (F.col("event_id") % 500).cast("double").alias("value"))


_COUNTER = """
    SELECT series, w, count(*) AS samples, sum(g) AS increase,
           sum(g) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) AS rate,
           max(CASE WHEN back = 1 THEN g / ((epoch_us(ts) - epoch_us(pt)) / 1e6) END) AS irate
    FROM (SELECT *, CASE WHEN value >= pv THEN value - pv WHEN pv IS NOT NULL THEN value END AS g
          FROM (SELECT *, lag(value) OVER p AS pv, lag(ts) OVER p AS pt,
                       row_number() OVER (PARTITION BY series, w ORDER BY ts DESC, event_id DESC) AS back
                FROM (SELECT event_type AS series, ts, event_id, cast(event_id % 500 AS double) AS value,
                             time_bucket(INTERVAL 2 HOUR, ts) AS w FROM events)
                WINDOW p AS (PARTITION BY series, w ORDER BY ts, event_id)))
    GROUP BY 1, 2"""


def _counter_sql(where: str = "true") -> str:
    return f"""
    SELECT series, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start,
           strftime(w + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end,
           cast(samples AS integer) AS samples, increase, round(rate, 9) AS rate, round(irate, 9) AS irate
    FROM ({_COUNTER}) WHERE {where}"""


def _rates(df: DataFrame) -> DataFrame:
    return stamped(df).withColumns({"rate": F.round("rate", 9), "irate": F.round("irate", 9)})


@query("t03_counter_rate", _counter_sql())
def counter_rate(r: Register) -> DataFrame:
    events = r.source("events").withColumn("ts", utc_instant(F.col("ts")))
    return _rates(C.counter_rate(counter_samples(events), "2 hours", "5 minutes", "event_id"))


@query("t03_counter_rate_stream", _counter_sql(f"w + INTERVAL 2 HOUR <= {_CLOSED}"))
def counter_rate_stream(r: Register) -> DataFrame:
    rates = C.counter_rate(counter_samples(event_stream(r)), "2 hours", "5 minutes", "event_id")
    return _rates(to_table(rates, work(r, "rate")))


@query("t05_busy_pct", f"""
    SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, round(100 - avg(rate) * 100, 6) AS busy_pct
    FROM ({_COUNTER}) GROUP BY w""")
def busy_pct(r: Register) -> DataFrame:
    events = r.source("events").withColumn("ts", utc_instant(F.col("ts")))
    rates = C.counter_rate(counter_samples(events), "2 hours", "5 minutes", "event_id")
    return stamped(C.busy_pct(rates)).withColumn("busy_pct", F.round("busy_pct", 6))


@query("t04_gauge_ratio", _window_sql("""
    SELECT {w}, avg(floor(value * 8)) FILTER (WHERE event_type = 'click')
                / nullif(avg(floor(value * 8)) FILTER (WHERE event_type = 'view'), 0) AS ratio
    FROM {src} GROUP BY w""", "event_type IN ('click', 'view')"))
def gauge_ratio(r: Register) -> DataFrame:
    samples = event_stream(r).select("ts", F.col("event_type").alias("metric"),
                                     F.floor(F.col("value") * 8).cast("double").alias("value"))
    return stamped(to_table(W.gauge_ratio(samples, "click", "view", "1 hour"), work(r, "gauge")))


def log_lines(events: DataFrame) -> DataFrame:
    """key=value lines of one job per event type."""
    line = F.format_string('level=%s msg="item %d stored" dur=%s user=%d level=dup',
                           F.when(F.col("value") > 100, "warn").otherwise("info"), "event_id",
                           F.col("value").cast("string"), "user_id")
    return events.select("ts", "event_id", F.col("event_type").alias("job"), line.alias("line"))


@query("t06_match_count", _window_sql("""
    SELECT {w}, count(*) AS n FROM {src} AND event_type = 'error' AND value > 100 GROUP BY w"""))
def match_count(r: Register) -> DataFrame:
    counts = W.match_count(log_lines(event_stream(r)), "error", "level=warn", "1 hour")
    return stamped(to_table(counts, work(r, "match")))


@query("t07_parse_logfmt", """
    SELECT event_id, CASE WHEN value > 100 THEN 'warn' ELSE 'info' END AS level,
           concat('item ', event_id, ' stored') AS msg, value AS dur, user_id AS "user" FROM events""")
def parsed_lines(r: Register) -> DataFrame:
    fields = log_lines(r.source("events")).select("event_id", W.parse_logfmt(F.col("line")).alias("kv"))
    return fields.select(
        "event_id", F.col("kv")["level"].alias("level"), F.col("kv")["msg"].alias("msg"),
        F.col("kv")["dur"].try_cast("double").alias("dur"), F.col("kv")["user"].try_cast("bigint").alias("user"))


@query("t08_probe_summary", _window_sql("""
    SELECT {w}, event_type AS target, avg(CASE WHEN value < 100 THEN 1e0 ELSE 0e0 END) AS availability,
           avg(floor(value * 8) * 125e-3) AS mean_duration, count(*) AS probes
    FROM {src} GROUP BY w, event_type"""))
def probe_summary(r: Register) -> DataFrame:
    probes = event_stream(r).select("ts", F.col("event_type").alias("target"),
                                    (F.col("value") < 100).cast("int").alias("success"),
                                    (F.floor(F.col("value") * 8) * 0.125).alias("duration"))
    return stamped(to_table(W.probe_summary(probes, "1 hour"), work(r, "probe")))


@query("t08_probe_phases", _window_sql("""
    SELECT {w}, event_type AS target, CASE user_id % 3 WHEN 0 THEN 'resolve' WHEN 1 THEN 'connect' ELSE 'transfer' END AS phase,
           avg(floor(value * 8) * 125e-3) AS mean_duration, count(*) AS probes
    FROM {src} GROUP BY w, 3, 4"""))
def probe_phases(r: Register) -> DataFrame:
    """Mean duration of each phase of a probe."""
    phase = F.when(F.col("user_id") % 3 == 0, "resolve").when(F.col("user_id") % 3 == 1, "connect").otherwise("transfer")
    probes = event_stream(r).select("ts", F.col("event_type").alias("target"), phase.alias("phase"),
                                    (F.floor(F.col("value") * 8) * 0.125).alias("duration"))
    return stamped(to_table(W.probe_means(probes, "1 hour", "target", "phase"), work(r, "phases")))


@query("t08_probe_status", _window_sql("""
    SELECT {w}, cast(CASE WHEN value < 50 THEN 200 WHEN value < 100 THEN 302 ELSE 503 END AS integer) AS status,
           avg(floor(value * 8) * 125e-3) AS mean_duration, count(*) AS probes
    FROM {src} GROUP BY w, 3"""))
def probe_status(r: Register) -> DataFrame:
    """Probes and mean duration per status code."""
    status = F.when(F.col("value") < 50, 200).when(F.col("value") < 100, 302).otherwise(503)
    probes = event_stream(r).select("ts", status.alias("status"), (F.floor(F.col("value") * 8) * 0.125).alias("duration"))
    return stamped(to_table(W.probe_means(probes, "1 hour", "status"), work(r, "status")))


@query("t09_expiry_left", """
    SELECT user_id, cast(arg_max(event_id, ts) % 90 * 86400 AS bigint) AS seconds_left FROM events GROUP BY 1""")
def expiry_left(r: Register) -> DataFrame:
    events = r.source("events").withColumn("ts", F.date_trunc("second", utc_instant(F.col("ts"))))
    expires = F.timestamp_seconds(F.col("ts").cast("bigint") + F.col("event_id") % 90 * 86400)
    samples = events.select("user_id", "ts", expires.alias("expires"))
    return W.expiry_left(samples, ["user_id"], "ts", "expires").select("user_id", "seconds_left")


@query("t10_latest_stream", """
    SELECT user_id, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS event_type,
           arg_max(value, ts) AS value
    FROM events GROUP BY 1""")
def latest_events(r: Register) -> DataFrame:
    events = event_stream(r).select("user_id", "ts", "event_id", "event_type", "value")
    return to_latest(W.latest_stream(events, ["user_id"], "ts"), work(r, "latest"), ["user_id"]).drop("ts")


@query("t11_ingest_snapshots", """
    SELECT strftime(date_trunc('year', o_orderdate), '%Y-%m-%d') AS snapshot, count(*) AS rows FROM orders GROUP BY 1""")
def ingested(r: Register) -> DataFrame:
    """Orders land in two deliveries; both are taken once, and a third look takes nothing."""
    base = work(r, "ingest")
    year = F.date_format(F.date_trunc("year", "o_orderdate"), "yyyy-MM-dd")
    rows = r.source("orders").select("o_orderkey", year.alias("snapshot"))

    def deliver(condition: str) -> None:
        rows.filter(condition).write.partitionBy("snapshot").mode("append").parquet(f"{base}/landing")

    def look() -> None:
        ingest_snapshots(r.spark, f"{base}/landing", rows.schema, f"{base}/table", f"{base}/checkpoint")

    deliver("snapshot < '1998-01-01'")
    look()
    deliver("snapshot >= '1998-01-01'")
    look()
    look()
    table = r.spark.read.schema(rows.schema).parquet(f"{base}/table")
    return table.groupBy("snapshot").agg(F.count("*").alias("rows"))


@query("t12_dedup_stream", "SELECT event_id, event_type, value FROM events")
def deduplicated(r: Register) -> DataFrame:
    """Every event arrives twice, as when a poll fetches the same hours again."""
    twice = event_stream(r).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    out = to_table(W.dedup_stream(twice, ["event_id", "ts"], "ts"), work(r, "dedup"))
    return out.select("event_id", "event_type", "value")
