"""Site traffic from access-log lines."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridledger.operators import aggregates as A
from gridledger.operators import ranking as L
from gridledger.plans.register import Register, access_lines
from gridledger.plans.registry import query
from gridledger.session import new_work_path
from gridledger.sources.access_log import page_views, parse_access_log, recent_window, tail_events
from gridledger.sources.log_tail import tail_lines

NOW = dt.datetime(2024, 1, 31)
_WINDOW = "page_views WHERE time >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY"
_NEWEST = "page_views WHERE time >= (SELECT max(time) FROM page_views) - INTERVAL 7 DAY"


def views(r: Register, days: int = 7, now: dt.datetime | None = NOW) -> DataFrame:
    return recent_window(page_views(parse_access_log(r.access_lines)), days, now)


def visitor_profile(page_hits: DataFrame) -> DataFrame:
    """Hits, last visit and modal device per address, from one pass over the views.

    The first step folds views by (address, device), so a busy address arrives as a few rows.
    """
    per_device = page_hits.groupBy("ip", "device").agg(
        F.count("*").alias("n"), F.max("time").alias("t"))
    return per_device.groupBy("ip").agg(
        F.sum("n").alias("hits"), F.max("t").alias("last_seen"),
        F.min_by("device", F.struct(-F.col("n"), F.col("device"))).alias("device"))


def traffic_summary(page_hits: DataFrame) -> DataFrame:
    """Hits and visitors in total and by day, hour, page and device, from one read of the views.

    Views are folded per address first; only the folded rows are copied once per summary.
    """
    dims = ["day", "hour", "dashboard", "device"]
    folded = page_hits.groupBy(
        F.date_format("time", "yyyy-MM-dd").alias("day"), F.date_format("time", "HH:00").alias("hour"),
        "dashboard", "device", "ip").agg(F.count("*").alias("n"))
    sets = [[], *[[F.col(d)] for d in dims]]
    grouped = folded.groupingSets(sets, *[F.col(d) for d in dims]).agg(
        F.grouping_id().cast("int").alias("level"), F.sum("n").alias("hits"),
        F.count_distinct("ip").alias("visitors"))
    everything = (1 << len(dims)) - 1
    names = F.create_map(F.lit(everything), F.lit("total"), *[
        F.lit(x) for i, d in enumerate(dims) for x in (everything - (1 << (len(dims) - 1 - i)), d)])
    return grouped.select(
        F.element_at(names, F.col("level")).alias("dimension"),
        F.coalesce(*dims, F.lit("all")).alias("label"), "hits", "visitors")


def _by(label: str, name: str) -> str:
    return (f"SELECT '{name}' AS dimension, {label} AS label, count(*) AS hits,"
            f" count(DISTINCT ip) AS visitors FROM {_WINDOW} GROUP BY 2")


@query("q54_traffic_summary", " UNION ALL ".join([
    f"SELECT 'total' AS dimension, 'all' AS label, count(*) AS hits, count(DISTINCT ip) AS visitors"
    f" FROM {_WINDOW}",
    _by("strftime(time, '%Y-%m-%d')", "day"), _by("strftime(time, '%H:00')", "hour"),
    _by("dashboard", "dashboard"), _by("device", "device")]))
def traffic(r: Register) -> DataFrame:
    return traffic_summary(views(r))


def _hits(label: Column, name: str, df: DataFrame) -> DataFrame:
    return A.freq(df.select(label.alias(name)), name, n="hits")


@query("q54_hits_by_day", f"SELECT cast(time AS date) AS day, count(*) AS hits FROM {_NEWEST} GROUP BY 1")
def hits_by_day(r: Register) -> DataFrame:
    return _hits(F.to_date("time"), "day", views(r, now=None))


@query("q54_hits_by_page", f"""
    SELECT dashboard, count(*) AS hits FROM {_WINDOW} GROUP BY 1""")
def hits_by_page(r: Register) -> DataFrame:
    return _hits(F.col("dashboard"), "dashboard", views(r))


@query("q55_visitor_profile", f"""
    SELECT ip, cast(sum(n) AS bigint) AS hits, strftime(max(t), '%Y-%m-%d %H:%M:%S') AS last_seen,
           arg_max(device, rank_key) AS device
    FROM (SELECT ip, device, n, t, -row_number() OVER (PARTITION BY ip ORDER BY n DESC, device) AS rank_key
          FROM (SELECT ip, device, count(*) AS n, max(time) AS t FROM {_WINDOW} GROUP BY 1, 2))
    GROUP BY 1""")
def visitors(r: Register) -> DataFrame:
    profile = visitor_profile(views(r))
    return profile.withColumn("last_seen", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss"))


@query("q55_recent_views", f"""
    SELECT strftime(time, '%Y-%m-%d %H:%M:%S') AS time, ip, dashboard, path, device, status
    FROM (SELECT * FROM {_WINDOW} ORDER BY time DESC, ip, path, user_agent, status LIMIT 200)""")
def recent_views(r: Register) -> DataFrame:
    top = L.most_recent(views(r), "time", 200, "ip", "path", "user_agent", "status")
    return top.select(F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("time"), "ip", "dashboard",
                      "path", "device", "status")


@query("s24_access_log", """
    SELECT ip, strftime(time, '%Y-%m-%d %H:%M:%S') AS time, method, path, status, bytes, referer,
           user_agent FROM access_events""")
def access_log(r: Register) -> DataFrame:
    return parse_access_log(r.access_lines).withColumn(
        "time", F.date_format("time", "yyyy-MM-dd HH:mm:ss"))


@query("s26_tail_events", """
    SELECT ip, strftime(time, '%Y-%m-%d %H:%M:%S') AS time, path, status FROM access_events
    ORDER BY time DESC, ip, path, status, user_agent LIMIT 1000""")
def tail(r: Register, n: int = 1000) -> DataFrame:
    last = tail_events(parse_access_log(r.access_lines), n, "ip", "path", "status", "user_agent")
    return last.select("ip", F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("time"), "path", "status")


@query("s26_tail_lines", """
    SELECT a.ip, strftime(a.time, '%Y-%m-%d %H:%M:%S') AS time, a.path, a.status
    FROM (SELECT event_id FROM events ORDER BY event_id DESC LIMIT 1000) e JOIN access_events a USING (event_id)""")
def tail_of_files(r: Register, n: int = 1000) -> DataFrame:
    """The last lines of log files, read from the files' ends."""
    folder = new_work_path(r.spark, "access-log")
    events = r.source("events").orderBy("event_id")
    access_lines(events).write.text(folder)
    last = parse_access_log(tail_lines(r.spark, folder, n))
    return last.select("ip", F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("time"), "path", "status")
