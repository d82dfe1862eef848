"""Web access lines in the combined log format."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridledger.functions.convert import clock, log_time
from gridledger.functions.labels import device, page_slug
from gridledger.functions.predicates import is_entry_page

# fixed value: address, two ignored fields, [time], "METHOD path protocol", status, bytes, "referer", "agent"
COMBINED = (r'^([^ ]+) [^ ]+ [^ ]+ \[([^\]]+)\] "([A-Z]+) ([^ ]+) [^"]+" ([0-9]+) ([^ ]+)'
            r' "([^"]*)" "(.*)"$')
FIELDS = 8


def read_access_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_access_log(spark.read.text(path))


def parse_access_log(lines: DataFrame) -> DataFrame:
    """Typed columns of every line that fits the format; other lines are dropped. Streams too.

    One pattern match per line: it puts the fields on lines of their own, which a log line cannot
    contain, and a line that does not fit stays in one piece. Exploding the zero or one field list
    keeps the optimizer from matching once for the filter and again for every column.
    """
    apart = F.regexp_replace(F.trim("value"), COMBINED, "\n".join(f"${i}" for i in range(1, FIELDS + 1)))
    fields = F.filter(F.array(F.split(apart, "\n")), lambda f: F.size(f) == FIELDS)
    f = F.col("f")
    return lines.select(F.explode(fields).alias("f")).select(
        f[0].alias("ip"),
        log_time(f[1]).alias("time"),
        f[2].alias("method"),
        f[3].alias("path"),
        f[4].try_cast("int").alias("status"),
        f[5].try_cast("double").alias("bytes"),
        f[6].alias("referer"),
        f[7].alias("user_agent"),
    )


def tail_events(events: DataFrame, n: int, *tiebreak: str) -> DataFrame:
    """The last n events by time: each task keeps n, then n are merged."""
    return events.orderBy(F.desc_nulls_last("time"), *tiebreak).limit(n)


def page_views(requests: DataFrame) -> DataFrame:
    """Successful GETs of entry pages, with page and device."""
    return requests.filter(
        (F.col("method") == "GET") & F.col("status").isin(200, 304) & is_entry_page(F.col("path"))
    ).withColumns({"dashboard": page_slug(F.col("path")), "device": device(F.col("user_agent"))})


def recent_window(views: DataFrame, days: int, now: dt.datetime | None = None) -> DataFrame:
    """Views of the last ``days`` days before ``now``; undated views are left out.

    Without ``now`` the window ends at the newest view, so it is never empty; that costs a second
    pass over the log, as an aggregate.
    """
    end = views.select(F.max("time")).scalar() if now is None else clock(now)
    since = end - F.make_dt_interval(F.lit(days))
    return views.filter(F.col("time").isNotNull() & (F.col("time") >= since))
