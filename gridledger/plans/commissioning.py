"""When units were commissioned and registered: mixes, matrices, deltas, delays, year-to-date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridledger.catalog import DELAY_BINS, SIZE_BUCKETS_17
from gridledger.functions.convert import code_text, norm_plz, to_iso_date
from gridledger.functions.labels import (
    label_at,
    month_name_de,
    quarter_label,
    segment3,
    size_bucket17_ord,
    year_quarter_label,
)
from gridledger.functions.predicates import (
    in_list_or_all,
    in_states,
    is_active,
    is_battery,
    year_between,
    ytd,
)
from gridledger.operators import aggregates as A
from gridledger.operators import projection as P
from gridledger.operators import windows as W
from gridledger.plans.register import AS_OF, Register
from gridledger.plans.registry import query
from gridledger.plans.shaping import (
    CHECKED_BUCKETS_17,
    CHECKED_DELAYS,
    mw,
    sql_bucket17,
    sql_ladder,
    sql_ladder_ord,
    sql_segment3,
)

DAY = "Inbetriebnahmedatum"
KW = "Bruttoleistung"
BUCKETS = [label for label, _ in SIZE_BUCKETS_17]
ORDINALS = list(range(1, len(BUCKETS) + 1))
QUARTERS = ["Q1", "Q2", "Q3", "Q4"]


def dated(df: DataFrame, first: int = 1995, last: int = 2001, active: bool = False) -> DataFrame:
    rows = df.filter(year_between(F.col(DAY), first, last))
    return rows.filter(is_active(rows)) if active else rows


# ------------------------------------------------------------------------------- size mix

_MIX = f"""
    SELECT cast(date_trunc('month', {DAY}) AS date) AS month, {sql_bucket17(KW)} AS bucket,
           {sql_ladder_ord(KW, CHECKED_BUCKETS_17, '<=')} AS bucket_ord,
           sum({KW}) / 1000 AS mw, count(*) AS units
    FROM solar
    WHERE {KW} IS NOT NULL AND year({DAY}) BETWEEN 1996 AND 2000
      AND Nutzungsbereich IN ('1', '2', '3', '4', '5') AND Einspeisungsart = '688'
      AND Leistungsbegrenzung IN (801, 802, 803, 804)
    GROUP BY 1, 2, 3"""


def size_mix(r: Register) -> DataFrame:
    """Solar build-out per month and size bucket, under the usage, feed-in and limit filters."""
    rows = dated(r.solar, 1996, 2000).filter(F.col(KW).isNotNull())
    rows = P.filter_if_present(rows, "Nutzungsbereich", ["1", "2", "3", "4", "5"])
    rows = P.filter_if_present(rows, "Einspeisungsart", ["688"])
    # the limit was typed as a number; its code is compared as text
    rows = rows.filter(
        in_list_or_all(code_text(F.col("Leistungsbegrenzung")), ["801", "802", "803", "804"]))
    return rows.groupBy(
        F.trunc(DAY, "MM").alias("month"), size_bucket17_ord(F.col(KW)).alias("bucket_ord"),
    ).agg(mw(KW).alias("mw"), F.count("*").alias("units")).withColumn(
        "bucket", label_at(F.col("bucket_ord"), SIZE_BUCKETS_17))


@query("q28_size_mix_mw", f"""
    SELECT month, {", ".join(f"coalesce(sum(mw) FILTER (WHERE bucket = '{b}'), 0) AS \"{b}\"" for b, _ in CHECKED_BUCKETS_17)}
    FROM ({_MIX}) GROUP BY 1""")
def size_mix_mw(r: Register) -> DataFrame:
    return A.pivot_sum(size_mix(r), ["month"], "bucket_ord", ORDINALS, "mw", BUCKETS)


@query("q28_size_mix_units", f"""
    SELECT month, {", ".join(f"cast(coalesce(sum(units) FILTER (WHERE bucket = '{b}'), 0) AS bigint) AS \"{b}\"" for b, _ in CHECKED_BUCKETS_17)}
    FROM ({_MIX}) GROUP BY 1""")
def size_mix_units(r: Register) -> DataFrame:
    return A.pivot_sum(size_mix(r), ["month"], "bucket_ord", ORDINALS, "units", BUCKETS)


@query("q28_size_mix_share", f"""
    SELECT month, bucket, bucket_ord, mw, units,
           round(mw * 100 / nullif(sum(mw) OVER (PARTITION BY month), 0), 6) AS share_pct
    FROM ({_MIX})""")
def size_mix_share(r: Register) -> DataFrame:
    shared = W.pct_in_period(size_mix(r), "month", "mw", "share_pct")
    return shared.withColumn("share_pct", F.round("share_pct", 6))


# ------------------------------------------------------------------------------- size matrix


def _matrix_sql(kw: str) -> str:
    return f"""
    SELECT bucket, bucket_ord, units, mw, units_total, mw_total,
           round(units / units_total, 9) AS units_share, round(mw / mw_total, 9) AS mw_share
    FROM (SELECT *, cast(sum(units) OVER () AS bigint) AS units_total,
                 round(sum(mw) OVER (), 6) AS mw_total
          FROM (SELECT {sql_bucket17(kw)} AS bucket,
                       {sql_ladder_ord(kw, CHECKED_BUCKETS_17, '<=')} AS bucket_ord,
                       count(*) AS units, sum({kw}) / 1000 AS mw
                FROM solar WHERE {DAY} IS NOT NULL AND {kw} IS NOT NULL
                  AND Bundesland IN ('1403', '1415') GROUP BY 1, 2))"""


def bucket_matrix(r: Register, kw: str) -> DataFrame:
    rows = r.solar.filter(
        F.col(DAY).isNotNull() & F.col(kw).isNotNull()
        & in_states(F.col("Bundesland"), ["Bayern", "Thüringen"]))
    matrix = A.bucket_matrix(rows, kw, SIZE_BUCKETS_17)
    return matrix.withColumns({
        "mw_total": F.round("mw_total", 6), "units_share": F.round("units_share", 9),
        "mw_share": F.round("mw_share", 9)})


@query("q29_bucket_matrix_gross", _matrix_sql("Bruttoleistung"))
def bucket_matrix_gross(r: Register) -> DataFrame:
    return bucket_matrix(r, "Bruttoleistung")


@query("q29_bucket_matrix_net", _matrix_sql("Nettonennleistung"))
def bucket_matrix_net(r: Register) -> DataFrame:
    return bucket_matrix(r, "Nettonennleistung")


@query("q30_plz_mean_kw", f"""
    SELECT CASE WHEN length(Postleitzahl) < 5 THEN lpad(Postleitzahl, 5, '0') ELSE Postleitzahl END AS plz, count(*) AS units, sum({KW}) / 1000 AS mw,
           avg({KW}) AS avg_kw, avg(Breitengrad) AS lat, avg(Laengengrad) AS lng
    FROM solar
    WHERE {DAY} IS NOT NULL AND {KW} IS NOT NULL AND Breitengrad IS NOT NULL
      AND Laengengrad IS NOT NULL AND Postleitzahl IS NOT NULL
    GROUP BY 1""")
def plz_mean_kw(r: Register) -> DataFrame:
    rows = r.solar.dropna(subset=[DAY, KW, "Breitengrad", "Laengengrad", "Postleitzahl"])
    return rows.groupBy(norm_plz(F.col("Postleitzahl")).alias("plz")).agg(
        F.count("*").alias("units"), mw(KW).alias("mw"), F.avg(KW).alias("avg_kw"),
        F.avg("Breitengrad").alias("lat"), F.avg("Laengengrad").alias("lng"))


# ------------------------------------------------------------------------------- period tables


def per_period(df: DataFrame, grain: str, measures: dict[str, Column]) -> DataFrame:
    """Units and sums per month, quarter or year."""
    return df.groupBy(F.trunc(DAY, grain).alias("bucket")).agg(
        *[col.alias(name) for name, col in measures.items()])


def commissioning_table(df: DataFrame, grain: str, units: str, percent: bool) -> DataFrame:
    """Period table with the change against the period before and calendar labels."""
    periods = per_period(df, grain, {
        units: F.count("*"), "brutto_mw": mw(KW), "netto_mw": mw("Nettonennleistung")})
    table = W.period_delta(periods, "bucket", [units, "brutto_mw", "netto_mw"], percent)
    labels = {"jahr": F.year("bucket")}
    if grain != "year":
        labels["quartal"] = quarter_label(F.col("bucket"))
    if grain == "month":
        labels["monat"] = month_name_de(F.col("bucket"))
    doubles = [c for c in table.columns if c.endswith(("_pct", "mw_delta"))]
    return table.withColumns(labels | {c: F.round(c, 6) for c in doubles})


_MONATE = ("['Januar', 'Februar', 'Maerz', 'April', 'Mai', 'Juni', 'Juli', 'August', 'September',"
           " 'Oktober', 'November', 'Dezember']")


def _period_sql(table: str, grain: str, units: str, where: str, percent: bool) -> str:
    def deltas(name: str, digits: bool) -> str:
        diff = f"{name} - lag({name}) OVER w"
        parts = [f"{f'round({diff}, 6)' if digits else diff} AS {name}_delta"]
        if percent:
            parts.append(f"round(({diff}) / lag({name}) OVER w, 6) AS {name}_delta_pct")
        return ", ".join(parts)

    labels = "cast(year(bucket) AS integer) AS jahr"
    if grain != "year":
        labels += ", concat('Q', quarter(bucket)) AS quartal"
    if grain == "month":
        labels += f", {_MONATE}[month(bucket)] AS monat"
    return f"""
    SELECT bucket, {units}, brutto_mw, netto_mw, {deltas(units, False)},
           {deltas('brutto_mw', True)}, {deltas('netto_mw', True)}, {labels}
    FROM (SELECT cast(date_trunc('{grain}', {DAY}) AS date) AS bucket, count(*) AS {units},
                 sum({KW}) / 1000 AS brutto_mw, sum(Nettonennleistung) / 1000 AS netto_mw
          FROM {table} WHERE {where} GROUP BY 1)
    WINDOW w AS (ORDER BY bucket)"""


_SOLAR_TABLE = (f"year({DAY}) BETWEEN 1995 AND 2001 AND EinheitBetriebsstatus IN ('35', 'InBetrieb')"
                " AND Bundesland IN ('1402', '1403')")


def solar_table(r: Register, grain: str) -> DataFrame:
    rows = dated(r.solar, active=True).filter(
        in_states(F.col("Bundesland"), ["Baden-Württemberg", "Bayern"]))
    return commissioning_table(rows, grain, "solaranlagen", percent=True)


@query("q32_solar_table_month", _period_sql("solar", "month", "solaranlagen", _SOLAR_TABLE, True))
def solar_table_month(r: Register) -> DataFrame:
    return solar_table(r, "month")


@query("q32_solar_table_quarter", _period_sql("solar", "quarter", "solaranlagen", _SOLAR_TABLE, True))
def solar_table_quarter(r: Register) -> DataFrame:
    return solar_table(r, "quarter")


@query("q32_solar_table_year", _period_sql("solar", "year", "solaranlagen", _SOLAR_TABLE, True))
def solar_table_year(r: Register) -> DataFrame:
    return solar_table(r, "year")


def storage_table(r: Register, grain: str) -> DataFrame:
    rows = dated(r.storage_raw, active=True).filter(
        in_list_or_all(F.col("Batterietechnologie"), ["727", "728"]))
    return commissioning_table(rows, grain, "speicher", percent=False)


_STORAGE_TABLE = (f"year({DAY}) BETWEEN 1995 AND 2001"
                  " AND EinheitBetriebsstatus IN ('35', 'InBetrieb')"
                  " AND Batterietechnologie IN ('727', '728')")


@query("q34_storage_table_month", _period_sql("stromspeicher", "month", "speicher", _STORAGE_TABLE, False))
def storage_table_month(r: Register) -> DataFrame:
    return storage_table(r, "month")


@query("q34_storage_table_year", _period_sql("stromspeicher", "year", "speicher", _STORAGE_TABLE, False))
def storage_table_year(r: Register) -> DataFrame:
    return storage_table(r, "year")


@query("q31_quarterly_units", f"""
    SELECT cast(date_trunc('quarter', {DAY}) AS date) AS bucket, count(*) AS units,
           sum({KW}) / 1000 AS mw
    FROM solar WHERE {DAY} IS NOT NULL AND {KW} IS NOT NULL GROUP BY 1""")
def quarterly_units(r: Register) -> DataFrame:
    rows = r.solar.dropna(subset=[DAY, KW])
    return per_period(rows, "quarter", {"units": F.count("*"), "mw": mw(KW)})


def quarterly_bars(df: DataFrame) -> DataFrame:
    bars = W.period_delta(per_period(df, "quarter", {"units": F.count("*"), "mw": mw(KW)}),
                          "bucket", ["units", "mw"], percent=False)
    return bars.withColumns({"mw_delta": F.round("mw_delta", 6),
                             "qlabel": year_quarter_label(F.col("bucket"))})


def _bars_sql(table: str, where: str) -> str:
    return f"""
    SELECT bucket, units, mw, units - lag(units) OVER (ORDER BY bucket) AS units_delta,
           round(mw - lag(mw) OVER (ORDER BY bucket), 6) AS mw_delta,
           concat(year(bucket), ' Q', quarter(bucket)) AS qlabel
    FROM (SELECT cast(date_trunc('quarter', {DAY}) AS date) AS bucket, count(*) AS units,
                 sum({KW}) / 1000 AS mw
          FROM {table} WHERE year({DAY}) BETWEEN 1995 AND 2001
            AND EinheitBetriebsstatus IN ('35', 'InBetrieb') AND {where} GROUP BY 1)"""


@query("q33_solar_quarter_bars", _bars_sql("solar", "Bundesland = '1403'"))
def solar_quarter_bars(r: Register) -> DataFrame:
    rows = dated(r.solar, active=True)
    return quarterly_bars(rows.filter(in_states(F.col("Bundesland"), ["Bayern"])))


@query("q33_battery_quarter_bars", _bars_sql("stromspeicher", """
    (lower(trim(coalesce(Technologie, ''))) NOT LIKE '%pumpspeicher%'
     AND lower(trim(coalesce(Technologie, ''))) NOT LIKE '%wasserstoff%'
     AND (lower(Technologie) LIKE '%batterie%' OR lower(Technologie) LIKE '%lithium%'
          OR lower(Technologie) LIKE '%akku%' OR Technologie = '524'
          OR Batterietechnologie = '727'))"""))
def battery_quarter_bars(r: Register) -> DataFrame:
    rows = dated(r.storage_raw, active=True)
    return quarterly_bars(rows.filter(is_battery(rows)))


# ------------------------------------------------------------------------------- storage histogram

BIN_KW, TOP_KW = 250, 5000
_BINS = f"""
    SELECT CASE WHEN {KW} >= {TOP_KW + BIN_KW} THEN {TOP_KW + BIN_KW} ELSE floor({KW} / {BIN_KW}) * {BIN_KW} END AS bin_lo,
           coalesce(Batterietechnologie, 'Unbekannt') AS tech, AcDcKoppelung AS ac, count(*) AS n
    FROM stromspeicher WHERE {KW} IS NOT NULL GROUP BY 1, 2, 3"""


def storage_bins(r: Register) -> DataFrame:
    tech = F.coalesce("Batterietechnologie", F.lit("Unbekannt")).alias("tech")
    return A.histogram(r.storage_raw, KW, BIN_KW, TOP_KW, tech, F.col("AcDcKoppelung").alias("ac"))


def bin_label(low: Column, width: int, top: int) -> Column:
    """Both ends of a bin; the last one is open."""
    start = low.cast("bigint")
    return F.when(low > top, F.format_string("%d+", start)).otherwise(
        F.format_string("%d–%d", start, (low + width).cast("bigint")))


@query("q35_storage_histogram_share", f"""
    SELECT bin_lo, CASE WHEN bin_lo > {TOP_KW} THEN concat(cast(bin_lo AS bigint), '+')
                ELSE concat(cast(bin_lo AS bigint), '–', cast(bin_lo + {BIN_KW} AS bigint)) END AS bin_label,
           cast(sum(n) AS bigint) AS n, round(sum(n) / sum(sum(n)) OVER (), 9) AS pct
    FROM ({_BINS}) GROUP BY 1, 2""")
def storage_histogram_share(r: Register) -> DataFrame:
    bins = A.rollup_from_agg(storage_bins(r), ["bin_lo"], ["n"])
    share = W.pct_of_total(bins, "n", "pct")
    return share.withColumns({"pct": F.round("pct", 9), "bin_label": bin_label(F.col("bin_lo"), BIN_KW, TOP_KW)})


@query("q35_storage_histogram_stack", f"SELECT * FROM ({_BINS})")
def storage_histogram_stack(r: Register) -> DataFrame:
    return storage_bins(r)


# ------------------------------------------------------------------------------- registration delay

_DELAY = f"""
    SELECT date_diff('day', {DAY}, try_cast(Registrierungsdatum AS date)) AS days,
           cast(year({DAY}) AS integer) AS ibn_year, {sql_bucket17(KW)} AS bucket
    FROM solar
    WHERE year({DAY}) BETWEEN 1995 AND 2001 AND {KW} IS NOT NULL
      AND try_cast(Registrierungsdatum AS date) IS NOT NULL"""


def registration_delay(r: Register) -> DataFrame:
    registered = to_iso_date(F.col("Registrierungsdatum"))
    rows = dated(r.solar).filter(F.col(KW).isNotNull() & registered.isNotNull())
    return rows.select(
        F.datediff(registered, F.col(DAY)).alias("days"), F.year(DAY).alias("ibn_year"),
        size_bucket17_ord(F.col(KW)).alias("bucket_ord"))


@query("q36_registration_delay", f"""
    SELECT ibn_year, count(*) AS n, quantile_cont(days, 0.5) AS median,
           quantile_cont(days, 0.25) AS p25, quantile_cont(days, 0.75) AS p75
    FROM ({_DELAY}) GROUP BY 1""")
def registration_delay_quartiles(r: Register) -> DataFrame:
    return A.day_quantiles(registration_delay(r), "ibn_year", "days")


@query("q37_registration_delay_bins", f"""
    SELECT {sql_ladder('days', CHECKED_DELAYS, '<=')} AS bin,
           {sql_ladder_ord('days', CHECKED_DELAYS, '<=')} AS bin_ord, bucket, count(*) AS n
    FROM ({_DELAY}) GROUP BY 1, 2, 3""")
def registration_delay_bins(r: Register) -> DataFrame:
    counts = A.edge_histogram(registration_delay(r), "days", DELAY_BINS, "bucket_ord")
    return counts.withColumn("bucket", label_at(F.col("bucket_ord"), SIZE_BUCKETS_17)).drop("bucket_ord")


_HEAT = f"""
    SELECT cast(year({DAY}) AS integer) AS ibn_year, cast(quarter({DAY}) AS integer) AS ibn_q,
           cast(year(try_cast(Registrierungsdatum AS date)) AS integer) AS reg_year,
           cast(quarter(try_cast(Registrierungsdatum AS date)) AS integer) AS reg_q,
           count(*) AS n, sum({KW}) / 1e6 AS gw
    FROM solar
    WHERE year({DAY}) BETWEEN 1995 AND 2001 AND try_cast(Registrierungsdatum AS date) IS NOT NULL
    GROUP BY 1, 2, 3, 4"""


def registration_heat(r: Register) -> DataFrame:
    registered = to_iso_date(F.col("Registrierungsdatum"))
    rows = dated(r.solar).withColumn("reg", registered).filter(F.col("reg").isNotNull())
    return rows.groupBy(
        F.year(DAY).alias("ibn_year"), F.quarter(DAY).alias("ibn_q"),
        F.year("reg").alias("reg_year"), F.quarter("reg").alias("reg_q"),
    ).agg(F.count("*").alias("n"), (F.sum(KW) / 1e6).alias("gw"))


def _quarter_sql(year: str, quarter: str) -> str:
    cells = ", ".join(
        f"cast(coalesce(sum(n) FILTER (WHERE {quarter} = {i}), 0) AS bigint) AS Q{i}"
        for i in range(1, 5))
    return f"SELECT {year} AS year, {cells} FROM ({_HEAT}) GROUP BY 1"


def year_quarter_heat(r: Register, year: str, quarter: str) -> DataFrame:
    heat = registration_heat(r).withColumnRenamed(year, "year")
    return A.pivot_sum(heat, ["year"], quarter, [1, 2, 3, 4], "n", QUARTERS)


@query("q38_commissioned_by_quarter", _quarter_sql("ibn_year", "ibn_q"))
def commissioned_by_quarter(r: Register) -> DataFrame:
    return year_quarter_heat(r, "ibn_year", "ibn_q")


@query("q38_registered_by_quarter", _quarter_sql("reg_year", "reg_q"))
def registered_by_quarter(r: Register) -> DataFrame:
    return year_quarter_heat(r, "reg_year", "reg_q")


YEARS = list(range(1995, 2002))


@query("q38_late_registration", f"""
    SELECT reg_year, {", ".join(f"round(coalesce(sum(gw) FILTER (WHERE ibn_year = {y}), 0), 9) AS ibn_{y}" for y in YEARS)},
           round(coalesce(sum(gw) FILTER (WHERE ibn_year IS NULL OR ibn_year NOT BETWEEN 1995 AND 2001), 0), 9) AS ibn_other
    FROM ({_HEAT}) GROUP BY 1""")
def late_registration(r: Register) -> DataFrame:
    names = [f"ibn_{y}" for y in YEARS]
    matrix = A.pivot_sum(registration_heat(r), ["reg_year"], "ibn_year", YEARS, "gw", names, other="ibn_other")
    return matrix.withColumns({c: F.round(c, 9) for c in [*names, "ibn_other"]})


# ------------------------------------------------------------------------------- year to date

_SEGMENT_ROWS = f"""
    FROM solar WHERE {KW} IS NOT NULL AND year({DAY}) BETWEEN 1998 AND 2001
      AND EinheitBetriebsstatus IN ('35', 'InBetrieb')"""


def segment_rows(r: Register, first: int = 1998, last: int = 2001) -> DataFrame:
    return dated(r.solar, first, last, active=True).filter(F.col(KW).isNotNull()).select(
        F.year(DAY).alias("year"), F.month(DAY).alias("month"),
        segment3(F.col(KW)).alias("segment"), KW, DAY)


@query("q39_monthly_segments", f"""
    SELECT cast(year({DAY}) AS integer) AS year, cast(month({DAY}) AS integer) AS month,
           {sql_segment3(KW)} AS segment, sum({KW}) / 1000 AS mw, count(*) AS units
    {_SEGMENT_ROWS} GROUP BY 1, 2, 3
    UNION ALL
    SELECT cast(year({DAY}) AS integer), cast(month({DAY}) AS integer), 'Grand Total',
           sum({KW}) / 1000, count(*)
    {_SEGMENT_ROWS} GROUP BY 1, 2""")
def monthly_segments(r: Register) -> DataFrame:
    totals = A.with_grand_total(segment_rows(r), ["year", "month"], "segment",
                                {"mw": F.col(KW), "units": F.lit(1)})
    return totals.withColumn("mw", F.col("mw") / 1000)


@query("q40_ytd_vs_previous_year", f"""
    WITH months AS (
        SELECT cast(year({DAY}) AS integer) AS year, cast(month({DAY}) AS integer) AS month,
               sum({KW}) / 1000 AS mw
        {_SEGMENT_ROWS} AND month({DAY}) <= 8 GROUP BY 1, 2),
    grid AS (
        SELECT y.year, m.month, coalesce(months.mw, 0) AS mw
        FROM (SELECT cast(unnest(range(1998, 2002)) AS integer) AS year) y
        CROSS JOIN (SELECT cast(unnest(range(1, 9)) AS integer) AS month) m
        LEFT JOIN months ON months.year = y.year AND months.month = m.month)
    SELECT year, month, {_MONATE}[month] AS monat, mw,
           round((mw - lag(mw) OVER (PARTITION BY month ORDER BY year))
                 / nullif(lag(mw) OVER (PARTITION BY month ORDER BY year), 0), 6) AS vs_prev_year
    FROM grid""")
def ytd_vs_previous_year(r: Register) -> DataFrame:
    rows = segment_rows(r)
    monthly = rows.filter(ytd(F.col(DAY), AS_OF, all_years=True)).groupBy("year", "month").agg(
        mw(KW).alias("mw"))
    table = W.yoy_month(monthly, range(1998, 2002), range(1, AS_OF.month + 1), "year", "month", "mw")
    return table.withColumns({
        "vs_prev_year": F.round("vs_prev_year", 6),
        "monat": month_name_de(F.make_date("year", "month", F.lit(1)))})
