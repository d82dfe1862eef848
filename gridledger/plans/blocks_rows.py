"""Row-level building blocks, each run over a whole table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridledger.catalog import STORAGE_TECHNOLOGY
from gridledger.functions import convert as V
from gridledger.functions import labels as B
from gridledger.functions import predicates as T
from gridledger.operators import projection as P
from gridledger.plans.register import AS_OF, Register
from gridledger.plans.registry import query
from gridledger.plans.shaping import sql_bucket17, sql_class6, sql_segment3
from gridledger.sources.access_log import parse_access_log

KW = "Bruttoleistung"
DAY = "Inbetriebnahmedatum"


@query("p01_col_or_null", """
    SELECT EinheitMastrNummer AS mastr_nr, try_cast(Bruttoleistung AS double) AS kw,
           cast(NULL AS double) AS hoehe, cast(NULL AS varchar) AS plz FROM geothermie""")
def tolerant_projection(r: Register) -> DataFrame:
    unit = r.table("geothermie")
    return unit.select(
        P.col_or_null(unit, "einheitmastrnummer").alias("mastr_nr"),
        P.col_or_null(unit, "BRUTTOLEISTUNG", "double").alias("kw"),
        P.col_or_null(unit, "Nabenhoehe", "double").alias("hoehe"),
        P.col_or_null(unit, "Postleitzahl").alias("plz"))


@query("p02_filter_if_present", """
    SELECT Nutzungsbereich, count(*) AS n FROM solar WHERE Nutzungsbereich IN ('2', '3') GROUP BY 1""")
def optional_filters(r: Register) -> DataFrame:
    rows = P.filter_if_present(r.solar, "Nutzungsbereich", ["2", "3"])
    rows = P.filter_if_present(rows, "Fernsteuerbarkeit", ["1"])  # not in this release: no effect
    return rows.groupBy("Nutzungsbereich").agg(F.count("*").alias("n"))


@query("p03_in_list", """
    SELECT count(*) FILTER (WHERE Bundesland IN ('1400', '1401')) AS chosen, 0::BIGINT AS none_listed,
           count(*) AS no_filter FROM solar""")
def membership(r: Register) -> DataFrame:
    state = F.col("Bundesland")
    return r.solar.agg(
        F.count_if(T.in_list(state, ["1400", "1401"])).alias("chosen"),
        F.count_if(T.in_list(state, [])).alias("none_listed"),
        F.count_if(T.in_list_or_all(state, [])).alias("no_filter"))


@query("p04_p05_unit_ranges", f"""
    SELECT EinheitMastrNummer AS mastr_nr, {KW} AS kw, {DAY} AS day FROM wind
    WHERE year({DAY}) BETWEEN 1997 AND 1999 AND {KW} BETWEEN 1500 AND 4000""")
def unit_ranges(r: Register) -> DataFrame:
    rows = r.wind.filter(T.year_between(F.col(DAY), 1997, 1999) & T.kw_between(F.col(KW), 1.5, 4.0))
    return rows.select(F.col("EinheitMastrNummer").alias("mastr_nr"), F.col(KW).alias("kw"),
                       F.col(DAY).alias("day"))


@query("p06_p07_p08_wind_flags", """
    SELECT EinheitMastrNummer AS mastr_nr, EinheitBetriebsstatus IN ('35', 'InBetrieb') AS active,
           (Lage IS NULL OR Lage <> 'WindAufSee')
               AND (WindAnLandOderAufSee IS NULL OR WindAnLandOderAufSee <> '889') AS onshore,
           coalesce(Lage = 'WindAufSee', false) OR Seelage IS NOT NULL AS offshore
    FROM wind""")
def wind_flags(r: Register) -> DataFrame:
    return r.wind.select(
        F.col("EinheitMastrNummer").alias("mastr_nr"), T.is_active(r.wind).alias("active"),
        T.is_onshore(r.wind).alias("onshore"), T.is_offshore(r.wind).alias("offshore"))


@query("p09_p10_p11_size_labels", f"""
    SELECT {sql_class6('bruttoleistung_kw')} AS class6, {sql_bucket17('bruttoleistung_kw')} AS bucket17,
           {sql_segment3('bruttoleistung_kw')} AS segment, count(*) AS n
    FROM units_all GROUP BY 1, 2, 3""")
def size_labels(r: Register) -> DataFrame:
    kw = F.col("bruttoleistung_kw")
    return r.units.groupBy(
        B.size_class6(kw).alias("class6"), B.size_bucket17(kw).alias("bucket17"),
        B.segment3(kw).alias("segment")).agg(F.count("*").alias("n"))


@query("p12_label_or_unknown", """
    SELECT coalesce(Technologie, Batterietechnologie, 'Unbekannt') AS label, count(*) AS n
    FROM stromspeicher GROUP BY 1""")
def unknown_label(r: Register) -> DataFrame:
    label = B.label_or_unknown(F.col("Technologie"), F.col("Batterietechnologie"), label="Unbekannt")
    return r.storage_raw.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@query("p13_is_battery", """
    SELECT Technologie, Batterietechnologie,
           (lower(coalesce(Technologie, '')) LIKE '%batterie%' OR coalesce(Technologie = '524', false)
            OR lower(coalesce(Technologie, '')) LIKE '%akku%' OR coalesce(Batterietechnologie = '727', false))
           AND lower(coalesce(Technologie, '')) NOT LIKE '%pumpspeicher%'
           AND lower(coalesce(Technologie, '')) NOT LIKE '%wasserstoff%'
           AND coalesce(Technologie, '') <> '999' AS battery, count(*) AS n
    FROM stromspeicher GROUP BY 1, 2""")
def battery_flag(r: Register) -> DataFrame:
    flag = T.is_battery(r.storage_raw, excluded_codes=["999"])
    return r.storage_raw.groupBy(
        "Technologie", "Batterietechnologie", flag.alias("battery")).agg(F.count("*").alias("n"))


@query("p14_storage_compat", """
    SELECT EinheitMastrNummer AS mastr_nr, NutzbareSpeicherkapazitaet AS kwh FROM storage""")
def storage_compat(r: Register) -> DataFrame:
    return P.storage_compat(r.storage_raw).select(
        F.col("EinheitMastrNummer").alias("mastr_nr"),
        F.col("NutzbareSpeicherkapazitaet").alias("kwh"))


_ENUM = " ".join(f"WHEN '{c}' THEN '{n}'" for c, n in STORAGE_TECHNOLOGY.items())


@query("p15_enum_label", f"""
    SELECT EinheitMastrNummer AS mastr_nr,
           CASE Technologie {_ENUM} ELSE 'Code ' || Technologie END AS label FROM stromspeicher""")
def enum_labels(r: Register) -> DataFrame:
    return r.storage_raw.select(
        F.col("EinheitMastrNummer").alias("mastr_nr"),
        B.enum_label(F.col("Technologie"), STORAGE_TECHNOLOGY).alias("label"))


@query("p16_state_names_to_codes", """
    SELECT u.bundesland_code, count(*) AS n FROM units_all u
    WHERE bundesland_name IN ('Hessen', 'Sachsen') GROUP BY 1""")
def named_states(r: Register) -> DataFrame:
    chosen = r.units.filter(T.in_states(F.col("bundesland_code"), ["Hessen", "Sachsen", "Atlantis"]))
    return chosen.groupBy("bundesland_code").agg(F.count("*").alias("n"))


@query("p17_plausible", """
    SELECT Bundesland, count(*) AS n FROM wind
    WHERE Nabenhoehe BETWEEN 30 AND 120 AND Rotordurchmesser BETWEEN 40 AND 150 GROUP BY 1""")
def plausible_rows(r: Register) -> DataFrame:
    rows = P.plausible(r.wind, {"Nabenhoehe": (30, 120), "Rotordurchmesser": (40, 150)})
    return rows.groupBy("Bundesland").agg(F.count("*").alias("n"))


@query("p18_mask_measures", """
    SELECT c_custkey AS id, 0::BIGINT AS a, c_custkey % 5 AS b, c_custkey % 3 AS c,
           c_custkey % 5 + c_custkey % 3 AS total FROM customer""")
def masked(r: Register) -> DataFrame:
    key = F.col("c_custkey")
    wide = r.source("customer").select(
        key.alias("id"), (key % 7).alias("a"), (key % 5).alias("b"), (key % 3).alias("c"))
    return P.mask_measures(wide, {"x": "a", "y": "b", "z": "c"}, ["y", "z"], "total")


@query("p19_norm_plz", """
    SELECT EinheitMastrNummer AS mastr_nr,
           CASE WHEN length(Postleitzahl) < 5 THEN lpad(Postleitzahl, 5, '0') ELSE Postleitzahl END AS plz FROM solar""")
def postcodes(r: Register) -> DataFrame:
    return r.solar.select(F.col("EinheitMastrNummer").alias("mastr_nr"),
                          V.norm_plz(F.col("Postleitzahl")).alias("plz"))


@query("p21_p22_bands", """
    SELECT event_id, CASE WHEN value - 20 < 0 THEN 'negative' WHEN value - 20 < 50 THEN 'low'
               WHEN value - 20 < 100 THEN 'medium' ELSE 'high' END AS price_band,
           CASE WHEN value * 4 < 50 THEN 'dark' WHEN value * 4 < 200 THEN 'dim'
                WHEN value * 4 < 500 THEN 'bright' ELSE 'strong' END AS rad_band
    FROM events""")
def bands(r: Register) -> DataFrame:
    value = F.col("value")
    return r.source("events").select("event_id", B.price_band(value - 20).alias("price_band"),
                                     B.rad_band(value * 4).alias("rad_band"))


@query("p23_business_hour", """
    SELECT event_id, hour(ts + INTERVAL 1 HOUR) BETWEEN 7 AND 18 AS business_hour FROM events""")
def business_hours(r: Register) -> DataFrame:
    local = V.local_clock(V.utc_instant(F.col("ts")), "Europe/Berlin")
    return r.source("events").select("event_id", T.business_hour(local).alias("business_hour"))


@query("p24_clamp_range", """
    WITH asked AS (
        SELECT o_orderkey, CASE WHEN o_custkey % 50 = 0 THEN NULL ELSE cast(o_orderdate AS date) END AS s,
               cast(o_orderdate AS date) + cast(o_custkey % 60 - 10 AS integer) AS e FROM orders),
    ends AS (SELECT *, least(greatest(s, e), DATE '2001-07-02') AS le FROM asked)
    SELECT o_orderkey, s AS start, e AS "end",
           CASE WHEN s IS NULL OR e IS NULL THEN DATE '2001-06-25'
                WHEN date_diff('day', s, le) + 1 > 31 THEN le - 30 ELSE s END AS clamped_start,
           CASE WHEN s IS NULL OR e IS NULL THEN DATE '2001-07-01' ELSE le END AS clamped_end
    FROM ends""")
def clamped(r: Register) -> DataFrame:
    start = F.to_date("o_orderdate")
    asked = r.source("orders").select(
        "o_orderkey", F.when(F.col("o_custkey") % 50 != 0, start).alias("start"),
        F.date_add(start, (F.col("o_custkey") % 60 - 10).cast("int")).alias("end"))
    return P.clamp_range(asked, dt.date(2001, 7, 1))


@query("p25_in_season", """
    SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 7 BETWEEN 6 AND 8
               WHEN p_size % 4 = 1 THEN 7 >= 11 OR 7 <= 2 ELSE false END AS summer,
           CASE WHEN p_size % 4 = 0 THEN 1 BETWEEN 6 AND 8
               WHEN p_size % 4 = 1 THEN 1 >= 11 OR 1 <= 2 ELSE false END AS winter
    FROM part""")
def seasons(r: Register) -> DataFrame:
    kind = F.col("p_size") % 4
    season = F.when(kind == 0, "Jun-Aug").when(kind == 1, "Nov-Feb").when(kind == 2, "Sommer")
    return r.source("part").select(
        "p_partkey", T.in_season(season, F.lit(7)).alias("summer"),
        T.in_season(season, F.lit(1)).alias("winter"))


@query("p26_p27_scaling", """
    SELECT p_partkey,
           cast(floor((p_size - lo) * 1e0 / (hi - lo) * 99 + 1) AS integer) AS idx,
           round(6 + (sqrt(p_size) - sqrt(lo)) / (sqrt(hi) - sqrt(lo)) * 16, 6) AS radius
    FROM part, (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part)""")
def scaling(r: Register) -> DataFrame:
    parts = r.source("part").select("p_partkey", F.col("p_size").cast("double").alias("size"))
    scaled = P.rescale_sqrt(P.scale_idx(parts, "size", "idx"), "size", "radius")
    return scaled.select("p_partkey", "idx", F.round("radius", 6).alias("radius"))


@query("p28_sector", """
    SELECT schluessel, CASE left(schluessel, 1) WHEN 'R' THEN 'Health & social work' WHEN 'Q'
           THEN 'Education' WHEN 'T' THEN 'Advocacy & services' ELSE 'Other' END AS sector, count(*) AS n
    FROM organisations GROUP BY 1""")
def sectors(r: Register) -> DataFrame:
    key = F.col("schluessel")
    return r.table("organisations").groupBy(key, B.sector(key).alias("sector")).agg(
        F.count("*").alias("n"))


@query("p29_extract_features", """
    SELECT doc_id, cast(length(text) AS integer) AS extract_length,
           CASE WHEN lang IN ('en', 'de') THEN lang END AS lang FROM documents""")
def features(r: Register) -> DataFrame:
    docs = r.source("documents").select("doc_id", "text", "lang")
    return P.extract_features(docs, "text", "lang", ["en", "de"]).drop("text")


@query("p30_search_text", """
    SELECT conv_id, turn, regexp_matches(text, 'ation|ing\\b', 'i') AS hit, true AS blank_hit
    FROM conversations""")
def text_search(r: Register) -> DataFrame:
    return r.source("conversations").select(
        "conv_id", "turn", T.search_text(F.col("text"), r"ation|ing\b").alias("hit"),
        T.search_text(F.col("text"), "  ").alias("blank_hit"))


@query("p31_p32_p33_p34_page_views", """
    SELECT path, status, method, event_type NOT IN ('purchase', 'error') AS entry,
           event_type IN ('purchase', 'error') AS asset,
           CASE event_type WHEN 'view' THEN 'hub' WHEN 'click' THEN 'karte' WHEN 'signup' THEN 'anmeldung'
                WHEN 'purchase' THEN 'lib' ELSE 'speicher' END AS slug,
           CASE (user_id + event_id) % 5 WHEN 0 THEN 'Tablet' WHEN 1 THEN 'Phone' WHEN 2 THEN 'Bot'
                ELSE 'Desktop' END AS device, count(*) AS n
    FROM access_events GROUP BY ALL""")
def request_labels(r: Register) -> DataFrame:
    path = F.col("path")
    return parse_access_log(r.access_lines).groupBy(
        path, "status", "method", T.is_entry_page(path).alias("entry"),
        T.is_asset(path).alias("asset"), B.page_slug(path).alias("slug"),
        B.device(F.col("user_agent")).alias("device")).agg(F.count("*").alias("n"))


@query("p35_s25_request_and_time", """
    SELECT event_id, 'GET' AS method, CASE WHEN event_type = 'error' THEN NULL
           ELSE concat('/', event_type) END AS path,
           CASE WHEN event_id % 5 = 4 THEN NULL WHEN event_id % 5 = 3
                THEN strftime(date_trunc('second', ts) - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S')
                ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS time
    FROM events WHERE event_type <> 'error'
    UNION ALL
    SELECT event_id, NULL, NULL,
           CASE WHEN event_id % 5 = 4 THEN NULL WHEN event_id % 5 = 3
                THEN strftime(date_trunc('second', ts) - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S')
                ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END
    FROM events WHERE event_type = 'error'""")
def request_parts(r: Register) -> DataFrame:
    kind = F.col("event_type")
    request = F.when(kind == "error", F.lit("??")).otherwise(
        F.concat(F.lit("GET /"), kind, F.lit(" HTTP/1.1")))
    stamp = F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss")
    variant = F.col("event_id") % 5
    text = (F.when(variant == 4, "gestern").when(variant == 3, F.concat(stamp, F.lit(" +0200")))
            .when(variant == 2, stamp).otherwise(F.concat(stamp, F.lit(" +0000"))))
    return r.source("events").select(
        "event_id", V.request_method(request).alias("method"), V.request_path(request).alias("path"),
        F.date_format(V.log_time(text), "yyyy-MM-dd HH:mm:ss").alias("time"))


@query("p36_scenario", """
    SELECT p_partkey, cast(round_even(p_size * 1.5e0, 0) AS bigint) AS n, p_retailprice * 1.5e0 AS mw
    FROM part""")
def uplift(r: Register) -> DataFrame:
    parts = r.source("part").select("p_partkey", F.col("p_size").alias("n"), F.col("p_retailprice").alias("mw"))
    return P.scenario(parts, 50, "n", "mw")


@query("p37_calendar", """
    SELECT o_orderkey, cast(year(o_orderdate) AS integer) AS year,
           concat('Q', quarter(o_orderdate)) AS quarter,
           ['Januar', 'Februar', 'Maerz', 'April', 'Mai', 'Juni', 'Juli', 'August', 'September',
            'Oktober', 'November', 'Dezember'][month(o_orderdate)] AS month_name,
           concat(year(o_orderdate), ' Q', quarter(o_orderdate)) AS year_quarter FROM orders""")
def calendar(r: Register) -> DataFrame:
    day = F.to_date("o_orderdate")
    return r.source("orders").select(
        "o_orderkey", F.year(day).alias("year"), B.quarter_label(day).alias("quarter"),
        B.month_name_de(day).alias("month_name"), B.year_quarter_label(day).alias("year_quarter"))


@query("p38_event_date", f"""
    SELECT EinheitMastrNummer AS mastr_nr, coalesce(try_cast(Registrierungsdatum AS date), {DAY}) AS day
    FROM stromspeicher""")
def event_dates(r: Register) -> DataFrame:
    return r.storage_raw.select(F.col("EinheitMastrNummer").alias("mastr_nr"),
                                P.event_date(r.storage_raw).alias("day"))


@query("p39_format_de", """
    SELECT o_orderkey, concat(translate(format('{:,}', cast(o_custkey * 1000 AS bigint)), ',', '.'), ' kW')
               AS whole,
           CASE WHEN o_custkey % 10 = 0 THEN '—'
                ELSE concat(o_custkey % 50, ',', lpad(cast(o_custkey % 4 * 25 AS varchar), 2, '0'), '%') END AS pct
    FROM orders""")
def formatted(r: Register) -> DataFrame:
    key = F.col("o_custkey")
    ratio = F.when(key % 10 != 0, ((key % 50) + (key % 4) * 0.25) / 100)
    return r.source("orders").select(
        "o_orderkey", V.fmt_de(key * 1000, 0, " kW").alias("whole"), V.fmt_percent_de(ratio).alias("pct"))


@query("p40_label_or_dash", """
    SELECT project_id, coalesce(nullif(trim(status), ''), '—') AS status FROM projects""")
def dashes(r: Register) -> DataFrame:
    return r.table("projects").select("project_id", B.label_or_dash(F.col("status")).alias("status"))


@query("p41_every_kth", """
    SELECT o_orderkey FROM (
        SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i,
               count(*) OVER () AS n FROM orders)
    WHERE i % cast(ceil(n / 700.0) AS bigint) = 0""")
def systematic_sample(r: Register) -> DataFrame:
    orders = r.source("orders").select("o_orderdate", "o_orderkey")
    return P.every_kth(orders, 700, ["o_orderdate", "o_orderkey"]).select("o_orderkey")


@query("p42_sample_n", """
    SELECT o_orderkey FROM orders ORDER BY md5(concat('1:', o_orderkey)), o_orderkey LIMIT 800""")
def random_sample(r: Register) -> DataFrame:
    return P.sample_n(r.source("orders").select("o_orderkey"), 800, 1, "o_orderkey")


@query("p43_p44_p45_unit_windows", f"""
    SELECT EinheitMastrNummer AS mastr_nr,
           year({DAY}) = 2001 AND month({DAY}) <= 8 AS this_year, month({DAY}) <= 8 AS every_year,
           {DAY} >= DATE '2000-08-01' AS last_months,
           coalesce({KW} >= 10 AND {KW} < 1000, false) AS mid_band
    FROM solar WHERE {DAY} IS NOT NULL""")
def unit_windows(r: Register) -> DataFrame:
    day = F.col(DAY)
    return r.solar.filter(day.isNotNull()).select(
        F.col("EinheitMastrNummer").alias("mastr_nr"), T.ytd(day, AS_OF).alias("this_year"),
        T.ytd(day, AS_OF, all_years=True).alias("every_year"),
        T.since_months(day, AS_OF, 12).alias("last_months"),
        F.coalesce(T.kw_band(F.col(KW), 10, 1000), F.lit(False)).alias("mid_band"))


@query("p46_local_day", """
    SELECT event_id, event_type FROM events
    WHERE cast(ts + INTERVAL 1 HOUR AS date) = DATE '2024-01-10'""")
def one_local_day(r: Register) -> DataFrame:
    instant = V.utc_instant(F.col("ts"))
    events = r.source("events").filter(T.local_day(instant, "Europe/Berlin", dt.date(2024, 1, 10)))
    return events.select("event_id", "event_type")
