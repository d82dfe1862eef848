"""District questions: densities, asset mixes, external indices, tourism, labour market."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridledger.catalog import DISSOLVED_DISTRICTS, DISTRICT_ALIASES
from gridledger.functions.convert import norm_plz
from gridledger.functions.labels import segment3
from gridledger.functions.predicates import in_season, is_active, is_onshore, kw_band, ytd
from gridledger.operators import aggregates as A
from gridledger.operators import joins as J
from gridledger.operators import projection as P
from gridledger.operators import ranking as L
from gridledger.operators import windows as W
from gridledger.operators.sets import append
from gridledger.plans.register import AS_OF, HOME_STATE, Register
from gridledger.plans.registry import query
from gridledger.plans.shaping import mw, sql_segment3, units_and_mw
from gridledger.sources.payloads import parse_metrics, pick_metric

KW = "Bruttoleistung"
DAY = "Inbetriebnahmedatum"
_ACTIVE = "EinheitBetriebsstatus IN ('35', 'InBetrieb')"


def active(df: DataFrame) -> DataFrame:
    return df.filter(is_active(df))


def _district_sql(where: str) -> str:
    """Solar rows rolled up to districts on the checking side."""
    return f"""
    SELECT d.kreis, count(*) AS units, sum({KW}) / 1000 AS mw, any_value(m.einwohner) AS einwohner,
           any_value(m.lat) AS lat, any_value(m.lon) AS lon,
           CASE WHEN any_value(m.einwohner) > 0
                THEN round(count(*) / any_value(m.einwohner) * 1000, 6) END AS per_1000
    FROM solar JOIN plz_district d ON d.plz = CASE WHEN length(Postleitzahl) < 5 THEN lpad(Postleitzahl, 5, '0') ELSE Postleitzahl END
    LEFT JOIN district_meta m ON m.kreis = d.kreis
    WHERE {where} GROUP BY d.kreis"""


def solar_districts(r: Register, rows: DataFrame) -> DataFrame:
    out = J.to_district(J.by_plz(rows), r.plz_district, r.district_meta)
    return out.withColumns({"mw": F.round("mw", 6), "per_1000": F.round("per_1000", 6)})


@query("q41_district_ranking", f"""
    SELECT kreis, units, round(mw, 6) AS mw, einwohner, lat, lon, per_1000,
           cast(row_number() OVER (ORDER BY per_1000 DESC, kreis) AS integer) AS rank
    FROM ({_district_sql(_ACTIVE)}) WHERE per_1000 IS NOT NULL""")
def district_ranking(r: Register) -> DataFrame:
    return W.rank_by(solar_districts(r, active(r.solar)), "per_1000", "kreis")


@query("q41_rank_of_district", f"""
    SELECT * FROM (SELECT kreis, units, round(mw, 6) AS mw, per_1000,
           cast(row_number() OVER (ORDER BY per_1000 DESC, kreis) AS integer) AS rank
    FROM ({_district_sql(_ACTIVE)}) WHERE per_1000 IS NOT NULL) WHERE kreis = 'NATION_15'""")
def rank_of_district(r: Register, name: str = "NATION_15") -> DataFrame:
    return W.rank_of(solar_districts(r, active(r.solar)), "per_1000", "kreis", name).select(
        "kreis", "units", "mw", "per_1000", "rank")


# ------------------------------------------------------------------------------- one region


def region(df: DataFrame) -> DataFrame:
    return active(df.filter(F.col("Bundesland") == HOME_STATE))


_REGION = f"FROM solar WHERE Bundesland = '{HOME_STATE}' AND {_ACTIVE}"
_YTD = f"year({DAY}) = 2001 AND month({DAY}) <= 8"


@query("q42_region_kpi", f"""
    SELECT count(*) AS units, sum({KW}) / 1000 AS mw, count(*) FILTER (WHERE {_YTD}) AS ytd_units,
           sum({KW}) FILTER (WHERE {_YTD}) / 1000 AS ytd_mw {_REGION}""")
def region_kpi(r: Register) -> DataFrame:
    this_year = F.coalesce(ytd(F.col(DAY), AS_OF), F.lit(False))
    return region(r.solar).agg(
        *units_and_mw(KW), F.count_if(this_year).alias("ytd_units"),
        (F.sum(F.when(this_year, F.col(KW))) / 1000).alias("ytd_mw"))


@query("q42_region_monthly", f"""
    SELECT cast(year({DAY}) AS integer) AS year, cast(month({DAY}) AS integer) AS month,
           sum({KW}) / 1000 AS mw
    {_REGION} AND {KW} IS NOT NULL AND year({DAY}) BETWEEN 1998 AND 2001 GROUP BY 1, 2""")
def region_monthly(r: Register) -> DataFrame:
    rows = region(r.solar).filter(
        F.col(KW).isNotNull() & F.col(DAY).between("1998-01-01", "2001-12-31"))
    return rows.groupBy(F.year(DAY).alias("year"), F.month(DAY).alias("month")).agg(mw(KW).alias("mw"))


@query("q42_region_segments", f"""
    SELECT {sql_segment3(KW)} AS segment, count(*) AS units, sum({KW}) / 1000 AS mw
    {_REGION} GROUP BY 1""")
def region_segments(r: Register) -> DataFrame:
    return region(r.solar).groupBy(segment3(F.col(KW)).alias("segment")).agg(*units_and_mw(KW))


# ------------------------------------------------------------------------------- district assets


def plz_rows(df: DataFrame) -> DataFrame:
    """One row per unit: postcode, a 1 to count and its capacity."""
    return df.filter(F.col("Postleitzahl").isNotNull()).select(
        norm_plz(F.col("Postleitzahl")).alias("plz"), F.lit(1).cast("bigint").alias("units"),
        F.coalesce(F.col(KW), F.lit(0.0)).alias("kw"))


def district_assets(r: Register) -> DataFrame:
    """Large solar, storage and onshore wind per district; every known district appears."""
    solar = active(r.solar).filter(kw_band(F.col(KW), low=100))
    wind = active(r.wind)
    by_plz = J.merge_branches({
        "solar": plz_rows(solar),
        "storage": plz_rows(active(r.storage_raw)),
        "wind": plz_rows(wind.filter(is_onshore(wind))),
    }, "plz", ["units", "kw"])
    measures = [c for c in by_plz.columns if c != "plz"]
    found = by_plz.join(r.plz_district, "plz").groupBy("kreis").agg(
        *[F.sum(c).alias(c) for c in measures])
    every = r.district_meta.join(found, "kreis", "full").fillna(0, subset=measures)
    kw = {c: c.replace("_kw", "_mw") for c in measures if c.endswith("_kw")}
    return every.select(
        "kreis", "einwohner", "lat", "lon", *[c for c in measures if c not in kw],
        *[(F.col(c) / 1000).alias(name) for c, name in kw.items()])


def _assets_sql() -> str:
    def branch(name: str, table: str, where: str) -> str:
        return f"""
        SELECT d.kreis, '{name}' AS tech, coalesce({KW}, 0) AS kw
        FROM {table} JOIN plz_district d ON d.plz = CASE WHEN length(Postleitzahl) < 5 THEN lpad(Postleitzahl, 5, '0') ELSE Postleitzahl END
        WHERE {_ACTIVE} AND {where}"""

    rows = " UNION ALL ".join([
        branch("solar", "solar", f"{KW} >= 100"), branch("storage", "stromspeicher", "true"),
        branch("wind", "wind", "(Lage IS NULL OR Lage <> 'WindAufSee') AND"
               " (WindAnLandOderAufSee IS NULL OR WindAnLandOderAufSee <> '889')")])
    cells = ", ".join(
        f"count(*) FILTER (WHERE tech = '{t}') AS {t}_units,"
        f" coalesce(sum(kw) FILTER (WHERE tech = '{t}'), 0) / 1000 AS {t}_mw"
        for t in ("solar", "storage", "wind"))
    return f"""
    SELECT m.kreis, m.einwohner, m.lat, m.lon, {cells}, count(tech) AS total_units,
           coalesce(sum(kw), 0) / 1000 AS total_mw
    FROM district_meta m LEFT JOIN ({rows}) x ON x.kreis = m.kreis
    GROUP BY m.kreis, m.einwohner, m.lat, m.lon"""


@query("q43_district_assets", _assets_sql())
def district_assets_table(r: Register) -> DataFrame:
    return district_assets(r)


_TOP_ASSETS = f"SELECT * FROM ({_assets_sql()}) ORDER BY total_units DESC, kreis LIMIT 10"


@query("q43_district_assets_long", f"""
    SELECT kreis, tech, units FROM ({_TOP_ASSETS})
    UNPIVOT (units FOR tech IN (solar_units AS 'Solar', storage_units AS 'Speicher',
                                wind_units AS 'Wind'))""")
def district_assets_long(r: Register) -> DataFrame:
    top = L.top_k(district_assets(r), "total_units", 10, ["kreis"])
    return A.unpivot_measures(top, ["kreis"], {
        "solar_units": "Solar", "storage_units": "Speicher", "wind_units": "Wind"}, "tech", "units")


@query("q43_top_district", f"""
    SELECT max(total_mw) AS max_value, arg_max(kreis, total_mw) AS max_label,
           min(total_mw) AS min_value, (SELECT kreis FROM ({_assets_sql()})
               ORDER BY total_mw, kreis LIMIT 1) AS min_label
    FROM ({_assets_sql()})""")
def top_district(r: Register) -> DataFrame:
    return A.extremes(district_assets(r).select("kreis", "total_mw"), "total_mw", "kreis")


# ------------------------------------------------------------------------------- building energy

TYPES = {"speicher": "speicher_units", "home_pv": "home_pv_units", "biomasse": "biomasse_units"}


def building_plz(r: Register) -> DataFrame:
    """Storage, home PV and biomass units per postcode with the district, where one is known."""
    merged = J.merge_branches({
        "speicher": plz_rows(active(r.storage_raw)),
        "home_pv": plz_rows(active(r.solar).filter(kw_band(F.col(KW), high=10))),
        "biomasse": plz_rows(active(r.table("biomasse"))),
    }, "plz", ["units"])
    return merged.withColumnRenamed("total_units", "units").join(r.plz_district, "plz", "left")


def building_districts(r: Register, detail: DataFrame) -> DataFrame:
    measures = [*TYPES.values(), "units"]
    found = detail.filter(F.col("kreis").isNotNull()).groupBy("kreis").agg(
        *[F.sum(c).alias(c) for c in measures])
    return found.join(r.district_meta, "kreis", "left").withColumn(
        "per_1000", F.round(J.per_thousand(F.col("units"), F.col("einwohner")), 6))


def _building_sql(types: tuple[str, ...] = tuple(TYPES)) -> str:
    def branch(name: str, table: str, where: str) -> str:
        return (f"SELECT CASE WHEN length(Postleitzahl) < 5 THEN lpad(Postleitzahl, 5, '0') ELSE Postleitzahl END AS plz, '{name}' AS kind FROM {table}"
                f" WHERE Postleitzahl IS NOT NULL AND {_ACTIVE} AND {where}")

    rows = " UNION ALL ".join([
        branch("speicher", "stromspeicher", "true"), branch("home_pv", "solar", f"{KW} < 10"),
        branch("biomasse", "biomasse", "true")])
    cells = ", ".join(
        f"count(*) FILTER (WHERE kind = '{t}' AND {str(t in types).lower()}) AS {t}_units" for t in TYPES)
    wanted = ", ".join(f"'{t}'" for t in types)
    return f"""
    SELECT x.plz, d.kreis, {cells}, count(*) FILTER (WHERE kind IN ({wanted})) AS units
    FROM ({rows}) x LEFT JOIN plz_district d ON d.plz = x.plz GROUP BY 1, 2"""


def _building_district_sql(types: tuple[str, ...] = tuple(TYPES)) -> str:
    sums = ", ".join(f"cast(sum({c}) AS bigint) AS {c}" for c in [*TYPES.values(), "units"])
    return f"""
    SELECT b.*, m.einwohner, m.lat, m.lon,
           CASE WHEN m.einwohner > 0 THEN round(b.units / m.einwohner * 1000, 6) END AS per_1000
    FROM (SELECT kreis, {sums} FROM ({_building_sql(types)}) WHERE kreis IS NOT NULL GROUP BY 1) b
    LEFT JOIN district_meta m ON m.kreis = b.kreis"""


@query("q44_building_plz", _building_sql())
def building_plz_table(r: Register) -> DataFrame:
    return building_plz(r)


@query("q44_building_districts", _building_district_sql())
def building_district_table(r: Register) -> DataFrame:
    return building_districts(r, building_plz(r))


@query("q44_building_districts_masked", _building_district_sql(("speicher", "home_pv")))
def building_district_masked(r: Register) -> DataFrame:
    masked = P.mask_measures(building_plz(r), TYPES, ["speicher", "home_pv"], "units")
    return building_districts(r, masked)


_EVENT_DAY = f"coalesce(try_cast(Registrierungsdatum AS date), {DAY})"


@query("q45_storage_monthly", f"""
    SELECT cast(year({_EVENT_DAY}) AS integer) AS year, cast(month({_EVENT_DAY}) AS integer) AS month,
           count(*) AS units
    FROM stromspeicher
    WHERE Bundesland = '{HOME_STATE}' AND {_ACTIVE} AND year({_EVENT_DAY}) BETWEEN 1997 AND 2001
    GROUP BY 1, 2""")
def storage_monthly(r: Register) -> DataFrame:
    rows = region(r.storage_raw)
    dated = rows.withColumn("event_day", P.event_date(rows)).filter(
        F.col("event_day").between("1997-01-01", "2001-12-31"))
    return dated.groupBy(F.year("event_day").alias("year"), F.month("event_day").alias("month")).agg(
        F.count("*").alias("units"))


@query("q46_commercial_segments", f"""
    SELECT {sql_segment3(KW)} AS kategorie, count(*) AS anlagen, round(sum({KW}) / 1000, 1) AS mw
    {_REGION} AND {KW} >= 10 GROUP BY 1
    UNION ALL
    SELECT 'Batteriespeicher', count(*), round(sum({KW}) / 1000, 1)
    FROM stromspeicher WHERE Bundesland = '{HOME_STATE}'""")
def commercial_segments(r: Register) -> DataFrame:
    rounded_mw = F.round(F.sum(KW) / 1000, 1).alias("mw")
    solar = region(r.solar).filter(kw_band(F.col(KW), low=10))
    segments = solar.groupBy(segment3(F.col(KW)).alias("kategorie")).agg(
        F.count("*").alias("anlagen"), rounded_mw)
    storage = r.storage_raw.filter(F.col("Bundesland") == HOME_STATE).agg(
        F.count("*").alias("anlagen"), rounded_mw)
    return append([segments, storage.select(F.lit("Batteriespeicher").alias("kategorie"),
                                            "anlagen", "mw")])


# ------------------------------------------------------------------------------- external indices


def by_nation(r: Register, *aggs: Column) -> DataFrame:
    """Customers summarised per district, the stand-in for externally published district tables."""
    people = r.source("customer").groupBy("c_nationkey").agg(*aggs)
    names = r.source("nation").select(F.col("n_nationkey").alias("c_nationkey"),
                                      F.col("n_name").alias("kreis"))
    return names.join(people, "c_nationkey", "left")


_LOGISTICS = f"""
    SELECT i.kreis, i.logistik_index, coalesce(s.mw, 0) AS solar_mw, coalesce(s.units, 0) AS solar_units,
           m.einwohner, m.lat, m.lon
    FROM (SELECT n_name AS kreis, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS logistik_index
          FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1) i
    LEFT JOIN (SELECT kreis, units, round(mw, 6) AS mw
               FROM ({_district_sql(f"{_ACTIVE} AND {KW} >= 10 AND {KW} < 1000")})) s USING (kreis)
    LEFT JOIN district_meta m USING (kreis)"""


def logistics(r: Register) -> DataFrame:
    index = by_nation(r, F.count_if(F.col("c_mktsegment") == "BUILDING").alias("logistik_index"))
    solar = solar_districts(r, active(r.solar).filter(kw_band(F.col(KW), 10, 1000)))
    return J.index_vs_capacity(
        index.select("kreis", F.coalesce("logistik_index", F.lit(0)).alias("logistik_index")),
        solar, r.district_meta)


@query("q47_logistics_index", _LOGISTICS)
def logistics_index(r: Register) -> DataFrame:
    return logistics(r)


@query("q47_logistics_fit", f"""
    SELECT round(regr_slope(solar_mw, logistik_index), 6) AS slope,
           round(regr_intercept(solar_mw, logistik_index), 6) AS intercept, count(*) AS n
    FROM ({_LOGISTICS})""")
def logistics_fit(r: Register) -> DataFrame:
    fit = A.linear_fit(logistics(r), "logistik_index", "solar_mw")
    return fit.withColumns({"slope": F.round("slope", 6), "intercept": F.round("intercept", 6)})


_TOURISM = """
    SELECT n_name AS kreis, count(c_custkey) AS uebernachtungen_tausend,
           count(*) FILTER (WHERE c_mktsegment = 'HOUSEHOLD') AS betten,
           CASE n_nationkey % 5 WHEN 0 THEN 'Jun-Aug' WHEN 1 THEN 'Nov-Feb' WHEN 2 THEN 'Mar'
                WHEN 3 THEN 'Xxx-Aug' ELSE 'Aug-Dec' END AS saison_peak,
           n_nationkey % 5 IN (0, 4) AS peak_now
    FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey"""


def tourism(r: Register, month: int = AS_OF.month) -> DataFrame:
    """District tourism with a flag for the current season."""
    rows = by_nation(r, F.count("*").alias("n"),
                     F.count_if(F.col("c_mktsegment") == "HOUSEHOLD").alias("b"))
    season = F.element_at(
        F.array(*[F.lit(s) for s in ("Jun-Aug", "Nov-Feb", "Mar", "Xxx-Aug", "Aug-Dec")]),
        (F.col("c_nationkey") % 5 + 1).cast("int"))
    return rows.select(
        "kreis", F.coalesce("n", F.lit(0)).alias("uebernachtungen_tausend"),
        F.coalesce("b", F.lit(0)).alias("betten"), season.alias("saison_peak"),
    ).withColumn("peak_now", in_season(F.col("saison_peak"), F.lit(month)))


@query("q48_tourism", _TOURISM)
def tourism_table(r: Register) -> DataFrame:
    return tourism(r)


@query("q48_tourism_top8", f"""
    SELECT * FROM ({_TOURISM}) WHERE peak_now
    ORDER BY uebernachtungen_tausend DESC, kreis LIMIT 8""")
def tourism_top8(r: Register) -> DataFrame:
    return L.top_k(tourism(r).filter("peak_now"), "uebernachtungen_tausend", 8, ["kreis"])


# ------------------------------------------------------------------------------- labour market

_NAMES = {0: "Landkreis Gotha", 1: "Eisenach, Stadt", 2: "Sömmerda, Landkreis"}


def labour_payloads(r: Register) -> DataFrame:
    """District name and the two metric documents the feed would have answered with."""
    rows = by_nation(r, F.count("*").alias("n"),
                     F.count_if(F.col("c_mktsegment") == "BUILDING").alias("jobs"))
    key = F.col("c_nationkey")
    name = F.col("kreis")
    for number, text in _NAMES.items():
        name = F.when(key == number, F.lit(text)).otherwise(name)
    jobs = F.format_string(
        '[{"metricName":"Sonstiges","value":"x","attributes":[]},'
        '{"metricName":"Bestand Arbeitsstellen","value":"%d","attributes":[{"DESC":"Juni 2001"}]},'
        '{"metricName":"STEA_VJV_rel","value":"%d.5","attributes":null}]', "jobs", key)
    employed = F.when(key == 7, F.lit("0")).otherwise((F.col("n") * 10).cast("string"))
    people = F.when(key == 6, F.lit("[]")).otherwise(F.format_string(
        '[{"metricName":"Beschäftigte","value":"%s","attributes":[{"DESC":"März 2001"}]}]', employed))
    return rows.select(key.alias("nr"), name.alias("kreis"), F.col("kreis").alias("meta_kreis"),
                       jobs.alias("stea"), people.alias("bst"))


def labour_by_district(r: Register) -> DataFrame:
    """Open positions against employment per district; a dissolved district keeps only its note."""
    named = J.norm_district(labour_payloads(r), "kreis")
    alive = F.col("api_name").isNotNull()
    stea, bst = parse_metrics(F.col("stea")), parse_metrics(F.col("bst"))
    jobs, period = pick_metric(stea, "Bestand Arbeitsstellen")
    yoy, _ = pick_metric(stea, "STEA_VJV_rel")
    people, people_period = pick_metric(bst, "Beschäftigte")
    picked = named.select(
        "kreis", "meta_kreis", "api_name", "ba_note", F.when(alive, people).alias("beschaeftigte"),
        F.when(alive, jobs).alias("offene_stellen"), F.when(alive, yoy).alias("stellen_yoy_pct"),
        F.when(alive, period).alias("stea_periode"), F.when(alive, people_period).alias("bst_periode"))
    ratios = J.labour_ratios(F.col("offene_stellen"), F.col("beschaeftigte"))
    meta = r.district_meta.withColumnRenamed("kreis", "meta_kreis").select("meta_kreis", "einwohner")
    return picked.withColumns({k: F.round(v, 6) for k, v in ratios.items()}).join(
        meta, "meta_kreis", "left").drop("meta_kreis")


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_LABOUR = f"""
    WITH base AS (
        SELECT n_nationkey AS nr, n_name, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS jobs,
               count(*) AS n
        FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2),
    rows AS (
        SELECT nr, n_name, CASE nr {" ".join(f"WHEN {k} THEN {_sql_text(v)}" for k, v in _NAMES.items())}
                   ELSE n_name END AS kreis,
               CASE WHEN nr <> 1 THEN cast(jobs AS double) END AS offene_stellen,
               CASE WHEN nr = 7 THEN 0.0e0 WHEN nr NOT IN (1, 6) THEN n * 10.0e0 END AS beschaeftigte
        FROM base)
    SELECT r.kreis, CASE r.nr WHEN 0 THEN {_sql_text(DISTRICT_ALIASES[_NAMES[0]])} WHEN 1 THEN NULL
                         WHEN 2 THEN {_sql_text(DISTRICT_ALIASES[_NAMES[2]])} ELSE r.kreis END AS api_name,
           CASE WHEN r.nr = 1 THEN {_sql_text(DISSOLVED_DISTRICTS[_NAMES[1]])} END AS ba_note,
           beschaeftigte, offene_stellen, CASE WHEN r.nr <> 1 THEN r.nr + 0.5e0 END AS stellen_yoy_pct,
           CASE WHEN r.nr <> 1 THEN 'Juni 2001' END AS stea_periode,
           CASE WHEN r.nr NOT IN (1, 6) THEN 'März 2001' END AS bst_periode,
           round(beschaeftigte / 1000, 6) AS beschaeftigte_tausend,
           CASE WHEN beschaeftigte > 0 THEN round(offene_stellen / beschaeftigte * 100, 6) END
               AS quote_vakanz_pct,
           CASE WHEN beschaeftigte > 0 THEN round(offene_stellen / beschaeftigte * 1000, 6) END
               AS recruiting_index,
           m.einwohner
    FROM rows r LEFT JOIN district_meta m ON m.kreis = r.n_name"""


@query("q49_labour_market", _LABOUR)
def labour_market(r: Register) -> DataFrame:
    return labour_by_district(r)


@query("q49_labour_top", f"""
    SELECT max(quote_vakanz_pct) AS max_value, (SELECT kreis FROM ({_LABOUR})
               WHERE quote_vakanz_pct IS NOT NULL ORDER BY quote_vakanz_pct DESC, kreis LIMIT 1) AS max_label,
           min(quote_vakanz_pct) AS min_value, (SELECT kreis FROM ({_LABOUR})
               WHERE quote_vakanz_pct IS NOT NULL ORDER BY quote_vakanz_pct, kreis LIMIT 1) AS min_label
    FROM ({_LABOUR})""")
def labour_top(r: Register) -> DataFrame:
    return A.extremes(labour_by_district(r), "quote_vakanz_pct", "kreis")


@query("q49_labour_total", f"""
    SELECT sum(offene_stellen) AS offene_stellen, sum(beschaeftigte) AS beschaeftigte,
           round(sum(offene_stellen) / sum(beschaeftigte) * 100, 6) AS quote_vakanz_pct
    FROM ({_LABOUR})""")
def labour_total(r: Register) -> DataFrame:
    total = labour_by_district(r).agg(F.sum("offene_stellen").alias("offene_stellen"),
                                      F.sum("beschaeftigte").alias("beschaeftigte"))
    ratios = J.labour_ratios(F.col("offene_stellen"), F.col("beschaeftigte"))
    return total.withColumn("quote_vakanz_pct", F.round(ratios["quote_vakanz_pct"], 6))
