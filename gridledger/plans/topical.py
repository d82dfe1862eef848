"""Stand-alone topics: countries, elections, interviews, organisations, batteries, projects,
intake, series, citations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridledger.catalog import INTERVIEW_THEMES, STORAGE_TECHNOLOGY
from gridledger.functions.convert import clock
from gridledger.functions.labels import enum_label, label_or_dash
from gridledger.functions.predicates import in_list_or_all, is_battery, search_text
from gridledger.operators import aggregates as A
from gridledger.operators import citations as C
from gridledger.operators import joins as J
from gridledger.operators import projection as P
from gridledger.operators import ranking as L
from gridledger.operators import units as U
from gridledger.operators import windows as W
from gridledger.plans.register import Register
from gridledger.plans.registry import query
from gridledger.sources.dimensions import elections, organisations

# ------------------------------------------------------------------------------- countries

_COUNTRIES = """
    SELECT n_name AS country, r_name AS continent, o.year,
           o.turnover / o.n AS gdp_per_cap, 40 + o.n * 25e-2 AS life_exp, o.n / 8e0 AS pop_mio
    FROM (SELECT c_nationkey, cast(year(o_orderdate) AS integer) AS year, count(*) AS n,
                 cast(sum(cast(floor(o_totalprice) AS bigint)) AS double) AS turnover
          FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2) o
    JOIN nation ON n_nationkey = o.c_nationkey JOIN region ON r_regionkey = n_regionkey
    WHERE o.year = 1998 AND r_name IN ('EUROPE', 'ASIA', 'AFRICA')"""


def countries(r: Register, year: int = 1998, continents=("EUROPE", "ASIA", "AFRICA")) -> DataFrame:
    """Country indicators of one year.

    Orders are folded per customer before the join, which tames busy customers and is already
    partitioned the way the join needs it, and per country before names are joined.
    """
    day = F.col("o_orderdate")
    orders = r.source("orders").filter(
        (day >= clock(dt.datetime(year, 1, 1))) & (day < clock(dt.datetime(year + 1, 1, 1))))
    folded = orders.groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.sum(F.floor("o_totalprice")).alias("turnover"))
    people = r.source("customer").select("c_custkey", "c_nationkey")
    totals = folded.join(people, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(
        F.lit(year).alias("year"), F.sum("n").alias("n"),
        F.sum("turnover").cast("double").alias("turnover"))
    names = r.source("nation").join(
        r.source("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    named = totals.join(names, F.col("c_nationkey") == F.col("n_nationkey"))
    return named.filter(in_list_or_all(F.col("r_name"), continents)).select(
        F.col("n_name").alias("country"), F.col("r_name").alias("continent"), "year",
        (F.col("turnover") / F.col("n")).alias("gdp_per_cap"),
        (40 + F.col("n") * 0.25).alias("life_exp"), (F.col("n") / 8.0).alias("pop_mio"))


@query("q56_country_table", f"""
    SELECT country, continent, year, round(life_exp, 1) AS life_exp,
           round(gdp_per_cap, 0) AS gdp_per_cap, round(pop_mio, 2) AS pop_mio FROM ({_COUNTRIES})""")
def country_table(r: Register) -> DataFrame:
    return countries(r).withColumns({
        "life_exp": F.round("life_exp", 1), "gdp_per_cap": F.round("gdp_per_cap", 0),
        "pop_mio": F.round("pop_mio", 2)}).orderBy(F.desc("gdp_per_cap"), "country")


@query("q56_country_medians", f"""
    SELECT count(*) AS n, round(median(life_exp), 6) AS life_exp,
           round(median(gdp_per_cap), 6) AS gdp_per_cap FROM ({_COUNTRIES})""")
def country_medians(r: Register) -> DataFrame:
    # one row per country reaches the medians
    return countries(r).agg(F.count("*").alias("n"), F.round(F.median("life_exp"), 6).alias("life_exp"),
                            F.round(F.median("gdp_per_cap"), 6).alias("gdp_per_cap"))


# ------------------------------------------------------------------------------- elections

_ELECTION = """
    SELECT n_name AS casa, cast(count(*) FILTER (WHERE c_acctbal >= 0) AS integer) AS local_votes,
           cast(count(*) FILTER (WHERE c_acctbal < 0) AS integer) AS expat_votes,
           cast(count(DISTINCT c_mktsegment) + n_nationkey % 7 AS integer) AS candidates,
           CASE WHEN n_nationkey <> 5 THEN 33e0 + n_nationkey * 125e-3 END AS lat,
           CASE WHEN n_nationkey <> 5 THEN 35e0 + n_nationkey * 125e-3 END AS lon
    FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey"""


def election_areas(r: Register) -> DataFrame:
    """Votes per area as the published table has them: text columns with spaced names."""
    votes = r.source("customer").groupBy("c_nationkey").agg(
        F.count_if(F.col("c_acctbal") >= 0).alias("l"), F.count_if(F.col("c_acctbal") < 0).alias("e"),
        F.count_distinct("c_mktsegment").alias("c"))
    key = F.col("n_nationkey")
    raw = r.source("nation").join(votes, key == F.col("c_nationkey")).select(
        F.col("n_name").alias("Electoral Area"), F.col("l").cast("string").alias("Local votes"),
        F.col("e").cast("string").alias("Expat votes"),
        (F.col("c") + key % 7).cast("string").alias("Candidates"))
    places = r.source("nation").filter(key != 5).select(
        F.col("n_name").alias("casa"), (33 + key * 0.125).alias("lat"), (35 + key * 0.125).alias("lon"))
    return elections(raw, places)


@query("q57_election_areas", f"""
    SELECT e.*, local_votes + expat_votes AS registered,
           greatest(1, least(100, cast(floor((local_votes - lo) / (hi - lo) * 99 + 1) AS integer)))
               AS local_idx,
           cast(floor(least(1, greatest(0, (candidates - 1) / 10)) * 99 + 1) AS integer) AS candidate_idx,
           round(6 + (sqrt(local_votes) - sqrt(lo)) / (sqrt(hi) - sqrt(lo)) * 16, 6) AS radius
    FROM ({_ELECTION}) e,
         (SELECT min(local_votes) * 1e0 AS lo, max(local_votes) * 1e0 AS hi FROM ({_ELECTION}))""")
def election_table(r: Register) -> DataFrame:
    areas = election_areas(r).withColumn("registered", F.col("local_votes") + F.col("expat_votes"))
    ranged = P.with_ranges(areas, _votes=F.col("local_votes"), _root=F.sqrt("local_votes"))
    scaled = P.scale_idx(ranged, "local_votes", "local_idx", known="_votes")
    scaled = P.scale_idx(scaled, "candidates", "candidate_idx", low=1, high=11)
    placed = P.rescale_sqrt(scaled, "local_votes", "radius", known="_root").drop("_votes", "_root")
    return placed.withColumn("radius", F.round("radius", 6))


@query("q57_election_totals", f"""
    SELECT count(*) AS casas, cast(sum(local_votes) AS bigint) AS local_votes,
           cast(sum(candidates) AS bigint) AS candidates FROM ({_ELECTION})""")
def election_totals(r: Register) -> DataFrame:
    return election_areas(r).agg(
        F.count("*").alias("casas"), F.sum("local_votes").alias("local_votes"),
        F.sum("candidates").alias("candidates"))


# ------------------------------------------------------------------------------- interviews

_KNOWN_THEMES = ", ".join(f"'{t}'" for t in INTERVIEW_THEMES)
PATTERN = "tion.*the"


def extracts(r: Register) -> DataFrame:
    return P.extract_features(r.table("extracts"), "extract", "theme", INTERVIEW_THEMES)


def filtered_extracts(r: Register, interviews=("src1", "src2", "src3", "src4"), themes=(),
                      codes=("en", "de"), pattern: str = PATTERN) -> DataFrame:
    return extracts(r).filter(
        in_list_or_all(F.col("interview"), interviews) & in_list_or_all(F.col("theme"), themes)
        & in_list_or_all(F.col("code"), codes) & search_text(F.col("extract"), pattern))


@query("q58_extract_search", f"""
    SELECT extract_id, interview, code, CASE WHEN theme IN ({_KNOWN_THEMES}) THEN theme END AS theme,
           cast(length(extract) AS integer) AS extract_length
    FROM extracts
    WHERE interview IN ('src1', 'src2', 'src3', 'src4') AND code IN ('en', 'de')
      AND regexp_matches(extract, '{PATTERN}', 'i')""")
def extract_search(r: Register) -> DataFrame:
    return filtered_extracts(r).drop("extract")


@query("q58_code_by_interview", "SELECT code, interview, count(*) AS n FROM extracts GROUP BY 1, 2")
def code_by_interview(r: Register) -> DataFrame:
    """Long form: interviews are data, so no list of columns can name them all."""
    return A.freq(extracts(r), "code", "interview")


@query("q58_interview_theme", f"""
    SELECT interview, CASE WHEN theme IN ({_KNOWN_THEMES}) THEN theme END AS theme, count(*) AS n
    FROM extracts GROUP BY 1, 2""")
def interview_theme(r: Register) -> DataFrame:
    return A.freq(extracts(r), "interview", "theme")


# ------------------------------------------------------------------------------- organisations

_SECTOR = ("CASE WHEN schluessel LIKE 'R%' THEN 'Health & social work' WHEN schluessel LIKE 'Q%'"
           " THEN 'Education' WHEN schluessel LIKE 'T%' THEN 'Advocacy & services' ELSE 'Other' END")
_ORGS = (f"SELECT *, {_SECTOR} AS sector FROM organisations"
         " WHERE latitude IS NOT NULL AND longitude IS NOT NULL")


def orgs(r: Register) -> DataFrame:
    return organisations(r.table("organisations"))


@query("q59_org_sectors", f"SELECT sector, count(*) AS n FROM ({_ORGS}) GROUP BY 1")
def org_sectors(r: Register) -> DataFrame:
    return A.freq(orgs(r), "sector")


@query("q59_org_locations", f"""
    SELECT location, count(*) AS n FROM ({_ORGS}) GROUP BY 1 ORDER BY n DESC, location LIMIT 12""")
def org_locations(r: Register) -> DataFrame:
    return L.top_groups(orgs(r), ["location"], F.count("*"), "n", 12)


@query("q59_org_list", f"""
    SELECT institution, location, sector, email FROM ({_ORGS})
    WHERE sector = 'Education' AND location = 'Ort 3'""")
def org_list(r: Register, sector_name: str = "Education", place: str = "Ort 3") -> DataFrame:
    chosen = orgs(r).filter((F.col("sector") == sector_name) & (F.col("location") == place))
    return chosen.select("institution", "location", "sector", "email")


# ------------------------------------------------------------------------------- batteries

_BATTERIES = """
    SELECT EinheitMastrNummer AS mastr_nr, Bruttoleistung AS kw, NutzbareSpeicherkapazitaet AS kwh,
           Inbetriebnahmedatum AS inbetrieb, Technologie, Batterietechnologie, Bundesland, Gemeinde
    FROM storage
    WHERE NOT (lower(trim(coalesce(Technologie, ''))) LIKE '%pumpspeicher%'
               OR lower(trim(coalesce(Technologie, ''))) LIKE '%wasserstoff%')
      AND (lower(trim(Technologie)) LIKE '%batterie%' OR lower(trim(Technologie)) LIKE '%lithium%'
           OR lower(trim(Technologie)) LIKE '%akku%' OR trim(Technologie) = '524'
           OR trim(Batterietechnologie) = '727')"""


def batteries(r: Register) -> DataFrame:
    fleet = P.storage_compat(r.storage_raw)
    return fleet.filter(is_battery(fleet)).select(
        F.col("EinheitMastrNummer").alias("mastr_nr"), F.col("Bruttoleistung").alias("kw"),
        F.col("NutzbareSpeicherkapazitaet").alias("kwh"), F.col("Inbetriebnahmedatum").alias("inbetrieb"),
        "Technologie", "Batterietechnologie", "Bundesland", "Gemeinde")


@query("q60_battery_kpi", f"""
    SELECT count(*) AS units, sum(kw) / 1000 AS mw, sum(kwh) / 1000 AS mwh,
           round(avg(kw / kwh) FILTER (WHERE kw > 0 AND kwh > 0), 6) AS c_rate
    FROM ({_BATTERIES})""")
def battery_kpi(r: Register) -> DataFrame:
    return batteries(r).agg(
        F.count("*").alias("units"), (F.sum("kw") / 1000).alias("mw"), (F.sum("kwh") / 1000).alias("mwh"),
        F.round(A.mean_ratio(F.col("kw"), F.col("kwh")), 6).alias("c_rate"))


@query("q60_battery_by_year", f"""
    SELECT cast(year(inbetrieb) AS integer) AS year, sum(kw) / 1000 AS mw
    FROM ({_BATTERIES}) WHERE inbetrieb IS NOT NULL GROUP BY 1""")
def battery_by_year(r: Register) -> DataFrame:
    dated = batteries(r).filter(F.col("inbetrieb").isNotNull())
    return dated.groupBy(F.year("inbetrieb").alias("year")).agg((F.sum("kw") / 1000).alias("mw"))


@query("q60_battery_by_state", f"""
    SELECT s.name AS bundesland_name, sum(kw) / 1000 AS mw
    FROM ({_BATTERIES}) LEFT JOIN state_names s ON s.code = Bundesland GROUP BY 1""")
def battery_by_state(r: Register) -> DataFrame:
    totals = batteries(r).groupBy("Bundesland").agg((F.sum("kw") / 1000).alias("mw"))
    return U.with_state(totals, "Bundesland").select("bundesland_name", "mw")


@query("q60_battery_largest", f"""
    SELECT mastr_nr, Technologie, Batterietechnologie, Gemeinde, round(kw / 1000, 2) AS mw,
           round(kwh / 1000, 2) AS mwh, inbetrieb
    FROM ({_BATTERIES}) ORDER BY kwh DESC NULLS LAST, mastr_nr LIMIT 40""")
def battery_largest(r: Register) -> DataFrame:
    return L.top_k(batteries(r), "kwh", 40, ["mastr_nr"]).select(
        "mastr_nr", "Technologie", "Batterietechnologie", "Gemeinde",
        F.round(F.col("kw") / 1000, 2).alias("mw"), F.round(F.col("kwh") / 1000, 2).alias("mwh"),
        "inbetrieb")


_LABELS = " ".join(f"WHEN '{code}' THEN '{label}'" for code, label in STORAGE_TECHNOLOGY.items())
_LABEL = f"CASE trim(Technologie) {_LABELS} ELSE concat('Code ', trim(Technologie)) END"


@query("q61_technology_mix", f"""
    SELECT Technologie, {_LABEL} AS bezeichnung, count(*) AS n, sum(Bruttoleistung) / 1000 AS mw
    FROM stromspeicher WHERE Technologie IS NOT NULL GROUP BY 1""")
def technology_mix(r: Register) -> DataFrame:
    mix = r.storage_raw.filter(F.col("Technologie").isNotNull()).groupBy("Technologie").agg(
        F.count("*").alias("n"), (F.sum("Bruttoleistung") / 1000).alias("mw"))
    return mix.withColumn("bezeichnung", enum_label(F.col("Technologie"), STORAGE_TECHNOLOGY))


@query("q61_cumulative_top5", """
    WITH top AS (SELECT Technologie FROM stromspeicher WHERE Technologie IS NOT NULL GROUP BY 1
                 ORDER BY sum(Bruttoleistung) DESC NULLS LAST, Technologie LIMIT 5)
    SELECT Technologie, year, mw, round(sum(mw) OVER (PARTITION BY Technologie ORDER BY year), 6) AS cum_mw
    FROM (SELECT Technologie, cast(year(Inbetriebnahmedatum) AS integer) AS year,
                 sum(Bruttoleistung) / 1000 AS mw
          FROM stromspeicher
          WHERE Inbetriebnahmedatum IS NOT NULL AND Technologie IN (SELECT Technologie FROM top)
          GROUP BY 1, 2)""")
def cumulative_top5(r: Register) -> DataFrame:
    kept = J.only_top_keys(r.storage_raw, "Technologie", "Bruttoleistung", 5)
    yearly = kept.filter(F.col("Inbetriebnahmedatum").isNotNull()).groupBy(
        "Technologie", F.year("Inbetriebnahmedatum").alias("year")).agg(
        (F.sum("Bruttoleistung") / 1000).alias("mw"))
    running = W.cumulative(yearly, ["Technologie"], "year", "mw", "cum_mw")
    return running.withColumn("cum_mw", F.round("cum_mw", 6))


# ------------------------------------------------------------------------------- projects


@query("q62_projects_by_status", """
    SELECT coalesce(nullif(trim(status), ''), '—') AS status, count(*) AS n FROM projects GROUP BY 1""")
def projects_by_status(r: Register) -> DataFrame:
    return A.freq(r.table("projects").select(label_or_dash(F.col("status")).alias("status")), "status")


@query("q62_projects_by_state", """
    SELECT coalesce(nullif(trim(bundesland), ''), '—') AS bundesland, count(*) AS n
    FROM projects GROUP BY 1""")
def projects_by_state(r: Register) -> DataFrame:
    label = label_or_dash(F.col("bundesland")).alias("bundesland")
    return A.freq(r.table("projects").select(label), "bundesland")


# ------------------------------------------------------------------------------- intake

_DAILY = """
    SELECT cast(o_orderdate AS date) AS day, count(*) AS n_units,
           cast(sum(cast(floor(o_totalprice) AS bigint)) AS double) AS amount
    FROM orders GROUP BY 1"""


def intake(r: Register, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
    """New registrations per day, optionally only of the days [first, last)."""
    orders = r.source("orders")
    day = F.col("o_orderdate")
    if first:
        orders = orders.filter(day >= clock(dt.datetime(first.year, first.month, first.day)))
    if last:
        orders = orders.filter(day < clock(dt.datetime(last.year, last.month, last.day)))
    return A.daily(orders, F.to_date(day), F.floor("o_totalprice").cast("double"))


@query("q63_month_daily", f"""
    SELECT day, cast(round_even(n_units * 1.15e0, 0) AS bigint) AS n_units,
           round(amount * 1.15e0, 6) AS amount
    FROM ({_DAILY}) WHERE day >= DATE '2000-03-01' AND day < DATE '2000-04-01'""")
def month_daily(r: Register) -> DataFrame:
    days = intake(r, dt.date(2000, 3, 1), dt.date(2000, 4, 1))
    return P.scenario(days, 15, "n_units", "amount").withColumn("amount", F.round("amount", 6))


@query("q63_vs_prior_month", f"""
    SELECT month, units, amount, lag(units) OVER w AS units_prior, lag(amount) OVER w AS amount_prior,
           round((units - lag(units) OVER w) * 100 / lag(units) OVER w, 6) AS units_change_pct,
           round((amount - lag(amount) OVER w) * 100 / lag(amount) OVER w, 6) AS amount_change_pct
    FROM (SELECT cast(date_trunc('month', day) AS date) AS month, cast(sum(n_units) AS bigint) AS units,
                 sum(amount) AS amount FROM ({_DAILY}) GROUP BY 1)
    WINDOW w AS (ORDER BY month)""")
def vs_prior_month(r: Register) -> DataFrame:
    monthly = r.source("orders").groupBy(
        F.trunc(F.to_date("o_orderdate"), "MM").alias("month")).agg(
        F.count("*").alias("units"), F.sum(F.floor("o_totalprice")).cast("double").alias("amount"))
    table = W.vs_prior_month(monthly, "month", ["units", "amount"])
    return table.withColumns({c: F.round(c, 6) for c in ("units_change_pct", "amount_change_pct")})


@query("q63_prior_daily_mean", f"""
    SELECT month, round(daily_mean, 6) AS daily_mean,
           round(lag(daily_mean) OVER (ORDER BY month), 6) AS prior_daily_mean
    FROM (SELECT cast(date_trunc('month', day) AS date) AS month, avg(n_units) AS daily_mean
          FROM ({_DAILY}) GROUP BY 1)""")
def prior_daily_mean(r: Register) -> DataFrame:
    means = W.prior_daily_mean(intake(r), "day", "n_units")
    return means.withColumns({c: F.round(c, 6) for c in ("daily_mean", "prior_daily_mean")})


@query("q64_series_ratio", """
    SELECT sum(a) * 1.5e0 AS series_a, sum(b) * 1.5e0 AS series_b,
           CASE WHEN sum(b) > 0 THEN round(sum(a) / sum(b), 6) END AS ratio
    FROM (SELECT date_trunc('month', o_orderdate) AS m, count(*) FILTER (WHERE o_orderstatus = 'O') AS a,
                 count(*) FILTER (WHERE o_orderstatus = 'F') AS b FROM orders GROUP BY 1)""")
def series_ratio(r: Register, scale: float = 1.5) -> DataFrame:
    totals = r.source("orders").agg(
        (F.count_if(F.col("o_orderstatus") == "O") * scale).alias("series_a"),
        (F.count_if(F.col("o_orderstatus") == "F") * scale).alias("series_b"))
    ratio = A.guarded_ratio(F.col("series_a"), F.col("series_b"))
    return totals.withColumn("ratio", F.round(ratio, 6))


# ------------------------------------------------------------------------------- citations


def part_title() -> Column:
    """Frequent words and rare ones, as titles have."""
    key = F.col("p_partkey")
    rare = [("alpha", key % 101), ("beta", key * 7 % 1009), ("gamma", key), ("delta", F.floor(key / 3))]
    return F.concat_ws(" ", "p_name", F.lower("p_type"), "p_brand", *[F.concat(F.lit(w), n.cast("string")) for w, n in rare])


def bibliography(r: Register) -> DataFrame:
    """A reference list written from the part catalogue: persons, group authors with a short name, DOIs with brackets."""
    key = F.col("p_partkey")
    title = part_title()
    tail = (
        F.when(key % 18 == 0, F.concat(F.lit(" doi: 10.1234/part(05)."), key.cast("string"), F.lit(".")))
        .when(key % 9 == 0, F.concat(F.lit(" doi: 10.1234/part."), key.cast("string")))
        .when(key % 9 == 1, F.lit(" Reuters press release. https://news.example.org/a"))
        .when(key % 9 == 2, F.lit(" https://example.org/b"))
        .otherwise(F.lit(""))
    )
    who = F.when(key % 10 == 3, F.concat(F.lit("Amt Netz"), key.cast("string"), F.lit(" (AN)"))).otherwise(
        F.concat(F.lit("Autor"), key.cast("string"), F.lit(", A. & Zweit, B.")))
    text = F.concat(who, F.lit(" ("), (1970 + F.col("p_size")).cast("string"), F.lit("). "), title,
                    F.lit(". Journal of Parts, 3(1), 1-9."), tail)
    return r.source("part").select(key.alias("ref_id"), text.alias("citation"))


def known_works(r: Register) -> DataFrame:
    """What two metadata services know: titles that differ a little, a lot or not at all. No key of a citation."""
    key = F.col("p_partkey")
    title = part_title()
    part = r.source("part")
    year = 1970 + F.col("p_size")
    first = part.filter("p_size <> 11").select(
        F.concat(F.lit("oa"), F.lpad(key.cast("string"), 10, "0")).alias("work_id"), F.lit("openalex").alias("source"),
        F.when(key % 2 == 0, F.concat(F.lit("A. Autor"), key.cast("string"))).alias("author"),
        F.when(key % 5 == 0, F.concat(title, F.lit(" (reprint)"))).when(key % 5 == 1, F.upper(title))
        .when(key % 5 == 2, F.lit("a completely different work")).otherwise(title).alias("title"),
        F.when(key % 4 == 0, year + 1).otherwise(year).alias("year"),
        F.when(key % 3 != 0, F.concat(F.lit("10.1234/oa."), key.cast("string"))).alias("doi"))
    second = part.filter("p_size <> 13").select(
        F.concat(F.lit("cr"), F.lpad(key.cast("string"), 10, "0")).alias("work_id"), F.lit("crossref").alias("source"),
        F.concat(F.lit("A. Autor"), key.cast("string")).alias("author"),
        F.when(key % 6 == 0, F.concat(F.lit("on the "), title, F.lit(" and its limits")))
        .otherwise(title).alias("title"),
        F.when(key % 7 == 0, year - 2).otherwise(year).alias("year"),
        F.concat(F.lit("10.1234/cr."), key.cast("string")).alias("doi"))
    return first.unionByName(second)


def resolved(r: Register) -> DataFrame:
    citations = C.parse_citations(bibliography(r))
    found = C.find_candidates(citations, known_works(r), "ref_id")
    return C.link_reliability(C.match_citations(citations, found, "ref_id"))


_TITLE = ("concat_ws(' ', p_name, lower(p_type), p_brand, concat('alpha', p_partkey % 101), concat('beta', p_partkey * 7 % 1009),"
          " concat('gamma', p_partkey), concat('delta', p_partkey // 3))")
_NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_CITATIONS = f"""
    WITH RECURSIVE refs AS (
        SELECT p_partkey AS ref_id, {_TITLE} AS title, 1970 + p_size AS year,
               CASE WHEN p_partkey % 18 = 0 THEN concat('10.1234/part(05).', p_partkey)
                    WHEN p_partkey % 9 = 0 THEN concat('10.1234/part.', p_partkey) END AS doi,
               p_partkey % 9 = 1 AS is_web,
               concat(CASE WHEN p_partkey % 10 = 3 THEN 'Netz' ELSE 'Autor' END, p_partkey) AS last_name FROM part),
    works AS (
        SELECT concat('oa', lpad(p_partkey::VARCHAR, 10, '0')) AS work_id, 'openalex' AS source,
               CASE WHEN p_partkey % 2 = 0 THEN concat('autor', p_partkey) END AS name,
               CASE p_partkey % 5 WHEN 0 THEN concat({_TITLE}, ' (reprint)') WHEN 1 THEN upper({_TITLE})
                    WHEN 2 THEN 'a completely different work' ELSE {_TITLE} END AS ctitle,
               CASE WHEN p_partkey % 4 = 0 THEN 1971 + p_size ELSE 1970 + p_size END AS cyear,
               CASE WHEN p_partkey % 3 <> 0 THEN concat('10.1234/oa.', p_partkey) END AS cdoi
        FROM part WHERE p_size <> 11
        UNION ALL
        SELECT concat('cr', lpad(p_partkey::VARCHAR, 10, '0')), 'crossref', concat('autor', p_partkey),
               CASE WHEN p_partkey % 6 = 0 THEN concat('on the ', {_TITLE}, ' and its limits')
                    ELSE {_TITLE} END,
               CASE WHEN p_partkey % 7 = 0 THEN 1968 + p_size ELSE 1970 + p_size END,
               concat('10.1234/cr.', p_partkey)
        FROM part WHERE p_size <> 13),
    ref_words AS (SELECT ref_id, unnest(w) AS word, len(w) AS n
                  FROM (SELECT ref_id, list_distinct(string_split({_NORM.format('title')}, ' ')) AS w FROM refs)),
    work_words AS (SELECT work_id, unnest(w) AS word, len(w) AS n
                   FROM (SELECT work_id, list_distinct(string_split({_NORM.format('ctitle')}, ' ')) AS w FROM works)),
    met AS (SELECT ref_id, work_id, 2e0 * count(*) / (r.n + w.n) AS overlap
            FROM ref_words r JOIN work_words w USING (word) GROUP BY ref_id, work_id, r.n, w.n
            HAVING 200 * count(*) >= 65 * (r.n + w.n)),
    cands AS (
        SELECT ref_id, source, {_NORM.format('title')} AS a, {_NORM.format('ctitle')} AS b, cdoi, cyear = year AS same_year
        FROM met JOIN refs USING (ref_id) JOIN works USING (work_id)
        QUALIFY row_number() OVER (PARTITION BY ref_id, source ORDER BY
            coalesce(name = lower(last_name), FALSE) DESC, overlap DESC, work_id) <= 5),
    blocks AS (
        SELECT 0 AS depth, a, b, a AS x, b AS y, 0 AS same FROM (SELECT DISTINCT a, b FROM cands)
        UNION ALL
        SELECT depth + 1, a, b,
               CASE side WHEN 0 THEN left(x, i - 1) ELSE substr(x, i + k) END,
               CASE side WHEN 0 THEN left(y, strpos(y, substr(x, i, k)) - 1) ELSE substr(y, strpos(y, substr(x, i, k)) + k) END,
               CASE side WHEN 0 THEN k ELSE 0 END
        FROM (SELECT depth, a, b, x, y, best // 1000 AS k, 999 - best % 1000 AS i, unnest([0, 1]) AS side
              FROM (SELECT depth, a, b, x, y, max(k * 1000 + 999 - i) AS best
                    FROM (SELECT depth, a, b, x, y, i, unnest(range(1, length(x) - i + 2)) AS k
                          FROM (SELECT depth, a, b, x, y, unnest(range(1, length(x) + 1)) AS i FROM blocks WHERE x <> '' AND y <> ''))
                    WHERE contains(y, substr(x, i, k)) GROUP BY depth, a, b, x, y))),
    ratios AS (SELECT a, b, 2e0 * sum(same) / (length(a) + length(b)) AS ratio FROM blocks GROUP BY a, b),
    scored AS (
        SELECT ref_id, source, cdoi, round(least(1.0e0, ratio + CASE WHEN same_year THEN 1e-1 ELSE 0e0 END), 9) AS score
        FROM cands JOIN ratios USING (a, b)),
    best AS (
        SELECT * FROM scored WHERE score >= 65e-2
        QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY
            (source = 'openalex' AND score >= 82e-2) DESC, score DESC, source = 'openalex' DESC, cdoi DESC NULLS LAST) = 1),
    linked AS (
        SELECT r.*, b.source, b.score, b.cdoi AS match_doi,
               CASE WHEN r.doi IS NOT NULL THEN 'doi_citation'
                    WHEN b.cdoi IS NOT NULL AND b.score >= 7e-1 THEN 'doi_found' ELSE 'search' END AS method
        FROM refs r LEFT JOIN best b USING (ref_id)),
    rated AS (
        SELECT *, cast(CASE method WHEN 'doi_citation' THEN CASE WHEN score >= 95e-2 THEN 98 WHEN score >= 85e-2 THEN 92 ELSE 80 END
                 WHEN 'doi_found' THEN CASE WHEN score >= 92e-2 THEN 96 WHEN score >= 8e-1 THEN 88 ELSE 75 END
                 ELSE CASE WHEN is_web THEN 35 WHEN score >= 85e-2 THEN 72 WHEN score >= 7e-1 THEN 58
                      ELSE 42 END END AS integer) AS accuracy
        FROM linked)
    SELECT *, concat('https://scholar.google.com/scholar?q=',
                     CASE method WHEN 'doi_citation' THEN concat('doi:', doi) WHEN 'doi_found' THEN concat('doi:', match_doi)
                     ELSE replace(url_encode(concat('"', title, '" ', last_name, ' ', year)), '%20', '+') END) AS link,
           CASE WHEN accuracy >= 90 THEN '>= 90' WHEN accuracy >= 80 THEN '80-89'
                   WHEN accuracy >= 60 THEN '60-79' ELSE '< 60' END AS band FROM rated"""


@query("q65_citation_links", f"""
    SELECT ref_id, year, title, doi, is_web, score, source, match_doi, method, link, accuracy, band
    FROM ({_CITATIONS})""")
def citation_links(r: Register) -> DataFrame:
    return resolved(r).select("ref_id", "year", "title", "doi", "is_web", "score", "source",
                              "match_doi", "method", "link", "accuracy", "band")


@query("q65_citation_bands", f"""
    SELECT method, band, count(*) AS n FROM ({_CITATIONS}) GROUP BY 1, 2""")
def citation_bands(r: Register) -> DataFrame:
    return A.freq(resolved(r), "method", "band")
