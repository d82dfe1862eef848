"""Questions about one kind of unit: wind, biomass, hydro, geothermal, storage, CHP, grid, actors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridledger.functions.convert import to_iso_date
from gridledger.functions.labels import label_or_unknown
from gridledger.functions.predicates import (
    in_list,
    in_states,
    is_active,
    is_offshore,
    is_onshore,
    kw_between,
    year_between,
)
from gridledger.operators import aggregates as A
from gridledger.operators import projection as P
from gridledger.operators import ranking as L
from gridledger.operators import units as U
from gridledger.plans.register import AS_OF, Register
from gridledger.plans.registry import query
from gridledger.plans.shaping import units_and_mw

# ------------------------------------------------------------------------------- wind

_ONSHORE = """(Lage IS NULL OR Lage <> 'WindAufSee')
    AND (WindAnLandOderAufSee IS NULL OR WindAnLandOderAufSee <> '889')
    AND Inbetriebnahmedatum BETWEEN DATE '1995-01-01' AND DATE '2001-12-31'
    AND Bruttoleistung BETWEEN 500 AND 8000"""


def onshore(r: Register, years=(1995, 2001), mw=(0.5, 8.0)) -> DataFrame:
    day, kw = F.col("Inbetriebnahmedatum"), F.col("Bruttoleistung")
    return r.wind.filter(is_onshore(r.wind) & year_between(day, *years) & kw_between(kw, *mw))


@query("q08_onshore_summary", f"""
    SELECT count(*) AS turbines, sum(Bruttoleistung) / 1000 AS mw,
           avg(Bruttoleistung) / 1000 AS avg_mw
    FROM wind WHERE {_ONSHORE} AND Bundesland IN ('1403', '1408', '1415')""")
def onshore_summary(r: Register, states=("Bayern", "Niedersachsen", "Thüringen")) -> DataFrame:
    chosen = onshore(r).filter(in_states(F.col("Bundesland"), states))
    return chosen.agg(F.count("*").alias("turbines"), (F.sum("Bruttoleistung") / 1000).alias("mw"),
                      (F.avg("Bruttoleistung") / 1000).alias("avg_mw"))


@query("q09_hub_height_rotor", """
    SELECT Nabenhoehe AS nabenhoehe, Rotordurchmesser AS rotor, Bruttoleistung / 1000 AS mw, Bundesland
    FROM wind WHERE Nabenhoehe BETWEEN 30 AND 200 AND Rotordurchmesser BETWEEN 20 AND 200""")
def hub_height_rotor(r: Register) -> DataFrame:
    rows = P.plausible(r.wind, {"Nabenhoehe": (30, 200), "Rotordurchmesser": (20, 200)})
    return rows.select(F.col("Nabenhoehe").alias("nabenhoehe"),
                       F.col("Rotordurchmesser").alias("rotor"),
                       (F.col("Bruttoleistung") / 1000).alias("mw"), "Bundesland")


@query("q10_onshore_buildout", f"""
    SELECT cast(year(Inbetriebnahmedatum) AS integer) AS year, s.name AS bundesland_name,
           sum(Bruttoleistung) / 1000 AS mw
    FROM wind LEFT JOIN state_names s ON s.code = Bundesland
    WHERE {_ONSHORE} GROUP BY 1, 2""")
def onshore_buildout(r: Register) -> DataFrame:
    # aggregate on the code, then name the few groups: the join sees 17 x years rows
    by_code = onshore(r).groupBy(F.year("Inbetriebnahmedatum").alias("year"), "Bundesland").agg(
        (F.sum("Bruttoleistung") / 1000).alias("mw"))
    return U.with_state(by_code, "Bundesland").select("year", "bundesland_name", "mw")


@query("q11_largest_onshore", f"""
    SELECT EinheitMastrNummer AS mastr_nr, s.name AS bundesland_name, Gemeinde AS gemeinde,
           round(Bruttoleistung / 1000, 2) AS mw, Inbetriebnahmedatum AS inbetriebnahme_datum
    FROM wind LEFT JOIN state_names s ON s.code = Bundesland
    WHERE {_ONSHORE} AND EinheitBetriebsstatus IN ('35', 'InBetrieb')
    ORDER BY Bruttoleistung DESC NULLS LAST, EinheitMastrNummer LIMIT 50""")
def largest_onshore(r: Register) -> DataFrame:
    active = onshore(r)
    top = L.top_k(active.filter(is_active(active)), "Bruttoleistung", 50, ["EinheitMastrNummer"])
    return U.with_state(top, "Bundesland").select(
        F.col("EinheitMastrNummer").alias("mastr_nr"), "bundesland_name",
        F.col("Gemeinde").alias("gemeinde"), F.round(F.col("Bruttoleistung") / 1000, 2).alias("mw"),
        F.col("Inbetriebnahmedatum").alias("inbetriebnahme_datum"))


_OFFSHORE = "(Lage = 'WindAufSee' OR Seelage IS NOT NULL)"


@query("q12_offshore_fleet", f"""
    SELECT count(*) AS turbines, sum(Bruttoleistung) / 1000 AS mw,
           count(DISTINCT NameWindpark) + max(CASE WHEN NameWindpark IS NULL THEN 1 ELSE 0 END) AS parks
    FROM wind WHERE {_OFFSHORE}""")
def offshore_fleet(r: Register) -> DataFrame:
    return r.wind.filter(is_offshore(r.wind)).agg(
        F.count("*").alias("turbines"), (F.sum("Bruttoleistung") / 1000).alias("mw"),
        A.n_distinct(F.col("NameWindpark"), count_null=True).alias("parks"))


@query("q13_offshore_depth", f"""
    SELECT EinheitMastrNummer AS mastr_nr, Bruttoleistung AS kw, Wassertiefe AS wassertiefe,
           KuestenEntfernung AS kuestenentfernung, Seelage
    FROM wind WHERE {_OFFSHORE} AND Wassertiefe IS NOT NULL AND KuestenEntfernung IS NOT NULL""")
def offshore_depth(r: Register) -> DataFrame:
    sea = r.wind.filter(is_offshore(r.wind)).dropna(subset=["Wassertiefe", "KuestenEntfernung"])
    return sea.select(F.col("EinheitMastrNummer").alias("mastr_nr"),
                      F.col("Bruttoleistung").alias("kw"), F.col("Wassertiefe").alias("wassertiefe"),
                      F.col("KuestenEntfernung").alias("kuestenentfernung"), "Seelage")


@query("q13_offshore_rating", f"""
    SELECT EinheitMastrNummer AS mastr_nr, Inbetriebnahmedatum AS inbetrieb,
           Bruttoleistung / 1000 AS mw
    FROM wind WHERE {_OFFSHORE} AND Inbetriebnahmedatum IS NOT NULL""")
def offshore_rating(r: Register) -> DataFrame:
    sea = r.wind.filter(is_offshore(r.wind)).dropna(subset=["Inbetriebnahmedatum"])
    return sea.select(F.col("EinheitMastrNummer").alias("mastr_nr"),
                      F.col("Inbetriebnahmedatum").alias("inbetrieb"),
                      (F.col("Bruttoleistung") / 1000).alias("mw"))


# ------------------------------------------------------------------------------- biomass, hydro


def by_state(df: DataFrame) -> DataFrame:
    """Units and megawatts per named state, of a raw unit table."""
    named = U.with_state(df.groupBy("Bundesland").agg(*units_and_mw("Bruttoleistung")), "Bundesland")
    return named.filter(F.col("bundesland_name").isNotNull()).select("bundesland_name", "units", "mw")


@query("q14_biomass_summary", """
    SELECT count(*) AS units, sum(Bruttoleistung) / 1000 AS mw, avg(Bruttoleistung) AS avg_kw
    FROM biomasse""")
def biomass_summary(r: Register) -> DataFrame:
    return A.fleet_summary(r.table("biomasse"), "Bruttoleistung")


@query("q14_biomass_by_state", """
    SELECT s.name AS bundesland_name, count(*) AS units, sum(Bruttoleistung) / 1000 AS mw
    FROM biomasse JOIN state_names s ON s.code = Bundesland GROUP BY 1""")
def biomass_by_state(r: Register) -> DataFrame:
    return by_state(r.table("biomasse"))


@query("q14_biomass_buildout", """
    SELECT cast(year(Inbetriebnahmedatum) AS integer) AS year, sum(Bruttoleistung) / 1000 AS mw
    FROM biomasse WHERE Inbetriebnahmedatum IS NOT NULL GROUP BY 1""")
def biomass_buildout(r: Register) -> DataFrame:
    dated = r.table("biomasse").filter(F.col("Inbetriebnahmedatum").isNotNull())
    return dated.groupBy(F.year("Inbetriebnahmedatum").alias("year")).agg(
        (F.sum("Bruttoleistung") / 1000).alias("mw"))


@query("q15_main_fuel", """
    SELECT coalesce(Hauptbrennstoff, '(unbekannt)') AS brennstoff, count(*) AS einheiten,
           round(sum(Bruttoleistung) / 1000, 1) AS mw
    FROM biomasse GROUP BY 1 ORDER BY mw DESC NULLS LAST, brennstoff LIMIT 50""")
def main_fuel(r: Register) -> DataFrame:
    fuel = label_or_unknown(F.col("Hauptbrennstoff"))
    table = r.table("biomasse").groupBy(fuel.alias("brennstoff")).agg(
        F.count("*").alias("einheiten"), F.round(F.sum("Bruttoleistung") / 1000, 1).alias("mw"))
    return L.top_k(table, "mw", 50, ["brennstoff"])


@query("q16_hydro_types", """
    SELECT coalesce(ArtDerWasserkraftanlage, '(unbekannt)') AS art, count(*) AS n,
           sum(Bruttoleistung) / 1000 AS mw
    FROM wasser GROUP BY 1""")
def hydro_types(r: Register) -> DataFrame:
    kind = label_or_unknown(F.col("ArtDerWasserkraftanlage"))
    return r.table("wasser").groupBy(kind.alias("art")).agg(
        F.count("*").alias("n"), (F.sum("Bruttoleistung") / 1000).alias("mw"))


@query("q16_hydro_largest", """
    SELECT mastr_nr, bundesland_name, gemeinde, round(bruttoleistung_kw / 1000, 1) AS mw,
           inbetriebnahme_datum
    FROM units_all WHERE energietraeger = 'Wasser'
    ORDER BY bruttoleistung_kw DESC NULLS LAST, mastr_nr LIMIT 50""")
def hydro_largest(r: Register) -> DataFrame:
    return U.with_state(L.top_k(r.units_of("wasser"), "bruttoleistung_kw", 50, ["mastr_nr"])).select(
        "mastr_nr", "bundesland_name", "gemeinde",
        F.round(F.col("bruttoleistung_kw") / 1000, 1).alias("mw"), "inbetriebnahme_datum")


@query("q16_hydro_top_mw", "SELECT max(Bruttoleistung) / 1000 AS top_mw FROM wasser")
def hydro_top_mw(r: Register) -> DataFrame:
    return A.largest(r.table("wasser"), "Bruttoleistung")


@query("q17_geothermal_mix", """
    SELECT ArtDerAnlage AS art, count(*) AS n FROM geothermie
    WHERE ArtDerAnlage IS NOT NULL GROUP BY 1""")
def geothermal_mix(r: Register) -> DataFrame:
    known = r.table("geothermie").filter(F.col("ArtDerAnlage").isNotNull())
    return A.freq(known, "ArtDerAnlage").withColumnRenamed("ArtDerAnlage", "art")


@query("q17_geothermal_kpi", """
    SELECT count(*) AS n, sum(Bruttoleistung) / 1000 AS mw, count(DISTINCT ArtDerAnlage) AS types
    FROM geothermie""")
def geothermal_kpi(r: Register) -> DataFrame:
    return r.table("geothermie").agg(
        F.count("*").alias("n"), (F.sum("Bruttoleistung") / 1000).alias("mw"),
        A.n_distinct(F.col("ArtDerAnlage")).alias("types"))


# ------------------------------------------------------------------------------- storage


def storage_technology() -> Column:
    return label_or_unknown(F.col("Technologie"), F.col("Batterietechnologie"), label="Unbekannt")


_STORAGE_TECH = "coalesce(Technologie, Batterietechnologie, 'Unbekannt')"


@query("q18_storage_kpi", """
    SELECT count(*) AS n, sum(Bruttoleistung) / 1000 AS mw,
           avg(Bruttoleistung) FILTER (WHERE Bruttoleistung > 0) AS mean_kw
    FROM stromspeicher""")
def storage_kpi(r: Register) -> DataFrame:
    return r.storage_raw.agg(
        F.count("*").alias("n"), (F.sum("Bruttoleistung") / 1000).alias("mw"),
        A.mean_positive(F.col("Bruttoleistung")).alias("mean_kw"))


@query("q18_storage_dominant", f"""
    SELECT technologie, n * 100.0e0 / total AS share_pct
    FROM (SELECT {_STORAGE_TECH} AS technologie, count(*) AS n, sum(count(*)) OVER () AS total
          FROM stromspeicher GROUP BY 1) ORDER BY n DESC, technologie LIMIT 1""")
def storage_dominant(r: Register) -> DataFrame:
    return A.dominant(r.storage_raw.select(storage_technology().alias("technologie")), "technologie")


@query("q18_storage_mix", f"""
    SELECT {_STORAGE_TECH} AS technologie, count(*) AS n FROM stromspeicher GROUP BY 1""")
def storage_mix(r: Register) -> DataFrame:
    return A.freq(r.storage_raw.select(storage_technology().alias("technologie")), "technologie")


@query("q19_storage_buildout", """
    SELECT cast(year(Inbetriebnahmedatum) AS integer) AS year,
           coalesce(sum(Bruttoleistung), 0) / 1000 AS mw
    FROM stromspeicher WHERE Inbetriebnahmedatum >= DATE '2000-01-01' GROUP BY 1""")
def storage_buildout(r: Register, first_year: int = 2000) -> DataFrame:
    dated = r.storage_raw.filter(year_between(F.col("Inbetriebnahmedatum"), first_year, 2100))
    return dated.groupBy(F.year("Inbetriebnahmedatum").alias("year")).agg(
        (F.coalesce(F.sum("Bruttoleistung"), F.lit(0.0)) / 1000).alias("mw"))


@query("q19_storage_largest", f"""
    SELECT EinheitMastrNummer AS mastr_nr, {_STORAGE_TECH} AS technologie, Bundesland,
           cast(year(Inbetriebnahmedatum) AS integer) AS jahr, round(Bruttoleistung / 1000, 3) AS mw
    FROM stromspeicher ORDER BY Bruttoleistung DESC NULLS LAST, EinheitMastrNummer LIMIT 30""")
def storage_largest(r: Register) -> DataFrame:
    top = L.top_k(r.storage_raw, "Bruttoleistung", 30, ["EinheitMastrNummer"])
    return top.select(
        F.col("EinheitMastrNummer").alias("mastr_nr"), storage_technology().alias("technologie"),
        "Bundesland", F.year("Inbetriebnahmedatum").alias("jahr"),
        F.round(F.col("Bruttoleistung") / 1000, 3).alias("mw"))


# ------------------------------------------------------------------------------- CHP


def chp(r: Register) -> DataFrame:
    return r.table("kwk").select(
        F.col("KwkMastrNummer").alias("mastr_nr"),
        F.col("ElektrischeKwkLeistung").alias("el_kw"),
        F.col("ThermischeNutzleistung").alias("th_kw"),
        F.col("AusschliesslicheVerwendungBrennstoffe").alias("brennstoff"))


@query("q20_chp_totals", """
    SELECT count(*) AS n, sum(ElektrischeKwkLeistung) / 1000 AS el_mw,
           sum(ThermischeNutzleistung) / 1000 AS th_mw FROM kwk""")
def chp_totals(r: Register) -> DataFrame:
    return chp(r).agg(F.count("*").alias("n"), (F.sum("el_kw") / 1000).alias("el_mw"),
                      (F.sum("th_kw") / 1000).alias("th_mw"))


@query("q20_chp_pairs", """
    SELECT KwkMastrNummer AS mastr_nr, ElektrischeKwkLeistung AS el_kw,
           ThermischeNutzleistung AS th_kw
    FROM kwk WHERE ElektrischeKwkLeistung > 0 AND ThermischeNutzleistung > 0""")
def chp_pairs(r: Register) -> DataFrame:
    return chp(r).filter("el_kw > 0 AND th_kw > 0").select("mastr_nr", "el_kw", "th_kw")


@query("q20_chp_log_histogram", """
    SELECT cast(floor(log10(ElektrischeKwkLeistung) * 10) AS integer) AS log_bin, count(*) AS n
    FROM kwk WHERE ElektrischeKwkLeistung > 0 GROUP BY 1""")
def chp_log_histogram(r: Register) -> DataFrame:
    return A.log_histogram(chp(r), "el_kw")


@query("q20_chp_largest", """
    SELECT KwkMastrNummer AS mastr_nr, ElektrischeKwkLeistung AS el_kw,
           ThermischeNutzleistung AS th_kw, AusschliesslicheVerwendungBrennstoffe AS brennstoff
    FROM kwk ORDER BY ElektrischeKwkLeistung DESC NULLS LAST, KwkMastrNummer LIMIT 50""")
def chp_largest(r: Register) -> DataFrame:
    return L.top_k(chp(r), "el_kw", 50, ["mastr_nr"])


# ------------------------------------------------------------------------------- grid and actors


@query("q21_grid_points", """
    SELECT Netzbetreiber, Spannungsebene, count(*) AS n,
           cast(grouping(Netzbetreiber, Spannungsebene) AS integer) AS level
    FROM netzanschlusspunkte
    GROUP BY GROUPING SETS ((Netzbetreiber, Spannungsebene), (Netzbetreiber), (Spannungsebene))""")
def grid_points(r: Register) -> DataFrame:
    return A.grouping_sets(
        r.table("netzanschlusspunkte"),
        [["Netzbetreiber", "Spannungsebene"], ["Netzbetreiber"], ["Spannungsebene"]],
        {"n": F.lit(1)})


@query("q21_grid_kpi", """
    SELECT count(*) AS points, count(DISTINCT Spannungsebene) AS voltage_levels
    FROM netzanschlusspunkte""")
def grid_kpi(r: Register) -> DataFrame:
    return r.table("netzanschlusspunkte").agg(
        F.count("*").alias("points"), A.n_distinct(F.col("Spannungsebene")).alias("voltage_levels"))


@query("q21_top_operators", """
    SELECT Netzbetreiber, count(*) AS n FROM netzanschlusspunkte
    GROUP BY 1 ORDER BY n DESC, Netzbetreiber LIMIT 20""")
def top_operators(r: Register) -> DataFrame:
    return L.top_groups(r.table("netzanschlusspunkte"), ["Netzbetreiber"], F.count("*"), "n", 20)


_OPERATOR_TYPES = ("Netzbetreiber", "Uebertragungsnetzbetreiber")


@query("q21_operators_by_type", """
    SELECT MarktakteurHauptTyp AS type, count(*) AS n FROM marktakteure
    WHERE MarktakteurHauptTyp IN ('Netzbetreiber', 'Uebertragungsnetzbetreiber') GROUP BY 1""")
def operators_by_type(r: Register) -> DataFrame:
    actors = r.table("marktakteure").withColumnRenamed("MarktakteurHauptTyp", "type")
    return A.freq(actors.filter(in_list(F.col("type"), _OPERATOR_TYPES)), "type")


@query("q22_actors_by_type", """
    SELECT MarktakteurHauptTyp AS type, count(*) AS n FROM marktakteure
    WHERE MarktakteurHauptTyp IS NOT NULL GROUP BY 1""")
def actors_by_type(r: Register) -> DataFrame:
    actors = r.table("marktakteure").withColumnRenamed("MarktakteurHauptTyp", "type")
    return A.freq(actors.filter(F.col("type").isNotNull()), "type")


@query("q22_actor_registrations", """
    SELECT cast(year(try_cast(DatumRegistrierung AS date)) AS integer) AS year, count(*) AS n
    FROM marktakteure WHERE try_cast(DatumRegistrierung AS date) IS NOT NULL GROUP BY 1""")
def actor_registrations(r: Register) -> DataFrame:
    day = to_iso_date(F.col("DatumRegistrierung"))
    dated = r.table("marktakteure").select(day.alias("day")).filter(F.col("day").isNotNull())
    return A.freq(dated.select(F.year("day").alias("year")), "year")


@query("q22_actor_kpi", """
    SELECT count(*) AS actors, count(DISTINCT MarktakteurHauptTyp) AS types,
           count(*) FILTER (WHERE try_cast(DatumRegistrierung AS date) >= DATE '2001-07-16') AS recent
    FROM marktakteure""")
def actor_kpi(r: Register, days: int = 30) -> DataFrame:
    registered = to_iso_date(F.col("DatumRegistrierung"))
    return r.table("marktakteure").agg(
        F.count("*").alias("actors"), A.n_distinct(F.col("MarktakteurHauptTyp")).alias("types"),
        A.recent(registered, AS_OF, days).alias("recent"))
