"""What the register contains: entity types, codes and labels."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Entity:
    """How one record type is found in the export and typed once read."""

    key: str
    tag: str
    members: str
    ids: tuple[str, ...] = ("EinheitMastrNummer",)
    numbers: tuple[str, ...] = ()
    dates: tuple[str, ...] = ()
    partition_by: tuple[str, ...] = ()


# --- fixed values: field names of the public XML export -------------------------------------
# HerstellungsDatum is deliberately absent: it is text, casting it to a number would lose it.
UNIT_NUMBERS = (
    "Bruttoleistung", "Nettonennleistung", "Laengengrad", "Breitengrad",
    "Nabenhoehe", "Rotordurchmesser", "Nutzflaeche", "AnzahlModule",
)
UNIT_DATES = (
    "DatumLetzteAktualisierung", "EinheitRegistrierungsdatum", "GeplantesInbetriebnahmeDatum",
    "Inbetriebnahmedatum", "DatumEndgueltigeStilllegung",
    "DatumBeginnVoruebergehendeStilllegung", "DatumWiederaufnahmeBetrieb",
)


def _unit(key: str, stem: str, tag: str, *numbers: str, partition_by: tuple[str, ...] = ()) -> Entity:
    return Entity(key, tag, f"{stem}*.xml", numbers=UNIT_NUMBERS + numbers, dates=UNIT_DATES,
                  partition_by=partition_by)


def _funding(key: str, suffix: str, *numbers: str) -> Entity:
    return Entity(key, f"AnlageEeg{suffix}", f"AnlagenEeg{suffix}*.xml", ids=("EegMastrNummer",),
                  numbers=("InstallierteLeistung", *numbers), dates=("RegistrierungsDatum",))


ENTITIES: dict[str, Entity] = {
    entity.key: entity
    for entity in (
        _unit("solar", "EinheitenSolar", "EinheitSolar", "Leistungsbegrenzung",
              partition_by=("Bundesland",)),
        _unit("wind", "EinheitenWind", "EinheitWind", "Seelage", partition_by=("Bundesland",)),
        _unit("biomasse", "EinheitenBiomasse", "EinheitBiomasse"),
        _unit("wasser", "EinheitenWasser", "EinheitWasser"),
        _unit("geothermie", "EinheitenGeoSolarthermie",
              "EinheitGeoSolarthermieGrubenKlaerschlammDruckentspannung"),
        _unit("kernkraft", "EinheitenKernkraft", "EinheitKernkraft"),
        _unit("verbrennung", "EinheitenVerbrennung", "EinheitVerbrennung"),
        _unit("stromspeicher", "EinheitenStromSpeicher", "EinheitStromSpeicher",
              "NutzbareSpeicherkapazitaet"),
        _unit("gaserzeuger", "EinheitenGasErzeuger", "EinheitGasErzeuger"),
        _unit("gasverbraucher", "EinheitenGasVerbraucher", "EinheitGasVerbraucher"),
        _unit("gasspeicher", "EinheitenGasSpeicher", "EinheitGasSpeicher"),
        Entity("kwk", "AnlageKwk", "AnlagenKwk*.xml", ids=("KwkMastrNummer",),
               numbers=("ThermischeNutzleistung", "ElektrischeKwkLeistung"), dates=UNIT_DATES),
        _funding("eeg_solar", "Solar", "AnlagenschluesselEeg"),
        _funding("eeg_wind", "Wind"),
        _funding("eeg_biomasse", "Biomasse"),
        _funding("eeg_wasser", "Wasser"),
        Entity("marktakteure", "Marktakteur", "Marktakteure*.xml", ids=("MastrNummer",),
               dates=("DatumLetzeAktualisierung", "DatumRegistrierung")),
        Entity("netzanschlusspunkte", "Netzanschlusspunkt", "Netzanschlusspunkte*.xml",
               ids=("NetzanschlusspunktMastrNummer",), numbers=("Spannungsebene",)),
        Entity("bilanzierungsgebiete", "Bilanzierungsgebiet", "Bilanzierungsgebiete*.xml",
               ids=("Code",)),
        Entity("lokationen", "Lokation", "Lokationen*.xml", ids=("MastrNummer",)),
    )
}

# --- fixed values: energy carrier of each power-unit table in the unified view --------------
CARRIERS = {
    "solar": "SolareStrahlungsenergie",
    "wind": "Wind",
    "biomasse": "Biomasse",
    "wasser": "Wasser",
    "geothermie": "GeothermieGrubenKlaerschlamm",
    "kernkraft": "Kernenergie",
    "verbrennung": "FossilOderSonstige",
    "stromspeicher": "Speicher",
}
RENEWABLE = (
    "SolareStrahlungsenergie", "Wind", "Biomasse", "Wasser", "GeothermieGrubenKlaerschlamm",
)

# --- fixed values: federal-state codes ------------------------------------------------------
STATES = {
    "1400": "Brandenburg",
    "1401": "Berlin",
    "1402": "Baden-Württemberg",
    "1403": "Bayern",
    "1404": "Bremen",
    "1405": "Hessen",
    "1406": "Hamburg",
    "1407": "Mecklenburg-Vorpommern",
    "1408": "Niedersachsen",
    "1409": "Nordrhein-Westfalen",
    "1410": "Rheinland-Pfalz",
    "1411": "Schleswig-Holstein",
    "1412": "Saarland",
    "1413": "Sachsen",
    "1414": "Sachsen-Anhalt",
    "1415": "Thüringen",
    "1416": "Ausschließliche Wirtschaftszone",
}

# --- fixed values: operating status, either code or text ------------------------------------
ACTIVE_STATUS = ("35", "InBetrieb")

# --- fixed values: size classes -------------------------------------------------------------
# six classes, upper bound exclusive, the last one open
SIZE_CLASSES_6 = (
    ("0–10 kW", 10), ("10–30 kW", 30), ("30–100 kW", 100),
    ("100–750 kW", 750), ("0.75–10 MW", 10000), (">10 MW", None),
)
# seventeen classes, upper bound inclusive, the last one open
_BUCKET_BOUNDS = (1, 3, 5, 10, 15, 25, 50, 100, 125, 150, 250, 500, 1000, 2500, 5000, 10000)
SIZE_BUCKETS_17 = tuple((f"<= {kw} kW", kw) for kw in _BUCKET_BOUNDS) + (("> 10000 kW", None),)
# three market segments, upper bound exclusive
SEGMENTS_3 = (("Home", 10), ("C&I", 1000), ("Large Scale", None))

# --- fixed values: registration delay in days, (a, b] bins ----------------------------------
DELAY_BINS = (
    ("<-900", -900), ("-900", -600), ("-600", -300), ("-300", -60), ("-60", -30), ("-30", -14),
    ("-14", 0), ("0", 7), ("7", 14), ("14", 30), ("30", 60), ("60", 90), ("90", 180),
    ("180", 365), ("365", 730), ("730+", None),
)

# --- fixed values: German month names, English month abbreviations --------------------------
MONTHS_DE = (
    "Januar", "Februar", "Maerz", "April", "Mai", "Juni",
    "Juli", "August", "September", "Oktober", "November", "Dezember",
)
MONTHS_ABBR = ("Jan", "Feb", "Mar", "Apr", "May", "Jun",
               "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

# --- fixed values: storage technology codes -------------------------------------------------
STORAGE_TECHNOLOGY = {
    "524": "Batteriespeicher (Klein; i. d. R. viele Einheiten)",
    "1537": "Speichertyp 1537 (i. d. R. wenige, sehr große Anlagen, z. B. Pumpspeicher)",
    "525": "Speichertechnologie 525",
    "526": "Speichertechnologie 526",
    "3067": "Speichertechnologie 3067",
    "3087": "Speichertechnologie 3087",
}
BATTERY_WORDS = ("batterie", "battery", "lithium", "ionspeicher", "li-ion", "liion", "akku")
NOT_BATTERY_WORDS = ("pumpspeicher", "wasserstoff")
BATTERY_TECHNOLOGY_CODES = ("524",)
BATTERY_CHEMISTRY_CODES = ("727",)

# --- fixed values: district names used by the labour-market feed ----------------------------
DISTRICT_ALIASES = {
    "Landkreis Gotha": "Gotha",
    "Landkreis Greiz": "Greiz",
    "Landkreis Hildburghausen": "Hildburghausen",
    "Landkreis Schmalkalden-Meiningen": "Schmalkalden-Meiningen",
    "Nordhausen, Landkreis": "Nordhausen",
    "Sonneberg, Landkreis": "Sonneberg",
    "Sömmerda, Landkreis": "Sömmerda",
}
DISSOLVED_DISTRICTS = {
    "Eisenach, Stadt": "Seit 07/2024 im Wartburgkreis — keine separate BA-Kreisstatistik",
}

# --- fixed values: interview themes ---------------------------------------------------------
INTERVIEW_THEMES = (
    "Transnational Recruitment", "Worker Suitability", "Pre-Arrival Expectations",
    "Extended Support", "Qualification Mismatches", "Adverse Outcomes", "Unknown",
)
# --- fixed values: first letter of the classification key -> sector -------------------------
SECTOR_PREFIXES = (
    ("R", "Health & social work"), ("Q", "Education"), ("T", "Advocacy & services"),
)

# --- fixed values: inhabitants per federal state, millions ----------------------------------
STATE_POPULATION_MIO = {
    "Schleswig-Holstein": 2.97, "Hamburg": 1.89, "Niedersachsen": 8.14, "Bremen": 0.68,
    "Nordrhein-Westfalen": 18.14, "Hessen": 6.39, "Rheinland-Pfalz": 4.16,
    "Baden-Württemberg": 11.34, "Bayern": 13.45, "Saarland": 0.99, "Berlin": 3.80,
    "Brandenburg": 2.60, "Mecklenburg-Vorpommern": 1.61, "Sachsen": 4.00,
    "Sachsen-Anhalt": 2.13, "Thüringen": 2.10,
}

# --- fixed values: words in a user agent, first rule that fits ------------------------------
DEVICE_WORDS = (
    ("Tablet", ("ipad", "tablet")),
    ("Phone", ("mobile", "iphone", "android")),
    ("Bot", ("bot", "crawl", "spider", "slurp")),
)
# --- fixed values: paths that are no page views ---------------------------------------------
ASSET_PATH_PARTS = (
    "websocket", "/__", "/lib/", "/shiny-", "/bootstrap-", "/jquery-", "/font-", ".woff", ".woff2",
)
ASSET_SUFFIXES = (
    "js", "css", "png", "jpg", "jpeg", "gif", "svg", "ico", "map", "json", "tsv", "wasm",
)
