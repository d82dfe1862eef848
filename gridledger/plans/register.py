"""Register-shaped tables over the star-schema input.

Every unit table is a narrow projection of the line-item rows of one (return flag, line status)
pair: no join, and the pair is a pushed-down Parquet filter. The unified view reads the line items
once. The column expressions are plain SQL that Spark and the checking engine both understand, so
both sides derive the very same input; the questions asked of it are written twice, independently.

Capacities and coordinates are multiples of 1/8, which makes their double sums exact in any order.
"""

from __future__ import annotations

import datetime as dt
import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridledger.catalog import CARRIERS, STATE_POPULATION_MIO
from gridledger.operators.units import literal_table, units_all, units_all_tagged
from gridledger.plans.shaping import SQL_STATES

AS_OF = dt.date(2001, 8, 15)
HOME_STATE = "1415"

UNIT_FLAGS = {
    "solar": ("N", "O"),
    "stromspeicher": ("N", "F"),
    "wind": ("R", "O"),
    "verbrennung": ("R", "F"),
    "biomasse": ("A", "O"),
    "wasser": ("A", "F"),
}

UNIT_COLUMNS = {
    "EinheitMastrNummer": "concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string),"
                          " cast(l_partkey as string), cast(l_suppkey as string))",
    "Bruttoleistung": "case when l_discount = 1e-1 and l_tax = 8e-2 then null"
                      " else floor(l_quantity * l_extendedprice / 125e0) * 25e-2 end",
    "Nettonennleistung": "floor(l_quantity * l_extendedprice * (1e0 - l_discount) / 125e0) * 25e-2",
    "Bundesland": "case when l_linenumber = 7 and l_quantity = 5e1 then null"
                  " else cast(1400 + l_suppkey % 17 as string) end",
    "Gemeinde": "concat('Gemeinde ', cast(l_suppkey as string))",
    "Postleitzahl": "case when l_linenumber = 6 and l_quantity = 4e1 then null"
                    " else cast(l_suppkey * 37 % 1000 as string) end",
    "Laengengrad": "6e0 + cast(l_suppkey % 64 as double) * 125e-3",
    "Breitengrad": "case when l_suppkey % 11 = 10 then null"
                   " else 47e0 + cast(l_suppkey % 56 as double) * 125e-3 end",
    "Inbetriebnahmedatum": "case when l_linenumber = 3 and l_quantity = 13e0 then null"
                           " else cast(l_shipdate as date) end",
    "Registrierungsdatum": "case when l_linenumber = 5 and l_quantity = 17e0 then 'unbekannt'"
                           " else cast(cast(l_shipdate as date)"
                           " + cast(l_orderkey % 1500 - 700 as int) as string) end",
    "EinheitBetriebsstatus": "case when l_tax <= 4e-2 then '35' when l_tax <= 6e-2 then 'InBetrieb'"
                             " else '38' end",
    "Betriebsstatus": "case when l_tax <= 6e-2 then 'InBetrieb' else 'EndgueltigStillgelegt' end",
    "Einspeisungsart": "case when l_discount < 5e-2 then '688' else '689' end",
    "Nutzungsbereich": "cast(l_linenumber as string)",
    "Leistungsbegrenzung": "8e2 + l_linenumber",
}

EXTRA_COLUMNS = {
    "solar": {},
    "wasser": {
        "ArtDerWasserkraftanlage": "case l_linenumber when 1 then 'Laufwasser' when 2 then"
                                   " 'Speicherwasser' when 3 then 'Pumpspeicher' else null end",
    },
    "verbrennung": {},
    "biomasse": {
        "Hauptbrennstoff": "case l_linenumber when 1 then 'Biogas' when 2 then 'Holz' when 3 then"
                           " 'Klaergas' when 4 then 'Pflanzenoel' else null end",
    },
    "wind": {
        "Nabenhoehe": "l_quantity * 4e0 - 10e0",
        "Rotordurchmesser": "cast(l_partkey % 250 as double)",
        "Wassertiefe": "case when l_linenumber = 1 then l_quantity else null end",
        "KuestenEntfernung": "case when l_linenumber = 1 and l_quantity > 5e0"
                             " then cast(l_suppkey % 90 as double) else null end",
        "NameWindpark": "case when l_suppkey % 10 = 0 then null"
                        " else concat('Windpark ', cast(l_suppkey as string)) end",
        "Seelage": "case when l_linenumber = 1 then 'Nordsee' when l_linenumber = 2 and"
                   " l_quantity > 4e1 then 'Ostsee' else null end",
        "Lage": "case when l_linenumber = 1 then 'WindAufSee' when l_linenumber = 7 then null"
                " else 'WindAnLand' end",
        "WindAnLandOderAufSee": "case when l_linenumber = 1 then '889' when l_linenumber = 7 then"
                                " null else '888' end",
    },
    "stromspeicher": {
        "Technologie": "case l_linenumber when 1 then '524' when 2 then 'Lithium-Batterie' when 3"
                       " then '1537' when 4 then 'Pumpspeicher' when 5 then"
                       " 'Wasserstoffspeicher Akku' when 6 then '999' else null end",
        "Batterietechnologie": "case when l_linenumber = 4 then null when l_quantity <= 2e1"
                               " then '727' when l_quantity <= 4e1 then '728' else null end",
        "AcDcKoppelung": "case when l_discount < 3e-2 then 'AC' when l_discount < 8e-2 then 'DC'"
                         " else null end",
        "NutzbareSpeicherkapazitaetInWh": "case when l_linenumber = 2 then null"
                                          " else l_quantity * 2048e3 end",
        "NutzbareSpeicherkapazitaetInKWh": "case when l_linenumber = 2 then l_quantity * 64e0"
                                           " else null end",
    },
}

# supplier, customer, order and part rows as the other register tables
OTHER_TABLES = {
    "geothermie": ("supplier", {
        "EinheitMastrNummer": "concat('GEO-', cast(s_suppkey as string))",
        "Bruttoleistung": "abs(floor(s_acctbal)) * 25e-2",
        "Bundesland": "cast(1400 + s_suppkey % 17 as string)",
        "Gemeinde": "concat('Gemeinde ', cast(s_suppkey as string))",
        "ArtDerAnlage": "case s_nationkey % 4 when 0 then 'Geothermie' when 1 then 'Grubengas'"
                        " when 2 then 'Klaerschlamm' else null end",
    }),
    "kernkraft": ("supplier", {
        "EinheitMastrNummer": "concat('KKW-', cast(s_suppkey as string))",
        "Bruttoleistung": "abs(floor(s_acctbal)) * 5e-1",
        "Nettonennleistung": "abs(floor(s_acctbal)) * 25e-2",
        "Bundesland": "cast(1400 + s_suppkey % 17 as string)",
        "Inbetriebnahmedatum": "date '1996-01-01' + cast(s_suppkey % 1500 as int)",
    }),
    "kwk": ("part", {
        "KwkMastrNummer": "concat('KWK-', cast(p_partkey as string))",
        "ElektrischeKwkLeistung": "case when p_size = 50 then null else"
                                  " floor(p_retailprice * (p_size - 3)) * 25e-2 end",
        "ThermischeNutzleistung": "floor(p_retailprice * (p_size - 2)) * 5e-1",
        "AusschliesslicheVerwendungBrennstoffe": "p_type",
    }),
    "marktakteure": ("customer", {
        "MastrNummer": "concat('AKT-', cast(c_custkey as string))",
        "Firmenname": "c_name",
        "Rechtsform": "c_mktsegment",
        "MarktakteurHauptTyp": "case c_mktsegment when 'BUILDING' then 'Netzbetreiber' when"
                               " 'MACHINERY' then 'Uebertragungsnetzbetreiber' when 'AUTOMOBILE'"
                               " then 'Stromlieferant' when 'FURNITURE' then 'Anlagenbetreiber'"
                               " else null end",
        "DatumRegistrierung": "case when c_custkey % 40 = 7 then '2001-13-01' else"
                              " cast(date '1995-01-01' + cast(c_custkey % 2400 as int) as string) end",
        "Land": "cast(c_nationkey as string)",
        "Bundesland": "cast(1400 + c_custkey % 17 as string)",
    }),
    "netzanschlusspunkte": ("orders", {
        "NetzanschlusspunktMastrNummer": "concat('SNE-', cast(o_orderkey as string))",
        "Netzbetreiber": "concat('SNB-', cast(o_custkey as string))",
        "Spannungsebene": "case o_orderpriority when '1-URGENT' then '347' when '2-HIGH' then '348'"
                          " when '3-MEDIUM' then '349' when '4-NOT SPECIFIED' then null"
                          " else '350' end",
        "Bundesland": "cast(1400 + o_custkey % 17 as string)",
        "Gemeinde": "concat('Gemeinde ', cast(o_custkey as string))",
    }),
    "extracts": ("documents", {
        "extract_id": "doc_id",
        "interview": "source",
        "code": "lang",
        "theme": "case when n_chars < 200 then 'Worker Suitability' when n_chars < 600 then"
                 " 'Extended Support' when n_chars < 1500 then 'Adverse Outcomes'"
                 " when n_chars < 4000 then 'Transnational Recruitment' else 'Sonstiges' end",
        "extract": "text",
    }),
    "organisations": ("customer", {
        "institution": "c_name",
        "latitude": "case when c_acctbal < 0 then null else"
                    " 50e0 + cast(c_custkey % 16 as double) * 125e-3 end",
        "longitude": "case when c_custkey % 50 = 3 then null else"
                     " 10e0 + cast(c_custkey % 24 as double) * 125e-3 end",
        "location": "concat('Ort ', cast(c_nationkey as string))",
        "email": "concat('kontakt', cast(c_custkey as string), '@example.org')",
        "schluessel": "case c_mktsegment when 'BUILDING' then 'R86' when 'MACHINERY' then 'Q85'"
                      " when 'AUTOMOBILE' then 'T94' when 'FURNITURE' then 'S12' else null end",
    }),
    "projects": ("orders", {
        "project_id": "o_orderkey",
        "status": "case o_orderstatus when 'O' then 'geplant' when 'F' then ' in Betrieb '"
                  " else '' end",
        "bundesland": "case when o_orderpriority = '5-LOW' then null"
                      " else cast(1400 + o_custkey % 17 as string) end",
    }),
}

# ---------------------------------------------------------------------------------------------
# SQL side: the same tables as CTEs
# ---------------------------------------------------------------------------------------------


def _select_list(columns: dict[str, str]) -> str:
    return ", ".join(f"{expr} AS {name}" for name, expr in columns.items())


def _sql_quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SQL_TABLES: dict[str, str] = {}
for _key, (_flag, _status) in UNIT_FLAGS.items():
    _SQL_TABLES[_key] = (
        f"SELECT {_select_list(UNIT_COLUMNS | EXTRA_COLUMNS[_key])} FROM lineitem"
        f" WHERE l_returnflag = '{_flag}' AND l_linestatus = '{_status}'")
for _key, (_source, _columns) in OTHER_TABLES.items():
    _SQL_TABLES[_key] = f"SELECT {_select_list(_columns)} FROM {_source}"

_SQL_TABLES["state_names"] = f"SELECT * FROM {SQL_STATES}"
_SQL_TABLES["state_population"] = "SELECT * FROM (VALUES " + ", ".join(
    f"({_sql_quote(n)}, cast({p!r} as double))" for n, p in STATE_POPULATION_MIO.items()
) + ") AS t(bundesland_name, einwohner_mio)"


def _unit_branch(key: str, carrier: str) -> str:
    have = UNIT_COLUMNS if key in UNIT_FLAGS else OTHER_TABLES[key][1]

    def pick(name: str, kind: str) -> str:
        return f"cast({name} as {kind})" if name in have else f"cast(null as {kind})"

    return (
        f"SELECT '{key}' AS source_table, '{carrier}' AS energietraeger,"
        f" {pick('EinheitMastrNummer', 'varchar')} AS mastr_nr,"
        f" {pick('Bruttoleistung', 'double')} AS bruttoleistung_kw,"
        f" {pick('Nettonennleistung', 'double')} AS nettonennleistung_kw,"
        f" {pick('Bundesland', 'varchar')} AS bundesland_code,"
        f" s.name AS bundesland_name,"
        f" {pick('Gemeinde', 'varchar')} AS gemeinde,"
        f" {pick('Postleitzahl', 'varchar')} AS plz,"
        f" {pick('Laengengrad', 'double')} AS lon,"
        f" {pick('Breitengrad', 'double')} AS lat,"
        f" {pick('Inbetriebnahmedatum', 'date')} AS inbetriebnahme_datum,"
        f" {pick('Betriebsstatus', 'varchar')} AS betriebsstatus"
        f" FROM {key} LEFT JOIN state_names s ON s.code = Bundesland"
    )


_SQL_TABLES["units_all"] = " UNION ALL ".join(_unit_branch(k, c) for k, c in CARRIERS.items())

_SQL_TABLES["storage"] = """
    SELECT *, coalesce(NutzbareSpeicherkapazitaetInKWh, NutzbareSpeicherkapazitaetInWh / 1000)
              AS NutzbareSpeicherkapazitaet
    FROM stromspeicher"""
_SQL_TABLES["plz_district"] = """
    SELECT lpad(cast(s_suppkey * 37 % 1000 as varchar), 5, '0') AS plz, min(n_name) AS kreis
    FROM supplier JOIN nation ON n_nationkey = s_nationkey
    WHERE s_acctbal >= 0 GROUP BY 1"""
_SQL_TABLES["district_meta"] = """
    SELECT n_name AS kreis,
           CASE WHEN n_nationkey = 3 THEN NULL WHEN n_nationkey = 4 THEN 0
                ELSE count(c_custkey) * 1000 END AS einwohner,
           50e0 + n_nationkey * 125e-3 AS lat, 10e0 + n_nationkey * 125e-3 AS lon
    FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey
    GROUP BY n_name, n_nationkey"""
_SQL_TABLES["access_events"] = r"""
    SELECT event_id, ts, user_id, event_type,
           concat('10.0.', cast(user_id % 7 as varchar), '.', cast(user_id as varchar)) AS ip,
           date_trunc('second', ts) AS time,
           CASE WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method,
           CASE event_type WHEN 'view' THEN '/' WHEN 'click' THEN '/karte/?tab=2'
                WHEN 'signup' THEN '/anmeldung' WHEN 'purchase' THEN '/lib/app.js'
                ELSE '//speicher' END AS path,
           CASE WHEN event_id % 10 = 0 THEN 404 WHEN event_id % 10 = 1 THEN 304 ELSE 200 END AS status,
           CASE WHEN event_id % 10 = 1 THEN NULL ELSE cast(event_id % 5000 as double) END AS bytes,
           CASE WHEN event_id % 4 = 0 THEN '-' ELSE 'https://example.org/' END AS referer,
           CASE (user_id + event_id) % 5 WHEN 0 THEN 'Mozilla/5.0 (iPad; CPU OS 17)'
                WHEN 1 THEN 'Mozilla/5.0 (Linux; Android 14) Mobile' WHEN 2 THEN 'ExampleBot/2.1'
                ELSE 'Mozilla/5.0 (X11; Linux x86_64)' END AS user_agent
    FROM events WHERE value >= 5e-1"""
_SQL_TABLES["page_views"] = """
    SELECT *, CASE event_type WHEN 'view' THEN 'hub' WHEN 'click' THEN 'karte'
                   WHEN 'signup' THEN 'anmeldung' END AS dashboard,
           CASE (user_id + event_id) % 5 WHEN 0 THEN 'Tablet' WHEN 1 THEN 'Phone' WHEN 2 THEN 'Bot'
                ELSE 'Desktop' END AS device
    FROM access_events
    WHERE method = 'GET' AND status IN (200, 304) AND event_type IN ('view', 'click', 'signup')"""
_SQL_TABLES["price_rows"] = """
    SELECT event_type AS bzn, date_trunc('hour', ts) AS hour_utc,
           floor(avg(floor(value * 8))) * 125e-3 - 10 AS price
    FROM events GROUP BY 1, 2"""

_WORD = re.compile(r"[A-Za-z_]+")


def with_register_sql(sql: str) -> str:
    """Prefix a query with the register tables it names, each after those it depends on."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for word in _WORD.findall(text):
            if word in _SQL_TABLES and word not in needed:
                visit(_SQL_TABLES[word])
                needed.append(word)

    visit(sql)
    if not needed:
        return sql.strip()
    ctes = ",\n".join(f"{name} AS ({_SQL_TABLES[name]})" for name in needed)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


# ---------------------------------------------------------------------------------------------
# Spark side
# ---------------------------------------------------------------------------------------------


_SCHEMAS: dict[tuple[str, str], StructType] = {}


class Register:
    """Lazily built register tables of one input folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def source(self, name: str) -> DataFrame:
        """An input table. Its schema is read from a footer once per application."""
        path = self.path(name)
        key = (self.spark.conf.get("spark.app.id", ""), path)
        if key not in _SCHEMAS:
            _SCHEMAS[key] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[key]).parquet(path)

    def table(self, key: str) -> DataFrame:
        """One register table."""
        if key in UNIT_FLAGS:
            flag, status = UNIT_FLAGS[key]
            columns = UNIT_COLUMNS | EXTRA_COLUMNS[key]
            rows = self.source("lineitem").filter(
                (F.col("l_returnflag") == flag) & (F.col("l_linestatus") == status))
        else:
            source, columns = OTHER_TABLES[key]
            rows = self.source(source)
        return rows.selectExpr(*[f"{expr} AS {name}" for name, expr in columns.items()])

    @cached_property
    def solar(self) -> DataFrame:
        return self.table("solar")

    @cached_property
    def wind(self) -> DataFrame:
        return self.table("wind")

    @cached_property
    def storage_raw(self) -> DataFrame:
        return self.table("stromspeicher")

    @cached_property
    def unit_tables(self) -> dict[str, DataFrame]:
        return {key: self.table(key) for key in CARRIERS}

    @cached_property
    def units(self) -> DataFrame:
        """The unified view with state codes; the line items are read once."""
        arms = " ".join(f"WHEN l_returnflag = '{flag}' AND l_linestatus = '{status}' THEN '{key}'"
                        for key, (flag, status) in UNIT_FLAGS.items())
        tagged = self.source("lineitem").selectExpr(
            f"CASE {arms} END AS entity",
            *[f"{expr} AS {name}" for name, expr in UNIT_COLUMNS.items()])
        extra = {key: self.table(key) for key in ("geothermie", "kernkraft")}
        return units_all_tagged(tagged, "entity", extra, names=False)

    def units_of(self, *keys: str) -> DataFrame:
        """The unified view of some unit types; their row filters reach the reader."""
        return units_all({key: self.table(key) for key in keys}, names=False)

    @cached_property
    def plz_district(self) -> DataFrame:
        """Postcode to district; a postcode has one district."""
        return (
            self.source("supplier").filter(F.col("s_acctbal") >= 0)
            .join(self.source("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .groupBy(F.expr("lpad(cast(s_suppkey * 37 % 1000 as string), 5, '0')").alias("plz"))
            .agg(F.min("n_name").alias("kreis"))
        )

    @cached_property
    def district_meta(self) -> DataFrame:
        """District with inhabitants and position."""
        people = self.source("customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
        key = F.col("n_nationkey")
        return self.source("nation").join(people, key == F.col("c_nationkey"), "left").select(
            F.col("n_name").alias("kreis"),
            F.when(key == 4, F.lit(0)).when(key != 3, F.coalesce("n", F.lit(0)) * 1000)
            .alias("einwohner"),
            (50.0 + key * 0.125).alias("lat"),
            (10.0 + key * 0.125).alias("lon"),
        )

    @cached_property
    def state_population(self) -> DataFrame:
        return literal_table(self.spark, list(STATE_POPULATION_MIO.items()),
                             "bundesland_name, einwohner_mio")

    @cached_property
    def access_lines(self) -> DataFrame:
        """Access-log text lines written from the events: one column ``value``, as text files give."""
        return access_lines(self.source("events"))

    @cached_property
    def price_payloads(self) -> DataFrame:
        """One JSON document per zone and day, parallel arrays of at most 24 hours."""
        hours = (
            self.source("events")
            .groupBy(F.col("event_type").alias("bzn"), F.date_trunc("hour", "ts").alias("hour"))
            .agg((F.floor(F.avg(F.floor(F.col("value") * 8))) * 0.125 - 10).alias("price"))
        )
        # seconds since the epoch of a UTC wall-clock hour, whatever the session time zone is
        seconds = F.datediff(F.to_date("hour"), F.lit(dt.date(1970, 1, 1))).cast("bigint") * 86400
        pairs = F.sort_array(F.collect_list(F.struct(
            (seconds + F.hour("hour") * 3600).alias("s"), F.col("price").alias("p"))))
        days = hours.groupBy("bzn", F.to_date("hour").alias("day")).agg(pairs.alias("pairs"))
        body = F.to_json(F.struct(
            F.transform("pairs", lambda x: x["s"]).alias("unix_seconds"),
            F.transform("pairs", lambda x: x["p"]).alias("price"),
            F.when(F.col("bzn") == "view", F.lit("EUR / MWh")).alias("unit"),
        ))
        return days.select("bzn", body.alias("body"))


def access_lines(events: DataFrame) -> DataFrame:
    eid, uid, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    ip = F.concat(F.lit("10.0."), (uid % 7).cast("string"), F.lit("."), uid.cast("string"))
    stamp = F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss")
    zone = F.when(eid % 6 == 5, F.lit("")).otherwise(F.lit(" +0000"))
    method = F.when((kind == "signup") & (eid % 3 == 0), "POST").otherwise("GET")
    path = (
        F.when(kind == "view", "/").when(kind == "click", "/karte/?tab=2")
        .when(kind == "signup", "/anmeldung").when(kind == "purchase", "/lib/app.js")
        .otherwise("//speicher")
    )
    status = F.when(eid % 10 == 0, "404").when(eid % 10 == 1, "304").otherwise("200")
    size = F.when(eid % 10 == 1, "-").otherwise((eid % 5000).cast("string"))
    referer = F.when(eid % 4 == 0, "-").otherwise("https://example.org/")
    shape = (uid + eid) % 5
    agent = (
        F.when(shape == 0, "Mozilla/5.0 (iPad; CPU OS 17)")
        .when(shape == 1, "Mozilla/5.0 (Linux; Android 14) Mobile")
        .when(shape == 2, "ExampleBot/2.1").otherwise("Mozilla/5.0 (X11; Linux x86_64)")
    )
    line = F.concat(
        ip, F.lit(" - - ["), stamp, zone, F.lit('] "'), method, F.lit(" "), path,
        F.lit(' HTTP/1.1" '), status, F.lit(" "), size, F.lit(' "'), referer, F.lit('" "'), agent,
        F.lit('"'))
    return events.select(
        F.when(F.col("value") < 0.5, F.lit("-- damaged line --")).otherwise(line).alias("value"))
