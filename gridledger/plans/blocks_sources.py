"""Ingest, snapshot and payload building blocks.

Those that read files first write them from the input tables, into a fresh folder of the shared
working area, and then read them back the way an export would be read.
"""

from __future__ import annotations

import dataclasses
import uuid
import zipfile
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyarrow.fs import FileSelector
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridledger.catalog import ENTITIES, Entity
from gridledger.functions.convert import to_iso_date, to_number
from gridledger.operators import changes
from gridledger.operators import cube as C
from gridledger.operators.sets import append, land_sources, union_sources
from gridledger.plans.districts import labour_payloads
from gridledger.plans.register import AS_OF, Register
from gridledger.plans.registry import query
from gridledger.plans.shaping import sql_class6
from gridledger.plans.series import zones
from gridledger.session import new_work_path
from gridledger.sources import dimensions as D
from gridledger.sources import manifests as M
from gridledger.sources import payloads as Y
from gridledger.sources import register_xml as X
from gridledger.sources import snapshots as N
from gridledger.sources import tables as B
from gridledger.sources.register_xml import at_storage


def as_export_xml(r: Register, df: DataFrame, entity: Entity) -> str:
    """Write a table as export XML: German decimals, ISO dates with a time part."""
    kinds = dict(df.dtypes)

    def text(name: str) -> Column:
        if kinds[name] == "double":
            return F.translate(F.format_number(name, 2), ".,", ",")  # decimal comma, no grouping
        if kinds[name] == "date":
            return F.concat(F.date_format(name, "yyyy-MM-dd"), F.lit("T00:00:00"))
        return F.col(name).cast("string")

    out = df.select(*[text(c).alias(c) for c in df.columns])
    path = new_work_path(r.spark, f"xml-{entity.key}")
    out.write.format("xml").option("rootTag", entity.members.split("*")[0]).option(
        "rowTag", entity.tag).save(path)
    return path


@query("s01_s05_xml_to_typed", """
    SELECT EinheitMastrNummer, Bruttoleistung, Nettonennleistung, Bundesland, Inbetriebnahmedatum,
           Nabenhoehe, NameWindpark FROM wind""")
def xml_to_typed(r: Register) -> DataFrame:
    entity = ENTITIES["wind"]
    columns = ["EinheitMastrNummer", "Bruttoleistung", "Nettonennleistung", "Bundesland",
               "Inbetriebnahmedatum", "Nabenhoehe", "NameWindpark"]
    path = as_export_xml(r, r.wind.select(*columns), entity)
    raw, _ = X.read_entity(r.spark, path, entity, columns)
    return X.typed(raw, entity)


def as_archives(r: Register, df: DataFrame, entity: Entity, records: int = 2000) -> list[str]:
    """Zip archives of export XML, one for about so many records and written by a task, with a member per thousand."""
    archives = max(2, -(-df.count() // records))
    folder = new_work_path(r.spark, f"zip-{entity.key}")
    record = F.to_xml(F.struct(*[F.col(c).cast("string").alias(c) for c in df.columns]), {"rowTag": entity.tag})
    stem = entity.members.split("*")[0]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, target = at_storage(folder)
        store.create_dir(target, recursive=True)
        number = TaskContext.get().partitionId()
        draft, name = f"{target}/.{uuid.uuid4().hex}", f"export-{number}.zip"
        rows = (text for batch in batches for text in batch["record"])
        with store.open_output_stream(draft) as sink, zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as zf:
            for part, some in enumerate(iter(lambda: list(islice(rows, 1000)), [])):
                zf.writestr(f"{part}/{stem}_1.xml", f"<{stem}>" + "".join(some) + f"</{stem}>")
        store.move(draft, f"{target}/{name}")
        yield pd.DataFrame({"archive": [f"{folder}/{name}"]})

    written = df.select(record.alias("record")).repartition(archives).mapInPandas(pack, "archive string")
    return sorted(row.archive for row in written.collect())


@query("s02_staged_archives", """
    SELECT EinheitMastrNummer, Bruttoleistung, Bundesland, Inbetriebnahmedatum FROM wind""")
def staged_archives(r: Register) -> DataFrame:
    """Turbines written to archives, staged by member and read back."""
    entity = dataclasses.replace(ENTITIES["wind"], members="*" + ENTITIES["wind"].members)
    columns = ["EinheitMastrNummer", "Bruttoleistung", "Bundesland", "Inbetriebnahmedatum"]
    staged = new_work_path(r.spark, "staged-wind")
    X.stage_archives(r.spark, as_archives(r, r.wind.select(*columns), ENTITIES["wind"]), entity, staged)
    return X.typed(X.read_entity(r.spark, staged, entity, columns)[0], entity)


@query("s03_to_number", """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
           CASE l_linenumber WHEN 1 THEN l_quantity + 5e-1 WHEN 2 THEN l_quantity WHEN 3 THEN NULL
                WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 6 THEN -l_quantity ELSE NULL END AS plain,
           CASE l_linenumber WHEN 1 THEN l_quantity + 5e-1 WHEN 2 THEN l_quantity
                WHEN 3 THEN 1000 + l_quantity + 25e-2 WHEN 6 THEN -l_quantity ELSE NULL END AS grouped
    FROM lineitem""")
def numbers(r: Register) -> DataFrame:
    whole = F.col("l_quantity").cast("int").cast("string")
    line = F.col("l_linenumber")
    text = (
        F.when(line == 1, F.concat(whole, F.lit(",5"))).when(line == 2, F.concat(F.lit(" "), whole, F.lit(".0 ")))
        .when(line == 3, F.concat(F.lit("1.0"), F.lpad(whole, 2, "0"), F.lit(",25")))
        .when(line == 4, F.concat(whole, F.lit("d"))).when(line == 5, F.lit(""))
        .when(line == 6, F.concat(F.lit("-"), whole)))
    return r.source("lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", to_number(text).alias("plain"),
        to_number(text, thousands=True).alias("grouped"))


@query("s04_to_iso_date", """
    SELECT o_orderkey, CASE WHEN o_custkey % 6 IN (0, 1) THEN cast(o_orderdate AS date) END AS day FROM orders""")
def iso_dates(r: Register) -> DataFrame:
    kind = F.col("o_custkey") % 6
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = (F.when(kind == 0, iso).when(kind == 1, F.concat(iso, F.lit("T12:30:00")))
            .when(kind == 2, F.date_format("o_orderdate", "yyyy")).when(kind == 3, F.lit("2001-13-01"))
            .when(kind == 4, F.date_format("o_orderdate", "dd.MM.yyyy")))
    return r.source("orders").select("o_orderkey", to_iso_date(text).alias("day"))


@query("s06_union_evolving", """
    SELECT EinheitMastrNummer, Bruttoleistung, cast(NULL AS varchar) AS Hauptbrennstoff,
           cast(NULL AS varchar) AS ArtDerWasserkraftanlage FROM solar
    UNION ALL SELECT EinheitMastrNummer, Bruttoleistung, Hauptbrennstoff, NULL FROM biomasse
    UNION ALL SELECT EinheitMastrNummer, Bruttoleistung, NULL, ArtDerWasserkraftanlage FROM wasser""")
def grown_schema(r: Register) -> DataFrame:
    return B.union_evolving([
        r.solar.select("EinheitMastrNummer", "Bruttoleistung"),
        r.table("biomasse").select("EinheitMastrNummer", "Bruttoleistung", "Hauptbrennstoff"),
        r.table("wasser").select("EinheitMastrNummer", "Bruttoleistung", "ArtDerWasserkraftanlage")])


@query("s07_dedup", """
    SELECT l_orderkey, l_linenumber, cast(l_shipdate AS date) AS updated, l_partkey, l_suppkey, l_quantity
    FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC,
                               l_partkey DESC, l_suppkey DESC, l_quantity DESC) = 1""")
def last_updated(r: Register) -> DataFrame:
    rows = r.source("lineitem").select(
        "l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("updated"), "l_partkey",
        "l_suppkey", "l_quantity")
    return X.dedup(rows, ["l_orderkey", "l_linenumber"], "updated")


@query("s08_s09_written_entities", """
    SELECT 'wind' AS table_name, count(*) AS rows, count(DISTINCT Bundesland) AS states FROM wind
    UNION ALL SELECT 'geothermie', count(*), count(DISTINCT Bundesland) FROM geothermie""")
def written_entities(r: Register) -> DataFrame:
    """Write one partitioned and one plain entity, load whatever is there, look at both."""
    folder = new_work_path(r.spark, "entities")
    for key in ("wind", "geothermie"):
        X.write_entity(r.table(key), ENTITIES[key], folder)
    loaded = B.load_entities(r.spark, folder)
    parts = [df.agg(F.lit(key).alias("table_name"), F.count("*").alias("rows"),
                    F.count_distinct("Bundesland").alias("states")) for key, df in loaded.items()]
    return parts[0].unionByName(parts[1])


@query("s11_s28_written_aggregate", """
    SELECT plz, energietraeger, count(*) AS units, sum(bruttoleistung_kw) / 1000 AS bruttoleistung_mw,
           avg(lat) AS lat, avg(lon) AS lon
    FROM units_all WHERE plz IS NOT NULL AND lat IS NOT NULL GROUP BY 1, 2
    HAVING sum(bruttoleistung_kw) IS NOT NULL
    ORDER BY bruttoleistung_mw DESC, plz, energietraeger LIMIT 5000""")
def written_aggregate(r: Register) -> DataFrame:
    """All aggregates written from one pass over the units; the postcode table read back."""
    folder = new_work_path(r.spark, "aggregates")
    B.write_aggregates(r.units, {"wind": r.wind}, folder, AS_OF)
    return B.agg_table(r.spark, folder, "capacity_by_plz_top5000")


@query("s11_s13_published_set", """
    SELECT plz, energietraeger, count(*) AS units, sum(bruttoleistung_kw) / 1000 AS bruttoleistung_mw
    FROM units_all WHERE plz IS NOT NULL AND lat IS NOT NULL GROUP BY 1, 2
    HAVING sum(bruttoleistung_kw) IS NOT NULL
    ORDER BY bruttoleistung_mw DESC, plz, energietraeger LIMIT 5000""")
def published_set(r: Register) -> DataFrame:
    """All aggregates published as one version; the next version fails half-way, so readers keep the first one whole."""
    root = new_work_path(r.spark, "published")
    B.publish_aggregates(r.units, {"wind": r.wind}, root, AS_OF)
    M.publish(r.spark, root, {
        "capacity_by_plz_top5000": lambda: r.units.select("plz").filter("false"),
        "kpi_overview": lambda: r.units.select(F.raise_error(F.lit("unexpected end")).alias("units"))})
    return B.published_agg(r.spark, root, "capacity_by_plz_top5000").select("plz", "energietraeger", "units", "bruttoleistung_mw")


@query("s07_s11_patched_cube", f"""
    WITH shaped AS (
        SELECT CASE WHEN bundesland_name IS NOT NULL THEN bundesland_code END AS bundesland_code, energietraeger, plz,
               cast(date_trunc('month', inbetriebnahme_datum) AS date) AS month,
               {sql_class6('bruttoleistung_kw')} AS size_class, lat IS NOT NULL AS located, bruttoleistung_kw, lat, lon
        FROM units_all),
    cells AS (
        SELECT 'state' AS grain, bundesland_code, energietraeger, size_class, NULL AS month, NULL AS plz, NULL AS located,
               count(*) AS n, sum(bruttoleistung_kw) AS kw, sum(lat) AS lat_sum, count(lon) AS lon_n
        FROM shaped GROUP BY 2, 3, 4
        UNION ALL
        SELECT 'month', NULL, energietraeger, NULL, month, NULL, NULL, count(*), sum(bruttoleistung_kw), sum(lat), count(lon)
        FROM shaped GROUP BY 3, 5
        UNION ALL
        SELECT 'place', NULL, energietraeger, NULL, NULL, plz, located, count(*), sum(bruttoleistung_kw), sum(lat), count(lon)
        FROM shaped GROUP BY 3, 6, 7)
    SELECT grain, bundesland_code, energietraeger, size_class, strftime(month, '%Y-%m-%d') AS month, plz, located, n,
           kw, lat_sum, lon_n FROM cells""")
def patched_cube(r: Register) -> DataFrame:
    """The cube of a first delivery, then patched to the second: a tenth of the units came, altered or went."""
    root = new_work_path(r.spark, "increments")
    late, altered = F.col("plz").endswith("7"), F.col("plz").endswith("3")
    first = r.units.filter(~F.coalesce(late, F.lit(False))).withColumn(
        "bruttoleistung_kw", F.when(altered, F.col("bruttoleistung_kw") + 1.5).otherwise(F.col("bruttoleistung_kw")))
    gone = r.units.filter(F.col("plz").endswith("5")).withColumns({
        "mastr_nr": F.concat(F.lit("gone "), "mastr_nr"), "plz": F.lit("00000"), "lon": F.col("lon") + 0.1})
    changes.advance(first.unionByName(gone), root)
    cube = changes.advance(r.units, root)
    names = F.when(C.grain(C.STATE), "state").when(C.grain(C.MONTH), "month").otherwise("place")
    return cube.select(names.alias("grain"), "bundesland_code", "energietraeger", "size_class",
                       F.date_format("month", "yyyy-MM-dd").alias("month"), "plz", "located", "n", "kw", "lat_sum", "lon_n")


@query("s29_load_summary", """
    SELECT 'solar' AS table_name, count(*) AS rows FROM solar UNION ALL SELECT 'wind', count(*) FROM wind
    UNION ALL SELECT 'kwk', count(*) FROM kwk""")
def summary(r: Register) -> DataFrame:
    tables = {key: r.table(key) for key in ("solar", "wind", "kwk")}
    return B.checked_summary(tables, required=["solar", "wind"])


@query("s09_s29_damaged_file", """
    SELECT 'solar' AS table_name, 0 AS damaged, count(*) AS rows, TRUE AS loaded, count(*) AS kept_rows FROM solar
    UNION ALL SELECT 'wind', 1, count(*), FALSE, count(*) FROM wind""")
def damaged_file(r: Register) -> DataFrame:
    """Two tables, one with half a file among its files: what the footers say, what is loaded, and what can be kept."""
    folder = new_work_path(r.spark, "entities")
    for key in ("solar", "wind"):
        target = X.write_entity(r.table(key), ENTITIES[key], folder)
    store, path = at_storage(target)
    whole = next(f for f in store.get_file_info(FileSelector(path, recursive=True)) if f.base_name.endswith(".parquet"))
    with store.open_input_file(whole.path) as data, store.open_output_stream(f"{path}/part-cut.parquet") as cut:
        cut.write(data.read(min(whole.size // 2, 1 << 16)))
    tables, files = B.load_checked(r.spark, folder)
    kept = B.load_entities(r.spark, folder, damaged="file")
    loaded = F.col("table_name").isin(list(tables))
    counts = B.load_summary(kept).withColumnRenamed("rows", "kept_rows")
    summary = B.footer_checked_summary(files, required=["solar", "wind"])
    return summary.join(counts, "table_name").select(
        "table_name", F.col("damaged").cast("int").alias("damaged"), "rows", loaded.alias("loaded"), "kept_rows")


# ------------------------------------------------------------------------------- snapshots


def release_catalogue(r: Register) -> DataFrame:
    """One release per order day; some are drafts, some pre-releases, some of another series."""
    day = F.to_date("o_orderdate")
    return r.source("orders").select(day.alias("day")).distinct().select(
        F.concat(F.when(F.dayofmonth("day") == 11, F.lit("test-")).otherwise(F.lit("data-")),
                 F.date_format("day", "yyyy-MM-dd")).alias("tag"),
        F.col("day").alias("published_at"), (F.dayofmonth("day") == 1).alias("draft"),
        (F.dayofmonth("day") == 31).alias("prerelease"))


_RELEASES = """
    SELECT concat(CASE WHEN day(d) = 11 THEN 'test-' ELSE 'data-' END, strftime(d, '%Y-%m-%d')) AS tag,
           d AS published_at, day(d) = 1 AS draft, day(d) = 31 AS prerelease
    FROM (SELECT DISTINCT cast(o_orderdate AS date) AS d FROM orders)"""


@query("s12_resolve_snapshot", f"""
    SELECT tag FROM ({_RELEASES}) WHERE tag LIKE 'data-%' AND NOT draft AND NOT prerelease
    ORDER BY published_at DESC, tag DESC LIMIT 1""")
def newest_snapshot(r: Register) -> DataFrame:
    return N.resolve_snapshot(release_catalogue(r))


@query("s13_expired_snapshots", f"""
    SELECT tag, cast(age_rank AS integer) AS age_rank FROM (
        SELECT tag, row_number() OVER (ORDER BY published_at DESC, tag DESC) AS age_rank FROM ({_RELEASES}))
    WHERE age_rank > 14""")
def expired(r: Register) -> DataFrame:
    return N.expired_snapshots(release_catalogue(r), 14)


def column_lists(r: Register) -> tuple[DataFrame, DataFrame]:
    """Two (entity, column) tables that overlap: brands as entities, sizes as columns."""
    pairs = r.source("part").select(
        F.col("p_brand").alias("entity"), F.concat(F.lit("c"), F.col("p_size")).alias("column"), "p_size")
    old = pairs.filter("p_size <= 35").drop("p_size").distinct()
    return old, pairs.filter("p_size >= 20").drop("p_size").distinct()


_DRIFT = """
    SELECT entity, change, "column" FROM (
        SELECT DISTINCT p_brand AS entity, concat('c', p_size) AS "column",
               CASE WHEN p_size > 35 THEN 'added' ELSE 'removed' END AS change
        FROM part WHERE p_size > 35 OR p_size < 20)"""


@query("s14_schema_drift", _DRIFT)
def drift(r: Register) -> DataFrame:
    return N.schema_drift(*column_lists(r))


@query("s15_drift_report", f"""
    SELECT entity, change, count(*) AS n_columns, string_agg("column", ', ' ORDER BY "column") AS columns
    FROM ({_DRIFT}) GROUP BY 1, 2""")
def drift_rows(r: Register) -> DataFrame:
    return N.drift_report(N.schema_drift(*column_lists(r)))


# ------------------------------------------------------------------------------- CSV dimensions


def as_csv(r: Register, df: DataFrame, label: str) -> str:
    path = new_work_path(r.spark, label)
    df.write.csv(path, header=True)
    return path


@query("s16_read_dim", """
    SELECT lpad(cast(s_suppkey AS varchar), 5, '0') AS plz, s_name AS ort, s_acctbal AS lat FROM supplier""")
def csv_dimension(r: Register) -> DataFrame:
    places = r.source("supplier").select(
        F.col("s_suppkey").alias("plz"), F.col("s_name").alias("ort"), F.col("s_acctbal").alias("lat"))
    return D.read_dim(r.spark, as_csv(r, places, "places"), "plz string, ort string, lat double", "plz")


@query("s17_read_elections", """
    SELECT s_name AS casa, cast(s_suppkey AS integer) AS local_votes,
           CASE WHEN s_suppkey % 9 <> 0 THEN cast(s_suppkey * 2 AS integer) END AS expat_votes,
           cast(s_nationkey AS integer) AS candidates,
           CASE WHEN s_acctbal >= 0 THEN 33.5e0 END AS lat, CASE WHEN s_acctbal >= 0 THEN 35.5e0 END AS lon
    FROM supplier""")
def csv_elections(r: Register) -> DataFrame:
    key = F.col("s_suppkey")
    votes = r.source("supplier").select(
        F.col("s_name").alias("Electoral Area"), key.alias("Local votes"),
        F.when(key % 9 == 0, F.lit("n/a")).otherwise((key * 2).cast("string")).alias("Expat votes"),
        F.col("s_nationkey").alias("Candidates"))
    places = r.source("supplier").filter("s_acctbal >= 0").select(
        F.col("s_name").alias("casa"), F.lit(33.5).alias("lat"), F.lit(35.5).alias("lon"))
    return D.read_elections(r.spark, as_csv(r, votes, "votes"), as_csv(r, places, "casas"))


@query("s18_read_orgs", """
    SELECT c_name AS "Institutions", CASE WHEN c_mktsegment = 'BUILDING' THEN 'Health & social work'
           ELSE 'Other' END AS sector
    FROM customer WHERE c_acctbal >= 0""")
def csv_orgs(r: Register) -> DataFrame:
    lat = F.when(F.col("c_acctbal") >= 0, F.lit(50.5))
    rows = r.source("customer").select(
        F.col("c_name").alias("Institutions"), lat.alias("Latitude"), F.lit(11.0).alias("Longitude"),
        F.concat(F.lit("Ort, "), F.col("c_nationkey")).alias("Location"), F.lit("a@example.org").alias("Email"),
        F.lit("").alias("Website"), F.lit("x").alias("Abschnitte"), F.lit(1.0).alias("Abteilungen"),
        F.lit(1.0).alias("Gruppen"), F.lit(1.0).alias("Klassen"), F.lit(1.0).alias("Unterklassen"),
        F.when(F.col("c_mktsegment") == "BUILDING", "R86").otherwise("X1").alias("Schlüssel"))
    return D.read_orgs(r.spark, as_csv(r, rows, "orgs")).select("Institutions", "sector")


# ------------------------------------------------------------------------------- payloads


@query("s19_explode_prices", """
    SELECT event_type AS bzn, cast(epoch(date_trunc('hour', ts)) AS bigint) AS unix_seconds,
           strftime(date_trunc('hour', ts) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M') AS ts,
           strftime(date_trunc('hour', ts) + INTERVAL 1 HOUR, '%H:%M') AS hour,
           floor(avg(floor(value * 8))) * 125e-3 - 10 AS price,
           CASE WHEN event_type = 'view' THEN 'EUR / MWh' ELSE 'EUR/MWh' END AS unit
    FROM events GROUP BY event_type, date_trunc('hour', ts)""")
def exploded_prices(r: Register) -> DataFrame:
    rows = Y.explode_prices(r.price_payloads, ["bzn"])
    return rows.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm"))


@query("s22_pick_metric", """
    SELECT n_nationkey AS nr, cast(count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS double) AS jobs,
           'Juni 2001' AS period, cast(NULL AS double) AS unknown, cast(NULL AS double) AS not_a_number
    FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1""")
def picked_metric(r: Register) -> DataFrame:
    metrics = Y.parse_metrics(F.col("stea"))
    jobs, period = Y.pick_metric(metrics, "Bestand Arbeitsstellen")
    unknown, _ = Y.pick_metric(metrics, "gibt es nicht")
    text, _ = Y.pick_metric(metrics, "Sonstiges")
    return labour_payloads(r).select(
        "nr", jobs.alias("jobs"), period.alias("period"), unknown.alias("unknown"),
        text.alias("not_a_number"))


@query("s23_explode_themes", """
    SELECT source, lang AS theme, cast(count(*) AS integer) AS count, count(*) * 5e-1 AS percentage
    FROM documents GROUP BY 1, 2""")
def exploded_themes(r: Register) -> DataFrame:
    """A summary document per source, a map from language to its numbers, read back as rows."""
    counts = r.source("documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    entry = F.struct(F.col("n").cast("int").alias("count"), (F.col("n") * 0.5).alias("percentage"),
                     F.array(F.lit("x")).alias("codes"))
    # one entry per language
    docs = counts.groupBy("source").agg(F.map_from_entries(F.collect_list(
        F.struct("lang", entry.alias("v")))).alias("m")).select("source", F.to_json("m").alias("body"))
    return Y.explode_themes(docs, "body", ["source"])


@query("s27_union_sources", """
    SELECT x.bzn, x.n, country FROM (
        SELECT event_type AS bzn, count(*) AS n FROM events WHERE value >= 50 GROUP BY 1
        UNION ALL SELECT event_type, count(*) FROM events WHERE value < 50 GROUP BY 1) x
    LEFT JOIN (VALUES ('view', 'Deutschland'), ('click', 'France'), ('signup', 'Polska'),
                      ('purchase', 'España')) z(bzn, country) ON z.bzn = x.bzn""")
def united_sources(r: Register) -> DataFrame:
    def source(condition: str) -> DataFrame:
        return r.source("events").filter(condition).groupBy(F.col("event_type").alias("bzn")).agg(
            F.count("*").alias("n"))

    parts = [source("value >= 50"), None, source("value < 50")]  # the middle source failed
    return union_sources(parts, zones(r).select("bzn", "country"), "bzn")


@query("s27_failing_source", """
    SELECT 'low' AS source, 'landed' AS status, event_type AS bzn, count(*) AS n FROM events WHERE value < 50 GROUP BY 3
    UNION ALL SELECT 'high', 'landed', event_type, count(*) FROM events WHERE value >= 50 GROUP BY 3
    UNION ALL SELECT 'broken', 'failed', NULL, NULL UNION ALL SELECT 'unplanned', 'failed', NULL, NULL
    UNION ALL SELECT 'silent', 'empty', NULL, NULL""")
def failing_source(r: Register) -> DataFrame:
    """Five sources: two deliver, one fails while it is read, one while it is planned, one has nothing."""
    def source(events: DataFrame) -> DataFrame:
        return events.groupBy(F.col("event_type").alias("bzn")).agg(F.count("*").alias("n"))

    events = r.source("events")
    raised = events.filter(F.when(F.col("event_id") % 100 == 50, F.raise_error(F.lit("unexpected end"))).otherwise(F.lit(True)))
    landed, report = land_sources(r.spark, {
        "low": lambda: source(events.filter("value < 50")), "high": lambda: source(events.filter("value >= 50")),
        "broken": lambda: source(raised), "unplanned": lambda: source(events.select("no_such_column")), "silent": lambda: None,
    }, new_work_path(r.spark, "sources"))
    rows = append([df.withColumn("source", F.lit(name)) for name, df in landed.items()])
    return report.join(rows, "source", "left").select("source", "status", "bzn", "n")
