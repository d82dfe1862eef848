"""XML exports to tables: damaged input, splitting, typing, de-duplication, partitions, drift."""

import datetime as dt
import os
import zipfile

import pytest
from conftest import rows
from pyspark.sql import functions as F

from gridledger.catalog import ENTITIES, Entity
from gridledger.sources import register_xml as X
from gridledger.sources import snapshots as N
from gridledger.sources import tables as B

SOLAR = ENTITIES["solar"]
HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<EinheitenSolar>\n'


def record(**fields):
    body = "".join(f"  <{k}>{v}</{k}>\n" for k, v in fields.items())
    return f"<EinheitSolar>\n{body}</EinheitSolar>\n"


FIRST = record(EinheitMastrNummer="SEE900000000001", Bruttoleistung="9,84", Bundesland="1408",
               Inbetriebnahmedatum="2021-03-15T00:00:00", Laengengrad="11.581", Breitengrad="48.135",
               Postleitzahl="01067", Gemeinde=" ")
SECOND = record(EinheitMastrNummer="SEE900000000002", Bruttoleistung="330.0", Bundesland="1404",
                Inbetriebnahmedatum="2022-07-01")
ODD = record(EinheitMastrNummer="SEE900000000003", Bruttoleistung="1.234,56",
             Inbetriebnahmedatum="2021-13-01", Neuland="ja")


def archive(folder, members, encoding="utf-8"):
    path = os.path.join(folder, "export.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as zf:
        for name, text in members.items():
            zf.writestr(name, text.encode(encoding))
    return path


def load(spark, folder, members, encoding="utf-8", part_bytes=1 << 20, columns=None):
    out = os.path.join(folder, "staged")
    found = X.stage_members(spark, archive(folder, members, encoding), SOLAR, out, part_bytes)
    raw, counts = X.read_entity(spark, out, SOLAR, columns or found.columns)
    return X.typed(raw, SOLAR), counts, found


def test_two_record_archive(spark, folder):
    df, counts, found = load(spark, folder, {"EinheitenSolar_1.xml": HEAD + FIRST + SECOND + "</EinheitenSolar>"})
    got = {r.EinheitMastrNummer: r for r in df.collect()}
    assert len(got) == 2 and found.parts == {"EinheitenSolar_1.xml": 1}
    one, two = got["SEE900000000001"], got["SEE900000000002"]
    assert one.Bruttoleistung == 9.84 and two.Bruttoleistung == 330.0
    assert one.Inbetriebnahmedatum == dt.date(2021, 3, 15) and one.Laengengrad == 11.581
    assert one.Postleitzahl == "01067"  # leading zero kept
    assert one.Gemeinde is None  # K24: blank text is missing
    assert two.Laengengrad is None
    assert counts.get == {"records": 2, "damaged": 0, "identified": 2}


def test_only_matching_members_are_read(spark, folder):
    other = HEAD.replace("Solar", "Wind") + "</EinheitenWind>"
    _, _, found = load(spark, folder, {"EinheitenSolar_1.xml": HEAD + FIRST + "</EinheitenSolar>",
                                       "EinheitenWind.xml": other})
    assert os.listdir(os.path.join(folder, "staged")) == [X.part_name("EinheitenSolar_1.xml", 0)]
    assert "Bruttoleistung" in found.columns and SOLAR.tag not in found.columns
    assert X.stage_members(spark, os.path.join(folder, "export.zip"), ENTITIES["kwk"], folder) == ({}, [], {})


def test_columns_grow_across_members(spark, folder):
    df, _, _ = load(spark, folder, {"EinheitenSolar_1.xml": HEAD + FIRST + "</EinheitenSolar>",
                                    "EinheitenSolar_2.xml": HEAD + ODD + "</EinheitenSolar>"})
    got = {r.EinheitMastrNummer[-1]: r for r in df.collect()}
    assert got["1"].Neuland is None and got["3"].Neuland == "ja"
    assert got["3"].Bruttoleistung is None and got["3"].Inbetriebnahmedatum is None  # K3, K5


def test_k25_truncated_member_keeps_whole_records(spark, folder):
    broken = HEAD + FIRST + SECOND + "<EinheitSolar>\n <EinheitMastrNummer>SEE9"
    df, _, found = load(spark, folder, {"EinheitenSolar_1.xml": broken, "EinheitenSolar_2.xml": HEAD + FIRST})
    assert df.count() == 3 and found.truncated == {"EinheitenSolar_1.xml": 1}


def test_schema_snapshots_are_stored_and_compared(spark, folder):
    one, two = spark.createDataFrame([], "a int, b int"), spark.createDataFrame([], "a int, c int")
    where = f"{folder}/schemas"
    assert N.record_schema(spark, {"t": one}, where, "data-2024-01-01").count() == 0
    changes = {("t", "added", "c"), ("t", "removed", "b"), ("u", "added", "a"), ("u", "added", "b")}
    for _ in range(2):
        got = N.record_schema(spark, {"t": two, "u": one}, where, "data-2024-02-01")
        assert {tuple(r) for r in got.collect()} == changes
    assert N.record_schema(spark, {"t": two, "u": one}, where, "data-2024-03-01").count() == 0


def test_members_of_one_name_stay_apart(spark, folder):
    members = {f"{place}/EinheitenSolar_1.xml": HEAD + text + "</EinheitenSolar>" for place, text in (("a", FIRST), ("b", SECOND))}
    out = os.path.join(folder, "staged")
    found = X.stage_members(spark, archive(folder, members), Entity("solar", SOLAR.tag, "*EinheitenSolar*"), f"file://{out}")
    assert len(os.listdir(out)) == 2 and set(found.parts.values()) == {1}
    raw, _ = X.read_entity(spark, f"file://{out}", SOLAR, found.columns)
    assert {r.EinheitMastrNummer for r in raw.collect()} == {"SEE900000000001", "SEE900000000002"}


def test_k23_k25_damaged_record_is_counted_and_dropped(spark, folder):
    bad = "<EinheitSolar><EinheitMastrNummer>SEE9</Falsch></EinheitSolar>"
    df, counts, _ = load(spark, folder, {"EinheitenSolar_1.xml": HEAD + FIRST + "</EinheitenSolar>",
                                         "EinheitenSolar_2.xml": HEAD + bad + "</EinheitenSolar>"})
    assert [r.EinheitMastrNummer for r in df.collect()] == ["SEE900000000001"]
    assert counts.get["records"] == 2 and counts.get["damaged"] == 1


def test_utf16_members(spark, folder):
    text = HEAD.replace("UTF-8", "UTF-16") + record(EinheitMastrNummer="S1", Gemeinde="Köln") + "</EinheitenSolar>"
    df, _, _ = load(spark, folder, {"EinheitenSolar_1.xml": text}, encoding="utf-16")
    assert df.first().Gemeinde == "Köln"


def test_large_members_are_cut_between_records(spark, folder):
    many = "".join(record(EinheitMastrNummer=f"S{i}", Gemeinde="Ä" * 40) for i in range(500))
    members = {"EinheitenSolar_1.xml": HEAD + many + "</EinheitenSolar>"}
    df, _, _ = load(spark, folder, members, part_bytes=4000)
    # the stream is read by the megabyte, so one small member arrives as a single chunk
    assert df.count() == 500 and df.select("EinheitMastrNummer").distinct().count() == 500
    text = (HEAD + many + "</EinheitenSolar>").encode()
    pieces = list(X.split_records((text[i:i + 777] for i in range(0, len(text), 777)), SOLAR.tag, 4000))
    assert len(pieces) > 10 and sum(p.count(b"</EinheitSolar>") for p in pieces) == 500
    assert all(p.startswith(b"<part><EinheitSolar>") and p.endswith(b"</part>") for p in pieces[:1])


def test_staging_again_gives_the_same_files(spark, folder):
    members = {"EinheitenSolar_1.xml": HEAD + FIRST + SECOND + "</EinheitenSolar>"}
    _, _, first = load(spark, folder, members)
    _, _, second = load(spark, folder, members)
    assert first == second and len(os.listdir(os.path.join(folder, "staged"))) == 1


def test_k02_dedup_keeps_the_last_update(spark):
    data = [("a", dt.date(2020, 1, 1), 1.0), ("a", dt.date(2021, 1, 1), 2.0), ("a", None, 9.0),
            ("b", None, 5.0), ("c", dt.date(2020, 1, 1), 3.0), ("c", dt.date(2020, 1, 1), 4.0)]
    df = spark.createDataFrame(data, "id string, DatumLetzteAktualisierung date, kw double")
    got = X.dedup(df, ["id"], "DatumLetzteAktualisierung")
    assert got.columns == df.columns
    assert {(r.id, r.kw) for r in got.collect()} == {("a", 2.0), ("b", 5.0), ("c", 4.0)}


def test_dedup_without_an_update_date_is_stable(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("a", 2), ("b", None)], "id string, v int")
    assert rows(X.dedup(df, ["id"])) == [("a", 3), ("b", None)]
    assert rows(X.dedup(df.select("id"), ["id"])) == [("a",), ("b",)]


def test_dedup_of_a_hot_id_combines_before_the_shuffle(spark):
    hot = spark.range(50_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("id"),
        F.expr("date'2020-01-01' + cast(id % 1000 as int)").alias("d"), F.col("id").alias("n"))
    got = X.dedup(hot, ["id"], "d")
    assert got.count() == 33_334 and got.filter("id = 'hot'").first().n == 48_999
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_max") >= 1


def test_k01_partitioned_when_declared(spark, folder):
    df = spark.createDataFrame([("a", "1408", 1.0), ("b", "1404", 2.0), ("c", None, 3.0)],
                               "EinheitMastrNummer string, Bundesland string, Bruttoleistung double")
    target = X.write_entity(df, SOLAR, folder)
    assert {"Bundesland=1404", "Bundesland=1408"} <= set(os.listdir(target))
    plain = X.write_entity(df, ENTITIES["wasser"], folder)
    assert not any(name.startswith("Bundesland=") for name in os.listdir(plain))
    back = B.load_entities(spark, folder)
    assert set(back) == {"solar", "wasser"}
    assert dict(back["solar"].dtypes)["Bundesland"] == "string"
    assert rows(back["solar"].select(df.columns)) == rows(df)
    pruned = back["solar"].filter("Bundesland = '1404'")
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert pruned.count() == 1 and "PartitionFilters: [isnotnull(Bundesland" in plan


def test_missing_and_corrupt_tables_are_skipped(spark, folder):
    spark.range(2).write.parquet(f"{folder}/wind.parquet")
    os.makedirs(f"{folder}/solar.parquet")
    with open(f"{folder}/solar.parquet/part-0.parquet", "wb") as f:
        f.write(b"not parquet at all")
    assert set(B.load_entities(spark, folder)) == {"wind"}
    assert spark.table("wind").count() == 2


def test_union_evolving(spark):
    a = spark.createDataFrame([(1,)], "x int")
    b = spark.createDataFrame([(2, "n")], "x int, y string")
    assert rows(B.union_evolving([a, b])) == [(1, None), (2, "n")]


def test_snapshots(spark):
    ts = lambda d: dt.datetime(2024, 1, d)
    data = [("data-2024-01-01", ts(1), False, False), ("data-2024-01-02", ts(2), False, False),
            ("data-2024-01-03", ts(3), True, False), ("data-2024-01-04", ts(4), False, True),
            ("app-v9", ts(9), False, False)]
    catalog = spark.createDataFrame(data, "tag string, published_at timestamp, draft boolean, prerelease boolean")
    assert N.resolve_snapshot(catalog).first().tag == "data-2024-01-02"
    assert N.resolve_snapshot(catalog, pin="app-v9").first().tag == "app-v9"
    assert N.resolve_snapshot(catalog, pin="nope").count() == 0
    assert N.resolve_snapshot(catalog.limit(0)).count() == 0
    assert {r.tag for r in N.expired_snapshots(catalog, 2).collect()} == {
        "data-2024-01-01", "data-2024-01-02", "data-2024-01-03"}


def test_schema_drift(spark):
    old = N.schema_table(spark, {"solar": spark.createDataFrame([(1, 2)], "a int, b int"),
                                 "wind": spark.createDataFrame([(1,)], "w int")})
    new = N.schema_table(spark, {"solar": spark.createDataFrame([(1, 2, 3)], "a int, d int, c int")})
    drift = N.schema_drift(old, new)
    assert rows(drift) == [("solar", "added", "c"), ("solar", "added", "d"), ("solar", "removed", "b"),
                           ("wind", "removed", "w")]
    assert ("solar", "added", 2, "c, d") in rows(N.drift_report(drift))
    assert N.schema_drift(old, old).count() == 0


def test_catalogue_is_complete():
    assert len(ENTITIES) == 20
    assert ENTITIES["kwk"].ids == ("KwkMastrNummer",) and ENTITIES["solar"].partition_by == ("Bundesland",)


def test_members_by_glob(folder):
    path = archive(folder, {"EinheitenSolar_2.xml": "", "EinheitenSolar_1.xml": "", "Lokationen.xml": ""})
    assert X.list_members(path, "EinheitenSolar*.xml") == ["EinheitenSolar_1.xml", "EinheitenSolar_2.xml"]


def test_reader_discovers_columns_when_none_are_given(spark, folder):
    _, _, found = load(spark, folder, {"EinheitenSolar_1.xml": HEAD + FIRST + ODD + "</EinheitenSolar>"})
    raw, _ = X.read_entity(spark, os.path.join(folder, "staged"), SOLAR)
    assert sorted(raw.columns) == found.columns and raw.count() == 2


@pytest.mark.parametrize("columns", [["EinheitMastrNummer", "Bruttoleistung"]])
def test_explicit_columns_skip_discovery(spark, folder, columns):
    df, _, _ = load(spark, folder, {"EinheitenSolar_1.xml": HEAD + FIRST + "</EinheitenSolar>"}, columns=columns)
    assert df.columns == columns and df.count() == 1
