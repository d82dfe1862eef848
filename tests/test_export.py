"""From a zipped export to SQL over views."""

import datetime as dt
import zipfile

import pytest
from conftest import rows

from gridledger.sources.export import load_export, open_register, refresh_aggregates
from gridledger.sources.snapshots import schema_drift, schema_table


def unit(tag, number, kw, state, day, updated, extra=""):
    return (f"<{tag}><EinheitMastrNummer>{number}</EinheitMastrNummer><Bruttoleistung>{kw}</Bruttoleistung>"
            f"<Bundesland>{state}</Bundesland><Inbetriebnahmedatum>{day}</Inbetriebnahmedatum>"
            f"<DatumLetzteAktualisierung>{updated}</DatumLetzteAktualisierung>{extra}</{tag}>")


@pytest.fixture
def export(folder):
    place = "<Postleitzahl>99084</Postleitzahl><Breitengrad>50.5</Breitengrad><Laengengrad>11.0</Laengengrad>"
    members = {
        "EinheitenSolar_1.xml": "<EinheitenSolar>" + unit("EinheitSolar", "S1", "9,5", "1415", "2020-01-05", "2021-01-01", place)
        + unit("EinheitSolar", "S2", "20", "1415", "2020-02-05", "2021-01-01") + "</EinheitenSolar>",
        "EinheitenSolar_2.xml": "<EinheitenSolar>" + unit("EinheitSolar", "S1", "10,5", "1415", "2020-01-05", "2022-01-01", place)
        + "</EinheitenSolar>",
        "EinheitenWind.xml": "<EinheitenWind>" + unit("EinheitWind", "W1", "3000", "1408", "2019-06-01", "2020-01-01",
                                                      "<Nabenhoehe>120</Nabenhoehe>") + "</EinheitenWind>",
        "Marktakteure_1.xml": "<Marktakteure><Marktakteur><MastrNummer>A1</MastrNummer><Firmenname>X &amp; Y</Firmenname>"
                              "</Marktakteur></Marktakteure>",
    }
    path = f"{folder}/export.zip"
    with zipfile.ZipFile(path, "w") as zf:
        for name, text in members.items():
            zf.writestr(name, text)
    return path


def test_load_and_query(spark, folder, export):
    report = {r.entity: (r.records, r.damaged, r.rows) for r in load_export(spark, export, f"{folder}/t").collect()}
    assert report == {"solar": (3, 0, 2), "wind": (1, 0, 1), "marktakteure": (1, 0, 1)}
    states = refresh_aggregates(spark, f"{folder}/t", f"{folder}/a", dt.date(2024, 1, 1))
    assert set(states.values()) == {"written"}
    tables = open_register(spark, f"{folder}/t", f"{folder}/a")
    assert set(tables) == {"solar", "wind", "marktakteure"}

    def sql(text):
        return rows(spark.sql(text))

    assert sql("SELECT energietraeger, SUM(bruttoleistung_mw) FROM agg_capacity_by_state GROUP BY 1") == [
        ("SolareStrahlungsenergie", 0.0305), ("Wind", 3.0)]
    assert sql("SELECT bundesland_name, COUNT(*) FROM v_units_all WHERE plz IS NULL GROUP BY 1") == [
        ("Niedersachsen", 1), ("Thüringen", 1)]
    assert sql("SELECT units_total, ee_units, as_of FROM agg_kpi_overview") == [(3, 3, dt.date(2024, 1, 1))]
    assert sql("SELECT plz, units, lat FROM v_capacity_by_plz") == [("99084", 1, 50.5)]
    assert sql("SELECT COUNT(*) FROM v_buildout_monthly WHERE month >= DATE'2020-01-01'") == [(2,)]
    assert sql("SELECT nabenhoehe_m, mw FROM agg_wind_hub_height") == [(120.0, 3.0)]
    assert sql("SELECT Firmenname FROM marktakteure") == [("X & Y",)]
    assert sql("SELECT b.name FROM solar s JOIN bundesland b ON b.code = s.Bundesland") == [("Thüringen",)] * 2


def test_only_some_entities(spark, folder, export):
    assert [r.entity for r in load_export(spark, export, f"{folder}/t", only=["wind"]).collect()] == ["wind"]
    with pytest.raises(RuntimeError, match="no power-unit table"):
        refresh_aggregates(spark, f"{folder}/empty", f"{folder}/a", dt.date(2024, 1, 1))


def test_drift_between_loads(spark, folder, export):
    load_export(spark, export, f"{folder}/t", only=["solar", "wind"])
    now = schema_table(spark, open_register(spark, f"{folder}/t"))
    before = now.filter("column <> 'Nabenhoehe'")
    assert rows(schema_drift(before, now)) == [("wind", "added", "Nabenhoehe")]
