"""The unified view over complete, skinny and missing tables."""

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from gridledger.catalog import CARRIERS
from gridledger.operators import cube as C
from gridledger.operators import units as U
from gridledger.sources import tables as B

RICH = ["EinheitMastrNummer", "Bruttoleistung", "Nettonennleistung", "Bundesland", "Inbetriebnahmedatum",
        "Gemeinde", "Postleitzahl", "Laengengrad", "Breitengrad", "Betriebsstatus"]
SKINNY = RICH[:5]


def register_table(spark, key, columns):
    def cell(column, i):
        return {"EinheitMastrNummer": f"{key}-{i}", "Bruttoleistung": f"{i + 1}.0",
                "Nettonennleistung": f"{i + 1}.0", "Bundesland": f"140{i + 2}",
                "Inbetriebnahmedatum": "2024-01-01", "Laengengrad": f"{i + 1}.0",
                "Breitengrad": f"{i + 1}.0", "Betriebsstatus": "InBetrieb"}.get(column, f"v{i}")

    data = [tuple(cell(c, i) for c in columns) for i in range(3)]
    return spark.createDataFrame(data, ", ".join(f"{c} string" for c in columns))


@pytest.fixture(scope="module")
def tables(spark):
    return {key: register_table(spark, key, SKINNY if key == "kernkraft" else RICH) for key in CARRIERS}


def test_union_of_eight_tables(tables):
    units = U.units_all(tables)
    assert units.count() == 24 and len(units.columns) == 13
    nuclear = units.filter("source_table = 'kernkraft'")
    absent = ["gemeinde", "plz", "lat", "lon", "betriebsstatus"]
    assert nuclear.select([F.count(c).alias(c) for c in absent]).first() == (0, 0, 0, 0, 0)
    solar = units.filter("source_table = 'solar'")
    assert solar.filter("gemeinde IS NULL OR betriebsstatus IS NULL").count() == 0
    assert solar.agg(F.sum("bruttoleistung_kw")).first()[0] == 6.0
    assert {r[0] for r in units.select("bundesland_name").collect()} == {"Baden-Württemberg", "Bayern", "Bremen"}


def test_k14_geothermal_carrier_label(tables):
    units = U.units_all(tables, names=False)
    assert "bundesland_name" not in units.columns
    assert units.filter("source_table = 'geothermie'").first().energietraeger == "GeothermieGrubenKlaerschlamm"


def test_partial_catalogue(tables):
    units = U.units_all({k: tables[k] for k in ("solar", "wind")})
    assert units.count() == 6
    assert {r[0] for r in units.select("source_table").distinct().collect()} == {"solar", "wind"}
    assert U.units_all({}) is None


def test_bad_values_become_null(spark):
    bad = spark.createDataFrame([("x", "abc", "2024-99-01")],
                                "EinheitMastrNummer string, Bruttoleistung string, Inbetriebnahmedatum string")
    row = U.units_all({"solar": bad}).first()
    assert row.bruttoleistung_kw is None and row.inbetriebnahme_datum is None


def test_wind_specs_tolerate_missing_columns(spark, tables):
    assert U.wind_specs(tables["wind"]).count() == 0
    high = tables["wind"].withColumn("nabenhoehe", F.lit("120"))
    assert U.wind_specs(high).count() == 3
    assert U.wind_specs(high).first().rotor_m is None


def test_unknown_states(spark, tables):
    odd = tables["solar"].withColumn("Bundesland", F.lit("9999"))
    units = U.units_all({"solar": odd, "wind": tables["wind"]}, names=False)
    assert U.capacity_by_state(units).count() == 3
    classes = U.solar_size_classes(units).collect()
    assert [(r.bundesland_name, r.units) for r in classes] == [(None, 3)]


def test_cube_gives_the_same_aggregates(spark, tables):
    as_of = dt.date(2024, 6, 1)
    units = U.units_all({k: v.withColumn("Bundesland", F.when(F.col("Bundesland") != "1404", F.col("Bundesland")))
                         for k, v in tables.items()}, names=False)
    cube = C.unit_cube(units)
    for name in ("capacity_by_state", "buildout_monthly", "top_plz", "solar_size_classes", "ee_quote_by_year"):
        direct = getattr(U, name)(units)
        assert rows(getattr(C, name)(cube).select(direct.columns)) == rows(direct), name
    assert rows(C.kpi_overview(cube, as_of)) == rows(U.kpi_overview(units, as_of))


def test_aggregates_are_written_and_isolated(spark, tables, folder):
    units = U.units_all(tables, names=False)
    report = B.write_aggregates(units, {}, folder, dt.date(2024, 6, 1))
    assert report.pop("wind_hub_height") == "skipped"
    assert set(report.values()) == {"written"} and len(report) == 6
    assert B.agg_table(spark, folder, "kpi_overview").first().units_total == 24
    broken = {"wind": spark.createDataFrame([("120",)], "Nabenhoehe string").withColumn(
        "Bruttoleistung", F.raise_error(F.lit("boom")).cast("string"))}
    again = B.write_aggregates(units, broken, folder, dt.date(2024, 6, 1))
    assert again["wind_hub_height"] == "failed" and again["ee_quote_by_year"] == "written"


def test_turbines_are_written_even_if_the_units_fail(spark, tables, folder):
    broken = U.units_all(tables, names=False).withColumn(
        "bruttoleistung_kw", F.raise_error(F.lit("boom")).cast("double"))
    wind = {"wind": tables["wind"].withColumn("Nabenhoehe", F.lit("99"))}
    report = B.write_aggregates(broken, wind, folder, dt.date(2024, 6, 1))
    assert report.pop("wind_hub_height") == "written" and set(report.values()) == {"failed"}


def test_required_tables(tables):
    assert B.checked_summary({"solar": tables["solar"]}, ["solar"]).first().rows == 3
    with pytest.raises(RuntimeError, match="wind"):
        B.checked_summary({"solar": tables["solar"]}, ["solar", "wind"])
