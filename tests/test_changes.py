"""A cube patched by the changes between snapshots must be the cube of the last snapshot."""

import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from gridledger.operators import changes as N
from gridledger.operators.cube import cube_rows, unit_cube
from gridledger.sources import manifests as M

SCHEMA = ("source_table string, energietraeger string, mastr_nr string, bruttoleistung_kw double, bundesland_code string,"
          " plz string, lon double, lat double, inbetriebnahme_datum date")


def unit(rng, number):
    return ("solar", rng.choice(["Wind", "Biomasse", None]), f"E{number}", rng.choice([None, rng.randrange(8000) / 8]),
            rng.choice(["1401", "1415", "77", None]), rng.choice(["1", "2", None]),
            rng.choice([None, rng.randrange(100) / 8]), rng.choice([None, rng.randrange(100) / 8]),
            rng.choice([None, dt.date(2020, rng.randrange(1, 13), 3)]))


@pytest.fixture
def snapshots(spark):
    """Three snapshots: inserts, updates and deletes, repeated rows whose number changes, and one that is empty."""
    rng = random.Random(4)
    first = [unit(rng, i) for i in range(300)]
    second = first[40:] + [unit(rng, i) for i in range(20)] + [unit(rng, 900 + i) for i in range(30)] + [first[50]] * 2
    return [spark.createDataFrame(data, SCHEMA) for data in (first, second, second[:-1], [])]


def test_patched_cells_are_those_of_a_full_cube(spark, folder, snapshots):
    for snapshot in snapshots:
        got = N.advance(snapshot, folder)
        assert got.columns == unit_cube(snapshot).columns
        assert rows(got) == rows(unit_cube(snapshot))


def test_only_changed_rows_are_folded(snapshots):
    old, new = (N.with_print(cube_rows(s, "mastr_nr")) for s in snapshots[:2])
    diff = N.change_set(old, new)
    times = sorted(r.times for r in N.changed_rows(old, new, diff).collect())
    assert times == [-1] * 40 + [1] * 50 + [2] and diff.count() == 91
    assert N.change_set(new, new).count() == 0


def test_sums_leave_no_rounding_behind(spark):
    cells = spark.createDataFrame([(0.1,), (0.2,), (1e12,)], "bruttoleistung_kw double").select(
        *[F.lit(None).cast("string").alias(c) for c in ("bundesland_code", "energietraeger", "size_class", "plz")],
        F.lit(None).cast("date").alias("month"), F.lit(True).alias("located"), "bruttoleistung_kw",
        F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"))
    cube = N.patched(N.signed_cube(cells), N.signed_cube(cells.filter("bruttoleistung_kw > 1"), F.lit(-1)))
    assert {(r.n, r.kw, r.lat_sum) for r in N.as_unit_cube(cube).collect()} == {(2, 0.3, None)}
    assert N.patched(cube, N.signed_cube(cells.filter("bruttoleistung_kw < 1"), F.lit(-1))).count() == 0


def test_a_snapshot_that_fails_leaves_the_state(spark, folder, snapshots):
    first = rows(N.advance(snapshots[0], folder))
    broken = snapshots[1].withColumn("plz", F.raise_error(F.lit("unexpected end")).cast("string"))
    with pytest.raises(Exception, match="unexpected end"):
        N.advance(broken, folder)
    assert M.numbers(spark, folder) == [1]
    assert rows(N.as_unit_cube(M.published(spark, folder, "cube"))) == first


def test_rows_are_written_and_compared_once(spark, folder, snapshots, monkeypatch):
    """A snapshot's rows are one copy, published where they landed, and no second shuffle fetches what differs."""
    published = {}
    monkeypatch.setattr(M, "publish", lambda spark, root, plans, publish=M.publish, **more: (
        published.update({name: plan() for name, plan in plans.items()}), publish(spark, root, plans, **more))[1])
    N.advance(snapshots[0], folder)
    N.advance(snapshots[1], folder)
    assert set(published) == {"cube"} and set(M.read(spark, folder)[1]) == {"rows", "cube"}
    assert M.published(spark, folder, "rows").count() == snapshots[1].count()
    assert " Join " not in published["cube"]._jdf.queryExecution().optimizedPlan().toString()


def test_absent_values_are_told_apart_by_the_hash(spark):
    rows_ = spark.createDataFrame([("a", None, 1.0), (None, "a", 1.0), ("a", "", 1.0), (None, None, None), ("a", None, None)],
                                  "x string, y string, z double")
    prints = [r.print for r in N.with_print(rows_).collect()]
    assert len(set(prints)) == 5
    assert sorted(prints) == sorted(r.print for r in N.with_print(rows_.select("z", "y", "x")).collect())


def test_a_state_kept_with_another_hash_goes_on(spark, folder, snapshots):
    kept = cube_rows(snapshots[0], "mastr_nr")
    M.publish(spark, folder, {"rows": lambda: kept.withColumn("print", F.unhex(F.md5("mastr_nr"))),
                              "cube": lambda: N.signed_cube(kept)})
    assert rows(N.advance(snapshots[1], folder)) == rows(unit_cube(snapshots[1]))
