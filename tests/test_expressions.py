
import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from gridledger.catalog import DELAY_BINS, ENTITIES, STATES
from gridledger.functions import convert as V
from gridledger.functions import labels as B
from gridledger.functions import predicates as T
from gridledger.operators import projection as P
from gridledger.operators import units as U


def one(spark, value, kind, build):
    """Value of a column expression over a single cell."""
    return spark.createDataFrame([(value,)], f"x {kind}").select(build(F.col("x"))).first()[0]


@pytest.mark.parametrize("text, expected", [
    ("9,84", 9.84), ("330.0", 330.0), (" 12 ", 12.0), ("-1,5", -1.5), ("1e3", 1000.0), (".5", 0.5),
    ("1.234,56", None), ("1d", None), ("", None), ("abc", None), (None, None), ("1,2,3", None),
])
def test_k03_k05_german_decimals(spark, text, expected):
    assert one(spark, text, "string", V.to_number) == expected


def test_k03_thousands_option(spark):
    assert one(spark, "1.234,56", "string", lambda c: V.to_number(c, thousands=True)) == 1234.56
    assert one(spark, "1234.5", "string", lambda c: V.to_number(c, thousands=True)) == 1234.5


@pytest.mark.parametrize("text, expected", [
    ("2021-03-15", dt.date(2021, 3, 15)), ("2021-03-15T10:00:00", dt.date(2021, 3, 15)),
    ("2021-13-01", None), ("2021", None), ("2021-3-1", None), ("", None), (None, None),
    ("2023-02-29", None), ("15.03.2021", None),
])
def test_k05_strict_iso_dates(spark, text, expected):
    assert one(spark, text, "string", V.to_iso_date) == expected


def test_k04_manufacture_date_stays_text():
    assert all("HerstellungsDatum" not in e.numbers for e in ENTITIES.values())


@pytest.mark.parametrize("kw, six, seventeen, three", [
    (0.5, "0–10 kW", "<= 1 kW", "Home"), (10.0, "10–30 kW", "<= 10 kW", "C&I"),
    (30.0, "30–100 kW", "<= 50 kW", "C&I"), (100.0, "100–750 kW", "<= 100 kW", "C&I"),
    (1000.0, "0.75–10 MW", "<= 1000 kW", "Large Scale"),
    (10000.0, ">10 MW", "<= 10000 kW", "Large Scale"), (10000.5, ">10 MW", "> 10000 kW", "Large Scale"),
    (None, ">10 MW", "> 10000 kW", "Large Scale"),
])
def test_k06_k07_size_classes(spark, kw, six, seventeen, three):
    assert one(spark, kw, "double", B.size_class6) == six
    assert one(spark, kw, "double", B.size_bucket17) == seventeen
    assert one(spark, kw, "double", B.segment3) == three


def test_k06_null_class_option(spark):
    assert one(spark, None, "double", lambda c: B.size_class6(c, null_class="ohne Angabe")) == "ohne Angabe"
    assert one(spark, 5.0, "double", lambda c: B.size_class6(c, null_class="ohne Angabe")) == "0–10 kW"


def test_bucket_order_follows_size(spark):
    df = spark.createDataFrame([(float(k),) for k in (1, 3, 4, 11, 126, 20000)], "x double")
    assert [r[0] for r in df.select(B.size_bucket17_ord(F.col("x"))).collect()] == [1, 2, 3, 5, 10, 17]


@pytest.mark.parametrize("name", ["Betriebsstatus", "EinheitBetriebsstatus", "einheitbetriebsstatus"])
def test_k08_active_in_every_encoding(spark, name):
    df = spark.createDataFrame([("35",), ("InBetrieb",), ("38",), (None,)], f"{name} string")
    assert df.filter(T.is_active(df)).count() == 2


def test_k08_active_as_number(spark):
    df = spark.createDataFrame([(35,), (38,)], "EinheitBetriebsstatus int")
    assert df.filter(T.is_active(df)).count() == 1


def test_k09_onshore_in_both_encodings(spark):
    raw = spark.createDataFrame([("WindAufSee",), ("WindAnLand",), (None,)], "Lage string")
    assert raw.filter(T.is_onshore(raw)).count() == 2
    coded = spark.createDataFrame([("889",), ("888",), (None,)], "WindAnLandOderAufSee string")
    assert coded.filter(T.is_onshore(coded)).count() == 2
    bare = spark.createDataFrame([(1,)], "x int")
    assert bare.filter(T.is_onshore(bare)).count() == 1


def test_k12_one_verified_state_lookup(spark):
    lookup = dict(rows(U.state_lookup(spark)))
    assert lookup == STATES and len(lookup) == 17 and lookup["1415"] == "Thüringen"


@pytest.mark.parametrize("value, kind", [(802.0, "double"), ("802", "string"), ("802.0", "string"), (802, "int")])
def test_k13_codes_compare_as_text(spark, value, kind):
    assert one(spark, value, kind, V.code_text) == "802"


def test_k13_text_codes_survive(spark):
    assert one(spark, "B7", "string", V.code_text) == "B7"


@pytest.mark.parametrize("path, slug", [
    ("/", "hub"), ("//", "hub"), ("/karte/?x=1", "karte"), ("/karte?x=/a/b", "karte"), ("/?q=1", "hub"),
    ("/a/b/c", "a"), (None, "hub"),
])
def test_k15_slug_drops_query_string(spark, path, slug):
    assert one(spark, path, "string", B.page_slug) == slug


@pytest.mark.parametrize("path, entry", [
    ("/", True), ("/karte", True), ("/karte/", True), ("/karte/?a=1", True), ("/a/b", False),
    ("//x", False), (None, False), ("", False),
])
def test_entry_pages(spark, path, entry):
    assert one(spark, path, "string", T.is_entry_page) is entry


@pytest.mark.parametrize("path, asset", [
    ("/", False), ("/karte", False), ("/app.js", True), ("/websocket", True), ("/a/b.png", True), (None, True)])
def test_assets(spark, path, asset):
    assert one(spark, path, "string", T.is_asset) is asset


@pytest.mark.parametrize("days, label", [
    (-901, "<-900"), (-900, "<-900"), (-899, "-900"), (0, "-14"), (1, "0"), (7, "0"), (8, "7"),
    (730, "365"), (731, "730+")])
def test_k19_bins_are_right_closed(spark, days, label):
    assert one(spark, days, "int", lambda c: B.ladder(c, DELAY_BINS, inclusive=True)) == label


def test_k21_postcode_padding(spark):
    assert one(spark, 7, "int", V.norm_plz) == "00007"
    assert one(spark, "123456", "string", V.norm_plz) == "123456"


@pytest.mark.parametrize("season, month, inside", [
    ("Jun-Aug", 7, True), ("Jun-Aug", 9, False), ("Nov-Feb", 1, True), ("Nov-Feb", 11, True),
    ("Nov-Feb", 3, False), ("Mar", 3, False), ("Xxx-Aug", 8, False), ("A-B-C", 1, False), (None, 1, False)])
def test_seasons_wrap_around(spark, season, month, inside):
    assert one(spark, season, "string", lambda c: T.in_season(c, F.lit(month))) is inside


@pytest.mark.parametrize("agent, label", [
    ("Mozilla (iPad)", "Tablet"), ("Android Mobile", "Phone"), ("SomeBot/1", "Bot"), ("X11", "Desktop"),
    (None, "Desktop"), ("Tablet bot mobile", "Tablet")])
def test_devices_in_order(spark, agent, label):
    assert one(spark, agent, "string", B.device) == label


def test_unknown_codes_keep_their_number(spark):
    label = lambda c: B.enum_label(c, {"1": "eins"})
    assert one(spark, " 1 ", "string", label) == "eins"
    assert one(spark, "9", "string", label) == "Code 9"
    assert one(spark, None, "string", label) is None


def test_german_formats(spark):
    assert one(spark, 1234567.891, "double", lambda c: V.fmt_de(c, 2)) == "1.234.567,89"
    assert one(spark, 0.1234, "double", V.fmt_percent_de) == "12,34%"
    assert one(spark, None, "double", V.fmt_percent_de) == "—"


def test_log_times(spark):
    expected = dt.datetime(2024, 1, 2, 3, 4, 5)
    assert one(spark, "02/Jan/2024:03:04:05 +0000", "string", V.log_time) == expected
    assert one(spark, "02/Jan/2024:05:04:05 +0200", "string", V.log_time) == expected
    assert one(spark, "02/Jan/2024:03:04:05", "string", V.log_time) == expected
    assert one(spark, "gestern", "string", V.log_time) is None


def test_clock_helpers_ignore_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            df = spark.sql("SELECT timestamp_ntz'2024-07-01 12:00:00' AS t, 1719835200L AS s")
            got = df.select(V.utc_clock(V.utc_instant(F.col("t"))), V.epoch_to_local(F.col("s"), "Europe/Berlin"),
                            T.local_day(V.utc_instant(F.col("t")), "Asia/Tokyo", dt.date(2024, 7, 1))).first()
            assert tuple(got) == (dt.datetime(2024, 7, 1, 12), dt.datetime(2024, 7, 1, 14), True)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_empty_lists(spark):
    df = spark.range(3)
    assert df.filter(T.in_list(F.col("id"), [])).count() == 0
    assert df.filter(T.in_list_or_all(F.col("id"), [])).count() == 3


def test_state_filters(spark):
    df = spark.createDataFrame([("1415",), ("1403",), (None,)], "c string")
    assert df.filter(T.in_states(F.col("c"), [])).count() == 3
    assert df.filter(T.in_states(F.col("c"), ["Thüringen", "Atlantis"])).count() == 1
    assert df.filter(T.in_states(F.col("c"), ["Atlantis"])).count() == 0


def test_since_months_aligns_to_month_start(spark):
    df = spark.createDataFrame([(dt.date(2000, 7, 31),), (dt.date(2000, 8, 1),)], "d date")
    assert df.filter(T.since_months(F.col("d"), dt.date(2001, 8, 15), 12)).count() == 1
    assert df.filter(T.since_months(F.col("d"), dt.date(2001, 1, 31), 6)).count() == 2


@pytest.mark.parametrize("start, end, expected", [
    ("2024-01-01", "2024-01-05", ("2024-01-01", "2024-01-05")),
    ("2024-01-05", "2024-01-01", ("2024-01-05", "2024-01-05")),
    ("2024-01-05", "2024-06-01", ("2024-01-05", "2024-02-02")),
    ("2023-01-01", "2024-01-31", ("2024-01-01", "2024-01-31")),
    (None, "2024-01-01", ("2024-01-26", "2024-02-01")),
])
def test_clamped_ranges(spark, start, end, expected):
    day = lambda t: dt.date.fromisoformat(t) if t else None
    asked = spark.createDataFrame([(day(start), day(end))], "start date, end date")
    got = P.clamp_range(asked, dt.date(2024, 2, 1)).first()
    assert (got.clamped_start, got.clamped_end) == tuple(day(t) for t in expected)


def test_storage_compat_variants(spark):
    wh = spark.createDataFrame([("a", "5000", None)], "id string, NutzbareSpeicherkapazitaetInWh string, SpeicherKapazitaet string")
    got = P.storage_compat(wh)
    assert got.columns == ["id", "NutzbareSpeicherkapazitaet", "Batterietechnologie"]
    assert got.first().NutzbareSpeicherkapazitaet == 5.0
    fuzzy = spark.createDataFrame([("a", "7")], "id string, MeineSpeicherkapazitaetX string")
    assert P.storage_compat(fuzzy).first().NutzbareSpeicherkapazitaet == 7.0
    vague = spark.createDataFrame([("a", "8", "1")], "id string, NutzbareKapazitaet string, DatumKapazitaetNutzbar string")
    assert P.storage_compat(vague).first().NutzbareSpeicherkapazitaet == 8.0
    none = spark.createDataFrame([("a", "x")], "id string, Batterietechnologie string")
    assert P.storage_compat(none).first().NutzbareSpeicherkapazitaet is None


def test_battery_rules(spark):
    data = [("524", None, True), ("Lithium-Ionenspeicher", None, True), ("999", "727", True),
            ("Pumpspeicher", "727", False), ("Wasserstoff-Akku", None, False), (None, "727", True),
            (None, None, False), ("1537", None, False)]
    df = spark.createDataFrame(data, "Technologie string, Batterietechnologie string, expected boolean")
    assert df.filter(T.is_battery(df) != F.col("expected")).count() == 0
    assert df.filter(T.is_battery(df, excluded_codes=["999"])).count() == 3
    bare = df.select("Technologie")
    assert bare.filter(T.is_battery(bare)).count() == 2


def test_rescaling_of_a_single_value(spark):
    df = spark.createDataFrame([(4.0,)], "v double")
    assert P.rescale_sqrt(df, "v", "r").first().r == 14.0
    assert P.scale_idx(df, "v", "i").first().i is None


def test_scale_idx_clamps(spark):
    df = spark.createDataFrame([(-5.0,), (1.0,), (6.0,), (11.0,), (50.0,), (None,)], "v double")
    got = [r.i for r in P.scale_idx(df, "v", "i", low=1, high=11).orderBy("v").collect()]
    assert got == [None, 1, 1, 50, 100, 100]
