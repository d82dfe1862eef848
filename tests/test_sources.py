"""Payload, log and CSV edges."""

import datetime as dt

from conftest import rows
from pyspark.sql import functions as F

from gridledger.sources import access_log as G
from gridledger.sources import dimensions as D
from gridledger.sources import payloads as Y


def bodies(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, body string")


def test_prices(spark):
    df = bodies(
        spark, '{"unix_seconds":[1704067200,1704070800],"price":[10.5,null],"unit":"EUR / MWh"}',
        '{"unix_seconds":[1704067200],"price":[1.0,2.0]}', '{"unix_seconds":[],"price":[]}', "not json",
        '{"error":"no data"}', None)
    got = rows(Y.explode_prices(df, ["k"]).select("k", "ts", "hour", "price", "unit"))
    assert got == [
        (0, dt.datetime(2024, 1, 1, 1), "01:00", 10.5, "EUR / MWh"),
        (0, dt.datetime(2024, 1, 1, 2), "02:00", None, "EUR / MWh"),
        (1, dt.datetime(2024, 1, 1, 1), "01:00", 1.0, "EUR/MWh")]


def test_prices_follow_summer_time(spark):
    df = bodies(spark, '{"unix_seconds":[1711846800],"price":[1.0]}')  # 2024-03-31 01:00 UTC
    assert Y.explode_prices(df, ["k"]).first().hour == "03:00"


def test_current_readings(spark):
    df = bodies(
        spark, '{"latitude":1.0,"longitude":2.0,"current":{"shortwave_radiation":55.5,"is_day":1}}',
        ' [{"latitude":1.0,"current":{"shortwave_radiation":null,"is_day":0}},{"latitude":2.0}]',
        '{"error":true,"reason":"limit"}', "oops", None)
    got = rows(Y.explode_current(df, ["k"]))
    assert got == [(0, 0, 55.5, 1), (1, 0, None, 0), (1, 1, None, None)]


def test_hourly(spark):
    df = bodies(spark, '{"hourly":{"time":["2024-01-01T00:00","2024-01-01T01:00"],"shortwave_radiation":[0.5]}}',
                '{"hourly":{"time":[],"shortwave_radiation":[]}}', '{}')
    assert rows(Y.explode_hourly(df, ["k"])) == [(0, "00:00", 1, 0.5), (0, "01:00", 2, None)]


def test_metrics(spark):
    df = bodies(spark, '[{"metricName":"a","value":"7","attributes":[{"DESC":"Juni"},{"DESC":"x"}]},'
                       '{"metricName":"a","value":"9","attributes":[]}]', '[]', None)
    value, period = Y.pick_metric(Y.parse_metrics(F.col("body")), "a")
    assert rows(df.select("k", value, period)) == [(0, 7.0, "Juni"), (1, None, None), (2, None, None)]


def test_themes(spark):
    df = bodies(spark, '{"A b":{"count":3,"percentage":1.5,"codes":["x"]},"C":{"count":1,"percentage":0.5,"codes":[]}}')
    assert rows(Y.explode_themes(df)) == [("A b", 3, 1.5), ("C", 1, 0.5)]


LINES = [
    '1.2.3.4 - - [02/Jan/2024:03:04:05 +0100] "GET /karte/?a=1 HTTP/1.1" 200 512 "-" "Mozilla (iPad)"',
    '1.2.3.4 - - [02/Jan/2024:03:04:05] "GET / HTTP/1.1" 304 - "http://x/" "say "hi" bot"',
    '5.6.7.8 - bob [kaputt] "POST /karte HTTP/1.1" 200 1 "-" "X"',
    '5.6.7.8 - - [02/Jan/2024:03:04:05 +0000] "GET /a"b HTTP/1.1" 404 0 "-" "X"',
    "", "damaged", '5.6.7.8 - - [02/Jan/2024:03:04:05 +0000] "-" 400 0 "-" "-"',
]


def test_access_lines(spark, folder):
    with open(f"{folder}/access.log", "w", encoding="utf-8") as f:
        f.write("\n".join(LINES) + "\n")
    got = rows(G.read_access_log(spark, folder))
    assert len(got) == 4
    assert ("1.2.3.4", dt.datetime(2024, 1, 2, 2, 4, 5), "GET", "/karte/?a=1", 200, 512.0, "-", "Mozilla (iPad)") in got
    assert ("1.2.3.4", dt.datetime(2024, 1, 2, 3, 4, 5), "GET", "/", 304, None, "http://x/", 'say "hi" bot') in got
    assert ("5.6.7.8", None, "POST", "/karte", 200, 1.0, "-", "X") in got
    assert any(r[3] == '/a"b' for r in got)


def test_page_views_and_windows(spark):
    lines = spark.createDataFrame([(x,) for x in LINES], "value string")
    views = G.page_views(G.parse_access_log(lines))
    assert {(r.dashboard, r.device) for r in views.collect()} == {("karte", "Tablet"), ("hub", "Bot")}
    assert G.recent_window(views, 1).count() == 2
    assert G.recent_window(views, 1, dt.datetime(2024, 1, 3, 3)).count() == 1
    assert G.tail_events(G.parse_access_log(lines), 2, "path").count() == 2


def test_k16_no_dated_view_gives_an_empty_window(spark):
    lines = spark.createDataFrame([(LINES[2].replace("POST", "GET"),)], "value string")
    assert G.recent_window(G.page_views(G.parse_access_log(lines)), 7).count() == 0


def test_csv_dimensions(spark, folder):
    with open(f"{folder}/plz.csv", "w", encoding="utf-8") as f:
        f.write('plz,kreis\n1067,"Gotha, Stadt"\n99084,Köln\n')
    got = rows(D.read_dim(spark, f"{folder}/plz.csv", "plz string, kreis string", "plz"))
    assert got == [("01067", "Gotha, Stadt"), ("99084", "Köln")]


def test_csv_elections(spark, folder):
    with open(f"{folder}/votes.csv", "w", encoding="utf-8") as f:
        f.write("Electoral Area,Local votes,Expat votes,Candidates\nA,10,x,3\nB,5,7,\n")
    with open(f"{folder}/geo.csv", "w", encoding="utf-8") as f:
        f.write("casa,lat,lon\nA,1.5,2.5\n")
    got = rows(D.read_elections(spark, f"{folder}/votes.csv", f"{folder}/geo.csv"))
    assert got == [("A", 10, None, 3, 1.5, 2.5), ("B", 5, 7, None, None, None)]


def test_csv_orgs_need_a_position(spark, folder):
    head = ("Institutions,Latitude,Longitude,Location,Email,Website,Abschnitte,Abteilungen,Gruppen,"
            "Klassen,Unterklassen,Schlüssel\n")
    with open(f"{folder}/orgs.csv", "w", encoding="utf-8") as f:
        f.write(head + "Eins,50.1,11.0,Ort,,,Q,86,1,1,1,R86\nZwei,,11.0,Ort,,,Q,86,1,1,1,Q1\n"
                       "Drei,50.2,11.1,Ort,,,Q,86,1,1,1,\n")
    got = {(r.Institutions, r.sector) for r in D.read_orgs(spark, f"{folder}/orgs.csv").collect()}
    assert got == {("Eins", "Health & social work"), ("Drei", "Other")}
