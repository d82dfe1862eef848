"""Aggregations, windows, rankings and joins against brute force on small tables."""

import datetime as dt
import math
import random
import statistics

import pytest
from conftest import SF_DIR, rows
from pyspark.sql import functions as F

from gridledger.operators import aggregates as A
from gridledger.operators import citations as C
from gridledger.operators import joins as J
from gridledger.operators import projection as P
from gridledger.operators import ranking as L
from gridledger.operators import sets as S
from gridledger.operators import title_join
from gridledger.operators import windows as W
from gridledger.plans.overview import plz_map
from gridledger.plans.traffic import visitor_profile


def interpolated(values, q):
    """Linear interpolation between closest ranks (type 7)."""
    ordered = sorted(values)
    pos = (len(ordered) - 1) * q
    low, high = ordered[math.floor(pos)], ordered[math.ceil(pos)]
    return low + (high - low) * (pos - math.floor(pos))


def test_k18_quantiles_interpolate(spark):
    random.seed(3)
    data = [(random.choice("ab"), random.randint(-50, 50)) for _ in range(501)]
    got = A.day_quantiles(spark.createDataFrame(data, "k string, d int"), "k", "d").collect()
    for r in got:
        values = [d for k, d in data if k == r.k]
        assert (r.n, r.median, r.p25, r.p75) == (
            len(values), interpolated(values, .5), interpolated(values, .25), interpolated(values, .75))


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.999, 1.0])
def test_exact_quantile_narrows_to_the_exact_value(spark, q):
    random.seed(5)
    values = [random.gauss(0, 100) for _ in range(30_000)] + [7.5] * 15_000  # a third is one value
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(4)
    got = A.exact_quantile(df, "v", q).first()
    assert got.n == 45_000 and got.value == pytest.approx(interpolated(values, q), abs=1e-9)


def test_exact_quantile_between_two_values_of_a_small_column(spark):
    values = [float(i) for i in range(1203)]
    got = A.exact_quantile(spark.createDataFrame([(v,) for v in values], "v double"), "v", 0.25).first()
    assert got.value == interpolated(values, 0.25)


def test_exact_quantile_of_nothing_and_of_one(spark):
    none = A.exact_quantile(spark.createDataFrame([(None,)], "v double"), "v", 0.5).first()
    assert (none.n, none.value) == (0, None)
    assert A.exact_quantile(spark.createDataFrame([(3.0,)], "v double"), "v", 0.5).first().value == 3.0


@pytest.mark.parametrize("limits", [{}, {"broadcast_groups": 2, "final_rows": 50, "bins": 8}])
def test_group_quantiles_of_hot_and_small_groups(spark, limits):
    random.seed(6)
    groups = {"hot": [random.gauss(0, 1e6) for _ in range(12_000)], "same": [7.5] * 9_000, "one": [3.0],
              "two": [-1.0, 4.0], None: [random.random() for _ in range(5_000)],
              "ends": [-math.inf] * 300 + [1.0 + i / 1024 for i in range(900)] + [math.inf] * 3}
    data = [(k, v) for k, values in groups.items() for v in values] + [("hot", None), ("hot", math.nan), ("none", None)]
    random.shuffle(data)
    marks = {"low": 0.0, "p25": 0.25, "median": 0.5, "p75": 0.75}
    df = spark.createDataFrame(data, "k string, v double").repartition(4)
    got = {r.k: r for r in A.group_quantiles(df, "k", "v", marks, **limits).collect()}
    assert set(got) == set(groups)
    for k, values in groups.items():
        assert got[k].n == len(values)
        for mark, q in marks.items():
            if k != "ends" or mark != "low":
                assert got[k][mark] == pytest.approx(interpolated(values, q), abs=1e-9), (k, mark)


def test_group_quantiles_of_no_rows(spark):
    none = A.group_quantiles(spark.createDataFrame([("a", None)], "k string, v double"), "k", "v", {"median": 0.5})
    assert none.columns == ["k", "n", "median"] and none.count() == 0


def test_k20_mode_ties_are_alphabetical(spark):
    data = [("u1", "Phone"), ("u1", "Desktop"), ("u2", "Tablet"), ("u2", "Tablet"), ("u2", "Bot"),
            ("u3", None), ("u3", "Phone"), ("u3", None)]
    df = spark.createDataFrame(data, "ip string, device string")
    assert dict(rows(A.mode_per_group(df, ["ip"], "device", "d"))) == {"u1": "Desktop", "u2": "Tablet", "u3": "Phone"}
    views = df.filter("device IS NOT NULL").withColumn("time", F.lit("t"))
    assert {(r.ip, r.hits, r.device) for r in visitor_profile(views).collect()} == {
        ("u1", 2, "Desktop"), ("u2", 3, "Tablet"), ("u3", 1, "Phone")}


def test_k10_deltas_belong_to_their_period(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 1), 10), (dt.date(2020, 4, 1), 15), (dt.date(2020, 7, 1), 0),
                                (dt.date(2020, 10, 1), 5)], "q date, n int")
    got = W.period_delta(df, "q", ["n"]).orderBy("q").collect()
    assert [r.n_delta for r in got] == [None, 5, -15, 5]
    assert [r.n_delta_pct for r in got] == [None, 0.5, -1.0, None]


def test_k11_watts_per_head(spark):
    states = spark.createDataFrame([("Bayern", 13450.0), ("Atlantis", 1.0)], "bundesland_name string, mw double")
    people = spark.createDataFrame([("Bayern", 13.45)], "bundesland_name string, einwohner_mio double")
    got = dict((r.bundesland_name, r.watt_per_capita) for r in J.per_capita(states, people).collect())
    assert got == {"Bayern": pytest.approx(1000.0), "Atlantis": None}


def test_k17_ties_share_a_running_total(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 2.0), ("a", 2, 4.0), ("b", 1, 8.0)], "k string, m int, v double")
    got = rows(W.cumulative(df, ["k"], "m", "v", "c").select("k", "v", "c"))
    assert got == [("a", 1.0, 3.0), ("a", 2.0, 3.0), ("a", 4.0, 7.0), ("b", 8.0, 8.0)]


def test_yoy_fills_gaps(spark):
    df = spark.createDataFrame([(2020, 1, 10.0), (2021, 1, 15.0), (2021, 2, 4.0)], "y int, m int, v double")
    got = {(r.y, r.m): (r.v, r.vs_prev_year) for r in W.yoy_month(df, [2020, 2021], [1, 2], "y", "m", "v").collect()}
    assert got == {(2020, 1): (10.0, None), (2020, 2): (0.0, None), (2021, 1): (15.0, 0.5), (2021, 2): (4.0, None)}


def test_prior_month_must_be_adjacent(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 1), 10), (dt.date(2020, 2, 1), 15), (dt.date(2020, 4, 1), 5)], "m date, n int")
    got = [r.n_prior for r in W.vs_prior_month(df, "m", ["n"]).orderBy("m").collect()]
    assert got == [None, 10, None]


def test_shares_sum_to_one(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "k string, n int")
    assert sum(r.p for r in W.pct_of_total(df, "n", "p").collect()) == pytest.approx(1.0)
    by_period = W.pct_in_period(df, "k", "n", "p").groupBy("k").agg(F.sum("p").alias("p")).collect()
    assert all(r.p == pytest.approx(100.0) for r in by_period)
    zero = spark.createDataFrame([("a", 0)], "k string, n int")
    assert W.pct_of_total(zero, "n", "p").first().p is None


def test_ranks(spark):
    df = spark.createDataFrame([("x", 2.0), ("y", 3.0), ("z", 2.0), ("n", None)], "k string, v double")
    assert {(r.k, r["rank"]) for r in W.rank_by(df, "v", "k").collect()} == {("y", 1), ("x", 2), ("z", 3)}
    assert W.rank_of(df, "v", "k", "n").count() == 0


def test_latest_per_key_keeps_one_row(spark):
    df = spark.createDataFrame([("a", 1, "old"), ("a", 2, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, t int, v string")
    assert rows(W.latest_per_key(df, ["k"], "t")) == [("a", 2, "y"), ("b", 1, "z")]


@pytest.mark.parametrize("n, max_n", [(0, 3), (1, 5), (10, 10), (11, 10), (1000, 7), (997, 100)])
def test_every_kth_is_exact(spark, n, max_n):
    df = spark.range(n).select(F.col("id").cast("int").alias("i"), (F.col("id") % 3).alias("hot")).repartition(5)
    step = max(1, math.ceil(n / max_n))
    got = sorted(r.i for r in P.every_kth(df, max_n, ["i"]).collect())
    assert got == list(range(0, n, step)) and len(got) <= max_n


def test_every_kth_with_a_hot_leading_key(spark):
    data = [(0 if i % 3 else i, i) for i in range(600)]
    df = spark.createDataFrame(data, "k int, i int").repartition(6)
    got = [(r.k, r.i) for r in P.every_kth(df, 50, ["k", "i"]).orderBy("k", "i").collect()]
    assert got == sorted(data)[::12]


def test_sample_does_not_depend_on_partitions(spark):
    df = spark.range(500)
    a = rows(P.sample_n(df.repartition(2), 40, 7, "id"))
    assert a == rows(P.sample_n(df.repartition(9), 40, 7, "id")) and len(a) == 40
    assert a != rows(P.sample_n(df, 40, 8, "id"))


def test_merge_branches(spark):
    a = spark.createDataFrame([("x", 1, 2.0), ("y", 3, 4.0)], "k string, units long, mw double")
    b = spark.createDataFrame([("y", 5, 6.0)], "k string, units long, mw double")
    base = spark.createDataFrame([("z",)], "k string")
    got = J.merge_branches({"s": a, "w": b}, "k", ["units", "mw"], base)
    assert rows(got.select("k", "s_units", "w_units", "total_units", "total_mw")) == [
        ("x", 1, 0, 1, 2.0), ("y", 3, 5, 8, 10.0), ("z", 0, 0, 0, 0.0)]


def test_districts_guard_density(spark):
    plz = spark.createDataFrame([("00001", 2, 1.0), ("00002", 4, 3.0), ("99999", 9, 9.0)], "plz string, units long, mw double")
    where = spark.createDataFrame([("00001", "A"), ("00002", "B")], "plz string, kreis string")
    meta = spark.createDataFrame([("A", 1000), ("B", 0)], "kreis string, einwohner int")
    got = {r.kreis: r.per_1000 for r in J.to_district(plz, where, meta).collect()}
    assert got == {"A": 2.0, "B": None}


def test_grouping_sets_tell_null_from_total(spark):
    df = spark.createDataFrame([("a", None), ("a", "x"), (None, "x")], "p string, q string")
    got = A.grouping_sets(df, [["p", "q"], ["p"]], {"n": F.lit(1)})
    assert rows(got.filter("level = 1").select("p", "n")) == [("a", 2), (None, 1)]
    totals = A.with_grand_total(df, ["p"], "q", {"n": F.lit(1)})
    assert {(r.p, r.q, r.n) for r in totals.collect()} == {
        ("a", None, 1), ("a", "x", 1), (None, "x", 1), ("a", "Grand Total", 2), (None, "Grand Total", 1)}


def test_pivot_total_equals_long_total(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 3.0), ("b", 1, 4.0)], "r string, c int, v double")
    wide = A.pivot_sum(df, ["r"], "c", [1, 2], "v", ["c1", "c2"])
    assert rows(wide) == [("a", 2.0, 3.0), ("b", 4.0, 0)]
    long = A.unpivot_measures(wide, ["r"], {"c1": "eins", "c2": "zwei"}, "name", "v")
    assert long.agg(F.sum("v")).first()[0] == 9.0


def test_pivots_lose_no_value(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 3, 3.0), ("b", None, 4.0)], "r string, c int, v double")
    assert rows(A.pivot_sum(df, ["r"], "c", [1], "v", other="rest")) == [("a", 2.0, 3.0), ("b", 0, 4.0)]
    with pytest.raises(Exception, match="no column for"):
        A.pivot_sum(df, ["r"], "c", [1, 3], "v").collect()
    assert rows(A.crosstab(df, "r", "c", [1])) == [("a", 1, 1), ("b", 0, 1)]


def test_map_cells_beyond_the_published_cut(spark):
    """More cells than the published table holds: the map filters all of them."""
    units = spark.range(6000).select(
        F.format_string("%06d", "id").alias("plz"), F.lit("Wind").alias("energietraeger"), F.lit(1.0).alias("lat"),
        F.lit(1.0).alias("lon"), (F.col("id") + 20_000).cast("double").alias("bruttoleistung_kw"))

    class Given:
        pass

    given = Given()
    given.units = units
    assert plz_map(given, carriers=("Wind",)).count() == 6000


def test_dominant_and_distinct(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), ("c",)], "k string")
    got = A.dominant(df, "k").first()
    assert got.k == "a" and got.share_pct == pytest.approx(40.0)
    assert df.agg(A.n_distinct(F.col("k"))).first()[0] == 3
    assert df.agg(A.n_distinct(F.col("k"), count_null=True)).first()[0] == 4


def test_extremes_and_means(spark):
    df = spark.createDataFrame([("b", 2.0), ("a", 2.0), ("c", -1.0), ("d", None)], "k string, v double")
    assert tuple(A.extremes(df, "v", "k").first()) == (2.0, "a", -1.0, "c")
    assert df.agg(A.mean_positive(F.col("v"))).first()[0] == 2.0
    assert df.agg(A.mean_ratio(F.col("v"), F.col("v"))).first()[0] == 1.0
    assert df.select(A.ratio(F.lit(1), F.lit(0)).alias("r")).first().r is None
    assert df.select(A.guarded_ratio(F.lit(1), F.lit(-1)).alias("r")).first().r is None


def test_histograms(spark):
    df = spark.createDataFrame([(0.0,), (9.9,), (10.0,), (25.0,), (45.0,), (None,)], "v double")
    assert rows(A.histogram(df, "v", 10, 30)) == [(0.0, 2), (10.0, 1), (20.0, 1), (40.0, 1)]
    assert rows(A.log_histogram(df, "v", 1)) == [(0, 1), (1, 3)]


def test_linear_fit(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 5.0), (3.0, 7.0)], "x double, y double")
    got = A.linear_fit(df, "x", "y").first()
    assert (got.slope, got.intercept, got.n) == (pytest.approx(2.0), pytest.approx(1.0), 3)


def test_top_k_puts_missing_last(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0), ("c", 1.0), ("d", 5.0)], "k string, v double")
    assert [r.k for r in L.top_k(df, "v", 3, ["k"]).collect()] == ["d", "b", "c"]
    assert [r.k for r in L.top_k(df, "v", 9, ["k"]).collect()][-1] == "a"
    kept = J.only_top_keys(df.union(df), "k", "v", 1)
    assert rows(kept) == [("d", 5.0), ("d", 5.0)]


def test_label_order(spark):
    df = spark.createDataFrame([("x",), ("b",), ("a",)], "k string")
    assert [r.k for r in L.order_by_label(df, "k", ["b", "a"], "k").collect()] == ["b", "a", "x"]


def test_sets(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert rows(S.all_keys([a, b], "k")) == [(1,), (2,), (3,)]
    assert rows(S.known_keys(a, b, "k")) == [(2,)]
    assert rows(S.only_in(a, b, ["k"])) == [(1,)]
    assert S.union_sources([None, None], b, "k") is None
    assert S.union_sources([a, None, b], b.withColumn("d", F.lit("x")), "k").count() == 5


def test_district_names(spark):
    df = spark.createDataFrame([("Landkreis Gotha",), ("Eisenach, Stadt",), ("Weimar, Stadt",)], "kreis string")
    got = {r.kreis: (r.api_name, r.ba_note is None) for r in J.norm_district(df, "kreis").collect()}
    assert got == {"Landkreis Gotha": ("Gotha", True), "Eisenach, Stadt": (None, False),
                   "Weimar, Stadt": ("Weimar, Stadt", True)}


def test_labour_ratios_are_guarded(spark):
    df = spark.createDataFrame([(5.0, 100.0), (5.0, 0.0), (None, 100.0), (5.0, None)], "j double, e double")
    ratios = J.labour_ratios(F.col("j"), F.col("e"))
    assert [r[0] for r in df.select(ratios["quote_vakanz_pct"]).collect()] == [5.0, None, None, None]


def test_citation_parsing(spark):
    texts = [
        "Muster, A. & Beispiel, B. (2019a, May). A title here. Journal, 3(1). https://doi.org/10.1234/abc.5",
        "Reuters (2020). Grid news. Press release https://www.reuters.com/x",
        "no structure at all",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, citation string")
    a, b, c = C.parse_citations(df).orderBy("id").collect()
    assert (a.year, a.title, a.doi, a.last_name, a.is_web) == (2019, "A title here", "10.1234/abc.5", "Muster", False)
    assert (b.year, b.title, b.doi, b.is_web) == (2020, "Grid news", None, True)
    assert (c.year, c.title, c.doi) == (None, None, None)


def test_citation_of_group_author_and_doi_with_brackets(spark):
    texts = [
        "Bundesnetzagentur (BNetzA) (2019). Monitoring of grids. doi:10.1016/S0140-6736(05)61787-6.",
        "Federal Agency (FA) (n.d.). Some title. See (10.1234/x.y).",
        "Lone, A. (in press, 2020). Other title.",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, citation string")
    a, b, c = C.parse_citations(df).orderBy("id").collect()
    assert (a.year, a.title, a.doi, a.last_name) == (2019, "Monitoring of grids", "10.1016/S0140-6736(05)61787-6", "Bundesnetzagentur")
    assert (b.year, b.title, b.doi, b.last_name) == (None, "Some title", "10.1234/x.y", "Agency")
    assert (c.year, c.title, c.last_name) == (None, "Other title", "Lone")


def test_citation_links_are_scholar_searches(spark):
    kind = "id int, title string, year int, last_name string, doi string, is_web boolean, score double, source string, match_doi string"
    rows_ = [(0, "t", 2000, "X", "10.1/x(1)", False, None, None, None), (1, "t", 2000, "X", None, False, 0.9, "s", "10.1/y"),
             (2, "Grid & study", None, "Müller", None, False, 0.5, None, None)]
    links = [r.link for r in C.link_reliability(spark.createDataFrame(rows_, kind)).orderBy("id").collect()]
    scholar = "https://scholar.google.com/scholar?q="
    assert links == [f"{scholar}doi:10.1/x(1)", f"{scholar}doi:10.1/y", f"{scholar}%22Grid+%26+study%22+M%C3%BCller"]


def random_titles(seed, n):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    return [(i, " ".join(["the"] * (i % 3 > 0) + [draw.choice(words[: draw.choice([4, 40])]) for _ in range(draw.randrange(9))]) + "!")
            for i in range(n)]


@pytest.mark.parametrize("least", [0.5, 0.65, 1.0])
def test_similar_titles_equal_all_pairs(spark, monkeypatch, least):
    monkeypatch.setattr(title_join, "BLOCK_TITLES", 7)
    monkeypatch.setattr(title_join, "FREQUENT_SHARE", 0.05)
    left, right = random_titles(1, 80), [*random_titles(1, 40), *((i + 40, t) for i, t in random_titles(2, 80)), (999, None)]
    found = title_join.similar_titles(spark.createDataFrame(left, "a int, title string"), spark.createDataFrame(right, "b int, title string"),
                                      "a", "b", "title", least)
    sets = lambda rows_: [(i, set((t or "").rstrip("!").split())) for i, t in rows_]
    want = sorted((i, k) for i, x in sets(left) for k, y in sets(right) if x and y and 2 * len(x & y) / (len(x) + len(y)) >= least - 1e-9)
    assert sorted((r.a, r.b) for r in found.collect()) == want and want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("rare, run_words", [(2, 6), (2, 2), (12, 3)])
def test_titles_meet_on_runs_of_frequent_words(spark, monkeypatch, rare, run_words):
    monkeypatch.setattr(title_join, "RARE_TITLES", rare)
    monkeypatch.setattr(title_join, "RUN_WORDS", run_words)
    monkeypatch.setattr(title_join, "BLOCK_TITLES", 5)
    monkeypatch.setattr(title_join, "FREQUENT_SHARE", 0.1)
    left, right = random_titles(3, 120), random_titles(4, 150)
    found = title_join.similar_titles(spark.createDataFrame(left, "a int, title string"), spark.createDataFrame(right, "b int, title string"),
                                      "a", "b", "title", 0.65)
    sets = lambda rows_: [(i, set(t.rstrip("!").split())) for i, t in rows_]
    want = sorted((i, k) for i, x in sets(left) for k, y in sets(right) if x and y and 2 * len(x & y) / (len(x) + len(y)) >= 0.65 - 1e-9)
    assert sorted((r.a, r.b) for r in found.collect()) == want and want


def test_titles_of_frequent_words_do_not_all_meet(spark):
    """Every word is in about a twentieth of the titles: by one word of three each, 450 others would meet a title."""
    draw = random.Random(5)
    titles = spark.createDataFrame([(i, " ".join(f"{place}{draw.randrange(20)}" for place in "pqrstuvw")) for i in range(3000)], "a int, title string")
    sides = titles, titles.withColumnRenamed("a", "b"), "a", "b", "title", 0.65
    assert title_join.meeting_titles(*sides).count() < 30 * 3000
    assert title_join.similar_titles(*sides).filter("a = b").count() == 3000


def test_candidates_prefer_the_author_then_shared_words(spark):
    refs = C.parse_citations(spark.createDataFrame([(1, "Muster, A. (2001). Alpha beta gamma delta. J."), (2, "no title")], "id int, citation string"))
    works = [(f"w{i}", "crossref", "B. Other", "alpha beta gamma delta", 2001, f"10.1/{i}") for i in range(7)]
    works += [("x", "crossref", "A. Muster", "alpha beta gamma epsilon", 2001, "10.1/x"), ("y", "openalex", None, "something else", 2001, None)]
    found = C.find_candidates(refs, spark.createDataFrame(works, "work_id string, source string, author string, title string, year int, doi string"), "id")
    assert sorted(r.doi for r in found.collect()) == ["10.1/0", "10.1/1", "10.1/2", "10.1/3", "10.1/x"]


def test_matching_blocks(spark):
    pairs = [("grid study", "grid study"), ("abxcd", "abcd"), ("a", None), ("", "")]
    got = [r.s for r in spark.createDataFrame(pairs, "a string, b string").coalesce(1).select(
        title_join.matching_blocks(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got == [1.0, pytest.approx(8 / 9), None, None]


def test_citation_without_title_is_not_matched(spark):
    refs = spark.createDataFrame([(1, None, 2000, "X", None, False)], "id int, title string, year int, last_name string, doi string, is_web boolean")
    cands = spark.createDataFrame([(1, "openalex", "anything", 2000, "10.1/x")],
                                  "id int, source string, title string, year int, doi string")
    got = C.link_reliability(C.match_citations(refs, cands, "id")).first()
    assert got.score is None and got.method == "search" and got.accuracy == 42


def test_citation_pick_does_not_depend_on_row_order(spark):
    refs = spark.createDataFrame([(1, "grid study", 2000, None, False)], "id int, title string, year int, doi string, is_web boolean")
    found = [(1, "crossref", "grid study", 2000, f"10.1/{x}") for x in "abcde"] + [(1, "crossref", "grid study", 2000, None)]
    kind = "id int, source string, title string, year int, doi string"
    picks = {C.match_citations(refs, spark.createDataFrame(rows, kind).coalesce(1), "id").first().match_doi
             for rows in (found, found[::-1], found[2:] + found[:2])}
    assert picks == {"10.1/e"}


def test_unconfirmed_doi_is_rated_lower(spark):
    kind = "id int, title string, year int, last_name string, doi string, is_web boolean, score double, source string, match_doi string"
    rows_ = [(1, "t", 2000, "X", "10.1/x", False, s, None, None) for s in (None, 0.84, 0.85, 0.95)]
    got = [r.accuracy for r in C.link_reliability(spark.createDataFrame(rows_, kind).coalesce(1)).collect()]
    assert got == [80, 80, 92, 98]


def test_invariants_on_the_register(spark):
    """Buckets add up to totals, the last running total is the total, the union is its branches."""
    from gridledger.plans import commissioning, overview
    from gridledger.plans.register import Register

    r = Register(spark, SF_DIR)
    assert r.units.count() == sum(df.count() for df in r.unit_tables.values())
    matrix = commissioning.bucket_matrix_gross(r).collect()
    assert sum(x.units for x in matrix) == matrix[0].units_total
    assert sum(x.mw_share for x in matrix) == pytest.approx(1.0)
    trend = overview.cumulative_buildout(r).collect()
    for carrier in {x.energietraeger for x in trend}:
        own = sorted((x for x in trend if x.energietraeger == carrier), key=lambda x: x.month)
        assert own[-1].cum_mw == pytest.approx(math.fsum(x.new_capacity_mw or 0 for x in own))
    wide = commissioning.size_mix_units(r).collect()
    long = commissioning.size_mix_share(r).collect()
    assert sum(sum(x[1:]) for x in wide) == sum(x.units for x in long)
    assert statistics.fmean(x.share_pct for x in long) > 0
