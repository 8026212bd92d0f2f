"""The rules of the core engine on small literal tables, checked by hand and against pandas."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rostra import schema
from rostra.functions import numeric, params, text
from rostra.operators import derived, distribution, profiles, scoring, stats
from rostra.plans.facade import Facade
from rostra.sources import load

NAN = float("nan")


def fact(spark, rows):
    """Rows of iso3, leader, year, dtype, final_score and optionally anti_elitism."""
    full = []
    for r in rows:
        iso3, leader, year, dtype, score, *more = r
        ms = {d: score for d in schema.DIMS6} | {"anti_elitism": more[0] if more else score}
        full.append((*[ms[d] for d in schema.DIMS6], score, iso3, leader, year, dtype))
    names = ", ".join(f"{m} double" for m in schema.M7)
    return load.labelled(spark.createDataFrame(full, f"{names}, iso3 string, leader_name string, year int, dtype string"))


@pytest.fixture(scope="module")
def base(spark):
    rows = [
        ("ARG", "A", 2000, "SPEECH", 10.0),
        ("ARG", "A", 2001, "SPEECH", 20.0, NAN),
        ("ARG", "B", 2001, "LETTER", None),
        ("XXX", "A", 2002, "speech", 90.0),
        (None, "C", 2003, "SPEECH", 50.0),
        ("BRA", "D", None, None, 40.0),
    ]
    return fact(spark, rows).cache()


def test_null_keys_nan_and_counts(base):
    got = {r.iso3: r for r in profiles.countries(base).collect()}
    assert set(got) == {"ARG", "XXX", "BRA"}
    assert got["ARG"].n == 2 and got["ARG"].final_score == 15.0 and got["ARG"].anti_elitism == 10.0
    assert got["ARG"].country == "Argentina" and got["XXX"].country == "XXX"
    assert [r.iso3 for r in profiles.countries(base).collect()] == ["XXX", "BRA", "ARG"]


def test_type_filter_is_exact(base):
    n = lambda d: params.by_dtype(base, d).count()
    assert (n(""), n("ALL"), n("SPEECH"), n("speech"), n("none")) == (6, 6, 3, 1, 0)


def test_unknown_choices_fall_back():
    assert params.measure("x") == "final_score" and params.measure("anti_elitism") == "anti_elitism"
    assert params.group_column("x") == "dtype" and params.group_column("country") == "country"
    assert params.parts(" a, ,b ,", ",") == ["a", "b"]


def test_lists_differ_when_empty(base):
    assert profiles.yearly(base, " , ").count() == profiles.yearly(base).count() == 3
    assert profiles.leader_trend(base, " | ").count() == 0
    assert profiles.leader_trend(base, "A| B").count() == 4


def test_one_name_in_two_countries(base):
    assert profiles.leaders(base).where("leader_name = 'A'").count() == 2
    assert stats.flat(base).first().n_leaders == 4


def test_years_are_inclusive(spark):
    rows = [("ARG", "A", y, "SPEECH", 1.0) for y in (1999, 2000, 2025, 2026, None) for _ in range(5)]
    assert distribution.distribution(fact(spark, rows)).first().n == 10


def test_quartiles_gate_and_order(spark):
    rows = [("ARG", "A", 2000, "S", float(v)) for v in (1, 2, 3, 4, 10)] + [("BRA", "A", 2000, "S", float(v)) for v in (4, 4, 4, 4, 4)]
    rows += [("CHL", "A", 2000, "S", 9.0)] * 4 + [("CHL", "A", 2000, "S", None)]
    got = [tuple(r) for r in distribution.distribution(fact(spark, rows)).collect()]
    assert got == [("Argentina", 1, 2, 3, 4, 10, 4, 5), ("Brazil", 4, 4, 4, 4, 4, 4, 5)]
    assert [r.half_iqr for r in distribution.bars(fact(spark, rows)).collect()] == [1.0, 0.0]


def test_leader_ties_and_limits(spark):
    rows = [("ARG", "few", 2000, "S", 5.0)] + [("ARG", "many", 2000, "S", 5.0)] * 7 + [("ARG", "none", 2000, "S", None)]
    df = fact(spark, rows)
    assert [r.leader_name for r in profiles.leaders(df, n=99).collect()] == ["many", "few", "none"]
    assert profiles.leaders(df, n=0).count() == profiles.leaders(df, n=-1).count() == 0
    assert profiles.leaders(df, country="ARG").count() == 3 and profiles.leaders(df, country="").count() == 0


def test_rounding(spark):
    values = [0.125, 0.375, 1.005, 1.115, 2.345, 2.675, -0.001, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    want = pd.DataFrame({"x": values}).round(2)["x"].tolist()
    got = [r.x for r in numeric.round_frame(df).collect()]
    assert got[:6] == want[:6] == [0.12, 0.38, 1.0, 1.12, 2.35, 2.68]
    assert math.copysign(1, got[6]) == 1 and got[7] is None


def test_facade_rounds_as_python(spark):
    out = Facade(fact(spark, [("ARG", "A", 2000, "S", 1.115)] * 8))
    assert out.stats()["avg_score"] == 1.11 and out.countries()[0]["final_score"] == 1.12
    assert out.distribution(year_min=1990)[0]["mean"] == 1.11
    assert out.stats("none") == {"n_discourses": 0, "n_countries": 0, "n_leaders": 0, "year_min": None, "year_max": None, "avg_score": None, "top_country": {"name": None, "score": None}, "top_leader": {"name": None, "score": None}, "dim_avgs": dict.fromkeys(schema.DIMS6)}
    assert out.countries("none") == out.yearly("none", dtype="none") == out.leader_trend() == []
    out.close()


def test_stats_nested(base):
    r = stats.stats(base).first()
    assert r.n_discourses == 6 and r.n_countries == 3 and (r.year_min, r.year_max) == (2000, 2003)
    assert r.top_country.name == "XXX" and r.top_leader.score == 90.0 and r.dim_avgs["crisis_rhetoric"] == 42.0


def test_movers(spark):
    rows = [("ARG", "A", 2000, "S", 1.0), ("ARG", "A", 2001, "S", 9.0), ("ARG", "A", 2002, "S", 5.0), ("BRA", "A", 2000, "S", 3.0)]
    assert [(r.iso3, r.delta) for r in derived.movers(fact(spark, rows)).collect()] == [("BRA", 0.0), ("ARG", 4.0)]


def test_load_filters_and_validation(spark):
    d = spark.createDataFrame([(f"d{i}", "ARG", "A", 2000, t, 5) for i, t in enumerate(["SPEECH", "INVALID", None, "SPEECH"])], schema.DISCOURSES)
    s = spark.createDataFrame([(f"d{i}", *[1.0] * 6, None if i == 3 else 2.0, 1) for i in range(4)], schema.SCORES)
    s.createOrReplaceTempView("scores")
    d.createOrReplaceTempView("discourses")
    assert {"scores", "discourses"} <= load.tables(spark)
    assert load.load_scored(spark, cached=False).count() == 1
    load.load_scored(spark, cached=False).drop("n_chunks", "word_count").createOrReplaceTempView("web_data")
    assert load.load_scored(spark, cached=False).count() == 1
    spark.catalog.dropTempView("web_data")
    with pytest.raises(ValueError, match="final_score"):
        load.validated(s.drop("final_score"), schema.SCORES, "scores")


def test_source_paths(tmp_path):
    root = tmp_path / "site"
    root.mkdir()
    assert load.resolve(root) == str(tmp_path / "full")
    (root / "web").mkdir()
    assert load.resolve(root) == str(root / "web")
    assert load.resolve(root, "x/y") == str((tmp_path / "x/y").resolve()) and load.resolve(root, "/a") == "/a"


def test_export_and_json(spark, base, tmp_path):
    load.export(base, f"{tmp_path}/csv")
    back = spark.read.option("header", True).csv(f"{tmp_path}/csv")
    assert back.columns == schema.EXPORT and back.count() == 6
    assert '"dtype":"LETTER"' in "".join(r.json for r in load.json_rows(profiles.dtypes(base)).collect())


def test_color_scale(spark):
    def by_hand(s):
        s = max(0, min(100, s or 0))
        a, b = next((a, b) for a, b in zip(schema.STOPS_DARK, schema.STOPS_DARK[1:]) if a[0] <= s <= b[0])
        return "rgb(%d,%d,%d)" % tuple(math.floor(a[k] + (s - a[0]) / (b[0] - a[0]) * (b[k] - a[k]) + 0.5) for k in (1, 2, 3))

    values = [None, -5.0, 0.0, 11.0, 22.0, 22.1, 50.0, 71.9, 72.0, 99.0, 100.0, 140.0]
    rows = spark.createDataFrame([(v,) for v in values], "s double").select("s", numeric.score_rgb(F.col("s")).alias("c"), numeric.score_band(F.col("s")).alias("b")).collect()
    assert [r.c for r in rows] == [by_hand(v) for v in values]
    assert [r.b for r in rows][:1] + [r.b for r in rows][3:7] == [None, "Low", "Low", "Low", "High"]
    light = spark.createDataFrame([(0.0,)], "s double").select(numeric.score_rgb(F.col("s"), schema.STOPS_LIGHT)).first()[0]
    assert light == "rgb(243,234,217)"


def test_labels_and_places(spark, base):
    points = derived.map_points(profiles.countries(base)).collect()
    assert {p.iso3 for p in points} == {"ARG", "BRA"}
    one = derived.long_form(profiles.yearly_global(base), ["year"])
    assert {r.label for r in derived.labelled_dimensions(one, "xx").collect()} >= {"Crisis Rhetoric"}
    n = spark.createDataFrame([(999,), (12345,)], "n long").select(numeric.short_count(F.col("n"))).collect()
    assert [r[0] for r in n] == ["999", "12.3k"]


def test_random_profiles_match_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({m: np.where(rng.random(400) < 0.1, np.nan, rng.random(400) * 100) for m in schema.M7})
    pdf["iso3"] = rng.choice(["ARG", "BRA", "CHL", None], 400)
    pdf["leader_name"] = rng.choice(list("abcdef"), 400)
    pdf["year"] = rng.integers(1998, 2004, 400).astype("int32")
    pdf["dtype"] = rng.choice(["S", "L"], 400)
    df = load.labelled(spark.createDataFrame(pdf))
    pdf["country"] = pdf["iso3"].map(schema.COUNTRY_NAMES).fillna(pdf["iso3"])
    want = pdf.groupby(["iso3", "country"]).agg(n=("final_score", "count"), **{m: (m, "mean") for m in schema.M7}).reset_index().sort_values("final_score", ascending=False).round(2)
    got = profiles.countries(df).toPandas()
    pd.testing.assert_frame_equal(got, want[got.columns].reset_index(drop=True), check_dtype=False)
    groups = pdf[pdf["year"].between(2000, 2025)].groupby("country")["anti_elitism"]
    for r in distribution.distribution(df, "anti_elitism").collect():
        s = groups.get_group(r.group).dropna()
        assert (r.q1, r.median, r.q3, r.n) == (round(s.quantile(0.25), 2), round(s.median(), 2), round(s.quantile(0.75), 2), len(s))


def test_plans(spark, tmp_path):
    spark.range(1000).selectExpr("id", "cast(id % 7 as string) as dtype", "cast(id as double) as final_score", "id as unused").write.parquet(f"{tmp_path}/t")
    df = params.by_dtype(spark.read.parquet(f"{tmp_path}/t"), "3").groupBy("dtype").agg(F.avg("final_score").alias("final_score")).orderBy(F.desc("final_score")).limit(3)
    plan = df._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(dtype), EqualTo(dtype,3)]" in plan and "TakeOrderedAndProject" in plan and "unused" not in plan.split("ReadSchema")[1]


def test_text_pipeline(spark):
    docs = spark.createDataFrame([(1, "a b  c\nd e"), (2, " "), (3, None), (4, "one")], "doc_id long, text string")
    assert [r.n for r in docs.select(text.word_count("text").alias("n")).collect()] == [5, 0, 0, 1]
    rows = scoring.chunked(docs, 2)
    assert sorted((r.doc_id, r.chunk, r.text) for r in rows.collect()) == [(1, 0, "a b"), (1, 1, "c d"), (1, 2, "e"), (4, 0, "one")]
    out = {r.doc_id: r for r in scoring.combined(scoring.scored_chunks(rows, scoring.marker_scorer), {"anti_elitism": 3.0, "crisis_rhetoric": 1.0}).collect()}
    assert out[1].n_chunks == 3 and out[1].anti_elitism == pytest.approx(50 / 3) and out[1].final_score == pytest.approx((3 * 50 / 3 + 50 / 3) / 4)
    assert scoring.classified(docs, F.lit("SPEECH")).first().dtype == "SPEECH"


def test_spreadsheet(spark, tmp_path):
    import zipfile
    from xml.etree import ElementTree

    rows = spark.createDataFrame([("a<b>&", "BRA", 2001, 1.5, NAN), ("é\x01", None, None, -2.25, 3.0)], "discourse_id string, iso3 string, year int, final_score double, crisis_rhetoric double")
    load.export(rows, str(tmp_path / "s.xlsx"), "xlsx")
    with zipfile.ZipFile(tmp_path / "s.xlsx") as z:
        assert all(ElementTree.fromstring(z.read(n)) is not None for n in z.namelist())
        sheet = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml"))
    lines = [["".join(c.itertext()) for c in row] for row in sheet[0]]
    at = {c: i for i, c in enumerate(schema.EXPORT)}
    assert lines[0] == schema.EXPORT and len(lines) == 3
    assert sorted((x[at["discourse_id"]], x[at["iso3"]], x[at["year"]], x[at["final_score"]], x[at["crisis_rhetoric"]]) for x in lines[1:]) == [("a<b>&", "BRA", "2001", "1.5", ""), ("é", "", "", "-2.25", "3.0")]


def test_selections():
    assert params.toggled(["a", "b"], "a") == ["b"] and params.toggled(["a"], "a") == ["a"] and params.toggled(["a"], "b") == ["a", "b"]
    seven = list("abcdefg")
    assert params.toggled(seven, "h", 1, 7) == seven and params.toggled(seven, "g", 1, 7) == seven[:-1]
    assert params.selection(seven, 1, 7) == seven
    for bad in ([], [*seven, "h"]):
        with pytest.raises(ValueError):
            params.selection(bad, 1, 7)


def test_number_and_colour_forms(spark):
    rows = spark.createDataFrame([(1234567, 1.25, "#F87171"), (7, -0.04, "rgb(1,2,3)"), (999, 0.0, "0a0B0c")], "n long, x double, c string")
    out = rows.select(numeric.thousands(F.col("n")), numeric.signed(F.col("x"), 2), numeric.sign_color(F.col("x")), numeric.rgba(F.col("c"), 0.5)).collect()
    assert [tuple(r) for r in out] == [("1.234.567", "+1.25", "#F87171", "rgba(248,113,113,0.5)"), ("7", "-0.04", "#4ADE80", "rgba(1,2,3,0.5)"), ("999", "+0.00", "#F87171", "rgba(10,11,12,0.5)")]
