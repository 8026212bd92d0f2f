import numpy as np
import pytest
from pyspark.sql import functions as F

from rostra.llm import toxicity as T


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(2)
    words = "river stone quiet morning over under light paper winter garden table window".split()
    rows, labels = [], []
    for i in range(600):
        t = list(rng.choice(words, 40))
        bad = i % 6 == 0
        if bad:
            t[int(rng.integers(40))] = rng.choice(["blockhead", "nitwit,", "NITWIT!", "blockheads"])
        rows.append((i, " ".join(t), "en", 1.0))
        labels.append((i, 1, int(bad)))
    rows += [(1000, None, None, 1.0), (1001, "", None, 1.0), (5, rows[5][1], "en", 1.0), (1002, "nitwit " * 40_000, "en", 1.0), (None, "blockhead", "en", 0.0)]
    labels += [(None, 1, 1), (7, 1, None), (8, None, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(tables):
    docs, labels = tables
    out = T.toxicity(docs, labels, ~T.held_out()).withColumn("held_out", T.held_out()).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    asked = [r for r in out if r.held_out and r.doc_id < 600]
    assert len(asked) > 150 and sum(r.predicted == (r.doc_id % 6 == 0) for r in asked) >= 0.98 * len(asked)
    by = {r.doc_id: r.score for r in out}
    assert by[1000] == by[1001] and by[1002] > 0.9 and by[None] > 0.7


def test_labels_held_out_change_nothing(tables):
    docs, labels = tables
    flipped = labels.withColumn("toxic", F.when(T.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (T.fit(docs, x, ~T.held_out()) for x in (labels, flipped))
    assert (a.weights == b.weights).all() and a.bias == b.bias


def test_ratios_by_brute_force():
    texts, y = ["bad bad thing", "good thing", "bad", "good good"] * 20, np.array([1, 0, 1, 0] * 20)
    h, c = T.present("bad bad")
    plain = " bad bad "
    grams = {plain[i : i + n] for n in T.ORDERS for i in range(len(plain) - n + 1)}
    assert len(h) == len(grams) and c.max() == max(sum(plain[i : i + len(g)] == g for i in range(len(plain))) for g in grams)
    model = T.train(texts, y)
    assert model.score("bad") > 0.8 > 0.2 > model.score("good")


def test_one_class_and_nothing(tables):
    docs, labels = tables
    assert {round(r.score, 6) for r in T.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert {round(r.score, 3) for r in T.toxicity(docs, labels.where("toxic = 1")).collect()} == {1.0}
    assert T.toxicity(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("window", [1, 3, 7, 64])
def test_windows_hold_each_n_gram_once(monkeypatch, window):
    text = "Some  words, a fool!  And   MORE... words 123 ÄÖ 日本 " * 3
    want = T.present(text)
    monkeypatch.setattr(T, "WINDOW", window)
    got = T.present(text)
    assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


def test_executors_learn_what_a_local_run_does(spark, tables):
    """Ratios, features and weights of the distributed fit against those of the same texts at hand, and ratios by definition."""
    docs, labels = tables
    rows = docs.join(labels.withColumnRenamed("doc_id", "i"), F.col("doc_id") == F.col("i")).where("toxic is not null").select("doc_id", "text", "toxic").distinct().collect()
    local = T.train([r.text for r in rows], np.array([r.toxic for r in rows]))
    model = T.fit(docs, labels)
    assert set(np.flatnonzero(model.used)) == set(np.flatnonzero(local.used))
    assert model.weights == pytest.approx(local.weights, abs=2e-3) and model.bias == pytest.approx(local.bias, abs=2e-3)  # rows are summed in another order
    count = np.zeros((2, 1 << T.BITS))
    for r in rows:
        for b in {int(x) for part in T.hashed(r.text) for x in part}:
            count[r.toxic, b] += 1
    n1 = sum(r.toxic for r in rows)
    kept, ratios = T.chosen(count, len(rows) - n1, n1, 50, 0.5)
    for b, ratio in zip(kept, ratios, strict=True):
        assert ratio == pytest.approx(np.log((count[1, b] + 0.5) / (n1 + 1) / ((count[0, b] + 0.5) / (len(rows) - n1 + 1))))


def test_more_rows_than_the_bound(tables):
    docs, labels = tables
    assert T.fit(docs, labels, max_rows=100).used.any()


def test_each_function_is_defined_once():
    import ast
    import collections
    import pathlib

    import rostra.llm

    for path in pathlib.Path(rostra.llm.__path__[0]).glob("*.py"):
        names = collections.Counter(n.name for n in ast.parse(path.read_text()).body if isinstance(n, ast.FunctionDef | ast.ClassDef))
        assert max(names.values(), default=1) == 1, path
