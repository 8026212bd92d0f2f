import numpy as np
import pytest

from rostra.llm import hnsw as H


def brute(rows, k):
    """Per query its candidates in order, from all usable rows."""
    ok = {}
    for i, v in rows:
        if i is None or v is None or not v or any(c is None or not np.isfinite(c) for c in v) or not any(v):
            continue
        ok[i] = min(ok.get(i, v), v)
    out = {}
    for i, q in ok.items():
        if i % 20 == 0:
            near = sorted((-sum(np.array(q) * np.array(v)), j) for j, v in ok.items() if j != i and len(v) == len(q))
            out[i] = [(j, -s) for s, j in near[:k]]
    return out


def checked(spark, rows, exact):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    rows = [(i, [None if c is None else float(np.float32(c)) for c in v] if v is not None else None) for i, v in rows]
    got = {}
    for r in H.search_all(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows, 20)
    assert set(got) == {i for i, x in want.items() if x}
    hits = total = 0
    vectors = {i: v for i, v in rows if v}
    for i, x in got.items():
        x.sort()
        assert [r for r, _, _ in x] == list(range(1, len(want[i]) + 1))
        assert [(-s, j) for _, j, s in x] == sorted((-s, j) for _, j, s in x)
        assert all(s == pytest.approx(float(np.dot(vectors[i], vectors[j])), abs=1e-9) for _, j, s in x[:3])
        total += len(want[i])
        hits += len({j for _, j, _ in x} & {j for j, _ in want[i]})
    assert hits == total if exact else hits >= 0.9 * total
    return got


@pytest.mark.parametrize("equal_lengths", [True, False])
def test_recall(spark, equal_lengths):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(1500, 12))
    v = v / np.linalg.norm(v, axis=1, keepdims=True) if equal_lengths else v * rng.gamma(2, size=(1500, 1))
    checked(spark, [(i, x.tolist()) for i, x in enumerate(v)], False)


def test_few_rows_copies_and_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (20, None), (40, [0.0, 0.0]), (60, [1.0, None]), (80, [float("inf"), 1.0]), (100, [float("nan"), 1.0]), (120, []), (None, [1.0, 1.0])]
    rows += [(140, [1.0, 0.0, 0.0]), (160, [0.0, 3.0]), (160, [0.0, 3.0]), (7, [-1.0, -1.0])]
    got = checked(spark, rows, True)
    assert set(got) == {0, 160}


def test_one_vector_in_a_third_of_the_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 0.5, -0.25] if i % 3 == 0 else rng.normal(size=3).tolist()) for i in range(600)]
    checked(spark, rows, False)


def test_empty(spark):
    assert H.search_all(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
