import random

import numpy as np
import pytest

from rostra.llm import components as C


def brute(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root}


def tangle(rng, n):
    """Paths in a random order, stars around large nodes, a clique and random links."""
    ids = rng.sample(range(-(10**12), 10**12), n)
    edges = list(zip(ids[: n // 2], ids[1 : n // 2], strict=False))
    edges += [(max(ids[n // 2 :]), x) for x in ids[n // 2 : 3 * n // 4]]
    edges += [(a, b) for a in ids[-8:] for b in ids[-8:] if a != b]
    edges += [tuple(rng.sample(ids[3 * n // 4 :], 2)) for _ in range(n // 10)]
    rng.shuffle(edges)
    return edges


@pytest.mark.parametrize("held", [1 << 18, 7])
@pytest.mark.parametrize("tasks", [1, 23])
def test_components_as_by_brute_force(spark, monkeypatch, held, tasks):
    monkeypatch.setattr(C, "HELD", held)
    edges = tangle(random.Random(held + tasks), 400)
    frame = type(spark.range(0))
    monkeypatch.setattr(frame, "distinct", lambda self, f=frame.distinct: f(self).repartition(tasks))
    out = C.components(spark.createDataFrame(edges, "u long, v long"))
    want = brute(edges)
    assert out.count() == len(want) and {r.node: r.root for r in out.collect()} == want


def test_loops_and_no_edges(spark):
    assert C.components(spark.createDataFrame([(1, 1)], "u long, v long")).count() == 0
    assert C.components(spark.createDataFrame([(1, 1), (2, 1), (1, 2)], "u long, v long").coalesce(1)).count() == 2


def test_contraction():
    rng = random.Random(3)
    edges = tangle(rng, 1000)
    u, v = C.contracted(*(np.array(x, np.int64) for x in zip(*edges, strict=True)))
    assert dict(zip(u.tolist(), v.tolist(), strict=True)) == {k: r for k, r in brute(edges).items() if k != r}


def test_a_table_of_one_task_costs_the_driver_few_jobs(spark):
    edges = [(i, i + 1) for i in range(500)]
    sc = spark.sparkContext
    sc.setJobGroup("components", "components")
    try:
        assert C.components(spark.createDataFrame(edges, "u long, v long").coalesce(1)).where("root <> 0").count() == 0
        assert len(sc.statusTracker().getJobIdsForGroup("components")) <= 12
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
