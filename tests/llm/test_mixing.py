import math
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rostra.llm import mixing as M


def brute_targets(sizes):
    """Share by weight, cap, share the excess again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(order)}
    capped, total = {}, sum(sizes.values())
    while True:
        left = [s for s in order if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * sizes[s]]
        if not over:
            return {**capped, **share}
        capped |= {s: 3.0 * sizes[s] for s in over}


@settings(max_examples=8, deadline=None)
@given(st.dictionaries(st.sampled_from([None, "", "a", "b", "B", "é", "z", "zz"]), st.integers(0, 500), min_size=1))
def test_targets_match_the_iterative_rule(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in M.targets(rows).collect()}
    want = brute_targets(sizes)
    assert all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-6) for s in sizes), (got, want)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "w " * (1 + i * 37 % 50), "big" if i % 3 else f"s{i % 7}", "x") for i in range(600)]
    rows += [(7, "same words", "s1", "x")] * 3 + [(None, None, None, None), (9001, "", "s1", "x"), (9002, "# $ % & # $", None, "x"), (9003, "long " * 20000, "s2", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string")


def test_taken_words_come_near_the_targets(docs):
    rows = M.taken(docs).collect()
    assert len(rows) == docs.count() and sorted(map(str, rows)) == sorted(map(str, M.taken(docs.repartition(5)).collect()))
    words = {(r.doc_id, r.source): len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
    sizes, taken, target, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in rows:
        assert r.size == words[r.doc_id, r.source] and r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size * 4)
    want = brute_targets(sizes)
    for s in sizes:
        assert all(r.source_size == sizes[s] for r in rows if r.source == s)
        assert math.isclose(target[s], want[s], rel_tol=1e-9) and abs(taken[s] - target[s]) <= largest[s] / 2 + 1


def test_mix_repeats_rows_as_taken(docs):
    taken = {}
    for r in M.taken(docs).collect():
        taken[r.doc_id] = r.taken
    mixed = M.mix(docs)
    assert mixed.columns == docs.columns
    got = defaultdict(int)
    for r in mixed.collect():
        got[r.doc_id] += len((r.text or "").split())
    assert all(got[i] == n for i, n in taken.items() if i != 7)  # id 7 is in four rows
    assert M.mix(docs.limit(0)).count() == 0 and M.taken(docs.limit(0)).count() == 0


def test_better_documents_are_taken_first(spark):
    from pyspark.sql import functions as F

    rows = [(i, f"word{i} " * 10, "a") for i in range(400)] + [(1000 + i, f"w{i} " * 3400, "b") for i in range(1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weight = F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0)
    out = M.taken(docs, weight, share=0.3).where("source = 'a' and taken > 0").collect()
    even = sum(r.doc_id % 2 == 0 for r in out)
    assert 20 < len(out) < 400 and even > 0.65 * len(out)


@pytest.mark.parametrize("weight", [1.0, 0.1, 1e-6, 1e9])
def test_cells_stay_small_whatever_the_weights(spark, weight):
    rows = spark.range(20_000).select((-F.log(F.rand(3)) / weight).alias("key"), F.lit("a").alias("source"), F.lit(3).cast("long").alias("size"))
    most = rows.groupBy(F.floor(F.log2("key") * M.CELLS)).count().agg(F.max("count")).first()[0]
    assert most <= 0.01 * 20_000
    rows = M.stored(rows, "rows")
    more = spark.createDataFrame([(1.0 + i, "b", 7) for i in range(5)], "key double, source string, size long")
    got = {r.source: r for r in M.edges(rows.select("source", "size", "key").unionByName(more.select("source", "size", "key"))).collect()}
    for source, part in (("a", rows), ("b", more)):
        keys = sorted(r.key for r in part.collect())
        size = 3 if source == "a" else 7
        rest = got[source].target - got[source].epochs * size * len(keys)
        taken = [k for i, k in enumerate(keys) if size * (i + 1) - size / 2 <= rest]
        assert got[source].edge == (taken[-1] if taken else None)
