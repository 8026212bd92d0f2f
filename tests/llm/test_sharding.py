import random
import zlib
from collections import Counter, defaultdict

import pytest

from rostra.llm import sharding as S


def checked(spark, rows, shards=16):
    out = S.shard(spark.createDataFrame(rows, "doc_id long, text string, shard string"), shards).collect()
    raw = lambda t: (t or "").encode()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len(raw(t)) + 1, zlib.crc32(raw(t))) for i, t, _ in rows)
    counts = Counter(r.shard for r in out)
    assert max(counts.values(), default=0) - (min(counts.values()) if len(counts) == shards else 0) <= 1
    slots = defaultdict(list)
    groups = defaultdict(Counter)
    for r in out:
        slots[r.shard].append(r.slot)
        groups[r.text_crc32][r.shard] += 1
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return groups


def test_groups_stay_together(spark):
    rows = [(i, f"text {i}", "a") for i in range(1500)] + [(2000 + i, f"copy {i % 100}", "a") for i in range(400)] + [(None, None, None), (1, "", "x"), (1, "", "x")]
    groups = checked(spark, rows)
    assert sum(len(g) > 1 for g in groups.values()) == 0


def test_a_hot_group_fills_whole_shards(spark):
    rows = [(i, f"text {i}", "a") for i in range(800)] + [(2000 + i, "hot", "a") for i in range(500)] + [(4000 + i, f"copy {i % 50}", "a") for i in range(200)]
    groups = checked(spark, rows)
    assert len(groups[zlib.crc32(b"hot")]) <= -(-500 // (1500 // 16)) + 1
    assert sum(len(g) > 1 for g in groups.values()) <= 5


@pytest.mark.parametrize("n", [0, 1, 5, 33])
def test_few_rows_all_alike(spark, n):
    checked(spark, [(7, "same", "a")] * n)


def test_every_text_has_copies(spark):
    """No shard has room, so only members that change places bring groups together."""
    rows = [(i, f"copy {i % 400}", "a") for i in range(1200)]
    groups = checked(spark, rows)
    assert sum(len(g) > 1 for g in groups.values()) <= 160  # without moves, 399 of 400


def test_hot_group_among_copies(spark):
    rows = [(i, "hot", "a") for i in range(400)] + [(1000 + i, f"copy {i % 200}", "a") for i in range(800)]
    groups = checked(spark, rows)
    hot = groups[zlib.crc32(b"hot")]
    assert sum(n for _, n in hot.most_common(6)) >= 200  # without moves, 150
    assert sum(len(g) > 1 for g in groups.values()) <= 120


def squares(units):
    return sum(n * n for n in units.values())


def test_rounds_follow_their_definition(spark):
    """Members of groups stay, no quota is passed, and members come together."""
    rng = random.Random(4)
    units = Counter((f"g{rng.randrange(60)}", rng.randrange(4)) for _ in range(300))
    held = Counter()
    for (_, label), n in units.items():
        held[label] += n
    quotas = [held[s] + (s == 2) for s in range(4)]
    start = spark.createDataFrame([(g, s, n) for (g, s), n in units.items()], "group string, label int, n long")
    out = {(r.group, r.label): r.n for r in S.propagate(S.stored(start, "units"), quotas).collect()}
    sizes = lambda u, k: {x: sum(n for key, n in u.items() if key[k] == x) for x in {key[k] for key in u}}
    assert sizes(out, 0) == sizes(units, 0) and squares(out) > squares(units)
    assert all(n <= quotas[s] for s, n in sizes(out, 1).items())
    assert squares(out) >= 2 * squares(units)


def test_granted_moves():
    assert S.granted([[0, 5], [3, 0]], [0, 0]) == [[0, 3], [3, 0]]
    assert S.granted([[0, 5], [3, 0]], [0, 1]) == [[0, 4], [3, 0]]
    assert S.granted([[0, 2, 0], [0, 0, 2], [0, 0, 0]], [0, 0, 1]) == [[0, 1, 0], [0, 0, 1], [0, 0, 0]]


def test_a_hot_group_is_no_task_s(spark):
    """Ranks of a hot group are found by cells of it, without a shuffle by group alone."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = [(i, "hot" if i % 2 else f"text {i}", "a") for i in range(400)]
        out = S.shard(spark.createDataFrame(rows, "doc_id long, text string, shard string"))
        made = []
        keep = S.stored
        S.stored = lambda df, name: (made.append((name, df._jdf.queryExecution().executedPlan().toString())), keep(df, name))[1]
        try:
            S.shard(spark.createDataFrame(rows, "doc_id long, text string, shard string"))
        finally:
            S.stored = keep
        plan = dict(made)["shard-placed"]
        assert "hashpartitioning(group" in plan and any("group" in x and "__cell" in x for x in plan.split("\n") if "Exchange hashpartitioning" in x)
        assert out.count() == 400
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
