import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from rostra.llm import simhash as S


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aAbÉ \t\x0b\x85\xa0é.", max_size=60) | st.none())
def test_fingerprint(text):
    assert S.fingerprint(None if text is None else text.encode()) % (1 << 64) == brute_fingerprint(text)


def test_hash_is_the_engine_s(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("É the words",)], "t string").select(F.xxhash64("t").alias("h")).first()
    assert row.h % (1 << 64) == xxhash.xxh64_intdigest("É the words".encode(), 42)


def near(x, bits, rng):
    for b in rng.sample(range(64), bits):
        x ^= 1 << b
    return x


def brute_roots(values):
    values = sorted(values)
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if ((a ^ b) % (1 << 64)).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {v: find(v) for v in values}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("hot", [2048, 6, 1])
def test_links_match_brute_force(spark, hot):
    rng = random.Random(hot)
    base = [rng.getrandbits(64) for _ in range(12)]
    values = {signed(near(b, k, rng)) for b in base for k in (0, 1, 2, 3, 3, 4, 4, 5, 6)} | {0, -1, 7, 15}
    from rostra.llm.components import components

    fps = spark.createDataFrame([(1, v) for v in values], "tag long, fp long")
    found = S.links(fps, hot)
    assert all(((r.u ^ r.v) % (1 << 64)).bit_count() <= 3 and r.tag == 1 for r in found.collect())
    got = {v: v for v in values} | {r.node: r.root for r in components(found.select("u", "v")).collect()}
    assert got == brute_roots(values)


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=5, unique=True))
def test_some_chain_holds_just_for_close_values(x, bits):
    d = np.array([sum(1 << b for b in bits)], dtype=np.uint64)
    assert any(S.chained(d, i)[0] for i in range(4)) == (len(bits) <= 3)


def test_documents(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(5, long, "a"), (3, long + " tail", "a"), (9, "Other  text here", "b"), (2, "other text\there", "b"), (8, None, None), (7, " \n", None), (7, " \n", None), (None, "", "x"), (4, "alone", "x"), (None, "x", "x")]
    out = S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    want = {v: brute_fingerprint(t) for v, t, _ in rows}
    assert len(out) == len(rows)
    got = {(r.doc_id, r.fp % (1 << 64)): r.component_id for r in out}
    assert got[9, want[9]] == got[2, want[2]] == 2 and got[7, 0] == got[8, 0] == got[None, 0] == 7 and got[4, want[4]] == 4
    assert got[None, brute_fingerprint("x")] is None
    assert S.near_duplicates(spark.createDataFrame(rows[:0], "doc_id long, text string, fp string")).count() == 0


def jaccard(a, b):
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_one_document_of_each_group_stays(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    rows, base = [], {}
    for i in range(60):
        base[i] = [word() for _ in range(rng.choice([30, 120, 400]))]
        rows.append((i, " ".join(base[i])))
    near = []
    for i in range(30):
        w = list(base[i])
        for _ in range(max(1, len(w) // 60)):
            w[rng.randrange(len(w))] = word()
        near.append((1000 + i, " ".join(w)))
    cloud = [(2000 + k, " ".join([*base[59][:200], word(), *base[59][200:]])) for k in range(60)]
    copies = [(3000 + i, "  " + " ".join(base[i]).upper()) for i in range(10)] + [(5, rows[5][1])] * 2 + [(None, rows[6][1]), (None, None), (None, None), (4000, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows + near + cloud + copies], "doc_id long, text string, node string")
    kept = [r.doc_id for r in S.deduplicate(docs).collect()]
    assert len(kept) == len(set(kept)) and set(range(60)) <= set(kept)
    extra = set(kept) - set(range(60)) - {None, 4000}
    assert not {x for x in extra if x >= 2000}
    similar = [i for i, t in near if jaccard(t, rows[i - 1000][1]) >= 0.8]
    assert similar and not extra & set(similar)
    assert S.deduplicate(docs.limit(0)).count() == 0 and S.deduplicate(docs).columns == docs.columns


def brute_groups(texts):
    """Which of the texts link with which, by single links of similarity 0.8 or more."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def edited(rng, base, changes):
    w = list(base)
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**9)}"
    return " ".join(w)


def test_a_cloud_of_edited_copies_links_as_by_brute_force(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = [edited(rng, base, rng.choice([2, 3, 4, 5])) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in S.deduplicate(docs).collect()}
    assert kept == set(brute_groups(texts))


def test_all_pairs_at_the_limit_are_found_in_short_texts_too(spark):
    rng = random.Random(9)
    texts = []
    for i in range(400):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([9, 12, 20, 60, 150]))]
        texts.append(" ".join(base))
        w = list(base)
        if len(base) <= 20:
            w.append(f"x{i}")  # of m shingles and one more
        else:
            w[rng.randrange(len(w))] = f"x{i}"
        texts.append(" ".join(w))
    similar = [i for i in range(0, len(texts), 2) if jaccard(texts[i], texts[i + 1]) >= 0.8]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in S.deduplicate(docs).collect()}
    assert len(similar) > 300 and not kept & {i + 1 for i in similar}
    assert len(kept) == len(texts) - len(similar)


def test_long_texts_near_the_limit_are_compared_whole(spark):
    rng = random.Random(10)
    texts = []
    for i in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(1500)]
        texts += [" ".join(base), edited(rng, base, rng.randint(30, 37))]
    similar = [i for i in range(0, len(texts), 2) if jaccard(texts[i], texts[i + 1]) >= 0.8]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in S.deduplicate(docs).collect()}
    assert 10 < len(similar) < 50
    assert kept == set(range(len(texts))) - {i + 1 for i in similar}


def test_a_batch_leaves_in_parts_that_keep_their_rows(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in (3, 0, 1, 2, 4)], "doc_id long, text string").coalesce(1)
    out = S._mapped(df, lambda t: [len(t)] * (1 + len(t) * 400_000), "hashes array<long>")
    got = [tuple(r) for r in out.selectExpr("doc_id", "size(hashes)", "array_distinct(hashes)").collect()]
    assert got == [(i, 1 + i * 400_000, [i]) for i in (3, 0, 1, 2, 4)]


def test_a_long_text_has_the_sketch_of_its_set(spark):
    words = [f"W{i % 70_001}" for i in range(150_000)]
    want = {S.xxhash.xxh64_intdigest(" ".join(words[i : i + 5]).lower(), 42) for i in range(len(words) - 4)}
    assert S.shingles(" ".join(words).encode()).tolist() == sorted(x - (1 << 64) if x >> 63 else x for x in want)
