import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from rostra.llm import kneser_ney as K


def brute(texts, order):
    """The textbook model over bytes, as a function of (context, symbol)."""
    top = Counter()
    for t in texts:
        b = bytes(order - 1) + t
        top.update(b[i : i + order] for i in range(len(t)))
    counts = {order: top}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    d = {n: K.discounts([sum(v == k for v in c.values()) for k in range(1, 5)]) for n, c in counts.items()}
    by = {n: defaultdict(dict) for n in counts}
    for n, c in counts.items():
        for g, v in c.items():
            by[n][g[:-1]][g[-1]] = v

    def p(context, w, n=order):
        if n == 0:
            return 1 / 256
        seen = by[n].get(context)
        below = p(context[1:], w, n - 1)
        if not seen:
            return below
        total = sum(seen.values())
        cut = lambda v: d[n][min(v, 3) - 1]
        own = (seen[w] - cut(seen[w])) / total if w in seen else 0
        return own + sum(cut(v) for v in seen.values()) / total * below

    return p


TEXTS = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "naïve café", "the the the", "", "zz", "the mat and the log and the cat"] * 2 + ["the hat"]


ODD = [(99, "unseen: qux", None), (100, None, "en"), (101, "the cat sat", "xx"), (101, "the cat sat", "xx"), (102, "", "en"), (103, "the log and the mat " * 40, "en")]


def compared(rows, texts, order):
    """Each row's perplexity against the textbook model of the texts."""
    p = brute([t.encode() for t in texts], order)
    for r in rows:
        b = (r.text or "").encode()
        line = bytes(order - 1) + b
        want = [-math.log(p(line[i : i + order - 1], line[i + order - 1])) for i in range(len(b))]
        assert r.n_symbols == len(b) and r.log_ppl == pytest.approx(np.mean(want) if want else 0, rel=1e-4)


@pytest.mark.parametrize(("order", "part", "chunk"), [(2, 400_000, 1 << 24), (4, 20, 40), (6, 30, 1)])
def test_matches_the_textbook_model(spark, monkeypatch, order, part, chunk):
    """With one shard and chunk, and with many."""
    monkeypatch.setattr(K, "PART_ROWS", part)
    monkeypatch.setattr(K, "CHUNK_BYTES", chunk)
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(TEXTS)] + ODD, "doc_id long, text string, lang string")
    trained = K.fitted(docs.where("doc_id < 90").select("text"), order)
    assert (len(K.cuts(trained, order)) > 1) == (part < 100)
    out = K.perplexities(docs, trained, ("doc_id", "text"), order).collect()
    assert len(out) == len(TEXTS) + len(ODD)
    compared(out, TEXTS, order)


@pytest.mark.parametrize("order", [3, 6])
def test_every_shard_holds_what_its_contexts_fall_back_to(spark, order):
    docs = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    rows = K.fitted(docs, order)
    starts = K.cuts(rows, order, 15)
    assert len(starts) >= 3
    sent = K.dealt(rows, starts, order).collect()
    for part in range(len(starts) + 1):
        model = K.interpolated(order, *K._columns([r.body for r in sent if r.part == part]))
        low, high = (starts[part - 1] if part else 0), (starts[part] if part < len(starts) else 1 << 62)
        for context in {(bytes(order - 1) + t.encode())[i : i + order - 1] for t in TEXTS for i in range(len(t.encode()))}:
            key = np.array([int.from_bytes(context + bytes([w]), "big") for w in range(256)], dtype=np.int64)
            if low <= K.backwards(key[:1], order, order)[0] < high:
                assert np.exp(model.log_probabilities(key)).sum() == pytest.approx(1, abs=1e-4)


def corpus(spark):
    words = "the of and to in is that for it was on with as be at by this had not are but from or have an they".split()
    rng = np.random.default_rng(5)
    text = lambda n: " ".join(rng.choice(words, n))
    junk = lambda n: "".join(chr(33 + rng.integers(90)) for _ in range(n))
    rows = [(i, text(80), "en") for i in range(150)] + [(200 + i, junk(400), "en") for i in range(15)] + [(300, None, "en"), (301, "", None), (302, text(900), "xx"), (303, text(4), "en"), (5, text(80), "en")]
    docs = spark.createDataFrame([(*r, "s", 1.0) for r in rows], "doc_id long, text string, lang string, source string, high double")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 150, 2)] + [(200, 0, 0), (None, 1, 1), (7, None, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_junk_goes_and_clean_text_stays(spark):
    docs, labels = corpus(spark)
    out = K.classified(docs, labels).collect()
    assert len(out) == docs.count()
    kept = {r.doc_id for r in out if r.kept}
    assert kept == {*range(150), 302, 303}
    again = K.classified(docs, labels, keep=("doc_id", "text", "lang", "source"))
    assert {r.doc_id for r in again.where("kept").collect()} == kept


def test_no_labels_and_no_rows(spark):
    docs, labels = corpus(spark)
    out = K.classified(docs, labels.limit(0)).collect()
    assert all(r.kept == (r.n_symbols > 0) for r in out) and len({round(r.log_ppl, 9) for r in out if r.n_symbols}) == 1
    assert K.classified(docs.limit(0), labels).count() == 0


def test_ids_join_by_a_shuffle_too(spark, monkeypatch):
    docs, labels = corpus(spark)
    want = {r.doc_id for r in K.only(docs, K.trusted_ids(labels)).select("doc_id").collect()}
    monkeypatch.setattr(K, "BROADCAST_IDS", 0)
    assert {r.doc_id for r in K.only(docs, K.trusted_ids(labels)).select("doc_id").collect()} == want == set(range(0, 150, 2))


def test_query_scores_by_the_textbook_model(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(TEXTS)] + ODD, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(len(TEXTS))], "doc_id long, quality int")
    monkeypatch.setattr(K, "PART_ROWS", 20)
    out = K.classified(docs, labels, 4, keep=("doc_id", "text", "lang")).collect()
    assert len(out) == len(TEXTS) + len(ODD)
    compared(out, TEXTS, 4)


@pytest.mark.parametrize("run", [1, 7, 50])
def test_runs_of_long_texts_keep_their_contexts(monkeypatch, run):
    texts = [t.encode() for t in TEXTS] + [b"the log and the mat " * 10]
    (key, owner), = K._windows(texts, 4)
    monkeypatch.setattr(K, "_CHUNK", run)
    keys, owners = zip(*K._windows(texts, 4), strict=True)
    assert len(keys) > 5 and np.concatenate(keys).tolist() == key.tolist() and np.concatenate(owners).tolist() == owner.tolist()


def test_numbers_survive_squeezing():
    for x in ([], [0], [5, 5, 1 << 47], [-1, 3, 1 << 40]):
        assert K._spread(K._squeezed(np.array(x, np.int64))).tolist() == x


def test_many_bad_documents_do_not_move_the_fence(spark):
    words = "the of and to in is that for it was on with as be at by this had not are but from or have an they".split()
    rng = np.random.default_rng(6)
    text = lambda n: " ".join(rng.choice(words, n))
    scrambled = lambda n: "".join(rng.permutation(list(text(n))))
    good = [(i, text(60), "en") for i in range(200)]
    bad = [(1000 + i, scrambled(60), "en") for i in range(150)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 200, 2)], "doc_id long, quality int")
    assert {r.doc_id for r in K.classified(docs, labels).where("kept").collect()} == set(range(200))
