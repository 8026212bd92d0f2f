"""The pipeline against plain versions of its stages, and its planted cases."""

import math
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline as C
from rostra.llm import mixing
from rostra.llm import packing as P
from rostra.llm import toxicity as T

INSULTS = ["wretched fool", "vile fool", "fool and liar", "stupid fool"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    vocabulary = ["".join(rng.choice(list("abcdeilmnorstu"), rng.integers(2, 9))) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(vocabulary, n)) + "."
    docs, labels = [], []

    def add(t, lang="en", quality=None, toxic=None):
        i = len(docs)
        docs.append((i, t, lang, f"s{i % 4}" if i % 9 else None, len(t or ""), "extra"))
        if quality is not None:
            labels.append((i, quality, toxic))
        return i

    clean = [add(text(int(rng.integers(20, 200))), quality=1 if k % 2 else None, toxic=0) for k in range(240)]
    toxic = []
    for k in range(60):
        words = text(60).split()
        for _ in range(3):
            words.insert(int(rng.integers(len(words))), INSULTS[k % 4])
        toxic.append(add(" ".join(words), quality=1 if k % 3 else None, toxic=1))
    junk = [add("".join(chr(int(c)) for c in rng.integers(33, 127, 500)), quality=0 if k % 2 else None, toxic=0) for k in range(20)]
    copies = [add(docs[i][1]) for i in clean[:15]]
    near = []
    for i in clean[20:40]:
        words = docs[i][1].split()
        words[len(words) // 2] = "changed"
        if len(words) > 60:
            near.append(add(" ".join(words)))
    odd = [add(None), add("")]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, node string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, dict(enumerate(docs)), {"clean": clean, "toxic": toxic, "junk": junk, "copies": copies, "near": near, "odd": odd}


def test_stages(spark, folder, tmp_path):
    path, docs, cases = folder
    out = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, out, path)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert out.columns == C.COLUMNS, name
        kept[k] = defaultdict(int)
        for r in out.select("doc_id").collect():
            kept[k][r.doc_id] += 1
    everything = set(docs)
    # toxicity: the model trained directly
    rows = spark.read.parquet(f"{path}/labels.parquet").collect()
    model = T.fit(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    assert set(kept[0]) == {i for i in everything if model.score(docs[i][1]) < 0.7}
    assert not set(kept[0]) & set(cases["toxic"]) and set(cases["clean"]) <= set(kept[0]) and rows
    # quality
    assert set(kept[1]) == set(kept[0]) - set(cases["junk"]) - set(cases["odd"])
    # near duplicates: of the groups planted, the first stays
    assert set(kept[2]) == set(kept[1]) - set(cases["copies"]) - set(cases["near"])
    assert set(kept[2].values()) == {1}
    # mixing: each source takes about its target
    n = {i: len((docs[i][1] or "").split()) for i in kept[2]}
    sizes, taken = defaultdict(int), defaultdict(int)
    for i in kept[2]:
        sizes[docs[i][3]] += n[i]
        taken[docs[i][3]] += n[i] * kept[3][i]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    capped = {}
    while True:
        left = [s for s in order if s not in capped]
        share = {s: (sum(sizes.values()) - sum(capped.values())) * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s: 3.0 * sizes[s] for s in left if share[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    assert all(math.isclose(taken[s], (capped | share)[s], abs_tol=120) for s in sizes)
    # packing: all tokens of all mixed documents
    coder = P.words(P.tokenizer_path())
    count = {i: len(coder.encode([docs[i][1].encode()])[0]) + 1 for i in kept[3]}
    packed = out.collect()
    assert sum(r.length for r in packed) == sum(count[i] * k for i, k in kept[3].items())
    assert len({r.sequence_id for r in packed}) <= sum(r.length for r in packed) / 2048 * 1.05 + 1


def test_run_gives_what_the_stages_give(spark, folder, tmp_path):
    path, docs, _ = folder
    once, again = (sorted(map(tuple, C.run(spark, path).drop("sequence_id", "offset").collect())) for _ in range(2))
    assert once == again and {r[0] for r in once} <= set(docs)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
