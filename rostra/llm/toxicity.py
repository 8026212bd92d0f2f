"""Toxicity: a character n-gram linear classifier whose features are scaled by naive Bayes log-count ratios.

``fit`` learns from a bounded sample of labelled rows (``max_rows``, the bound that the job allows for classifiers):
which n-grams a document holds, the log-count ratio r of each between toxic and clean documents, and a logistic
regression on the features r * log2(1 + count).  Executors count n-grams and pick the features of each text; the driver
gets the counts of at most 2 ** BITS buckets and at most ``max_features`` numbers of each row, never a text.  ``score``
applies the model to every whole text, a window at a time.

Defined cases: a null text counts as empty and gets the score of the intercept alone; very long texts take memory in
proportion to their length only for their characters; labels that are null take no part; of several labels for one doc_id
the largest counts; repeated rows are learnt once and scored alike; without labels of both classes every score is the
share of toxic labels (below 1e-8 without any or without toxic ones); empty tables give empty results; other columns of
either table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostra.llm.common import forget, stored, trimmed

ORDERS = (3, 4, 5, 6)
BITS = 20
MAX_ROWS = 6000
#: Characters whose n-grams are hashed at a time.
WINDOW = 1 << 18
THRESHOLD = 0.7
MAX_FEATURES = 10_000
#: Added to counts.
ALPHA = 0.5
#: Documents that a feature is in at least.
LEAST = 3


def hashed(text: str | None) -> Iterator[np.ndarray]:
    """The buckets of the n-grams of the lower-case text, where a run of ASCII other than letters is one space: an array for each order and window."""
    line = f" {(text or '').lower()} "
    ahead = np.zeros(0, dtype=np.uint32)  # the end of the window before, in which n-grams of this one begin
    for at in range(0, len(line), WINDOW):
        x = np.frombuffer(line[at : at + WINDOW].encode("utf-32-le", "replace"), dtype=np.uint32)
        x = np.concatenate([ahead, np.where(x < 128, _SPACED[np.minimum(x, 127)], x)])
        x = x[np.concatenate(([True], (x[1:] != 32) | (x[:-1] != 32)))]
        h = x * np.uint32(0x9E3779B1)
        for n in range(2, max(ORDERS) + 1):
            if len(x) < n:
                break
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + x[n - 1 :]
            if n in ORDERS:
                fresh = h[max(0, len(ahead) - n + 1) :]
                yield ((fresh * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - BITS)).astype(np.intp)
        ahead = x[1 - max(ORDERS) :]


_SPACED = np.array([i if chr(i).isalpha() else 32 for i in range(128)], dtype=np.uint32)


def present(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that a text holds, each once, in order, and how often."""
    held, often, fresh = np.zeros(0, dtype=np.intp), np.zeros(0, dtype=np.intp), 0
    for b in hashed(text):
        k, c = np.unique(b, return_counts=True)
        held, often, fresh = np.concatenate([held, k]), np.concatenate([often, c]), fresh + len(k)
        if fresh > 1 << BITS:
            (held, often), fresh = _summed(held, often), 0
    return _summed(held, often)


def _summed(bucket: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(bucket, return_inverse=True)
    return found, np.bincount(place, often, len(found)).astype(np.intp)


@dataclass
class Model:
    """weights: of each bucket, already scaled by r, 0 for most; 4 MB whatever the input's size."""

    weights: np.ndarray
    bias: float
    used: np.ndarray | None = None

    def score(self, text: str | None) -> float:
        used = self.weights != 0 if self.used is None else self.used
        hit = np.concatenate([np.zeros(0, dtype=np.intp), *(b[used[b]] for b in hashed(text))])
        found, often = np.unique(hit, return_counts=True)
        at = self.bias + float((self.weights[found] * np.log2(1.0 + often)).sum())
        return float(1 / (1 + np.exp(-np.clip(at, -60, 60))))


def chosen(count: np.ndarray, n0: int, n1: int, max_features: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the buckets, in order, those max_features with the surest log-count ratios, and their ratios."""
    r = np.log((count[1] + alpha) / (n1 + 2 * alpha)) - np.log((count[0] + alpha) / (n0 + 2 * alpha))
    sure = np.abs(r) / np.sqrt(1 / (count[1] + alpha) + 1 / (count[0] + alpha))
    sure[(count.sum(0) < LEAST) | (sure < 2.5)] = 0
    kept = np.sort(np.argsort(-sure, kind="stable")[:max_features])
    kept = kept[sure[kept] > 0]
    return kept, r[kept]


def constant(y: np.ndarray) -> Model | None:
    """The model without features, where labels aren't of both classes."""
    if len(y) and y.min() != y.max():
        return None
    share = float(y.mean()) if len(y) else 0.0
    return Model(np.zeros(1 << BITS, dtype=np.float32), float(np.clip(np.log(max(share, 1e-9) / max(1 - share, 1e-9)), -20, 20)))


def learnt(held: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, kept: np.ndarray, r: np.ndarray, l2: float = 0.002, rounds: int = 200) -> Model:
    """Logistic regression on each row's features (places among kept, and how often)."""
    row = np.repeat(np.arange(len(held)), [len(h) for h, _ in held])
    col, often = (np.concatenate([x[k] for x in held]).astype(np.intp) for k in (0, 1))
    value = r[col] * np.log2(1.0 + often)
    n1, n0 = y.sum(), len(y) - y.sum()
    cost = np.where(y == 1, 0.5 / n1, 0.5 / n0) * len(y)
    w, bias = np.zeros(len(kept)), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = bias + np.bincount(row, value * w[col], len(y))
        e = cost * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / len(y)
        g, gb = np.bincount(col, value * e[row], len(kept)) + l2 * w / max(len(kept), 1), e.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = 0.02 / (1 + t / 100)
        w -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        bias -= step * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    weights = np.zeros(1 << BITS, dtype=np.float32)
    weights[kept] = (r * w).astype(np.float32)
    return Model(weights, float(bias), weights != 0)


def features(text: str | None, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of a text's kept buckets, and how often it holds each."""
    h, c = present(text)
    used = place[h] >= 0
    return place[h[used]], c[used]


def _places(kept: np.ndarray) -> np.ndarray:
    place = np.full(1 << BITS, -1, dtype=np.int32)
    place[kept] = np.arange(len(kept))
    return place


def train(texts: list[str | None], toxic: np.ndarray, max_features: int = MAX_FEATURES, alpha: float = ALPHA) -> Model:
    """NB-scaled logistic regression over texts at hand."""
    y = np.asarray(toxic, dtype=np.float64)
    if (model := constant(y)) is not None:
        return model
    count = np.zeros((2, 1 << BITS), dtype=np.int64)
    for t, label in zip(texts, y, strict=True):
        count[int(label), present(t)[0]] += 1
    kept, r = chosen(count, int(len(y) - y.sum()), int(y.sum()), max_features, alpha)
    place = _places(kept)
    return learnt([features(t, place) for t in texts], y, kept, r)


def fit(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES, alpha: float = ALPHA) -> Model:
    """Learn from at most max_rows labelled rows for which ``allowed`` (a condition on labels' columns) holds.

    The rows are those whose hashed doc_id is smallest, so reruns and any partitioning agree.  Their ids are at most
    max_rows and so are broadcast.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.where(allowed) if allowed is not None else known
    ids = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    ids = F.broadcast(ids.select(F.col("doc_id").alias("__id"), F.col("toxic").alias("__toxic")))
    rows = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("__id"))
    rows = rows.groupBy("doc_id", F.xxhash64("text").alias("own"), "__toxic").agg(F.first("text").alias("text"))
    rows = stored(rows.select(F.xxhash64("doc_id").alias("id"), "doc_id", "own", "__toxic", "text"), "toxicity-rows")
    if rows.count() > max_rows:
        few = rows.orderBy("id", "doc_id", "own").select(F.col("doc_id").alias("__id"), F.col("own").alias("__own")).limit(max_rows)
        rows = rows.join(F.broadcast(few), (F.col("doc_id") == F.col("__id")) & (F.col("own") == F.col("__own")), "left_semi")
    sizes = {r["__toxic"]: r["count"] for r in rows.groupBy("__toxic").count().collect()}  # a row for each label
    y = np.repeat([float(k > 0) for k in sizes], list(sizes.values()))
    if (model := constant(y)) is not None:
        return model

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((2, 1 << BITS), dtype=np.int64)
        for batch in batches:
            for label, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                count[int(label > 0), present(t.as_py())[0]] += 1
        held = np.flatnonzero(count.any(0))
        for at in range(0, len(held), 50_000):
            k = held[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(count[0, k]), pa.array(count[1, k])], ["bucket", "n0", "n1"])

    texts = rows.select("__toxic", "text")
    sums = texts.mapInArrow(lambda batches: trimmed(counted(batches)), "bucket int, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    sums = sums.where(F.col("n0") + F.col("n1") >= LEAST).toArrow()  # 2 ** BITS rows at most
    count = np.zeros((2, 1 << BITS), dtype=np.int64)
    count[:, sums.column("bucket").to_numpy()] = [sums.column("n0").to_numpy(), sums.column("n1").to_numpy()]
    kept, r = chosen(count, int(len(y) - y.sum()), int(y.sum()), max_features, alpha)

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = _places(kept)
        for batch in batches:
            found = [features(t.as_py(), place) for t in batch.column(3)]
            lists = [pa.array([f[k].astype(np.int32) for f in found], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *lists], ["id", "own", "toxic", "at", "often"])

    held = rows.select("id", "own", "__toxic", "text").mapInArrow(lambda batches: trimmed(picked(batches)), "id long, own long, toxic int, at array<int>, often array<int>")
    held = held.orderBy("id", "own").toArrow().combine_chunks()  # max_rows rows of max_features numbers at most
    forget(rows)
    lists = [(a.values.to_numpy(), o.values.to_numpy()) for a, o in zip(held.column("at"), held.column("often"), strict=True)]
    return learnt(lists, (held.column("toxic").to_numpy() > 0).astype(np.float64), kept, r)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and score (0 to 1, higher: toxic likelier), a row for each row of docs, from its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = list(dict.fromkeys([*keep, "text"]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [shared.value.score(t.as_py()) for t in batch.column(names.index("text"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(k)) for k in keep), pa.array(values, pa.float64())], [*keep, "score"])

    schema = ", ".join([*(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep), "score double"])
    return docs.select(*names).mapInArrow(lambda batches: trimmed(scored(batches)), schema)


def toxicity(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, score and predicted (1 from the threshold on) of every document."""
    return score(docs, fit(docs, labels, allowed, max_rows)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


#: The rows whose labels may be learnt from: crc32 of the id's text mod 3 is not 1.
def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
