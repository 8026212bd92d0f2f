"""The optional text pipeline: classify, chunk, score, and combine; the scorer is pluggable."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostra.functions.text import chunks, word_count
from rostra.schema import DIMS6

Scorer = Callable[[pd.Series], pd.DataFrame]


def classified(docs: DataFrame, rule: Column) -> DataFrame:
    return docs.withColumn("dtype", rule)


def chunked(docs: DataFrame, size: int = 200, key: str = "doc_id") -> DataFrame:
    """key, chunk (from 0), n_words and text of each run of words."""
    rows = docs.select(key, F.posexplode(chunks("text", size)).alias("chunk", "text"))
    return rows.withColumn("n_words", word_count("text"))


def scored_chunks(rows: DataFrame, scorer: Scorer, key: str = "doc_id") -> DataFrame:
    """Six scores of each chunk, by batches; a scorer gets texts and returns the six columns."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = scorer(b["text"])
            yield pd.concat([b[[key, "chunk"]].reset_index(drop=True), out[DIMS6].reset_index(drop=True)], axis=1)

    schema = ", ".join([f"`{key}` {kind}", "chunk int", *(f"{d} double" for d in DIMS6)])
    return rows.select(key, "chunk", "text").mapInPandas(run, schema)


def combined(scores: DataFrame, weights: dict[str, float] | None = None, key: str = "doc_id") -> DataFrame:
    """Means over a document's chunks, and the weighted mean of them as final_score.

    The published figures don't state the weights, so they are a parameter; equal ones by default.
    """
    w = weights or dict.fromkeys(DIMS6, 1.0)
    out = scores.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("n_chunks"), *[F.avg(d).alias(d) for d in DIMS6])
    total = sum((F.col(d) * float(w.get(d, 0.0)) for d in DIMS6), F.lit(0.0))
    return out.withColumn("final_score", total / float(sum(w.get(d, 0.0) for d in DIMS6)))


def marker_scorer(texts: pd.Series) -> pd.DataFrame:
    """A deterministic stand-in for a model: share of words with a given first letter, times 100."""
    words = texts.str.lower().str.split()
    return pd.DataFrame({d: words.map(lambda w, c=d[0]: 100.0 * sum(x[0] == c for x in w) / max(1, len(w))) for d in DIMS6})
