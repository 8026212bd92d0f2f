"""The corpus pipeline: STAGES applied one after another to documents.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept, and returns the columns of
documents; the last returns the packed pieces.  Between stages the rows are written as Parquet and read again, and the
driver gives back what it has freed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rostra.llm import kneser_ney, mixing, packing, simhash
from rostra.llm import toxicity as tox
from rostra.llm.common import stored, table, trim_driver

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.7 or more go."""
    docs = docs.select(*COLUMNS)
    model = tox.fit(docs, table(spark, sf_dir, "labels"))
    trim_driver(spark)
    scored = tox.score(docs, model, tuple(COLUMNS))
    return scored.where(scored["score"] < tox.THRESHOLD).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are less likely under the model of trusted text than their language's fence go."""
    trim_driver(spark)
    docs = docs.select(*COLUMNS)
    return kneser_ney.classified(docs, table(spark, sf_dir, "labels"), keep=tuple(COLUMNS)).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays."""
    trim_driver(spark)
    return simhash.deduplicate(docs.select(*COLUMNS))


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source takes them."""
    trim_driver(spark)
    return mixing.mix(docs.select(*COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    trim_driver(spark)
    return packing.best_fit(docs.select(*COLUMNS))


STAGES = [
    ("toxicity", toxicity),
    ("quality classifier", quality),
    ("simhash near-dedup", near_duplicates),
    ("mixing to target weights", mixing_weights),
    ("best-fit packing", packed),
]
#: SQL can't express the trained stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
