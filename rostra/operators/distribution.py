"""Exact distribution summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostra.functions.numeric import r2
from rostra.functions.params import by_dtype, group_column, measure
from rostra.schema import YEARS

#: Groups with fewer values are left out.
LEAST = 5
FIVE = ["min", "q1", "median", "q3", "max", "mean"]


def summary(df: DataFrame, keys: list[str], column: str, least: int = LEAST) -> DataFrame:
    """min, quartiles (exact, linear between ranks), max, mean and n of a column by group."""
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    found = df.dropna(subset=keys).groupBy(*keys).agg(F.min(column).alias("min"), q.alias("q"), F.max(column).alias("max"), F.avg(column).alias("mean"), F.count(column).alias("n")).where(F.col("n") >= least)
    return found.select(*keys, "min", *[F.col("q")[i].alias(k) for i, k in enumerate(("q1", "median", "q3"))], "max", "mean", "n")


def distribution(df: DataFrame, dim: str = "final_score", group: str = "country", year_min: int = YEARS[0], year_max: int = YEARS[1], dtype: str = "", rounded: bool = True) -> DataFrame:
    """Ordered by the rounded mean, highest first, then by group."""
    sub = by_dtype(df, dtype).where(F.col("year").between(year_min, year_max))
    key = group_column(group)
    out = summary(sub, [key], measure(dim)).withColumnRenamed(key, "group")
    if not rounded:
        return out
    return out.select("group", *[r2(F.col(c)).alias(c) for c in FIVE], "n").orderBy(F.desc("mean"), "group")


def bars(df: DataFrame, most: int = 25, **choices) -> DataFrame:
    """The first groups of a distribution with their mean and half the interquartile range."""
    first = distribution(df, **choices).orderBy(F.desc("mean"), "group").limit(most)
    return first.select("group", "mean", ((F.col("q3") - F.col("q1")) / 2).alias("half_iqr"), "n")
