"""Headline statistics in one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostra.functions.numeric import rounded
from rostra.functions.params import by_dtype
from rostra.schema import DIMS6, M7

LEADER = ["leader_name", "leader_short", "iso3", "country"]


def _top(df: DataFrame, name: str, out: str, *ties) -> DataFrame:
    first = df.orderBy(F.col("final_score").desc_nulls_last(), *ties).limit(1)
    return first.agg(F.first(name).alias(f"{out}_name"), F.first("final_score").alias(f"{out}_score"))


def _mean(m: str) -> Column:
    return F.try_divide(F.sum(f"__sum_{m}"), F.sum(f"__n_{m}"))


def flat(df: DataFrame, dtype: str = "", places: bool = True) -> DataFrame:
    """One row: counts, range of years, mean score, top country, top leader and the means of the six dimensions.

    The fact is read once, into sums by leader and country; all figures come from those.  An empty selection gives zero
    counts and nulls.  ``places=False`` leaves the numbers unrounded.
    """
    keep = (lambda c, k: rounded(c, k)) if places else (lambda c, k: c)
    sums = [x for m in M7 for x in (F.sum(m).alias(f"__sum_{m}"), F.count(m).alias(f"__n_{m}"))]
    groups = by_dtype(df, dtype).groupBy(*LEADER).agg(F.count(F.lit(1)).alias("__rows"), F.min("year").alias("year_min"), F.max("year").alias("year_max"), *sums)
    total = groups.agg(
        F.coalesce(F.sum("__rows"), F.lit(0)).cast("long").alias("n_discourses"),
        F.countDistinct("iso3").alias("n_countries"),
        F.countDistinct("leader_name").alias("n_leaders"),
        F.min("year_min").alias("year_min"),
        F.max("year_max").alias("year_max"),
        keep(_mean("final_score"), 2).alias("avg_score"),
        *[keep(_mean(d), 2).alias(d) for d in DIMS6],
    )
    countries = groups.dropna(subset=["iso3", "country"]).groupBy("iso3", "country").agg(_mean("final_score").alias("final_score"))
    country = _top(countries, "country", "top_country", F.col("iso3"))
    leaders = groups.dropna(subset=LEADER).withColumn("final_score", F.try_divide("__sum_final_score", "__n_final_score"))
    leader = _top(leaders, "leader_short", "top_leader", F.desc("__n_final_score"), F.col("leader_name"), F.col("iso3"))
    # three frames of one row each
    one = total.withColumn("__k", F.lit(1)).join(country.withColumn("__k", F.lit(1)), "__k").join(leader.withColumn("__k", F.lit(1)), "__k").drop("__k")
    return one.withColumns({c: keep(F.col(c), 1) for c in ("top_country_score", "top_leader_score")})


def stats(df: DataFrame, dtype: str = "") -> DataFrame:
    """The same nested: top_country and top_leader as structs, dim_avgs as a map."""
    tops = [F.struct(F.col(f"{t}_name").alias("name"), F.col(f"{t}_score").alias("score")).alias(t) for t in ("top_country", "top_leader")]
    means = F.create_map(*[x for d in DIMS6 for x in (F.lit(d), F.col(d))]).alias("dim_avgs")
    return flat(df, dtype).select("n_discourses", "n_countries", "n_leaders", "year_min", "year_max", "avg_score", *tops, means)
