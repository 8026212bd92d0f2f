"""Group profiles and series: counts and means over the fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostra.functions.numeric import r2, round_frame
from rostra.functions.params import by_dtype, measure, parts
from rostra.schema import M7


def _desc(c: str) -> Column:
    return F.col(c).desc_nulls_last()


def profile(df: DataFrame, keys: list[str]) -> DataFrame:
    """n (documents with a final score) and the mean of each measure by group; rows with a null key are dropped."""
    return df.dropna(subset=keys).groupBy(*keys).agg(F.count("final_score").alias("n"), *[F.avg(m).alias(m) for m in M7])


def countries(df: DataFrame, dtype: str = "") -> DataFrame:
    """Ordered by the mean before rounding."""
    return round_frame(profile(by_dtype(df, dtype), ["iso3", "country"]).orderBy(_desc("final_score"), "iso3"))


def leader_profile(df: DataFrame) -> DataFrame:
    return profile(df, ["leader_name", "leader_short", "iso3", "country"])


def leaders(df: DataFrame, country: str = "ALL", n: int = 25, dtype: str = "") -> DataFrame:
    """The n leaders with the highest means; of equal ones those with more documents come first."""
    found = leader_profile(by_dtype(df, dtype))
    if country != "ALL":
        found = found.where(F.col("iso3") == country)
    return round_frame(found.orderBy(_desc("final_score"), F.desc("n"), "leader_name", "iso3").limit(max(0, n)))


def yearly_global(df: DataFrame, dtype: str = "") -> DataFrame:
    return round_frame(profile(by_dtype(df, dtype), ["year"]).orderBy("year"))


def yearly(df: DataFrame, countries: str = "", dim: str = "final_score", dtype: str = "") -> DataFrame:
    """Mean of one measure by country and year; no listed country means every country."""
    sub, chosen, keys = by_dtype(df, dtype), parts(countries, ","), ["iso3", "country", "year"]
    sub = sub.where(F.col("iso3").isin(chosen)) if chosen else sub
    return sub.dropna(subset=keys).groupBy(*keys).agg(r2(F.avg(measure(dim))).alias("score")).orderBy(*keys)


def leader_trend(df: DataFrame, names: str = "", dtype: str = "") -> DataFrame:
    """Mean by leader's name and year, over all countries of that name; no name means no rows."""
    keys = ["leader_name", "leader_short", "year"]
    sub = by_dtype(df, dtype).where(F.col("leader_name").isin(parts(names, "|")))
    return sub.dropna(subset=keys).groupBy(*keys).agg(r2(F.avg("final_score")).alias("final_score")).orderBy(*keys)


def dtypes(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["dtype"]).groupBy("dtype").agg(F.count("final_score").alias("n")).orderBy(F.desc("n"), "dtype")


def dtypes_with_total(df: DataFrame) -> DataFrame:
    """The counts and their sum as the type ALL."""
    counts = dtypes(df)
    return counts.unionByName(counts.agg(F.lit("ALL").alias("dtype"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n")))
