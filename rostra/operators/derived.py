"""What views derive from profiles: ranks, extremes, movers, long forms, outliers, map points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rostra.functions.numeric import r2, rgba, score_rgb, sign_color, signed
from rostra.functions.params import measure, parts, selection
from rostra.operators.profiles import yearly
from rostra.schema import CHOSEN_RADAR, DIMS6, STOPS_LIGHT, dim_country, dim_measure


def ranked(profile: DataFrame, ties: list[str]) -> DataFrame:
    """rank from 1 by falling final score.  The window runs over one row per group, which is small."""
    order = Window.orderBy(F.col("final_score").desc_nulls_last(), *ties)
    return profile.withColumn("rank", F.row_number().over(order).cast("int"))


def medals(df: DataFrame) -> DataFrame:
    return df.withColumn("medal", F.when(F.col("rank") == 1, "gold").when(F.col("rank") == 2, "silver").when(F.col("rank") == 3, "bronze"))


def extremes(profile: DataFrame) -> DataFrame:
    """The highest and the lowest country."""
    top = profile.orderBy(F.col("final_score").desc_nulls_last(), "iso3").limit(1).withColumn("place", F.lit("top"))
    low = profile.orderBy(F.col("final_score").asc_nulls_last(), F.desc("iso3")).limit(1).withColumn("place", F.lit("bottom"))
    return top.unionByName(low).select("place", "iso3", "country", "final_score")


def movers(df: DataFrame, dtype: str = "") -> DataFrame:
    """Last year's rounded mean less the first year's, by country, lowest first."""
    series = yearly(df, dtype=dtype)
    delta = series.groupBy("iso3", "country").agg(F.min_by("score", "year").alias("first"), F.max_by("score", "year").alias("last"))
    return delta.withColumn("delta", r2(F.col("last") - F.col("first"))).orderBy("delta", "iso3")


def long_form(profile: DataFrame, ids: list[str], closed: bool = False) -> DataFrame:
    """A row for each of the six dimensions; ``closed`` repeats the first, as a polygon needs."""
    rows = profile.select(*ids, *DIMS6).unpivot(ids, DIMS6, "dim", "value")
    order = F.array_position(F.array(*map(F.lit, DIMS6)), F.col("dim")).cast("int")
    rows = rows.withColumn("place", order)
    return rows.unionByName(rows.where("place = 1").withColumn("place", F.lit(len(DIMS6) + 1))) if closed else rows


def chosen(profile: DataFrame, names: str, column: str = "country") -> DataFrame:
    """Rows of the named groups; raises ValueError for fewer or more names than a view may hold."""
    return profile.where(F.col(column).isin(selection(parts(names, "|"), *CHOSEN_RADAR)))


def by_one_dimension(profile: DataFrame, dim: str) -> DataFrame:
    return profile.select("country", F.col(measure(dim)).alias("value")).orderBy(F.col("value").asc_nulls_first(), "country")


def trend(series: DataFrame, dim: str) -> DataFrame:
    return series.select("year", F.col(measure(dim)).alias("value")).orderBy("year")


def scatter(profile: DataFrame, x: str, y: str) -> DataFrame:
    """Two measures of each country and the size of its mark."""
    return profile.select("iso3", "country", F.col(measure(x)).alias("x"), F.col(measure(y)).alias("y"), (F.col("final_score") * 0.12 + 9).alias("size"))


def outliers(profile: DataFrame, x: str, y: str) -> DataFrame:
    """Countries to label: the top 3 and bottom 2 by x and the top 2 by y."""
    points = scatter(profile, x, y)

    def ends(column: str, n: int, falling: bool) -> DataFrame:
        by = F.col(column).desc_nulls_last() if falling else F.col(column).asc_nulls_last()
        return points.orderBy(by, F.desc("size") if falling else F.asc("size"), "iso3").limit(n).select("iso3")

    marked = ends("x", 3, True).union(ends("x", 2, False)).union(ends("y", 2, True)).distinct()
    return points.join(marked, "iso3", "left_semi")


def map_points(profile: DataFrame) -> DataFrame:
    """Countries that have a place on the map, with their colour."""
    place = dim_country(profile.sparkSession).select("iso3", "lat", "lon")
    return profile.join(F.broadcast(place), "iso3").select("iso3", "country", "final_score", "lat", "lon", score_rgb(F.col("final_score")).alias("color"))


def labelled_dimensions(rows: DataFrame, language: str = "en") -> DataFrame:
    """Add the label of ``dim`` in a language, else in English, else the key."""
    d = dim_measure(rows.sparkSession)
    label = F.coalesce(F.col(language) if language in ("pt", "en") else F.lit(None), F.col("en"), F.col("dim"))
    return rows.join(F.broadcast(d), F.col("dim") == F.col("key"), "left").withColumn("label", label).drop("key", "pt", "en")


def ascending(profile: DataFrame, light: bool = False) -> DataFrame:
    """Countries by rising final score, with their place, label and colour in a theme."""
    place = F.row_number().over(Window.orderBy(F.col("final_score").asc_nulls_first(), "iso3")).cast("int")
    color = score_rgb(F.col("final_score"), STOPS_LIGHT) if light else score_rgb(F.col("final_score"))
    return profile.select("iso3", "country", "final_score", place.alias("place"), F.format_string("%.1f", "final_score").alias("label"), color.alias("color")).orderBy("place")


def by_name(profile: DataFrame, column: str = "country") -> DataFrame:
    """Names in order, with their place."""
    return profile.select(column, F.row_number().over(Window.orderBy(column)).cast("int").alias("place")).orderBy("place")


def movers_bars(df: DataFrame, dtype: str = "") -> DataFrame:
    """Movers with the label and the colours of their bars."""
    rows = movers(df, dtype)
    return rows.select("iso3", "country", "delta", signed(F.col("delta")).alias("label"), sign_color(F.col("delta")).alias("color"), rgba(sign_color(F.col("delta")), 0.5).alias("faded"))


def collected(series: DataFrame, key: str = "country", order: str = "year", value: str = "score") -> DataFrame:
    """A row for each group: its (order, value) pairs in order, and how many there are."""
    rows = F.array_sort(F.collect_list(F.struct(order, value)))
    return series.groupBy(key).agg(rows.alias("rows")).withColumn("n_rows", F.size("rows"))


def flagged(profile: DataFrame, flags: DataFrame, default: str) -> DataFrame:
    """Add a column of a small lookup table (key, flag), or the default."""
    return profile.join(F.broadcast(flags), F.col("iso3") == F.col("key"), "left").withColumn("flag", F.coalesce("flag", F.lit(default))).drop("key")
