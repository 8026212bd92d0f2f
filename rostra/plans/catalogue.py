"""The registered queries of the core engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostra.functions import numeric, text
from rostra.operators import derived, distribution, profiles, scoring, stats
from rostra import schema
from rostra.schema import DIMS6, M7
from rostra.sources import load, testdata
from rostra.sources.testdata import LOADED_SQL, SCORED_SQL, scored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

FROM = f"with scored as ({SCORED_SQL})"


def r2(x: str) -> str:
    return f"round_even({x} * 100, 0) / 100 + 0.0::double"


MEANS = ", ".join(f"{r2(f'avg({m})')} as {m}" for m in M7)
RAW = ", ".join(f"avg({m}) as {m}" for m in M7)
ROUND = ", ".join(f"{r2(m)} as {m}" for m in M7)
TOP = "order by final_score desc nulls last, n desc, leader_name, iso3"
LEADER = "leader_name, leader_short, iso3, country"
CHOSEN_LEADERS = "|".join(f"Customer#{k:09d}" for k in range(1, 41))


def query(sql: str | None = None, fact: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"{FROM} {sql}" if fact else sql
        return f

    return add


def sub(where: str, keys: str, extra: str = "") -> str:
    return f"select {keys}, count(final_score) as n, {MEANS} from scored where {where} {extra} group by {keys}"


# ---- profiles -------------------------------------------------------------------------------------------------------


@query(sub("true", "iso3, country"))
def country_profile(spark, sf_dir):
    return profiles.countries(scored(spark, sf_dir))


@query(sub("dtype = '1-URGENT'", "iso3, country"))
def country_profile_by_dtype(spark, sf_dir):
    return profiles.countries(scored(spark, sf_dir), "1-URGENT")


@query(f"select {LEADER}, n, {ROUND} from (select {LEADER}, count(final_score) as n, {RAW} from scored group by {LEADER} {TOP} limit 25)")
def leader_profile_topn(spark, sf_dir):
    return profiles.leaders(scored(spark, sf_dir))


@query(f"select {LEADER}, n, {ROUND} from (select {LEADER}, count(final_score) as n, {RAW} from scored where iso3 = 'N03' and dtype = '2-HIGH' group by {LEADER} {TOP} limit 10)")
def leader_profile_country(spark, sf_dir):
    return profiles.leaders(scored(spark, sf_dir), "N03", 10, "2-HIGH")


@query(sub("true", LEADER))
def leader_profile_all(spark, sf_dir):
    return numeric.round_frame(profiles.leader_profile(scored(spark, sf_dir)))


@query(sub("true", "year"))
def yearly_global(spark, sf_dir):
    return profiles.yearly_global(scored(spark, sf_dir))


@query(f"select iso3, country, year, {r2('avg(anti_elitism)')} as score from scored where iso3 in ('N01', 'N02', 'N21') and dtype = '5-LOW' group by all")
def yearly_country_dim(spark, sf_dir):
    return profiles.yearly(scored(spark, sf_dir), " N01, N02 ,,N21", "anti_elitism", "5-LOW")


@query(f"select iso3, country, year, {r2('avg(final_score)')} as score from scored group by all")
def yearly_country_all(spark, sf_dir):
    return profiles.yearly(scored(spark, sf_dir), " , ", "no such measure")


@query(f"select leader_name, leader_short, year, {r2('avg(final_score)')} as final_score from scored where leader_name in (select unnest(string_split('{CHOSEN_LEADERS}', '|'))) group by all")
def leader_trend(spark, sf_dir):
    return profiles.leader_trend(scored(spark, sf_dir), CHOSEN_LEADERS)


@query("select dtype, count(final_score) as n from scored group by dtype")
def dtype_counts(spark, sf_dir):
    return profiles.dtypes(scored(spark, sf_dir))


@query("select dtype, count(final_score) as n from scored group by dtype union all select 'ALL', count(final_score) from scored")
def dtype_counts_total(spark, sf_dir):
    return profiles.dtypes_with_total(scored(spark, sf_dir))


# ---- statistics and distributions ------------------------------------------------------------------------------------

TOPS = (
    "(select country from (select iso3, country, avg(final_score) as s from scored {w} group by all order by s desc, iso3 limit 1)) as top_country_name, "
    "(select round_even(s * 10, 0) / 10 from (select iso3, country, avg(final_score) as s from scored {w} group by all order by s desc, iso3 limit 1)) as top_country_score, "
    "(select leader_short from (select leader_name, leader_short, iso3, country, count(final_score) as n, avg(final_score) as s from scored {w} group by all order by s desc, n desc, leader_name, iso3 limit 1)) as top_leader_name, "
    "(select round_even(s * 10, 0) / 10 from (select leader_name, leader_short, iso3, country, count(final_score) as n, avg(final_score) as s from scored {w} group by all order by s desc, n desc, leader_name, iso3 limit 1)) as top_leader_score"
)
TOTALS = "count(*) as n_discourses, count(distinct iso3) as n_countries, count(distinct leader_name) as n_leaders, min(year) as year_min, max(year) as year_max, " + f"{r2('avg(final_score)')} as avg_score, " + ", ".join(f"{r2(f'avg({d})')} as {d}" for d in DIMS6)


@query(f"select {TOTALS}, {TOPS.format(w='')} from scored")
def global_stats(spark, sf_dir):
    return stats.flat(scored(spark, sf_dir))


@query(f"select {TOTALS}, {TOPS.format(w="where dtype = '2-HIGH'")} from scored where dtype = '2-HIGH'")
def global_stats_by_dtype(spark, sf_dir):
    return stats.flat(scored(spark, sf_dir), "2-HIGH")


def five(column: str, keys: str, where: str) -> str:
    q = ", ".join(f"{r2(f'quantile_cont({column}, {p})')} as {k}" for k, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)))
    return f"select {keys}, {r2(f'min({column})')} as min, {q}, {r2(f'max({column})')} as max, {r2(f'avg({column})')} as mean, count({column}) as n from scored where {where} group by all having count({column}) >= 5"


@query(five("anti_elitism", 'country as "group"', "year between 1995 and 2001"))
def distribution_country(spark, sf_dir):
    return distribution.distribution(scored(spark, sf_dir), "anti_elitism", "country", 1995, 2001)


@query(five("final_score", 'dtype as "group"', "year between 2000 and 2025"))
def distribution_dtype(spark, sf_dir):
    return distribution.distribution(scored(spark, sf_dir), "?", "?")


@query(five("anti_elitism", "leader_name, year", "true"))
def distribution_having(spark, sf_dir):
    return numeric.round_frame(distribution.summary(scored(spark, sf_dir), ["leader_name", "year"], "anti_elitism"))


@query(f"""select "group", mean, (q3 - q1) / 2 as half_iqr, n from ({five('final_score', 'country as "group"', 'year between 1995 and 2001')}) order by mean desc, "group" limit 25""")
def distribution_bars(spark, sf_dir):
    return distribution.bars(scored(spark, sf_dir), dim="final_score", year_min=1995, year_max=2001)


# ---- derived ---------------------------------------------------------------------------------------------------------

COUNTRY_RAW = f"select iso3, country, count(final_score) as n, {RAW} from scored group by iso3, country"


@query(f"select iso3, country, cast(row_number() over (order by final_score desc, iso3) as int) as rank, {r2('final_score')} as final_score from ({COUNTRY_RAW})")
def country_rank(spark, sf_dir):
    found = derived.ranked(profiles.profile(scored(spark, sf_dir), ["iso3", "country"]), ["iso3"])
    return numeric.round_frame(found.select("iso3", "country", "rank", "final_score"))


@query(f"select leader_name, iso3, rank, case rank when 1 then 'gold' when 2 then 'silver' when 3 then 'bronze' end as medal, {r2('final_score')} as final_score from (select *, cast(row_number() over ({TOP}) as int) as rank from (select {LEADER}, count(final_score) as n, {RAW} from scored group by {LEADER} {TOP} limit 25))")
def leader_rank_medal(spark, sf_dir):
    keys = ["leader_name", "leader_short", "iso3", "country"]
    top = profiles.profile(scored(spark, sf_dir), keys).orderBy(F.desc_nulls_last("final_score"), F.desc("n"), "leader_name", "iso3").limit(25)
    found = derived.medals(derived.ranked(top, [F.desc("n"), F.col("leader_name"), F.col("iso3")]))
    return numeric.round_frame(found.select("leader_name", "iso3", "rank", "medal", "final_score"))


@query(f"select place, iso3, country, {r2('final_score')} as final_score from ((select 'top' as place, * from ({COUNTRY_RAW}) order by final_score desc, iso3 limit 1) union all (select 'bottom' as place, * from ({COUNTRY_RAW}) order by final_score, iso3 desc limit 1))")
def hero_top_bottom(spark, sf_dir):
    return numeric.round_frame(derived.extremes(profiles.profile(scored(spark, sf_dir), ["iso3", "country"])))


@query(f"select iso3, country, first, last, {r2('(last - first)')} as delta from (select iso3, country, arg_min(score, year) as first, arg_max(score, year) as last from (select iso3, country, year, {r2('avg(final_score)')} as score from scored group by all) group by all)")
def movers(spark, sf_dir):
    return derived.movers(scored(spark, sf_dir))


def long(source: str, ids: str) -> str:
    return " union all ".join(f"select {ids}, '{d}' as dim, {d} as value, {i} as place from ({source})" for i, d in enumerate(DIMS6, 1))


@query(long(sub("true", "iso3, country"), "iso3, country"))
def radar_long(spark, sf_dir):
    return derived.long_form(profiles.countries(scored(spark, sf_dir)), ["iso3", "country"])


RADAR3 = sub("country in (select unnest(['NATION_3', 'NATION_5', 'NATION_7']))", "iso3, country")


@query(f"{long(RADAR3, 'country')} union all select country, '{DIMS6[0]}', {DIMS6[0]}, 7 from ({RADAR3})")
def radar_chosen_closed(spark, sf_dir):
    some = derived.chosen(profiles.countries(scored(spark, sf_dir)), "NATION_5|NATION_3| NATION_7 |NOWHERE")
    return derived.long_form(some, ["country"], closed=True)


@query(long(f"select {LEADER}, n, {ROUND} from (select {LEADER}, count(final_score) as n, {RAW} from scored group by {LEADER} {TOP} limit 25)", "leader_name, iso3"))
def leader_radar_long(spark, sf_dir):
    return derived.long_form(profiles.leaders(scored(spark, sf_dir)), ["leader_name", "iso3"])


LABELS = "case dim when 'people_centrism' then 'Povo-Centrismo' when 'anti_elitism' then 'Anti-Elitismo' when 'moral_dichotomy' then 'Dicotomia Moral' when 'popular_sovereignty' then 'Soberania Popular' when 'exclusionary_rhetoric' then 'Retórica Excludente' else 'Retórica de Crise' end"


@query(f"select year, dim, {LABELS} as label, value from ({long(sub('true', 'year'), 'year')})")
def dimension_labels(spark, sf_dir):
    return derived.labelled_dimensions(derived.long_form(profiles.yearly_global(scored(spark, sf_dir)), ["year"]), "pt").select("year", "dim", "label", "value")


COUNTRY = sub("true", "iso3, country")


@query(f"select country, exclusionary_rhetoric as value from ({COUNTRY})")
def dimension_bars(spark, sf_dir):
    return derived.by_one_dimension(profiles.countries(scored(spark, sf_dir)), "exclusionary_rhetoric")


@query(f"select year, crisis_rhetoric as value from ({sub('true', 'year')})")
def global_trend(spark, sf_dir):
    return derived.trend(profiles.yearly_global(scored(spark, sf_dir)), "crisis_rhetoric")


SCATTER = f"select iso3, country, people_centrism as x, anti_elitism as y, final_score * 0.12::double + 9 as size from ({COUNTRY})"


@query(SCATTER)
def scatter_points(spark, sf_dir):
    return derived.scatter(profiles.countries(scored(spark, sf_dir)), "people_centrism", "anti_elitism")


@query(f", points as ({SCATTER}) select * from points where iso3 in ((select iso3 from points order by x desc, size desc, iso3 limit 3) union (select iso3 from points order by x, size, iso3 limit 2) union (select iso3 from points order by y desc, size desc, iso3 limit 2))")
def scatter_outliers(spark, sf_dir):
    return derived.outliers(profiles.countries(scored(spark, sf_dir)), "people_centrism", "anti_elitism")


def channel(s: str, k: int, scale: str = "STOPS_DARK") -> str:
    stops = getattr(schema, scale)
    arms = "".join(f"when {s} <= {b[0]} then cast(floor({a[k + 1]}.0::double + ({s} - {a[0]}.0::double) / {b[0] - a[0]}.0::double * {b[k + 1] - a[k + 1]}.0::double + 0.5::double) as int) " for a, b in zip(stops, stops[1:]))
    return f"case {arms}end"


@query(f"select leader_name, year, concat('rgb(', {channel('s', 0)}, ',', {channel('s', 1)}, ',', {channel('s', 2)}, ')') as color from (select leader_name, year, greatest(0, least(100, coalesce({r2('avg(anti_elitism)')}, 0))) as s from scored group by all)")
def score_color(spark, sf_dir):
    means = scored(spark, sf_dir).groupBy("leader_name", "year").agg(numeric.r2(F.avg("anti_elitism")).alias("s"))
    return means.select("leader_name", "year", numeric.score_rgb(F.col("s")).alias("color"))


@query("select discourse_id, count(*) as n, max(case when final_score < 30 then 'Low' when final_score < 50 then 'Moderate' when final_score < 65 then 'High' else 'Very High' end) as band from scored group by discourse_id")
def score_band(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("discourse_id").agg(F.count(F.lit(1)).alias("n"), F.max(numeric.score_band(F.col("final_score"))).alias("band"))


CODES = "['BRA', 'ARG', 'CHL', 'MEX', 'PER', 'COL', 'VEN', 'BOL']"
PLACES = "(values ('BRA', -14, -51), ('ARG', -34, -64), ('CHL', -35, -71), ('MEX', 23, -102), ('PER', -10, -76), ('COL', 4, -72), ('VEN', 7, -66)) as t(code, la, lo)"


@query(f"select code as iso3, country, final_score, la::double as lat, lo::double as lon, concat('rgb(', {channel('final_score', 0)}, ',', {channel('final_score', 1)}, ',', {channel('final_score', 2)}, ')') as color from ({COUNTRY}) join {PLACES} on code = case when iso3 < 'N07' then {CODES}[cast(substr(iso3, 2) as int) + 1] else iso3 end")
def map_points(spark, sf_dir):
    """Seven nations play countries that have a place on the map; the others have none and are left out."""
    codes = F.array(*[F.lit(c) for c in ("BRA", "ARG", "CHL", "MEX", "PER", "COL", "VEN")])
    known = F.when(F.col("iso3") < "N07", F.element_at(codes, F.substring("iso3", 2, 2).cast("int") + 1)).otherwise(F.col("iso3"))
    return derived.map_points(profiles.countries(scored(spark, sf_dir)).withColumn("iso3", known))


# ---- sources, SQL, text ----------------------------------------------------------------------------------------------


@query("select iso3, leader_name, year, dtype, count(*) as n, " + ", ".join(f"{r2(f'sum({m})')} as {m}" for m in ("final_score", "crisis_rhetoric")) + " from scored group by all")
def inner_join_scores(spark, sf_dir):
    sums = [numeric.r2(F.sum(m)).alias(m) for m in ("final_score", "crisis_rhetoric")]
    return scored(spark, sf_dir).groupBy("iso3", "leader_name", "year", "dtype").agg(F.count(F.lit(1)).alias("n"), *sums)


@query("select distinct iso3, country from scored")
def country_label_fallback(spark, sf_dir):
    return scored(spark, sf_dir).select("iso3", "country").distinct()


@query(f"select iso3, {r2('avg(final_score)')} as avg_score, count(*) as n from scored where final_score is not null group by iso3")
def sql_adhoc_avg(spark, sf_dir):
    return spark.sql("select iso3, rint(avg(final_score) * 100) / 100 as avg_score, count(*) as n from {fact} where final_score is not null group by iso3 order by avg_score desc", fact=scored(spark, sf_dir))


@query("select nullif(iso3, 'N05') as iso3, count(final_score) as n from scored where iso3 <> 'N05' group by all")
def dropna_groups(spark, sf_dir):
    some = scored(spark, sf_dir).withColumn("iso3", F.nullif(F.col("iso3"), F.lit("N05")))
    return some.dropna(subset=["iso3"]).groupBy("iso3").agg(F.count("final_score").alias("n"))


WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"


@query(f"select doc_id, cast(len({WORDS}) as int) as word_count from documents", fact=False)
def doc_word_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.word_count("text").alias("word_count"))


@query(
    f"with w as (select doc_id, {WORDS} as words from documents), c as (select doc_id, words, unnest(range(0, cast(ceil(len(words) / 200.0) as int))) as chunk from w) "
    "select doc_id, cast(chunk as int) as chunk, cast(len(words[chunk * 200 + 1:chunk * 200 + 200]) as int) as n_words, md5(array_to_string(words[chunk * 200 + 1:chunk * 200 + 200], ' ')) as digest from c",
    fact=False,
)
def doc_chunks(spark, sf_dir):
    return scoring.chunked(table(spark, sf_dir, "documents")).select("doc_id", "chunk", "n_words", F.md5("text").alias("digest"))


CHUNKS = f"w as (select doc_id, {WORDS} as words from documents), c as (select doc_id, words, unnest(range(0, cast(ceil(len(words) / 200.0) as int))) as chunk from w), k as (select doc_id, words[chunk * 200 + 1:chunk * 200 + 200] as words from c)"
SHARES = ", ".join(f"100.0::double * len(list_filter(words, lambda x: lower(x[1]) = '{d[0]}')) / len(words) as {d}" for d in DIMS6)


@query(
    f"with {CHUNKS}, s as (select doc_id, {SHARES} from k), g as (select doc_id, count(*)::int as n_chunks, {', '.join(f'avg({d}) as {d}' for d in DIMS6)} from s group by doc_id) "
    f"select doc_id, n_chunks, {', '.join(f'{r2(d)} as {d}' for d in DIMS6)}, {r2('((' + ' + '.join(DIMS6) + ') / 6.0::double)')} as final_score from g",
    fact=False,
)
def doc_scores(spark, sf_dir):
    """The whole text pipeline with the stand-in scorer."""
    rows = scoring.chunked(table(spark, sf_dir, "documents"))
    return numeric.round_frame(scoring.combined(scoring.scored_chunks(rows, scoring.marker_scorer)))


# ---- the published tables: scores joined with documents, or one table of both ------------------------------------------


def loaded(select: str) -> str:
    return f"with scored as (select * from ({LOADED_SQL}) where final_score is not null and dtype <> 'INVALID') {select}"


def _views(spark, sf_dir):
    testdata.scores(spark, sf_dir).createOrReplaceTempView("scores")
    testdata.discourses(spark, sf_dir).createOrReplaceTempView("discourses")


def _from_catalog(spark, **tables):
    """The fact that the loader makes of these views, which go again once it is planned."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    try:
        return load.load_scored(spark, cached=False)
    finally:
        for name in tables:
            spark.catalog.dropTempView(name)


def _joined(spark, sf_dir):
    return _from_catalog(spark, scores=testdata.scores(spark, sf_dir), discourses=testdata.discourses(spark, sf_dir))


@query(loaded(sub("true", "iso3, country")), fact=False)
def loaded_country_profile(spark, sf_dir):
    """Scores joined with documents: invalid and missing types and missing scores go, NaN counts as missing."""
    return profiles.countries(_joined(spark, sf_dir))


@query(loaded(f"select {LEADER}, n, {ROUND} from (select {LEADER}, count(final_score) as n, {RAW} from scored group by {LEADER} {TOP} limit 25)"), fact=False)
def loaded_leader_profile(spark, sf_dir):
    return profiles.leaders(_joined(spark, sf_dir))


@query(f"with scored as ({LOADED_SQL}) " + sub("true", "iso3, country"), fact=False)
def web_data_profile(spark, sf_dir):
    """One table of both is taken as it is, where the catalog has it, before scores and documents."""
    s, d = testdata.scores(spark, sf_dir), testdata.discourses(spark, sf_dir)
    both = s.join(d, F.col("id") == F.col("discourse_id")).withColumnRenamed("discourse_year", "year").drop("id")
    return profiles.countries(_from_catalog(spark, web_data=both, scores=s, discourses=d))


@query(f"with scored as ({LOADED_SQL}) select iso3, {r2('avg(final_score)')} as avg_score, count(*) as n from scored where final_score is not null group by iso3", fact=False)
def sql_documented(spark, sf_dir):
    """The documented ad-hoc statement over both tables; rounding as everywhere here."""
    text = "select d.iso3, rint(avg(s.final_score) * 100) / 100 as avg_score, count(*) as n from {scores} s join {discourses} d on d.id = s.discourse_id where s.final_score is not null group by d.iso3 order by avg_score desc"
    return spark.sql(text, scores=testdata.scores(spark, sf_dir), discourses=testdata.discourses(spark, sf_dir))


@query("select unnest(['discourses', 'scores']) as name", fact=False)
def catalog_tables(spark, sf_dir):
    """The catalog's listing of the two published tables."""
    _views(spark, sf_dir)
    try:
        names = sorted(load.tables(spark) & {"scores", "discourses"})
    finally:
        for name in ("scores", "discourses"):
            spark.catalog.dropTempView(name)
    return spark.createDataFrame([(n,) for n in names], "name string")


@query(loaded("select discourse_id, iso3, country, leader_name, year, dtype as discourse_type, final_score, count(*) as n from scored group by all"), fact=False)
def export_rows(spark, sf_dir):
    """The published spreadsheet's columns, equal rows counted."""
    d, s = testdata.discourses(spark, sf_dir), testdata.scores(spark, sf_dir)
    ids = s.join(d, F.col("id") == F.col("discourse_id")).where("final_score is not null and dtype <> 'INVALID'").withColumnRenamed("discourse_year", "year")
    rows = load.exported(load.labelled(ids))
    return rows.groupBy("discourse_id", "iso3", "country", "leader_name", "year", "discourse_type", "final_score").agg(F.count(F.lit(1)).alias("n"))


@query(f"select {TOTALS}, {TOPS.format(w='')} from scored")
def stats_nested(spark, sf_dir):
    """The nested statistics, opened again: structs of the top groups and a map of means."""
    nested = stats.stats(scored(spark, sf_dir))
    tops = [F.col(f"{t}.{k}").alias(f"{t}_{k}") for t in ("top_country", "top_leader") for k in ("name", "score")]
    return nested.select("n_discourses", "n_countries", "n_leaders", "year_min", "year_max", "avg_score", *[F.element_at("dim_avgs", F.lit(d)).alias(d) for d in DIMS6], *tops)


@query("select dtype, count(final_score) as n from scored group by dtype")
def json_records(spark, sf_dir):
    """Records as JSON text, and read again."""
    rows = load.json_rows(profiles.dtypes(scored(spark, sf_dir)))
    return rows.select(F.from_json("json", "dtype string, n bigint").alias("r")).select("r.dtype", "r.n")


# ---- views ---------------------------------------------------------------------------------------------------------------


def shown(x: str) -> str:
    return f"printf('%.1f', {x})"


def light(s: str, k: int) -> str:
    return channel(s, k, "STOPS_LIGHT")


@query(f"select iso3, country, final_score, cast(row_number() over (order by final_score, iso3) as int) as place, concat('rgb(', {{0}}, ',', {{1}}, ',', {{2}}, ')') as color from ({COUNTRY})".format(*[light("final_score", k) for k in range(3)]))
def country_ascending_light(spark, sf_dir):
    return derived.ascending(profiles.countries(scored(spark, sf_dir)), light=True).drop("label")


@query(f"select country, cast(row_number() over (order by encode(country)) as int) as place from (select distinct country from scored)")
def countries_by_name(spark, sf_dir):
    return derived.by_name(profiles.countries(scored(spark, sf_dir)))


@query("select iso3, country, delta, case when delta >= 0 then '#F87171' else '#4ADE80' end as color, case when delta >= 0 then 'rgba(248,113,113,0.5)' else 'rgba(74,222,128,0.5)' end as faded from (" + ORACLE_SQL["movers"].removeprefix(FROM) + ")")
def movers_bars(spark, sf_dir):
    return derived.movers_bars(scored(spark, sf_dir)).drop("label")


@query("select dtype, count(final_score) as n, case when count(final_score) >= 1000 then printf('%.1fk', count(final_score) / 1000.0::double) else cast(count(final_score) as varchar) end as short, replace(format('{:,}', count(final_score)), ',', '.') as grouped from scored group by dtype")
def dtype_chips(spark, sf_dir):
    rows = profiles.dtypes(scored(spark, sf_dir))
    return rows.select("dtype", "n", numeric.short_count(F.col("n")).alias("short"), numeric.thousands(F.col("n")).alias("grouped"))


@query(f"select country, string_agg(concat(year, ':', cast(cast(round_even(score * 100, 0) as int) as varchar)), ' ' order by year) as series, cast(count(*) as int) as n_rows from (select country, year, {r2('avg(final_score)')} as score from scored group by all) group by country")
def series_by_country(spark, sf_dir):
    """The rows of each group in order, and how many there are."""
    found = derived.collected(profiles.yearly(scored(spark, sf_dir)))
    pairs = F.transform("rows", lambda r: F.concat_ws(":", r["year"].cast("string"), F.rint(r["score"] * 100).cast("int").cast("string")))
    return found.select("country", F.array_join(pairs, " ").alias("series"), "n_rows")


@query(f"select iso3, country, case iso3 when 'N01' then 'one' when 'N02' then 'two' else '-' end as flag from ({COUNTRY})")
def country_flags(spark, sf_dir):
    flags = spark.createDataFrame([("N01", "one"), ("N02", "two"), ("N99", "none")], "key string, flag string")
    return derived.flagged(profiles.countries(scored(spark, sf_dir)), flags, "-").select("iso3", "country", "flag")


# ---- scored texts in the profiles -----------------------------------------------------------------------------------------

KIND = "case when len(words) >= 300 then 'SPEECH' when len(words) >= 40 then 'LETTER' else 'INVALID' end"
TEXTS = (
    f"with {CHUNKS}, s as (select doc_id, {SHARES} from k), g as (select doc_id, {', '.join(f'avg({d}) as {d}' for d in DIMS6)} from s group by doc_id), "
    f"scored as (select lang as iso3, lang as country, source as leader_name, source as leader_short, {KIND} as dtype, g.*, (({' + '.join(DIMS6)}) / 6.0::double) as final_score from g join w using (doc_id) join documents using (doc_id) where {KIND} <> 'INVALID') "
)


def _scored_texts(spark, sf_dir):
    """Documents classified by their length, chunked, scored and combined, as a fact of languages and sources."""
    docs = table(spark, sf_dir, "documents")
    n = text.word_count("text")
    kinds = scoring.classified(docs, F.when(n >= 300, "SPEECH").when(n >= 40, "LETTER").otherwise("INVALID")).where("dtype <> 'INVALID'")
    scores = scoring.combined(scoring.scored_chunks(scoring.chunked(kinds), scoring.marker_scorer)).withColumnRenamed("doc_id", "__id")
    rows = kinds.select("doc_id", F.col("lang").alias("iso3"), F.col("lang").alias("country"), F.col("source").alias("leader_name"), F.col("source").alias("leader_short"), "dtype")
    return rows.join(scores, F.col("doc_id") == F.col("__id")).drop("__id")


@query(TEXTS + sub("true", "iso3, country"), fact=False)
def text_country_profile(spark, sf_dir):
    return profiles.countries(_scored_texts(spark, sf_dir))


@query(TEXTS + f"select {LEADER}, n, {ROUND} from (select {LEADER}, count(final_score) as n, {RAW} from scored where dtype = 'SPEECH' group by {LEADER} {TOP} limit 25)", fact=False)
def text_leader_profile(spark, sf_dir):
    return profiles.leaders(_scored_texts(spark, sf_dir), dtype="SPEECH")
