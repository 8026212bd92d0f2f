"""The star schema of the test tables as the fact table."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostra.functions.numeric import lookup
from rostra.schema import DIMS6

#: Order priority that stands for the invalid type.
INVALID = "4-NOT SPECIFIED"
_held: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def names(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Labels of codes: of the first 20 nations, so that some codes have none.  There are 25 nations at every scale."""
    rows = table(spark, sf_dir, "nation").where("n_nationkey < 20").select("n_nationkey", "n_name").collect()
    return {f"N{r.n_nationkey:02d}": r.n_name for r in rows}


def build(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, orders, customer, nation, part = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation", "part"))
    joined = (
        line.join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(customer, F.col("c_custkey") == F.col("o_custkey"))
        .join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
        .join(part, F.col("p_partkey") == F.col("l_partkey"))
        .where(F.col("o_orderpriority") != INVALID)
    )
    iso3 = F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))
    measures = {
        "people_centrism": F.col("l_quantity") * 2,
        "anti_elitism": F.nullif(F.col("l_discount") * 1000, F.lit(0.0)),
        "moral_dichotomy": F.col("l_tax") * 1250,
        "popular_sovereignty": F.col("l_extendedprice") / 1050,
        "exclusionary_rhetoric": F.col("o_totalprice") / 5000,
        "crisis_rhetoric": F.col("p_size").cast("double") * 2,
    }
    total = measures[DIMS6[0]] + F.coalesce(measures[DIMS6[1]], F.lit(0.0))
    for d in DIMS6[2:]:
        total = total + measures[d]
    return joined.select(
        F.col("o_orderkey").alias("discourse_id"),
        iso3.alias("iso3"),
        lookup(iso3, names(spark, sf_dir)).alias("country"),
        F.col("c_name").alias("leader_name"),
        F.col("c_name").alias("leader_short"),
        F.year("o_orderdate").cast("int").alias("year"),
        F.col("o_orderpriority").alias("dtype"),
        *[c.alias(k) for k, c in measures.items()],
        (total / 6).alias("final_score"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact; the one that hold() keeps, if it does."""
    return _held.get((spark.sparkContext.applicationId, sf_dir)) or build(spark, sf_dir)


def hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build the fact once for all later queries of this session, in memory as far as it fits and else on disk."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _held:
        _held[key] = build(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
        _held[key].count()
    return _held[key]


#: The same fact in DuckDB.
SCORED_SQL = """
  select o_orderkey as discourse_id, concat('N', lpad(cast(n_nationkey as varchar), 2, '0')) as iso3,
    coalesce(case when n_nationkey < 20 then n_name end, concat('N', lpad(cast(n_nationkey as varchar), 2, '0'))) as country,
    c_name as leader_name, c_name as leader_short, cast(year(o_orderdate) as int) as year, o_orderpriority as dtype,
    l_quantity * 2 as people_centrism, nullif(l_discount * 1000, 0) as anti_elitism, l_tax * 1250 as moral_dichotomy,
    l_extendedprice / 1050 as popular_sovereignty, o_totalprice / 5000 as exclusionary_rhetoric, cast(p_size as double) * 2 as crisis_rhetoric,
    (l_quantity * 2 + coalesce(nullif(l_discount * 1000, 0), 0) + l_tax * 1250 + l_extendedprice / 1050 + o_totalprice / 5000 + cast(p_size as double) * 2) / 6 as final_score
  from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey
    join nation on n_nationkey = c_nationkey join part on p_partkey = l_partkey
  where o_orderpriority <> '4-NOT SPECIFIED'
"""


def discourses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents, in the shape of the published table; one in eleven has no type, and NaN is in no column here."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = orders.join(customer, F.col("c_custkey") == F.col("o_custkey")).join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
    dtype = F.when(F.col("o_orderkey") % 11 != 0, F.when(F.col("o_orderpriority") == INVALID, "INVALID").otherwise(F.col("o_orderpriority")))
    codes = F.array(*[F.lit(c) for c in ("BRA", "ARG", "CHL", "MEX", "PER", "COL", "VEN")])
    iso3 = F.when(F.col("n_nationkey") < 7, F.element_at(codes, F.col("n_nationkey") + 1)).otherwise(F.col("n_name"))
    return rows.select(F.col("o_orderkey").cast("string").alias("id"), iso3.alias("iso3"), F.col("c_name").alias("leader_name"), F.year("o_orderdate").cast("int").alias("discourse_year"), dtype.alias("dtype"), F.length("c_name").cast("int").alias("word_count"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as scores, in the shape of the published table; some measures are NaN, some final scores null."""
    line = table(spark, sf_dir, "lineitem")
    q, nan = F.col("l_quantity"), F.lit(float("nan"))
    values = {
        "people_centrism": q * 2,
        "anti_elitism": F.when(F.col("l_discount") == 0, nan).otherwise(F.col("l_discount") * 1000),
        "moral_dichotomy": F.col("l_tax") * 1250,
        "popular_sovereignty": F.col("l_extendedprice") / 1050,
        "exclusionary_rhetoric": 100 - q,
        "crisis_rhetoric": F.when(q == 7, nan).otherwise(q),
        "final_score": F.when(q != 50, q + F.col("l_tax") * 100),
    }
    return line.select(F.col("l_orderkey").cast("string").alias("discourse_id"), *[c.alias(k) for k, c in values.items()], F.col("l_linenumber").cast("int").alias("n_chunks"))


#: The same two tables in DuckDB, joined, labelled and with NaN as null.
LOADED_SQL = """
  select d.iso3, coalesce(n.name, d.iso3) as country, d.leader_name, d.leader_name as leader_short, d.discourse_year as year, d.dtype, s.*
  from (
    select cast(l_orderkey as varchar) as discourse_id, l_quantity * 2 as people_centrism, case when l_discount <> 0 then l_discount * 1000 end as anti_elitism,
      l_tax * 1250 as moral_dichotomy, l_extendedprice / 1050 as popular_sovereignty, 100 - l_quantity as exclusionary_rhetoric,
      case when l_quantity <> 7 then l_quantity end as crisis_rhetoric, case when l_quantity <> 50 then l_quantity + l_tax * 100 end as final_score
    from lineitem) s
  join (
    select cast(o_orderkey as varchar) as id, c_name as leader_name, cast(year(o_orderdate) as int) as discourse_year,
      case when n_nationkey < 7 then ['BRA', 'ARG', 'CHL', 'MEX', 'PER', 'COL', 'VEN'][n_nationkey + 1] else n_name end as iso3,
      case when o_orderkey % 11 <> 0 then case when o_orderpriority = '4-NOT SPECIFIED' then 'INVALID' else o_orderpriority end end as dtype
    from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey) d on d.id = s.discourse_id
  left join (values ('BRA', 'Brazil'), ('ARG', 'Argentina'), ('CHL', 'Chile'), ('MEX', 'Mexico'), ('PER', 'Peru'), ('COL', 'Colombia'), ('VEN', 'Venezuela')) as n(code, name) on n.code = d.iso3
"""
