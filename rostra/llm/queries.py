"""The registered queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostra.llm import avi, hnsw, kneser_ney, mixing, packing, sharding, simhash, warc
from rostra.llm import toxicity as tox
from rostra.llm.common import stored, table
from rostra.llm.licenses import licenses

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tox.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~tox.held_out())
    return out.select("doc_id", tox.held_out().alias("held_out"), "score", "predicted")


@query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.filter("places", lambda p: p["kind"] == "base")
    starts = F.transform(base, lambda p: p["word"])
    return licenses(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(base, lambda p: p["label"]))), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


@query
def op3_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.digests(table(spark, sf_dir, "documents"))


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"))


@query
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents")).drop("source")


ORACLE_SQL["op1_mix_sources"] = r"""
with docs as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    md5(concat('mix:', coalesce(cast(doc_id as varchar), ''), ':', md5(coalesce(text, '')))) as digest,
    coalesce(greatest(0.1::double, 1.0::double - 5.0::double *
      ((length(text) - length(translate(text, '#$%&*|!^~<>={}[]@+', '')))::double / nullif(length(text), 0)::double)), 1.0::double) as weight
  from documents),
keyed as (
  select doc_id, source, size,
    -ln(((('0x' || substr(digest, 1, 13))::bigint)::double + 0.5::double) / 4503599627370496.0::double) / weight as key
  from docs),
sizes as (select source, sum(size)::bigint as source_size from keyed group by source),
ranked as (
  select *, [5.0::double, 2.0::double, 1.0::double][((row_number() over (order by encode(source) nulls last) - 1) % 3 + 1)::int] as weight,
    source_size * 3.0::double as cap
  from sizes),
line as (
  select *, (sum(source_size) over ())::double as everything, sum(weight) over () as weights,
    coalesce(sum(cap) over w, 0) as caps, coalesce(sum(weight) over w, 0) as used
  from ranked
  window w as (order by cap / weight, encode(source) nulls last rows between unbounded preceding and 1 preceding)),
rates as (select *, (everything - caps) / (weights - used) as rate from line),
free as (select *, cap > weight * rate as is_free from rates),
goals as (
  select source, source_size,
    case when is_free then weight * max(case when is_free then rate end) over () else cap end as target
  from free),
parts as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end as epochs from goals),
ordered as (
  select k.*, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size as rest,
    sum(size) over (partition by k.source order by key range between unbounded preceding and current row) as until,
    sum(size) over (partition by k.source, key) as alike
  from keyed k join parts p on k.source is not distinct from p.source)
select doc_id, size, source_size, target,
  (size * (epochs + case when until <= rest or until - alike / 2.0::double <= rest then 1 else 0 end))::bigint as taken
from ordered
"""


@query
def op7_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


@query
def op10_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.as_hex().alias("fingerprint"), "component_id")


@query
def op9_hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.search_all(table(spark, sf_dir, "embeddings"))


@query
def op5_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kneser_ney.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "lang", F.exp("log_ppl").alias("perplexity"), F.exp("high").alias("threshold"), "kept")


@query
def op2_warc_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as records of an archive, against a replica in which a fiftieth of the records is damaged and a few are lost.

    Both archives are written and read back.  Each record's number decides damage and loss, so that the audit has
    something to find at every size.
    """
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType.simpleString()
    first = warc.archive(pages)
    rows = stored(warc.read(spark, first, kind), "warc-first")
    damaged = F.when(warc.number() % 50 == 7, F.replace("record", F.lit("\r\nContent-Type: text/html\r\n"), F.lit("\r\nContent-Type: text/htmL\r\n"))).otherwise(F.col("record"))
    second = warc.replica(spark, first, damaged, warc.number() % 211 == 3)
    out = warc.audited(rows, stored(warc.read(spark, second, kind), "warc-second"))
    return out.select("page_id", F.col("file").alias("warc_file"), F.col("offset").alias("record_offset"), F.col("length").alias("record_length"), F.col("hash").alias("record_sha256"), "status")


ORACLE_SQL["op2_warc_merkle_audit"] = r"""
with made as (
  select page_id, concat('WARC/1.0', chr(13), chr(10), 'WARC-Type: resource', chr(13), chr(10), 'WARC-Record-ID: <urn:page:',
      coalesce(cast(page_id as varchar), 'null'), '>', chr(13), chr(10), 'WARC-Target-URI: ', replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A'), chr(13), chr(10),
      'Content-Type: text/html', chr(13), chr(10), 'Content-Length: ', strlen(coalesce(html, '')), chr(13), chr(10), chr(13), chr(10),
      coalesce(html, ''), chr(13), chr(10), chr(13), chr(10)) as record
  from pages),
hashed as (
  select *, ('0x' || substr(hash, 1, 13))::bigint as number from (select page_id, record, strlen(record)::bigint as length, sha256(record) as hash from made)),
dealt as (select *, (number % (select greatest(1, ceil(sum(length) / 16777216.0))::bigint from hashed))::int as file from hashed)
select page_id, file as warc_file,
  coalesce(sum(length) over (partition by file order by number, record rows between unbounded preceding and 1 preceding), 0)::bigint as record_offset,
  length as record_length, hash as record_sha256,
  case when number % 211 = 3 then 'missing' when number % 50 = 7 then 'changed' else 'ok' end as status
from dealt
"""
