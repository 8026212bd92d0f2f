"""The registered queries: their columns, and those with SQL against DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from rostra.llm import queries as Q

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": ["doc_id", "size", "source_size", "target", "taken"],
    "op3": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    "op4": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op6": ["doc_id", "held_out", "score", "predicted"],
    "op7": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op8": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op9": ["query_id", "rank", "vec_id", "score"],
    "op10": ["doc_id", "fingerprint", "component_id"],
}


def test_all_ten_and_the_pipeline_are_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, name):
    got = Q.QUERIES[name](spark, SF).toPandas()
    want = COLUMNS.get(name.split("_")[0])
    assert len(got) and (want is None or list(got.columns) == want)
    if name in Q.ORACLE_SQL:
        con = duckdb.connect()
        for t in ("documents", "pages"):
            con.execute(f"create view {t} as from '{SF}/{t}.parquet'")
        sql = con.execute(Q.ORACLE_SQL[name]).df()
        by = sorted(sql.columns)
        order = lambda d: d[by].astype(str).sort_values(by, ignore_index=True)
        assert sorted(got.columns) == by and order(got).equals(order(sql))
