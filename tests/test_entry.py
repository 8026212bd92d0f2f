import duckdb
import pytest

import __spark_entry__ as entry
from rostra.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"]


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.count() > 0 and rows.columns[:3] == ["iso3", "country", "n"]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_core_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as from '{SF}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    by = sorted(want.columns)
    order = lambda d: d[by].astype(str).sort_values(by, ignore_index=True)
    assert order(got).equals(order(want))
    assert len(got) or name in ("leader_profile_country",)
