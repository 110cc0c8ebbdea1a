"""Some registered queries against their SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from factloom.plans import registry
from factloom.sources.tables import BASE_TABLES

SMALL = "/root/testdata/sf0.001"
NAMES = ["k1_redact", "k9_site_inventory", "a4_incremental_diff", "a7_latest_version_wins", "a14_ingest_json_facts", "c17_overload_match", "g9_callback_replay", "e5_route_table"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    df = entry_point.queries()[name](spark, SMALL)
    cur = duck.execute(entry_point.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted((tuple(map(str, r)) for r in cur.fetchall()))
    assert sorted(tuple(map(str, r)) for r in df.select(*[f"`{n}`" for n in names]).collect()) == want


def test_flagship(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["code", "n"]
    assert df.count() > 0


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())
