"""Every core query against its SQL twin on the same tables."""

import math

import duckdb
import pytest

from brightledger.plans import basics, filings, portal, registry, texts  # noqa: F401

BASE = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{BASE}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


def ordered(rows):
    return sorted([tuple(plain(x) for x in r) for r in rows], key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, BASE)
    columns = sorted(got.columns)
    rows = got.select(*columns).collect()
    if name not in registry.SQL:
        assert columns and len(set(columns)) == len(columns)
        return
    want = duck.sql(registry.SQL[name])
    assert sorted(want.columns) == columns
    place = [want.columns.index(c) for c in columns]
    assert ordered(rows) == ordered([[r[i] for i in place] for r in want.fetchall()])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["custkey", "yr", "total", "prior_total", "yoy_pct"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_pages_of_larger_tables_are_more_tasks(spark):
    assert texts._dealt(spark.range(20 * texts.REPORTS)).rdd.getNumPartitions() == 20
