"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from voltaflow.plans import registry

SF = "/root/testdata/sf0.001"
#: Some detectors need recordings of more than a few seconds.
LONGER = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return v if v is None or isinstance(v, (int, bool)) else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, oracle, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr)
    rel = oracle.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, name):
    df = registry.queries()[name](spark, LONGER if name.startswith(("dsp23", "dsp24")) else SF)
    assert df.columns and df.count() > 0


def test_entry():
    import __spark_entry__ as entry

    assert registry.FLAGSHIP in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
