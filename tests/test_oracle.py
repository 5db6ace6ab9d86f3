"""Every query with SQL equals it in DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 5) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    result = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in result.fetchall()), key=repr)
    df = entry.queries()[name](spark, SF)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    assert sorted(df.columns) == sorted(names)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
