"""Every registered query of the graph engine against its SQL in DuckDB, at the smallest scale."""

import os

import duckdb
import pytest

from loomgraph.plans import queries as q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(rows, columns):
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    fixed = lambda v: round(float(v), 6) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else int(v) if isinstance(v, int) and not isinstance(v, bool) else v
    return sorted((tuple(fixed(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = q.QUERIES[name](spark, SF)
    got = plain([tuple(r) for r in df.collect()], df.columns)
    cur = duck.execute(q.ORACLE_SQL[name])
    want = plain(cur.fetchall(), [d[0] for d in cur.description])
    assert got == want


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLE_SQL)))
def test_runs(spark, name):
    df = q.QUERIES[name](spark, SF)
    assert len(df.collect()) >= 0 and df.columns


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
