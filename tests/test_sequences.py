"""Every registered query of the frame operators against DuckDB on the same tables."""

import os

import duckdb
import pytest

from cadenza.plans import picture_queries, rule_queries, sequences

QUERIES = sequences.QUERIES | rule_queries.QUERIES | picture_queries.QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def rows_of(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", QUERIES)
def test_equals_duckdb(spark, duck, name):
    query, sql = QUERIES[name]
    df = query(spark, SF)
    names = sorted(df.columns)
    result = duck.execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == names
    want = [tuple(r[columns.index(c)] for c in names) for r in result.fetchall()]
    got = [tuple(r[c] for c in names) for r in df.collect()]
    assert len(got) > 0
    assert rows_of(got) == rows_of(want)
