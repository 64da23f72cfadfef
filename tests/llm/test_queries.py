import duckdb

from cadenza.llm import queries


def test_queries_equal_their_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{sf}/pages.parquet')")
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, sf)
        result = con.execute(sql)
        assert [d[0] for d in result.description] == df.columns
        assert sorted(map(tuple, df.collect()), key=str) == sorted(result.fetchall(), key=str)


def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES if k.startswith("op")) == [*range(1, 14)]
