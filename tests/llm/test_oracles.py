import duckdb
import pytest

from almanac.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        duck.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    relation, df = duck.sql(ORACLE_SQL[name]), QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[i] for i in at)) for r in relation.fetchall()) == sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
