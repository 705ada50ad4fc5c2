"""Every named query against its SQL, on the smallest tables."""

import duckdb
import pytest

from almanac.plans import everything

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}
CATALOGUE = everything()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return connection


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", [n for n, (_, sql) in CATALOGUE.items() if sql])
def test_query_equals_its_sql(spark, duck, name):
    query, sql = CATALOGUE[name]
    df, relation = query(spark, SF), duck.sql(sql)
    columns = sorted(df.columns)
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    assert [TYPES[dict(df.dtypes)[c]] for c in columns] == [str(relation.types[i]) for i in at]
    key = lambda row: tuple(map(repr, row))
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=key)
    assert mine == theirs and mine


def test_simplified_tracks_keep_their_ends(spark):
    rows = CATALOGUE["simplify_tracks"][0](spark, SF).collect()
    points = spark.read.parquet(f"{SF}/embeddings.parquet").groupBy("label").agg({"vec_id": "min"}).collect()
    assert {(r[0], r[1]) for r in points} <= {(r.label, r.vec_id) for r in rows}
