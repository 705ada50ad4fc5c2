import math
import random

from pyspark.sql import functions as F

from almanac.llm import queries
from almanac.llm.topk import top_k


def brute(rows, is_query, k):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if is_query(q):
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q)
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_query_equals_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op9_topk_search(spark, sf).collect())) == brute(rows, lambda i: i % 50 == 0, 5)


def test_ties_bad_vectors_and_blocks(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-2, 2) for _ in range(3)]) for i in range(60)] + [(100 + i, [1.0, 0.5, 0.0]) for i in range(40)]
    rows += [(200, None), (201, [1.0, None, 2.0]), (202, [float("nan"), 1.0, 1.0]), (204, [1.0, float("inf"), 1.0]), (None, [1.0, 1.0, 1.0]), (205, [1e6, -1e6, 1e6]), (206, []), (207, [0.5])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(5)
    for k, block in ((1, 7), (5, 1000), (500, 30)):
        found = top_k(table, table.where("vec_id % 3 = 0"), k, block=block).collect()
        assert sorted(map(tuple, found)) == brute(rows, lambda i: i % 3 == 0, k)


def test_large_numbers_stay_exact(spark):
    rows = [(i, [2.0**20 + i, float(i)]) for i in range(20)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, top_k(table, table, 3).collect())) == brute(rows, lambda i: True, 3)


def test_empty(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(table, table, 3).count() == 0
    one = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    assert top_k(one, one, 3).count() == 0 and top_k(one, one.where(F.lit(False)), 3).count() == 0
