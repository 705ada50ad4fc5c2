import heapq
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from almanac.llm import mixing, queries


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, epochs=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weigh = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    pool, capped = share * sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in capped]
        left = pool - sum(epochs * sizes[s] for s in capped)
        goal = {s: left * weigh[s] / sum(weigh[x] for x in rest) for s in rest}
        over = {s for s in rest if goal[s] > epochs * sizes[s]}
        if not over:
            return {s: epochs * sizes[s] if s in capped else goal[s] for s in names}
        capped |= over


def check(found, texts, block=16):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = defaultdict(int), defaultdict(int)
    for (i, s), own in texts.items():
        sizes[s] += sum(map(size, own))
    goals = brute_targets(sizes)
    source = {i: s for i, s in texts}
    for r in found:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(goals[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - goals[s]) <= 2 * block, (s, taken[s], goals[s])


def test_query_meets_targets(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    texts = {(r.doc_id, r.source): [r.text] for r in rows}
    found = queries.op7_mixing(spark, sf).collect()
    assert len(found) == len(rows)
    check(found, texts)
    assert sorted(found) == sorted(queries.op7_mixing(spark, sf).collect())


def test_many_shards_meet_targets(spark):
    rows = [(i, "w " * (i % 37), f"s{i % 4}", "x") for i in range(400)] + [(1000 + i, "w " * 50, "big", "x") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, key string")
    found = mixing.mix(docs, shard_words=500, block=4).collect()
    taken, goal = defaultdict(int), {}
    source = {i: s for i, _, s, _ in rows}
    for r in found:
        taken[source[r.doc_id]] += r.taken
        goal[source[r.doc_id]] = r.target
        assert r.taken <= 2 * r.size
    assert all(abs(taken[s] - g) <= 0.03 * g for s, g in goal.items()), (dict(taken), goal)


def test_seats_are_those_of_the_highest_quotients(spark):
    claims = {"g": [53, 24, 23, 7, 1, 0, 900], "h": [1, 1, 1, 1], "e": [0, 0]}
    seats = {"g": 31, "h": 2, "e": 5}
    rows = [(g, i, c, seats[g]) for g, own in claims.items() for i, c in enumerate(own)]
    found = mixing.apportion(spark.createDataFrame(rows, "g string, i long, c long, seats long"), ["g"], "seats", "c", ["i"]).collect()
    for g, own in claims.items():
        quotients = sorted(((-c / (2 * k + 1), i, k) for i, c in enumerate(own) if c for k in range(seats[g])))[: seats[g]]
        expected = [sum(i == x for _, x, _ in quotients) for i in range(len(own))]
        assert [r.quota for r in sorted(found) if r.g == g] == expected


def highest_quotients(own, seats):
    heap = [(-c, i, 0) for i, c in enumerate(own) if c > 0]
    heapq.heapify(heap)
    got = [0] * len(own)
    for _ in range(seats if heap else 0):
        _, i, k = heapq.heappop(heap)
        got[i] += 1
        heapq.heappush(heap, (-own[i] / (2 * k + 3), i, k + 1))
    return got


def test_seats_of_skewed_claims(spark):
    rng = random.Random(8)
    cases = [([20_000] + [6] * 200, 2120), ([3010] + [3] * 1000, 6020), ([5] * 40 + [1], 7), ([1] * 300, 100), ([1] * 300, 200), ([0, 0, 4], 9)]
    for _ in range(1000):
        own = [int(rng.paretovariate(rng.choice((0.4, 1, 3)))) % 100_000 for _ in range(rng.randint(1, 40))] + [rng.choice((0, 1, 2, 3))] * rng.choice((0, 0, 5, 60))
        cases.append((own, rng.randint(0, 400)))
    rows = [(g, i, c, seats) for g, (own, seats) in enumerate(cases) for i, c in enumerate(own)]
    got = defaultdict(dict)
    for r in mixing.apportion(spark.createDataFrame(rows, "g long, i long, c long, seats long"), ["g"], "seats", "c", ["i"]).collect():
        got[r.g][r.i] = r.quota
    for g, (own, seats) in enumerate(cases):
        assert [got[g][i] for i in range(len(own))] == highest_quotients(own, seats), (own, seats)


def test_awkward_rows(spark, awkward):
    docs = awkward.withColumn("source", F.expr("case when doc_id % 3 = 0 then null when doc_id % 3 = 1 then '' else 's' end"))
    found = mixing.mix(docs, block=2).collect()
    assert len(found) == docs.count()
    texts = defaultdict(list)
    for r in docs.collect():
        texts[(r.doc_id, r.source)].append(r.text)
    check(found, texts)
    mixed = mixing.mixed_texts(docs, block=2)
    assert mixed.columns == docs.columns
    words = mixed.agg(F.sum(F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")))).first()[0]
    assert words == sum(r.taken for r in found)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed_texts(docs.limit(0)).count() == 0
    single = docs.where("doc_id = 7")
    assert abs(mixing.mix(single).first().taken - 15000) <= 16  # a block
