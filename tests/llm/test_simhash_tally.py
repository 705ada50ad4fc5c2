import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from almanac.llm import simhash


def near_groups(seed, groups, size):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(groups)]
    flip = lambda: sum(1 << b for b in rng.sample(range(64), rng.randrange(6)))
    return sorted({b ^ flip() for b in base for _ in range(size)})


def pairs_within(fps, bits):
    return {(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= bits}


def components_of(pairs, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        root[find(a)] = find(b)
    groups = {}
    for n in nodes:
        groups.setdefault(find(n), []).append(n)
    return {n: min(g) for g in groups.values() for n in g}


@pytest.mark.parametrize("groups,size,long", [(40, 5, 256), (3, 60, 256), (40, 8, 4), (1, 200, 16), (200, 1, 8)])
def test_tallies_lose_no_link(monkeypatch, groups, size, long):
    monkeypatch.setattr(simhash, "_LONG", long)
    monkeypatch.setattr(simhash, "_PAIRS", 50)
    fps = near_groups(groups, groups, size)
    arr = np.array(fps, np.uint64).view(np.int64)
    for shared in (0, 2):  # without and with positions that all of a list agree in
        own = arr & ~np.int64(0xFFFF) if shared else arr
        own = np.unique(own)
        as_unsigned = own.view(np.uint64).tolist()
        for lists in (np.zeros(len(own), np.int64), np.arange(len(own)) // 7):
            a, b = simhash.link_lists(lists, own, 4)
            got = components_of(zip(a.view(np.uint64).tolist(), b.view(np.uint64).tolist()), as_unsigned)
            expected = {}
            for k in set(lists.tolist()):
                part = [x for x, n in zip(as_unsigned, lists.tolist()) if n == k]
                expected |= components_of(pairs_within(part, 4), part)
            assert got == expected
            assert all((x ^ y).bit_count() <= 4 for x, y in zip(a.view(np.uint64).tolist(), b.view(np.uint64).tolist()))


@pytest.mark.parametrize("size", [2, 3, 4])
def test_plans_for_all_sizes_link_the_same(spark, size):
    fps = near_groups(9, 30, 12)
    rows = [(int(np.uint64(f).astype(np.int64)), i) for i, f in enumerate(fps)]
    distinct = spark.createDataFrame(rows, "fp long, id long").select("fp", F.struct(F.lit(False).alias("none"), "id", "fp").alias("node"))
    found = simhash.links_by(distinct, size, 4).collect()
    got = components_of([(r.a.id, r.b.id) for r in found], range(len(fps)))
    at = {f: i for i, f in enumerate(fps)}
    assert got == components_of([(at[a], at[b]) for a, b in pairs_within(fps, 4)], range(len(fps)))
