import random
from collections import Counter

import numpy as np
import xxhash

from almanac.llm import queries
from almanac.llm.simhash import covering_family, keep_one, link_lists, near_duplicates


def fingerprint(text, size=4):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, bits=4):
    prints = {fingerprint(t) for _, t in rows}
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    ordered = sorted(prints)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    ids = {}
    for i, t in rows:
        if i is not None:
            k = find(fingerprint(t))
            ids[k] = min(i, ids.get(k, i))
    return Counter((i, f"{fingerprint(t):016x}", ids.get(find(fingerprint(t)))) for i, t in rows)


def test_query_equals_brute_force(spark, sf, documents):
    found = queries.op2_simhash_near_dedup(spark, sf).select("doc_id", "fingerprint", "component_id").collect()
    assert Counter(map(tuple, found)) == brute(documents)


def test_awkward_rows(spark, awkward):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert Counter(map(tuple, near_duplicates(awkward).collect())) == brute(rows)
    kept = keep_one(awkward)
    assert kept.columns == awkward.columns
    groups = {}
    for i, _, c in brute(rows):
        groups.setdefault(c, set()).add(i)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(groups.keys())


def test_empty_table(spark, awkward):
    assert near_duplicates(awkward.limit(0)).count() == 0
    assert keep_one(awkward.limit(0)).count() == 0


def test_families_cover():
    from itertools import combinations

    for size in (2, 3, 4):
        family = covering_family(4, size)
        assert all(any(set(s) <= set(o) for s in family) for o in combinations(range(8), 4))
    assert len(covering_family(4, 2)) == 7


def test_long_lists_lose_no_link():
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(30)]
    near = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & 2**64 - 1 for b in base for _ in range(40)})
    fps = np.array(near, np.uint64).view(np.int64)
    a, b = link_lists(np.zeros(len(fps), np.int64), fps, 4)
    assert len(a) < len(fps)
    root = {int(x): int(x) for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        root[find(x)] = find(y)
    for i, x in enumerate(near):
        for j, y in enumerate(near[:i]):
            if (x ^ y).bit_count() <= 4:
                assert find(int(fps[i])) == find(int(fps[j]))
