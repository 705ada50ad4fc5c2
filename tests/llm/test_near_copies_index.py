import numpy as np

from almanac.llm import near_copies
from almanac.llm.near_copies import Bounds


def sets_of(n, shared, times, seed=0):
    rng = np.random.default_rng(seed)
    for _ in range(times):
        pool = rng.integers(0, 1 << 64, 2 * n - shared, np.uint64)
        yield np.sort(pool[:n]), np.sort(pool[n - shared :])


def bits(hashes):
    return np.frombuffer(near_copies.fingerprint(hashes), "<u8")


def test_fingerprint_is_the_majority_of_the_hashes():
    hashes = next(sets_of(600, 0, 1))[0]
    x = (hashes[:, None] ^ near_copies._FLIP) * near_copies._TIMES
    x ^= x >> np.uint64(32)
    votes = (x[:, :, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)).sum(axis=0)
    assert (bits(hashes) == ((2 * votes > len(hashes)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)).all()


def test_similar_sets_meet_and_others_do_not():
    bounds = Bounds.of(0.8)
    for n, shared, similar in ((90, 80, True), (450, 400, True), (90, 30, False)):
        for one, other in sets_of(n, shared, 100):
            prints = np.stack([bits(one), bits(other)])
            lists = np.flatnonzero(np.diff(prints.view("<u2"), axis=0)[0] == 0)
            key = np.repeat(lists.astype(np.uint64) << np.uint64(16) | prints.view("<u2")[0, lists], 2)
            both = np.tile(prints, (len(lists), 1))
            found = list(near_copies.candidate_places(key.view(np.int64), np.full(len(key), n), np.arange(len(key)), both, 0.8))
            # one pair, though it shares several lists
            assert sum(len(a) for a, _, _ in found) == similar
            assert near_copies.with_neighbours(key, both[:, : near_copies.SKETCH], bounds.sketch).all() or not similar


def test_small_similar_sets_share_one_of_their_first_shingles():
    for n in range(1, near_copies.SMALL + 1):
        for drop in range(n // 5 + 1):
            hashes = next(sets_of(n, 0, 1, n))[0]
            part = np.delete(hashes, np.random.default_rng(drop).choice(n, drop, replace=False))
            if len(part) >= 0.8 * n:
                assert np.intersect1d(near_copies.first_shingles(hashes, 0.8), near_copies.first_shingles(part, 0.8)).size


def test_compared_pairs_do_not_follow_the_square_of_a_group(spark, monkeypatch):
    compared, alike = [], near_copies._alike

    def counted(pairs, sets, similarity):
        compared.append(pairs.count())
        return alike(pairs, sets, similarity)

    monkeypatch.setattr(near_copies, "_alike", counted)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(words[:i] + [f"x{i}"] + words[i:])) for i in range(200)]
    assert [r.doc_id for r in near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0]
    assert sum(compared) <= 2 * len(rows)


def test_a_group_just_short_of_similar_makes_no_row_of_a_pair(spark, monkeypatch):
    compared, packed, alike, of_cells = [], [], near_copies._alike, near_copies._links_of_cells

    def counted(pairs, sets, similarity):
        compared.append(pairs.count())
        return alike(pairs, sets, similarity)

    def counted_cells(letters, sets, similarity):
        rows = letters.collect()
        packed.append((len(rows), sum(len(r.a) // 8 for r in rows)))
        return of_cells(letters, sets, similarity)

    monkeypatch.setattr(near_copies, "_alike", counted)
    monkeypatch.setattr(near_copies, "_links_of_cells", counted_cells)
    words = " ".join(f"w{i}" for i in range(100))
    text = lambda i, n: " ".join([words, *(f"x{i}y{j}" for j in range(n))])
    # 96 of 126 shingles for any two, but 96 of 119 with the last two
    apart = [(i, text(i, 15)) for i in range(150)]
    assert near_copies.keep_one(spark.createDataFrame(apart, "doc_id long, text string")).count() == 150
    ((letters, pairs),) = packed
    assert sum(compared) + letters <= 2 * len(apart) and pairs > 10000
    near = [*apart, (150, text(150, 8)), (151, text(151, 8))]
    assert [r.doc_id for r in near_copies.keep_one(spark.createDataFrame(near, "doc_id long, text string")).collect()] == [0]


def test_shared_hashes_equal_intersections():
    rng = np.random.default_rng(7)
    sets = [np.sort(rng.choice(80, size, replace=False)).astype(np.int64) - 40 << 56 for size in rng.integers(1, 60, 40)]
    a, b = np.triu_indices(len(sets), 1)
    shared = near_copies.shared_hashes(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), a, b)
    assert shared.tolist() == [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b)]


def test_roots_by_the_driver_equal_those_by_rounds(spark, monkeypatch):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(-150, 150, (120, 2)) if a != b] + [(1000 + i, 1001 + i) for i in range(50)]
    links = spark.createDataFrame(edges, "a long, b long")
    rows = lambda: sorted(map(tuple, near_copies._roots(links).collect()))
    here = rows()
    monkeypatch.setattr(near_copies, "_COLLECTED", 0)
    assert here == rows() and len({r for _, r in here}) < len(here)
    assert near_copies._roots(links.limit(0)).count() == 0
