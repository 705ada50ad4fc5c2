import corpus_pipeline
from almanac.llm import near_copies


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute(rows):
    """The smallest id (null last) of each group."""
    sets = sorted({shingles(t) for _, t in rows}, key=sorted)
    root = {s: s for s in sets}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for i, a in enumerate(sets):
        for b in sets[:i]:
            if 9 * len(a & b) >= 4 * (len(a) + len(b)) and find(a) != find(b):
                root[find(a)] = find(b)
    ids = {}
    for i, t in rows:
        ids.setdefault(find(shingles(t)), []).append(i)
    return sorted(min((x for x in found if x is not None), default=-1) for found in ids.values())


def kept(docs):
    return sorted(-1 if r.doc_id is None else r.doc_id for r in docs.collect())


def test_stage_equals_brute_force(spark, sf, documents):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert kept(corpus_pipeline.keep_one_of_each(spark, docs, sf)) == brute([(r.doc_id, r.text) for r in documents])


def test_similarity_is_at_least_and_not_below(spark):
    words = [f"w{i}" for i in range(94)]  # 90 shingles; from one word changed 5 are others, from one at the end one is
    changed = lambda *places: " ".join("x" if i in places else w for i, w in enumerate(words))
    rows = [(1, changed()), (2, changed(20, 60)), (3, changed(10, 30, 50)), (4, "other text " * 30)]  # 80 of 100, 75 of 105
    assert kept(near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows) == [1, 3, 4]


def test_awkward_rows(spark, awkward):
    found = near_copies.keep_one(awkward)
    assert found.columns == awkward.columns and kept(found) == brute([(r.doc_id, r.text) for r in awkward.collect()])
    assert near_copies.keep_one(awkward.limit(0)).count() == 0


def test_large_groups_are_whole(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "_FEW_PAIRS", 0)
    words = [f"w{i}" for i in range(120)]
    rows = [(100 * g + i, " ".join([f"g{g}"] * 5 + words[: 60 + i // 2] + [f"g{g}w{j}" for j in range(90 - i)])) for g in range(3) for i in range(40)]
    assert kept(near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_run_is_its_stages(spark, sf, tmp_path):
    docs, counts = spark.read.parquet(f"{sf}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        counts.append(docs.count())
        if i == 1:
            assert kept(docs) == brute([(r.doc_id, r.text) for r in before.collect()])
    assert counts[1] < counts[0] and counts[2] == counts[1] and counts[4] == counts[3]
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()))
