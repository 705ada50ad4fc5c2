import hashlib
from collections import Counter
from functools import lru_cache

import numpy as np

import corpus_pipeline
from almanac.llm import queries, quality, secrets


def first_of_each(rows):
    """The smallest id of each component of texts whose sets of five words are 0.8 alike or more."""
    sets = {}
    for i, text in rows:
        words = text.lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
    by_shingle, root = {}, {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, own in sets.items():
        for s in own or {()}:
            by_shingle.setdefault(s, []).append(i)
    for i, own in sets.items():
        for j in {j for s in own or {()} for j in by_shingle[s] if j < i}:
            both = len(own & sets[j])
            if both >= 0.8 * (len(own) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i in sets:
        least[find(i)] = min(i, least.get(find(i), i))
    return sorted(least.values())


@lru_cache
def found_secrets(spark, docs):
    words = secrets.vocabulary_words(queries.tokenizer()[0])
    found = secrets.scan(docs, secrets.train(spark, dictionary=words), "source", dictionary=words).where("is_secret")
    return {r.doc_id for r in found.collect()}


def test_run_is_its_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts, columns = [docs.count()], docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{i}")
        counts.append(docs.count())
        if i < 4:
            assert docs.columns == columns
        if i == 0:
            kept = {r.doc_id for r in queries.op3_quality_rules(spark, sf).where("kept").collect()}
            assert {r.doc_id for r in docs.collect()} == kept and counts[1] == len(kept)
        if i == 1:
            assert sorted(r.doc_id for r in docs.collect()) == first_of_each([(r.doc_id, r.text) for r in before.collect()])
        if i == 2:
            hidden = {r.doc_id: r.text for r in docs.collect()}
            for r in before.collect():
                assert (hidden[r.doc_id] == r.text) == (r.doc_id not in found_secrets(spark, before))
    last = sorted(map(tuple, docs.collect()))
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[3] == counts[2] and counts[5] == counts[4]
    assert last == sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()))
    mixed = spark.read.parquet(f"{tmp_path}/3").collect()
    assert Counter(r.doc_id for r in mixed) == Counter(r[0] for r in last)
    assert Counter(hashlib.sha256(r.text.encode()).hexdigest() for r in mixed) == Counter(r[3] for r in last)


def test_awkward_documents(spark, awkward, tmp_path):
    labels = spark.createDataFrame([(1, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for n, docs in (("all", awkward), ("none", awkward.limit(0))):
        docs.selectExpr("doc_id", "text", "cast(null as string) lang", "shard source", "length(text) n_chars").write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{n}{i}")
            docs = spark.read.parquet(f"{tmp_path}/{n}{i}")
        # of the awkward texts those of at least 50 words repeat themselves, and go
        assert docs.count() == 0


def test_kept_rows_are_the_judged_ones(spark, awkward):
    field = quality.LineField.flat()
    assert quality.judge(awkward, field, keep_columns=True).count() == quality.judge(awkward, field).where("kept").count()
    assert np.isfinite([r.content_share for r in quality.judge(awkward, field).collect()]).all()
