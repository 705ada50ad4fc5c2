import hashlib
from collections import Counter

from almanac.llm import queries
from almanac.llm.substring_dedup import remove_repeats


def brute(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    times = Counter(tuple(w[s : s + window]) for _, w in words for s in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - window + 1):
            if times[tuple(w[s : s + window])] > 1:
                gone.update(range(s, s + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_query_equals_brute_force(spark, sf, documents):
    found = queries.op1_substring_dedup(spark, sf).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, found)) == brute(documents, 35)


def test_awkward_rows(spark, awkward):
    for window in (3, 34, 35, 36):
        found = remove_repeats(awkward, window).collect()
        got = Counter((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in found)
        assert got == brute([(r.doc_id, r.text) for r in awkward.collect()], window)
        assert all(a.end < b.start for r in found for a, b in zip(r.spans, r.spans[1:]))


def test_empty_table(spark, awkward):
    assert remove_repeats(awkward.limit(0)).count() == 0


def test_many_shards_and_owners_say_the_same(spark, sf, documents):
    found = remove_repeats(spark.read.parquet(f"{sf}/documents.parquet"), 35, shard_bytes=20_000, owner_bytes=30_000).collect()
    got = Counter((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in found)
    assert got == brute(documents, 35)
