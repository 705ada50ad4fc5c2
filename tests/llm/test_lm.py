import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from almanac.llm import lm, queries


def tokens(text):
    return [*(text or "").encode().lower().split(), "end"]


def is_held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def hold(found, rows, held, order):
    counts = Counter(t for (i, text) in rows if not held(i) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    model = lm.Automaton([t for i, t in rows if not held(i)], order)
    expected = []
    for i, text in rows:
        own = tokens(text)
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own)
        expected.append((-1 if i is None else i, held(i), len(own), sum(counts[t] > 0 for t in own), n, base, model.score(text)))
    got = sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in found)
    assert len(got) == len(expected)
    for g, e in zip(got, sorted(expected)):
        assert g[:5] == e[:5] and g[5:] == pytest.approx(e[5:], rel=1e-9)


def test_query_equals_brute_force(spark, sf, documents):
    hold(queries.op10_lm_scoring(spark, sf).collect(), [tuple(r) for r in documents], is_held_out, 3)


def test_held_out_texts_are_likelier_than_by_the_base(spark):
    found = queries.op10_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert found[0] > found[1]


def test_awkward_rows(spark, awkward):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    for order in (1, 2, 3, 4):
        hold(lm.score_texts(awkward, F.col("doc_id") % 4 == 1, order).collect(), rows, lambda i: i is not None and i % 4 == 1, order)
    hold(lm.score_texts(awkward, F.lit(True)).collect(), rows, lambda i: True, 3)
    # many shards, few bits: n-grams go to many owners
    hold(lm.score_texts(awkward, F.col("doc_id") % 4 == 1, 3, shard_bytes=2000, owner_bytes=3000).collect(), rows, lambda i: i is not None and i % 4 == 1, 3)
    assert lm.score_texts(awkward.limit(0), F.lit(False)).count() == 0


def test_a_distribution():
    model = lm.Automaton(["a b a c", "b a", None, "c c c a"], 3)
    words = [w for w, in (g for g in model.counts if len(g) == 1) if w is not lm.BEGIN and w != lm.BEGIN] + ["never seen"]
    for history in [(), (b"a",), (lm.BEGIN,), (b"b", b"a"), (lm.BEGIN, b"b")]:
        assert sum(model.probability(history, w) for w in words) == pytest.approx(1)


def test_stretches_read_as_whole_texts_do(monkeypatch):
    texts = [b"a b c a b d a b c " * 30, None, b"c c c", b"a b", b"x y z a b c d e f g"]
    held = lm.Streams(texts, 3)
    counts = [lm.np.bincount(w[w >= 0], minlength=len(d)) for d, w in zip(held.distinct, held.which)]
    continued = [lm.np.bincount(held.history(n), minlength=len(held.distinct[n - 2])) for n in (2, 3)] + [0 * counts[2]]
    model = lm.Automaton([t and t.decode() for t in texts], 3)
    discounts = [model.discounts[2], model.discounts[3]]
    for lanes in (1, 3, 7, 50, 4096):
        monkeypatch.setattr(lm, "_LANES", lanes)
        passed = lm.Traversal(held, counts, continued, model.tokens, model.types, discounts).read()
        sums = lm.np.bincount(held.doc[held.place > 0], passed[held.place > 0], len(texts))
        assert sums == pytest.approx([model.score(t and t.decode()) for t in texts])
