from collections import Counter
from itertools import product

import numpy as np
import regex

from almanac.llm import quality, queries

WORDS = regex.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORDS.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    again = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again), n < 50 or 100 * len(again) > 50 * n


def test_base_counts_equal_brute_force(spark, sf, documents):
    texts = {r.doc_id: r.text for r in documents}
    found = queries.op3_quality_rules(spark, sf).collect()
    assert len(found) == len(documents)
    for r in found:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id])
        assert not (r.kept and r.base_failed)


def test_keeps_good_and_rejects_bad(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    judged = [(labels[r.doc_id], r.kept) for r in queries.op3_quality_rules(spark, sf).where("not base_failed").collect() if r.doc_id in labels]
    good, bad = [k for q, k in judged if q], [k for q, k in judged if not q]
    assert np.mean(good) > 0.97
    assert np.mean(bad) < 0.3


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(3)
    field = quality.LineField(rng.normal(size=(2, len(quality.FEATURES))), rng.normal(size=(2, 2)))
    for n in range(1, 9):
        masks = rng.integers(0, 1 << len(quality.FEATURES), n).astype(np.int32)
        e = field.emissions(masks)
        total = lambda y: sum(e[i, y[i]] for i in range(n)) + sum(field.moves[a, b] for a, b in zip(y, y[1:]))
        assert tuple(field.viterbi(masks)) == max(product((0, 1), repeat=n), key=total)


def test_training_gradient_finds_what_tells_lines_apart():
    shouting, plain = np.full(6, 1 | 1 << 7, np.int32), np.full(6, 1 | 1 << 10, np.int32)
    field = quality.fit_field([shouting] * 5 + [plain] * 20, [quality.BOILERPLATE] * 5 + [quality.CONTENT] * 20)
    assert (field.viterbi(shouting) == quality.BOILERPLATE).all() and (field.viterbi(plain) == quality.CONTENT).all()
    assert (field.viterbi(np.concatenate([plain, shouting])) == [0] * 6 + [1] * 6).all()


def test_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(1, 0, 0), (5, 1, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    found = quality.judge(awkward, quality.train(awkward, labels)).collect()
    assert Counter((r.doc_id, r.n_words) for r in found) == Counter((r.doc_id, len(WORDS.findall(r.text or ""))) for r in awkward.collect())
    assert [r.kept for r in found if r.doc_id in (1, 2, 3)] == [False] * 3
    kept = quality.judge(awkward, quality.LineField.flat(), keep_columns=True)
    assert kept.columns == awkward.columns and kept.count() == 0  # the long ones repeat themselves
    empty = awkward.limit(0)
    assert quality.judge(empty, quality.train(empty, labels)).count() == 0
