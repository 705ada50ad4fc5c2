import itertools
import random

import numpy as np

from almanac.llm import quality, queries
from almanac.session import table


def mixed_documents(n=60, seed=3):
    """Documents of content lines with a menu among them; half of them are mostly junk and labelled bad."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abdeglmnorstu", k=rng.randint(2, 9)))
    plain = lambda: (" ".join(word() for _ in range(rng.randint(8, 20))) + ".").capitalize()
    shout = lambda: " ".join(f"{word().upper()}!! $$$" for _ in range(rng.randint(5, 12)))
    rows = []
    for i in range(n):
        bad = i % 2
        lines = [(plain(), 0) for _ in range(2 if bad else 9)] + [(shout(), 1) for _ in range(10 if bad else 2)]
        cut = rng.randint(1, 2)
        lines = [("Home | News | About | Contact us today", 1), *lines[:cut], *lines[cut:], ("All rights are reserved by the owner.", 1)]
        rows.append((i, bad, lines))
    return rows


def test_content_lines_of_mixed_documents_are_kept(spark):
    rows = mixed_documents()
    docs = spark.createDataFrame([(i, "\n".join(x for x, _ in lines)) for i, _, lines in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - bad) for i, bad, _ in rows if i < 40], "doc_id long, quality int")
    field = quality.train(docs, labels)
    right = total = 0
    for i, _, lines in rows[40:]:
        text = "\n".join(x for x, _ in lines).encode()
        found = field.viterbi(quality.line_masks(text, field.known)[0])
        right += sum(int(a) == b for a, (_, b) in zip(found, lines))
        total += len(lines)
    assert right / total > 0.97
    assert field.moves[0, 1] != field.moves[1, 0]
    judged = {r.doc_id: r for r in quality.judge(docs, field).collect()}
    shares = [judged[i].content_share for i, _, _ in rows[40:]]
    assert all(0 < s < 1 for s in shares)
    assert all(judged[i].kept == (not bad) for i, bad, _ in rows[40:])


def best_share(text, field):
    """By all labellings of short texts, by dynamic programming over label pairs of longer ones."""
    masks, sizes, _ = quality.line_masks(text, field.known)
    bits = [[1.0 * (int(m) >> k & 1) for k in range(len(quality.FEATURES))] for m in masks]
    emit = [[sum(w * x for w, x in zip(field.weights[y], b)) for y in (0, 1)] for b in bits]
    if len(masks) <= 10:
        total = lambda y: sum(emit[i][y[i]] for i in range(len(y))) + sum(field.moves[a, b] for a, b in zip(y, y[1:]))
        best = max(itertools.product((0, 1), repeat=len(masks)), key=total)
    else:
        paths = {y: (emit[0][y], (y,)) for y in (0, 1)}
        for row in emit[1:]:
            paths = {y: max(((s + field.moves[z, y] + row[y], (*p, y)) for z, (s, p) in paths.items()), key=lambda x: x[0]) for y in (0, 1)}
        best = max(paths.values(), key=lambda x: x[0])[1]
    return sum(n for n, y in zip(sizes.tolist(), best) if y == 0) / sizes.sum()


def test_query_keeps_what_the_best_labelling_says(spark, sf, documents):
    field = quality.train(table(spark, sf, "documents"), table(spark, sf, "labels"))
    texts = {r.doc_id: r.text for r in documents}
    shares = []
    for r in queries.op3_quality_rules(spark, sf).collect():
        share = best_share(texts[r.doc_id].encode(), field) if r.n_words else 0.0
        shares.append(share)
        assert abs(r.content_share - share) < 1e-9
        assert r.kept == (not r.base_failed and share >= 0.5)
    assert np.mean([0 < s < 1 for s in shares]) > 0.1


def test_long_runs_are_read_in_linear_time(spark):
    texts = ["a" * 2_000_000, "b\n" * 300_000, " " * 2_000_000, "\n" * 300_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in quality.judge(docs, quality.LineField.flat()).collect()}
    assert [found[i].n_words for i in range(4)] == [1, 300_000, 0, 0]
