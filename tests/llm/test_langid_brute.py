import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from almanac.llm import langid, queries


def brute_bins(text):
    kept = re.sub("[\x00-@\\[-`{-\x7f]+", " ", text.lower())
    data = (" " + kept.strip(" ") + " ").encode()
    found = Counter()
    for n in (2, 3, 4):
        for i in range(len(data) - n + 1):
            code = n
            for byte in data[i : i + n]:
                code = (code * 0x01000193 & 0xFFFFFFFF) ^ byte
            found[(code * 0x9E3779B1 & 0xFFFFFFFF) >> 17] += 1
    return found


def brute_model(rows):
    """Per language smoothed shares of bins, of rows (text, lang)."""
    counts = defaultdict(Counter)
    for text, lang in {(t, x) for t, x in rows if x is not None}:
        counts[lang].update(brute_bins(text) if text is not None else {})
    total = {x: sum(c.values()) + 0.1 * langid.BINS for x, c in counts.items()}
    return {x: (lambda b, x=x: (counts[x][b] + 0.1) / total[x]) for x in counts}


def brute_predict(text, model):
    if text is None or not any(c.isalpha() for c in text) or not model:
        return "und", 0.0
    names = sorted(model)
    code = langid.codewords(len(names))
    bins = brute_bins(text)
    margins = []
    for bit in range(code.shape[1]):
        yes, no = ([model[x] for x, w in zip(names, code[:, bit]) if w == side] for side in (1, -1))
        score = lambda b: math.log(sum(s(b) for s in yes) / len(yes)) - math.log(sum(s(b) for s in no) / len(no)) if yes and no else 0.0
        margins.append(sum(n * score(b) for b, n in bins.items()) / sum(bins.values()))
    scale = sum(map(abs, margins)) / len(margins) or 1.0
    losses = [sum(math.exp(-w * m / scale) for w, m in zip(row, margins)) / len(margins) for row in code]
    odds = [math.exp(-4 * (x - min(losses))) for x in losses]
    return names[losses.index(min(losses))], odds[losses.index(min(losses))] / sum(odds)


def hold(found, rows, model):
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.lang_pred, r.score) for r in found)
    expected = sorted((-1 if i is None else i, *brute_predict(t, model)) for i, t in rows)
    assert [g[:2] for g in got] == [e[:2] for e in expected]
    assert [g[2] for g in got] == pytest.approx([e[2] for e in expected], abs=1e-4)


def test_query_equals_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    model = brute_model([(r.text, r.lang) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 != 1])
    hold(queries.op4_language_id(spark, sf).collect(), [(r.doc_id, r.text) for r in rows], model)


def test_awkward_rows_and_the_empty_language(spark, awkward):
    rows = awkward.selectExpr("*", "case when doc_id % 3 = 0 then '' when doc_id % 3 = 1 then 'aa' when doc_id = 8 then null else 'bb' end lang")
    model = brute_model([(r.text, r.lang) for r in rows.collect()])
    assert "" in model
    hold(langid.identify(rows, langid.train(rows)).collect(), [(r.doc_id, r.text) for r in rows.collect()], model)


def test_more_than_64_languages_are_all_learned(spark):
    rng = np.random.default_rng(2)
    words = {f"l{i:02}": ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(12)] for i in range(70)}
    rows = [(k, " ".join(rng.choice(w, 40)), x) for k in range(3) for x, w in words.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    book = langid.train(docs)
    assert book.languages == sorted(words)
    found = langid.identify(docs.withColumn("doc_id", F.monotonically_increasing_id()).select("doc_id", "text", "lang"), book).count()
    right = sum(book.predict(t.encode())[0] == x for _, t, x in rows)
    assert found == len(rows) and right == len(rows)


def test_long_texts_are_read_whole_in_blocks():
    text = ("abc dé " * 100_000).encode()
    whole = gram_of_one_block(text)
    assert (langid.gram_counts(text) == whole).all() and len(list(langid.grams(text))) > 6


def gram_of_one_block(text):
    unit = brute_bins("abc dé " * 10)
    more = brute_bins("abc dé " * 11)
    counts = np.zeros(langid.BINS, np.int64)
    for b, n in unit.items():
        counts[b] = n + (more[b] - n) * (100_000 - 10)
    return counts
