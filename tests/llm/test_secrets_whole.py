import random
import re
import time
from collections import Counter

import pytest

from almanac.llm import queries, secrets
from almanac.session import table

KEY = "+/_=.-"


def long_runs(word):
    """Maximal runs of at least 14 key characters that hold a digit and a letter, dots at their end taken off."""
    runs, run = [], ""
    for c in word + "\0":
        if c.isascii() and c.isalnum() or c in KEY:
            run += c
        else:
            if len(run) >= 14 and any(c.isdigit() for c in run) and any(c.isalpha() for c in run):
                runs.append(run.rstrip("."))
            run = ""
    return runs


def test_plain_candidates_equal_brute_force(spark):
    """Words without an assignment or a known prefix: their candidates are their long runs."""
    rng = random.Random(6)
    some = lambda chars, a, b: "".join(rng.choices(chars, k=rng.randint(a, b)))
    texts = [" ".join(some("abcXYZ0189+/_.-" + "~(,é" * rng.randint(0, 1), 1, 60) for _ in range(20)) for _ in range(200)]
    texts += ["a" * 13 + "1", "a" * 12 + "1", "1" * 14, "a" * 14, "." * 14 + "a1", "a1" + "." * 14, "x" * 20 + " 1", "a1~" * 20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = Counter((r.doc_id, r.place, r.value) for r in secrets.candidates(docs).collect())
    expected = Counter((i, k, v) for i, t in enumerate(texts) for k, w in enumerate(t.split()) for v in long_runs(w) if len(v) >= 6)
    assert found == expected


@pytest.mark.parametrize("unit", ["abcdefghij", "1", "eyJ", "eyJ-", "token=", "AKIA", "a1", "xoxb-", "&", "a.", "password "])
def test_long_runs_take_linear_time(spark, unit):
    docs = spark.createDataFrame([(1, unit * (1_000_000 // len(unit)))], "doc_id long, text string")
    spark.createDataFrame([(1, "token=abcdefgh1")], "doc_id long, text string").transform(secrets.candidates).count()
    began = time.monotonic()
    secrets.candidates(docs).count()
    assert time.monotonic() - began < 10


@pytest.fixture(scope="module")
def words():
    return secrets.vocabulary_words(queries.tokenizer()[0])


def test_dictionary_covers_words(spark, words):
    assert len(words) == 4096 == len(set(words))
    values = [("systemconfiguration", "", "", None), ("xqzjvkwpth", "", "", None), ("report-version-number", "", "", None)]
    found = secrets.with_features(spark.createDataFrame(values, "value string, before string, after string, path string"), words).collect()
    assert found[0].dictionary > 0.85 and found[1].dictionary == 0 and found[2].dictionary == 1
    pattern = re.compile(secrets.any_of(["port", "portable", "able", "table"]))
    assert pattern.findall("portableport table xable") == ["portable", "port", "table", "able"]


def test_formats_never_seen_in_training(spark, words):
    """Trained on every second format, held against the others."""
    seen = spark.createDataFrame(secrets.example_findings(formats=lambda f: f % 2 == 0), "value string, before string, after string, path string, label int")
    other = secrets.example_findings(1500, 77, formats=lambda f: f % 2 == 1)
    model = secrets.train(spark, seen, dictionary=words)
    marked = spark.createDataFrame(other, "value string, before string, after string, path string, label int")
    ready = secrets.VectorAssembler(inputCols=list(secrets.FEATURES), outputCol="features").transform(secrets.with_features(marked, words))
    assert model.transform(ready).where("prediction = label").count() / len(other) > 0.8


def test_planted_secrets_are_found(spark):
    """By the formats in which the tables hold them; whatever else is called a secret counts against precision."""
    sf = "/root/testdata/sf0.1"
    planted = re.compile(r'\btoken = "([0-9a-f]{40})"|\b(AKIA[0-9A-Z]{16})\b|\bpassword=([0-9a-z]{12,})')
    expected = Counter()
    for r in table(spark, sf, "documents").select("doc_id", "text").collect():
        expected.update((r.doc_id, next(filter(None, m))) for m in planted.findall(r.text))
    words = secrets.vocabulary_words(queries.tokenizer()[0])
    found = secrets.scan(table(spark, sf, "documents"), secrets.train(spark, dictionary=words), "source", dictionary=words).where("is_secret")
    got = Counter((r.doc_id, r.value) for r in found.collect())
    assert sum(expected.values()) > 50
    assert sum((expected & got).values()) / sum(expected.values()) >= 0.9
    assert sum((expected & got).values()) / sum(got.values()) >= 0.9
