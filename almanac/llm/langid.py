"""Language identification with error-correcting output codes.

Each language gets a codeword of bits. For each bit one binary classifier, over hashed byte n-grams, tells the languages
whose codewords have the bit set from the others. Decoding weights every bit's margin by its loss against each codeword
and takes the language of the smallest loss, so some wrong bits are outvoted; where the best two losses are close the
prediction is flagged as ambiguous.

Codewords: with up to 7 languages the exhaustive code (each way to split the languages in two, once); with more, seeded
random codewords that keep a distance. The classifiers are log-ratio models of n-gram frequencies in which both sides'
languages weigh the same, fitted on ``train_docs`` documents of each language (that many in expectation: those whose text's hash is
under the rate for it; equal texts once), of each all n-grams. Every value of lang that isn't null is learned, the
empty one too. The book of codewords and weights is in every worker's memory, and grows with the logarithm of the
number of languages; the counts of one language at a time are on the driver.

Predictions read nothing but the text, whole, a block of bytes at a time. Defined results: a text that is null or has no letter is `und`, score 0,
not ambiguous; so is each one if there is nothing to learn from. Equal losses go to the language first by code point.
Rows are judged one by one, repeated or not. Other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.words import byte_texts, slices

UNKNOWN = "und"
SIZES, BINS = (2, 3, 4), 1 << 15
_HASH_RANGE = 1 << 31
#: N-grams are listed for so many bytes at a time.
_BLOCK = 1 << 18
_NOT_LETTERS = bytes(32 if b < 128 and not (65 <= b <= 90 or 97 <= b <= 122) else b for b in range(256))


def grams(text: bytes) -> Iterator[np.ndarray]:
    """Bins of all n-grams of a text's letters, lower-cased, any run of other ASCII being one space; block by block."""
    cleaned = b" " + b" ".join(text.decode("utf-8", "replace").lower().encode().translate(_NOT_LETTERS).split()) + b" "
    for at in range(0, len(cleaned), _BLOCK):
        for n in SIZES:
            b = np.frombuffer(cleaned[at : at + _BLOCK + n - 1], np.uint8).astype(np.uint32)
            if len(b) >= n:
                code = np.full(len(b) - n + 1, n, np.uint32)
                for i in range(n):
                    code = code * np.uint32(0x01000193) ^ b[i : len(b) - n + 1 + i]
                code = code * np.uint32(0x9E3779B1)
                yield code >> np.uint32(32 - 15)


def gram_counts(text: bytes) -> np.ndarray:
    return sum((np.bincount(g, minlength=BINS) for g in grams(text)), np.zeros(BINS, np.int64))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """Rows of -1 and 1, one for each of n languages."""
    if n <= 7:
        tails = [t for t in product((-1, 1), repeat=max(0, n - 1)) if -1 in t]
        return np.array([(1,) * max(1, len(tails)), *zip(*tails)], np.float32)[:n] if tails else np.ones((n, 1), np.float32)
    rng, bits, best = np.random.default_rng(seed), max(15, int(np.ceil(10 * np.log2(n)))), None
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], size=(n, bits)).astype(np.float32)
        distance = (bits - code @ code.T) / 2 + bits * np.eye(n)
        useful = (code.min(0) < 0) & (code.max(0) > 0)
        if useful.all() and (best is None or distance.min() > best[0]):
            best = distance.min(), code
    return best[1]


@dataclass
class Codebook:
    languages: list[str]
    code: np.ndarray  # language x bit
    weights: np.ndarray  # bin x bit

    def predict(self, text: bytes | None) -> tuple[str, float, bool]:
        if not text or not self.languages or not has_letter(text.decode("utf-8", "replace")):
            return UNKNOWN, 0.0, False
        margins, n = np.zeros(self.code.shape[1]), 0
        for g in grams(text):
            bins, times = np.unique(g, return_counts=True) if len(g) > BINS else (g, None)
            margins += self.weights[bins].sum(axis=0, dtype=np.float64) if times is None else times @ self.weights[bins].astype(np.float64)
            n += len(g)
        margins /= n
        scale = np.abs(margins).mean() or 1.0
        losses = np.exp(-self.code * margins / scale).mean(axis=1)
        odds = np.exp(-4 * (losses - losses.min()))
        shares = odds / odds.sum()
        first = int(np.argmin(losses))
        second = np.partition(losses, 1)[1] if len(losses) > 1 else np.inf
        return self.languages[first], float(shares[first]), bool(second - losses[first] < 0.1 * second)


def train(docs: DataFrame, train_docs: int = 1500) -> Codebook:
    """Fit on ``docs`` (text, lang); the caller has taken out what must not be learned from."""
    spark = docs.sparkSession
    rows = docs.select("text", "lang").where("lang is not null")
    sized = rows.groupBy("lang").count().collect()  # a row a language, as the book has
    languages = sorted(r["lang"] for r in sized)
    if not languages:
        return Codebook([], codewords(0), np.zeros((BINS, 1), np.float32))
    rates = [(r["lang"], languages.index(r["lang"]), min(_HASH_RANGE, -(-train_docs * _HASH_RANGE // r["count"]))) for r in sized]
    rated = spark.createDataFrame(rates, "lang string, number int, rate long")
    hashed = rows.where("text is not null").withColumn("hash", F.xxhash64("text"))
    sample = hashed.join(F.broadcast(rated), "lang").where(F.pmod("hash", F.lit(_HASH_RANGE)) < F.col("rate")).dropDuplicates(["number", "hash"])

    def count(batches):
        number, counts = None, None
        for batch in slices(batches):
            for own, text in zip(batch.column("number").to_pylist(), byte_texts(batch.column("text"))):
                if own != number and number is not None:
                    yield one(number, counts)
                number, counts = own, gram_counts(text) + (counts if own == number else 0)
        if number is not None:
            yield one(number, counts)

    def one(number, counts):
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([counts.astype("<i8").tobytes()], pa.binary())], ["number", "counts"])

    code = codewords(len(languages))
    sides = {1: np.zeros((code.shape[1], BINS)), -1: np.zeros((code.shape[1], BINS))}

    def learn(number: int, counts: np.ndarray) -> None:
        share = (counts + 0.1) / (counts + 0.1).sum()
        for side, sums in sides.items():
            sums[code[number] == side] += share

    # the sample is bounded, so a few tasks count it, each in order; a language's few rows come one after the other
    counted = sample.select("number", "text").repartition(8, "number").sortWithinPartitions("number").mapInArrow(count, "number int, counts binary")
    seen = set()
    for r in counted.toLocalIterator():
        seen.add(r.number)
        learn(r.number, np.frombuffer(bytes(r.counts), "<i8"))
    for number in set(range(len(languages))) - seen:  # all of its texts are null
        learn(number, np.zeros(BINS))
    weights = np.zeros((BINS, code.shape[1]), np.float32)
    for bit in range(code.shape[1]):
        n_yes, n_no = (code[:, bit] > 0).sum(), (code[:, bit] < 0).sum()
        if n_yes and n_no:
            weights[:, bit] = np.log(sides[1][bit] / n_yes) - np.log(sides[-1][bit] / n_no)
    return Codebook(languages, code, weights)


def identify(docs: DataFrame, book: Codebook) -> DataFrame:
    """doc_id, lang_pred, score (the best language's share of the loss weights) and ambiguous, one row per row."""
    rows = docs.select("doc_id", "text")

    def label(batches):
        for batch in slices(batches):
            found = list(zip(*map(book.predict, byte_texts(batch.column("text"))))) or [(), (), ()]
            columns = [batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(found, (pa.string(), pa.float64(), pa.bool_())))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "ambiguous"])

    return rows.mapInArrow(label, f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double, ambiguous boolean")
