import base64
import hashlib
import random

import numpy as np
import tiktoken
from pyspark.sql import functions as F

from almanac.llm import bpe, queries

FILE, PATTERN = queries.tokenizer()


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FILE, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_query_equals_the_library(spark, sf, documents):
    ids = {r.doc_id: np.array(library().encode_ordinary(r.text), "<u4").tobytes() for r in documents}
    for r in queries.op5_bpe(spark, sf).collect():
        text = next(d.text for d in documents if d.doc_id == r.doc_id)
        assert (r.n_tokens, r.ids_sha256) == (len(ids[r.doc_id]) // 4, hashlib.sha256(ids[r.doc_id]).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def awful_texts():
    rng = random.Random(4)
    alphabet = ["a", "B", "é", "日", "𝒳", "7", "٣", " ", "  ", "\n", "\t", "\u00a0", "\u2003", "\x1c", "\x85", "'", "'s", "'re", "'ll", "!", "…", "<|endoftext|>", "\u0301", "\r\n", "."]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(1, 400))) for _ in range(60)]
    return [*texts, "a" * 300, " " * 300, "a" * 150 + "\n" * 150 + "b", "", " ", "it's we're they'll " * 20]


def test_chunks_stitch_to_the_whole(spark):
    texts = awful_texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, row string")
    lib = library()
    for chunk, overlap in ((64, 16), (23, 7), (1 << 15, 512)):
        found = {r.doc_id: r for r in bpe.encode(docs, FILE, PATTERN, chunk, overlap).collect()}
        for i, t in enumerate(texts):
            assert np.frombuffer(found[i].ids, "<u4").tolist() == lib.encode_ordinary(t), (chunk, t)
            assert bytes(found[i].decoded) == t.encode()


def test_awkward_rows(spark, awkward):
    lib = library()
    for chunk in (50, 1 << 15):
        found = bpe.encode(awkward, FILE, PATTERN, chunk, 20).collect()
        expected = sorted((-1 if r.doc_id is None else r.doc_id, lib.encode_ordinary(r.text or "")) for r in awkward.collect())
        assert sorted((-1 if r.doc_id is None else r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in found) == expected
    assert bpe.encode(awkward.where(F.lit(False)), FILE, PATTERN).count() == 0


def test_runs_without_a_seam_are_read_a_bounded_number_of_times():
    content = open(FILE, "rb").read()
    vocabulary = bpe._loaded(content, PATTERN)
    read = []
    for text in ("x " + "a" * 60_000 + " b", "a b " * 20_000, "\n" * 50_000, "a" * 30_000 + "1" * 30_000 + " c"):
        chunks = [(b, text[b : b + 300 + 30], vocabulary.starts(text[b : b + 330], b, b + 330 >= len(text))) for b in range(0, len(text), 300)]
        seen = 0

        class Counted:
            pattern = vocabulary.pattern

            def starts(self, text, base, is_end):
                nonlocal seen
                seen += len(text)
                return vocabulary.starts(text, base, is_end)

        pieces = list(bpe.stitch(chunks, Counted()))
        assert pieces == vocabulary.pattern.findall(text)
        read.append(seen / len(text))
    assert max(read) < 6, read
