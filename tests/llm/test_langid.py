import zlib

import numpy as np

from almanac.llm import langid, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = queries.op4_language_id(spark, sf).collect()
    assert len(found) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95


def test_codewords_keep_distance():
    for n in (2, 3, 4, 7, 8, 20):
        code = langid.codewords(n)
        assert code.shape[0] == n and len({tuple(r) for r in code}) == n
        if n > 2:
            assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= 2


def test_a_wrong_bit_is_outvoted():
    code = langid.codewords(4)
    book = langid.Codebook(list("abcd"), code, np.zeros((langid.BINS, code.shape[1]), np.float32))
    for i in range(4):
        for wrong in range(code.shape[1]):
            margins = code[i].copy()
            margins[wrong] *= -1
            book.weights[:] = margins
            assert book.predict(b"some letters")[0] == "abcd"[i]


def test_awkward_rows(spark, awkward):
    rows = awkward.selectExpr("*", "case when doc_id % 2 = 0 then 'aa' when doc_id = 9 then null else 'bb' end lang")
    found = {r.doc_id: r for r in langid.identify(rows, langid.train(rows)).collect()}
    assert {found[i].lang_pred for i in (1, 2, 3)} == {"und"}
    assert found[5].lang_pred in ("aa", "bb")
    nothing = langid.train(rows.limit(0))
    assert {r.lang_pred for r in langid.identify(rows, nothing).collect()} == {"und"}
    assert langid.identify(rows.limit(0), nothing).count() == 0
    assert langid.Codebook(["aa", "bb"], langid.codewords(2), np.zeros((langid.BINS, 1), np.float32)).predict("12 !?".encode())[0] == "und"
