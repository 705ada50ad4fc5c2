"""Exact substrings, vectors, rank fusion and the scores that combine them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions import vectors
from almanac.functions.text import occurrences
from almanac.operators.fts import ranked

RRF_K = 60


def substring_count(docs: DataFrame, pattern: str, text_col: str = "text") -> DataFrame:
    """One row: documents that hold the literal and occurrences, overlapping ones included."""
    found = docs.where(F.contains(F.col(text_col), F.lit(pattern))) if pattern else docs.where(F.lit(False))
    return found.agg(F.count("*").alias("n_documents"), F.coalesce(F.sum(occurrences(F.col(text_col), pattern)), F.lit(0)).alias("n_occurrences"))


def substring_hits(docs: DataFrame, pattern: str, limit: int | None = 10, key: str = "doc_id", text_col: str = "text", context: int = 60, carry: Sequence[str] = ()) -> DataFrame:
    """key, byte position of the first occurrence and its context, one hit a document, smallest keys first.

    The context has ``context`` characters on either side, never beyond the document, line breaks and NULs as spaces,
    dots where it is cut. Case matters. ``carry`` names further columns that hits have.
    """
    text, at = F.col(text_col), F.col("_at")
    found = docs.where(F.contains(text, F.lit(pattern)) if pattern else F.lit(False)).withColumn("_at", F.locate(pattern, text))
    begin = F.greatest(F.lit(1), at - context)
    end = F.least(F.char_length(text), at + len(pattern) - 1 + context)
    cut = F.translate(F.substring(text, begin, end - begin + 1), "\n\r\0", "   ")
    shown = F.concat(F.when(begin > 1, "...").otherwise(""), F.btrim(cut), F.when(end < F.char_length(text), "...").otherwise(""))
    hits = found.select(key, *carry, F.octet_length(F.left(text, at - 1)).cast("long").alias("byte_position"), shown.alias("context"))
    return hits if limit is None else hits.orderBy(key).limit(limit)


def trigrams(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """gram, key: the distinct character trigrams of every text, to be written clustered by gram."""
    text = F.translate(F.coalesce(text_col, F.lit("")), "\0", " ")
    grams = F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)(?=(...))"), F.lit(1)))
    return docs.select(key, F.explode(grams).alias("gram"))


def trigram_candidates(index: DataFrame, pattern: str, key: str = "doc_id") -> DataFrame:
    """Keys of documents that have all trigrams of the literal; what they hold is to be verified."""
    grams = sorted({pattern[i : i + 3] for i in range(len(pattern) - 2)})
    if not grams:
        return index.select(key).distinct()
    return index.where(F.col("gram").isin(grams)).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select(key)


def vector_search(rows: DataFrame, query: Sequence[float], limit: int = 10, key: str = "vec_id", vector_col: str = "embedding", where: Column | None = None) -> DataFrame:
    """key, score (cosine, 6 digits) and rank; filtered before ranking, so filters cost no recall."""
    usable = rows.where(F.col(vector_col).isNotNull() & (F.size(vector_col) == len(query)))
    usable = usable.where(where) if where is not None else usable
    scored = usable.select(key, F.round(vectors.cosine(F.col(vector_col), vectors.literal(query)), 6).alias("score"))
    return ranked(scored, "score", [key], limit)


def fuse(lists: Sequence[DataFrame], key: Sequence[str], limit: int | None = 10, k: int = RRF_K, weights: Sequence[float] | None = None) -> DataFrame:
    """Reciprocal rank fusion of lists with key columns and rank (from 1): each entry adds weight / (k + rank - 1).

    Every hit of a key adds, so a document with several chunks in a list counts several times.
    """
    weights = weights or [1.0] * len(lists)
    bag = None
    for hits, weight in zip(lists, weights):
        part = hits.select(*key, (F.lit(weight) / (k + F.col("rank") - 1)).alias("_part"))
        bag = part if bag is None else bag.unionByName(part)
    fused = bag.groupBy(*key).agg(F.round(F.sum("_part"), 9).alias("score"))
    return ranked(fused, "score", list(key), limit)


def hybrid(text_hits: DataFrame, vector_hits: DataFrame, key: Sequence[str], limit: int = 10) -> DataFrame:
    """Fused ranks where there are vector hits; without any, the text hits and their own scores."""
    has_vectors = vector_hits.limit(1).count() > 0
    return fuse([text_hits, vector_hits], key, limit) if has_vectors else ranked(text_hits.select(*key, "score"), "score", list(key), limit)


def weighted_hybrid(text_hits: DataFrame, vector_hits: DataFrame, key: Sequence[str], alpha: float = 0.7, limit: int = 10) -> DataFrame:
    """alpha times the vector score and 1 - alpha times the text score, each scaled by its list's best."""
    parts = []
    for hits, weight in ((vector_hits, alpha), (text_hits, 1 - alpha)):
        best = hits.agg(F.max("score").alias("_best"))
        parts.append(hits.crossJoin(F.broadcast(best)).select(*key, (weight * F.col("score") / F.when(F.col("_best") != 0, F.col("_best"))).alias("_part")))
    fused = parts[0].unionByName(parts[1]).groupBy(*key).agg(F.round(F.sum("_part"), 9).alias("score"))
    return ranked(fused, "score", list(key), limit)


def similar_pairs(rows: DataFrame, threshold: float, key: str = "vec_id", vector_col: str = "embedding", block: int = 512) -> DataFrame:
    """a < b, score: all pairs of vectors whose cosine exceeds the threshold.

    Rows are dealt into blocks of at most about ``block`` rows, and each pair of blocks is one task's work: a block
    nested loop by key, with no pair formed that isn't compared where both blocks are.
    """
    usable = rows.select(F.col(key).alias("id"), vectors.doubles(F.col(vector_col)).alias("v")).where("id is not null and v is not null")
    n_blocks = max(1, -(-usable.count() // block))
    dealt = usable.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int"))
    others = F.sequence(F.lit(0), F.lit(n_blocks - 1))
    pair = lambda c: F.struct(F.least("block", c).alias("x"), F.greatest("block", c).alias("y"))
    copies = dealt.withColumn("other", F.explode(others)).select(pair(F.col("other")).alias("pair"), "block", "id", "v")

    def compare(table):
        import numpy as np
        import pyarrow as pa

        pairs = table["pair"].combine_chunks()
        x, y = pairs.field("x")[0].as_py(), pairs.field("y")[0].as_py()
        block_of, ids = table["block"].to_numpy(), table["id"].to_numpy()
        vectors_ = table["v"].to_pylist()
        sides = []
        for side in (x, y):
            at = np.flatnonzero(block_of == side)
            sides.append((ids[at], np.array([vectors_[i] for i in at], float).reshape(len(at), -1)))
        (a, va), (b, vb) = sides
        if not len(a) or not len(b) or va.shape[1] != vb.shape[1]:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        length = lambda m: np.where((n := np.sqrt((m * m).sum(1, keepdims=True))) > 0, n, np.inf)
        scores = (va / length(va)) @ (vb / length(vb)).T
        i, j = np.nonzero(scores > threshold)
        keep = a[i] < b[j] if x == y else a[i] != b[j]
        i, j = i[keep], j[keep]
        return pa.table({"a": np.minimum(a[i], b[j]), "b": np.maximum(a[i], b[j]), "score": np.round(scores[i, j], 6)})

    return copies.groupBy("pair").applyInArrow(compare, "a long, b long, score double")


def retrieval_score(similarity: Column, importance: Column, days_since_access: Column, days_since_valid: Column, centrality: Column) -> Column:
    """0.30 similarity, 0.25 importance, 0.15 recency of access, 0.15 recency of validity, 0.15 centrality."""
    recent = lambda rate, days: F.exp(-rate * days)
    return 0.30 * similarity + 0.25 * importance + 0.15 * recent(0.10, days_since_access) + 0.15 * recent(0.023, days_since_valid) + 0.15 * centrality
