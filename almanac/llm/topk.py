"""Exact top-k search by distributed histogram selection.

Each query's kth best score is located without sorting: all candidates are scored, each task counts its scores into a
histogram over the range in which the kth value is known to lie, the histograms are summed, and the range shrinks to
the bin that holds the kth value; after a few rounds the bin is one integer wide. Then candidates that score at least
that much are kept, in each task at most the k best, ties to the smaller id, so the exact answer is a selection from
k rows a task and query however many candidates tie.

Queries are taken in blocks of ``block`` ids; a block is collected and sent to all tasks, so what is broadcast has a
fixed bound where ids are names (an id that stands for many vectors makes its block larger), and each block is held
against all candidates once a round. Scores are integers: components are scaled
and floored. Products are exact in doubles where scale allows, else in 64-bit integers.

Defined results: a vector that is null, or holds null or a component that is not finite, takes no part, neither as a
query nor as a candidate; the same for ids that are null. Vectors of different lengths are compared over the shorter
one's components. A query is compared with each row but those of its own id. Ids that repeat are candidates each, in
any order among equals. With fewer than k candidates all are returned. No rows in, no rows out.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.session import shared_folder

_BINS = 1024


def _usable(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id and the scaled, floored components as longs; rows that take no part are out."""
    vector = F.transform(vector_col, lambda x: x.cast("double"))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    good = rows.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector")).where(F.col("id").isNotNull() & F.col("vector").isNotNull() & ~bad)
    return good.select("id", F.transform("vector", lambda x: F.floor(x * scale)).alias("vector"))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of longs, padded with zeros (or cut) to ``width``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    at = np.concatenate([[0], np.cumsum(lengths)])
    for i, n in enumerate(lengths):
        out[i, : min(n, width)] = values[at[i] : at[i] + min(n, width)]
    return out


def _scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * max(1, queries.shape[1])
    if most < 2**53:
        return (queries.astype(np.float64) @ candidates.astype(np.float64).T).astype(np.int64)
    return queries @ candidates.T


def _histogram(task_state: dict, scores: np.ndarray, own: np.ndarray, low: np.ndarray, width: np.ndarray) -> None:
    """Add to counts[query, bin]; bin -1 (the last) is above the range. ``own`` marks what is not a candidate."""
    bins = (scores - low[:, None]) // width[:, None]
    keep = ~own & (bins >= 0)
    bins = np.minimum(bins, _BINS) + np.arange(len(scores))[:, None] * (_BINS + 1)
    task_state["counts"] += np.bincount(bins[keep], minlength=len(scores) * (_BINS + 1))


def top_k(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, block: int = 2048) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: each query's k highest inner products, ties to the smaller id."""
    spark = rows.sparkSession
    candidates = _usable(rows, id_col, vector_col, scale)
    asked = _usable(queries, id_col, vector_col, scale)
    ids = asked.select("id").distinct().sort("id")
    schema, folder, after = "query_id long, rank int, vec_id long, score long", "", None
    while True:
        later = ids if after is None else ids.where(F.col("id") > after)
        edge = later.limit(block).agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n")).first()
        if edge.a is None:
            return spark.read.schema(schema).parquet(folder) if folder else spark.createDataFrame([], schema)
        found = _block(candidates, asked.where(F.col("id").between(edge.a, edge.b)).toArrow(), k)
        if after is None and edge.n < block:
            return found
        # with several blocks, each one's answers are written, so that the plan doesn't grow with them
        folder, after = folder or f"{shared_folder(spark)}/top-{uuid.uuid4().hex}", edge.b
        found.write.mode("append").parquet(folder)


def _block(candidates: DataFrame, asked: pa.Table, k: int) -> DataFrame:
    spark = candidates.sparkSession
    lengths = asked["vector"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    width = int(lengths.max(initial=0)) or 1
    # where an id asks with several vectors, each asks for itself
    asked = asked.sort_by("id")
    query_ids, matrix = asked["id"].to_numpy(), _matrix(asked["vector"], width)
    shared = spark.sparkContext.broadcast((query_ids, matrix))
    n = len(query_ids)

    def scored(batches):
        ids, vectors = shared.value
        for batch in batches:
            them = batch.column("id").to_numpy(zero_copy_only=False)
            for a in range(0, len(them), 4096):
                part = them[a : a + 4096]
                yield ids, part, _scores(vectors, _matrix(batch.column("vector").slice(a, 4096), width)), ids[:, None] == part[None, :]

    def extremes(batches):
        low, high, seen = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min), np.zeros(n, np.int64)
        for _, _, s, own in scored(batches):
            low = np.minimum(low, np.where(own, np.iinfo(np.int64).max, s).min(axis=1))
            high = np.maximum(high, np.where(own, np.iinfo(np.int64).min, s).max(axis=1))
            seen += (~own).sum(axis=1)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(x[at]) for x in (np.arange(n), low, high, seen)], ["q", "low", "high", "seen"])

    low, high, seen = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for r in candidates.mapInArrow(extremes, "q long, low long, high long, seen long").groupBy("q").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("seen").alias("seen")).collect():
        low[r.q], high[r.q], seen[r.q] = r.low, r.high, r.seen
    want = np.minimum(k, seen)
    high = high + 1  # the kth value lies in low .. high - 1
    while ((high - low > 1) & (want > 0)).any():
        step = np.maximum(1, -(-(high - low) // _BINS))
        state = spark.sparkContext.broadcast((low, step))

        def count(batches):
            lows, steps = state.value
            own_state = {"counts": np.zeros(n * (_BINS + 1), np.int64)}
            for _, _, s, own in scored(batches):
                _histogram(own_state, s, own, lows, steps)
            at = np.flatnonzero(own_state["counts"])
            yield pa.RecordBatch.from_arrays([pa.array(at // (_BINS + 1)), pa.array(at % (_BINS + 1)), pa.array(own_state["counts"][at])], ["q", "bin", "n"])

        summed = candidates.mapInArrow(count, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        # from the top: the first bin at which want scores are reached, and how many lie above it
        wanted = spark.createDataFrame([(int(q), int(w)) for q, w in enumerate(want) if w > 0], "q long, want long")
        run = F.expr("sum(n) over (partition by q order by bin desc)")
        reached = summed.withColumn("run", run).join(F.broadcast(wanted), "q").where("run >= want").groupBy("q").agg(F.max("bin").alias("bin")).collect()
        state.destroy()
        for r in reached:
            low[r.q] += r.bin * step[r.q]
            high[r.q] = min(high[r.q], low[r.q] + step[r.q])
    threshold = spark.sparkContext.broadcast(np.where(want > 0, low, np.iinfo(np.int64).max))

    def keep(batches):
        """The k best of the task for each query, refreshed whenever a slice has been scored."""
        best: dict[int, list[tuple[int, int]]] = {}
        for _, part, s, own in scored(batches):
            q, c = np.nonzero((s >= threshold.value[:, None]) & ~own)
            order = np.lexsort((part[c], -s[q, c], q))
            q, c = q[order], c[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            for x, i, v in zip(q[rank < k].tolist(), part[c[rank < k]].tolist(), s[q[rank < k], c[rank < k]].tolist()):
                best.setdefault(x, []).append((-v, i))
            for x in {*q.tolist()}:
                best[x] = sorted(best[x])[:k]
        flat = [(x, i, -v) for x, own_best in best.items() for v, i in own_best]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], pa.int64()) for i in range(3)], ["q", "vec_id", "score"])

    names = spark.createDataFrame([(q, int(i)) for q, i in enumerate(query_ids)], "q long, query_id long")
    kept = candidates.mapInArrow(keep, "q long, vec_id long, score long")
    ranked = kept.withColumn("rank", F.expr("row_number() over (partition by q order by score desc, vec_id)")).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(names), "q").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
