"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into chunks that overlap, and each chunk is pre-tokenised by itself, in whichever task has it. Where a
pre-token begins does not depend on what stands before it, so two neighbours that both begin a pre-token at one place
of their overlap agree from there on. The texts are stitched at the first such place, the pieces are encoded by the
rank file's merges, and the ids of all pieces follow one another. A text without such a place in an overlap (a run of
one kind of character longer than it) is pre-tokenised again across that seam. A text of one chunk has no seam to find,
so it is pre-tokenised and encoded where it is read; only texts of several chunks travel.

Decoding joins the bytes of the ids. Special tokens are ordinary text.

Defined results: a null text is encoded like an empty one: no ids. Rows are encoded one by one, repeated or not; other
columns are ignored whatever their names.
"""

from __future__ import annotations

import base64
from array import array
from bisect import bisect_left
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac.llm.words import slices
from almanac.session import shuffle_partitions

CHUNK, OVERLAP = 1 << 15, 512
#: Up to so many characters after a pre-token's end decide where it ends: a contraction's two letters.
_LOOK = 3
#: A worker's dictionary of encoded pieces is emptied at this size: it only saves time. Longer pieces stay out of it.
_CACHE_ENTRIES, _CACHE_PIECE = 100_000, 64


def split_pattern(pattern: str) -> regex.Pattern:
    """The pattern with white space as Unicode has it, which is what tokenizers mean by it."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


class Vocabulary:
    """The ranks of a tiktoken file: pieces to ids and ids to bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = split_pattern(pattern)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        self.merges = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    def encode_piece(self, piece: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        ids = self.known.get(piece)
        if ids is None:
            ids = array("I", self.merges.encode_ordinary(piece)).tobytes()
            if len(piece) <= _CACHE_PIECE:
                if len(self.known) >= _CACHE_ENTRIES:
                    self.known.clear()
                self.known[piece] = ids
        return ids

    def encode_pieces(self, pieces: Iterable[str]) -> bytes:
        return b"".join(map(self.encode_piece, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def starts(self, text: str, base: int, is_end: bool) -> list[int]:
        """Where pre-tokens begin in a chunk that stands at ``base``; those that its end may have changed are left out."""
        limit = len(text) if is_end else len(text) - _LOOK
        found = []
        for m in self.pattern.finditer(text):
            if not is_end and m.end() > limit:
                break
            found.append(base + m.start())
        else:
            m = None
        if m is not None:
            found.append(base + m.start())  # it begins here whatever follows
        return found


@lru_cache(maxsize=4)
def _loaded(content: bytes, pattern: str) -> Vocabulary:
    return Vocabulary({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}, pattern)


def stitch(chunks: list[tuple[int, str, list[int]]], vocabulary: Vocabulary) -> Iterable[str]:
    """The pre-tokens of the whole text of chunks (where it stands, text, pre-token starts), in order.

    Where neighbours have no start in common, the text from the last certain start on is pre-tokenised again together
    with as many chunks as double it, so a run of any length is read a bounded number of times.
    """
    pieces_from, at_chunk = 0, 1
    base, text, starts = chunks[0]
    while at_chunk < len(chunks):
        next_base, next_text, next_starts = chunks[at_chunk]
        low, common = bisect_left(starts, max(next_base, pieces_from)), set(next_starts)
        seam = next((s for s in starts[low:] if s in common), None)
        if seam is not None:
            yield from _cut(base, text, starts[bisect_left(starts, pieces_from) : bisect_left(starts, seam)], seam)
            base, text, starts, pieces_from = next_base, next_text, next_starts, seam
            at_chunk += 1
            continue
        certain = bisect_left(starts, next_base)
        at = starts[certain - 1] if certain and starts[certain - 1] >= pieces_from else pieces_from
        yield from _cut(base, text, starts[bisect_left(starts, pieces_from) : bisect_left(starts, at)], at)
        parts, size, goal = [text[at - base : next_base - base]], next_base - at, 2 * (next_base - at)
        while True:
            next_base, next_text, _ = chunks[at_chunk]
            at_chunk += 1
            if at_chunk == len(chunks) or size + len(next_text) >= goal:
                parts.append(next_text)
                break
            step = chunks[at_chunk][0] - next_base
            parts.append(next_text[:step])
            size += step
        text = "".join(parts)
        base, pieces_from, starts = at, at, vocabulary.starts(text, at, False)
    end = base + len(text)
    if pieces_from < end:
        yield from vocabulary.pattern.findall(text[pieces_from - base :])


def _cut(base: int, text: str, starts: list[int], end: int) -> Iterable[str]:
    for a, b in zip(starts, [*starts[1:], end]):
        yield text[a - base : b - base]


def encode(docs: DataFrame, rank_file: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit integers) and decoded (binary), one row per row.

    ``rank_file`` is read on the driver; its content, whose size is fixed by the vocabulary, goes to the workers.
    """
    spark = docs.sparkSession
    with open(rank_file, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())
    kind = docs.schema["doc_id"].dataType
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = F.length("text")
    result = T.StructType([T.StructField("doc_id", kind), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])

    def whole(batches):
        vocabulary = _loaded(content.value, pattern)
        for batch in slices(batches):
            ids = [vocabulary.encode_pieces(vocabulary.pattern.findall(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(map(vocabulary.decode, ids), pa.binary())], result.names)

    def pretokenise(batches):
        vocabulary = _loaded(content.value, pattern)
        for batch in slices(batches):
            found = [vocabulary.starts(t, b, e) for t, b, e in zip(*(batch.column(c).to_pylist() for c in ("piece", "base", "is_end")))]
            columns = [batch.column(c) for c in ("row", "base", "piece")] + [pa.array([np.array(x, "<i8").tobytes() for x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "base", "piece", "starts"])

    def join(table: pa.Table) -> pa.Table:
        vocabulary = _loaded(content.value, pattern)
        order = sorted(zip(table["base"].to_pylist(), table["piece"].to_pylist(), table["starts"].to_pylist()))
        chunks = [(b, t, np.frombuffer(s, "<i8").tolist()) for b, t, s in order]
        ids = vocabulary.encode_pieces(stitch(chunks, vocabulary))
        return pa.table({"row": table["row"][:1], "ids": pa.array([ids], pa.binary()), "decoded": pa.array([vocabulary.decode(ids)], pa.binary())})

    short = rows.where(size <= chunk).mapInArrow(whole, result)
    # equal rows have one key: they are encoded once, and each gets the result
    long_ = rows.where(size > chunk).withColumn("row", F.concat_ws(":", F.sha2("text", 256), F.col("doc_id").cast("string")))
    base = F.explode(F.sequence(F.lit(0), size - 1, F.lit(chunk)))
    cut = long_.dropDuplicates(["row"]).select("row", "text", base.alias("base")).select(
        "row", F.col("base").cast("long").alias("base"), F.substring("text", F.col("base") + 1, F.lit(chunk + overlap)).alias("piece"), (F.col("base") + chunk + overlap >= size).alias("is_end")
    )
    dealt = cut.repartition(shuffle_partitions(spark), "row", "base")
    marked = dealt.mapInArrow(pretokenise, T.StructType([T.StructField("row", T.StringType()), T.StructField("base", T.LongType()), T.StructField("piece", T.StringType()), T.StructField("starts", T.BinaryType())]))
    stitched = marked.groupBy("row").applyInArrow(join, T.StructType([T.StructField("row", T.StringType()), *result.fields[1:]]))
    return short.unionByName(long_.select("row", "doc_id").join(stitched, "row").select(*result.names))
