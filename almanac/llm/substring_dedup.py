"""Exact substring deduplication with fixed-block anchors.

A passage repeats if a run of at least ``window`` words occurs at two places, in one text or in two. Of any such run
each copy holds a whole block of ``anchor = (window + 1) // 2`` words that begins at a multiple of ``anchor``. So:

1. *Index and probe.* Every text's non-overlapping blocks are the index; the rolling windows of ``anchor`` words of
   all texts probe it. A probe hits if its words are those of a block and stand at two places or more.
2. *Extend.* Every window of ``window`` words around a hit is compared with all others of its words. Those that stand
   twice are repeats, and neighbouring ones join to maximal exact repeats. Extending groups of equal windows one by
   one, not pairs of hits, makes k copies cost k steps.
3. *Remove.* Words under a maximal repeat go.

Texts are dealt into shards of ``shard_bytes`` once, compressed. A shard sends each distinct hash once, however often it occurs in it, to the
partition that owns the hash, and hears back which of them count: a passage that stands in a third of all texts is as
many rows as there are shards. Anchors travel as 32 bits beside the number of the partition that owns them, for
they only nominate; repeats are decided on 96 bits.

Defined results: a null or empty text has no words, none removed, and an empty kept text. Rows are judged one by one,
also if they repeat (a repeated row's passages then do stand twice). Null ids are kept as they are. Other columns of
the input are ignored, whatever their names. No rows in, no rows out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.words import byte_texts, hash_texts, inside, maybe_member, member, ngram_hashes, packs, text_bytes, unpacked
from almanac.session import shuffle_partitions

_LETTER = "owner int, shard int, hashes binary, flags binary"
_REPLY = "shard int, owner int, hashes binary"
_RESULT = "doc_id {id}, n_words long, spans array<struct<start:long,end:long>>, kept_text string"
_PAIR = np.dtype([("lo", "<u8"), ("hi", "<u4")])


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 12 << 20, owner_bytes: int = 96 << 20) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, spans (maximal repeats as ranges of words), kept_text."""
    spark = docs.sparkSession
    anchor = (window + 1) // 2
    size, pieces = text_bytes(docs, text_col), shuffle_partitions(spark)
    # letters are shards times owners: few owners, as an owner's work is small
    shards, owners = max(pieces, -(-size // shard_bytes)), max(pieces, -(-size // owner_bytes))
    shard_tasks, owner_tasks = max(pieces, -(-shards // 4)), max(pieces, -(-owners // 4))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sharded = packs(rows, F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards))).repartition(shard_tasks, "shard").groupBy("shard")

    def probe(key: tuple, table: pa.Table) -> pa.Table:
        words, offsets = hash_texts(byte_texts(unpacked(table["pack"])["text"]))
        codes = _anchor_codes(words, anchor, owners)
        valid = inside(offsets, anchor, len(codes))
        place = np.arange(len(codes)) - np.repeat(offsets[:-1], np.diff(offsets))[: len(codes)]
        blocks = np.unique(codes[valid & (place % anchor == 0)])
        distinct, counts = np.unique(codes[valid], return_counts=True)
        flags = (counts > 1).astype(np.uint8) | member(distinct, blocks).astype(np.uint8) << 1
        low = (distinct & np.uint64(0xFFFFFFFF)).astype("<u4")
        return _letters(key[0].as_py(), (distinct >> np.uint64(32)).astype(np.int64), low, flags)

    def answer_anchors(key: tuple, table: pa.Table) -> pa.Table:
        hashes, flags, ends, which = _opened(table, "<u4")
        times = np.bincount(which)
        twice = (times > 1) | _any(which, flags & 1, len(times))
        return _replies(table, hashes, (twice & _any(which, flags & 2, len(times)))[which], ends)

    def extend(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(replies) or not len(table):
            return _letters(0, np.zeros(0, np.int64), np.zeros(0, _PAIR), np.zeros(0, np.uint8))
        words, offsets = hash_texts(byte_texts(unpacked(table["pack"])["text"]))
        codes = _anchor_codes(words, anchor, owners)
        hit = member(codes, _codes_of(replies)) & inside(offsets, anchor, len(codes))
        reach = np.concatenate([[0], np.cumsum(hit)])
        pairs = _window_pairs(words, window)
        start = np.arange(len(pairs))
        near = reach[np.minimum(start + window - anchor + 1, len(hit))] > reach[start]
        pairs = _in_order(pairs[near & inside(offsets, window, len(pairs))])
        new = np.ones(len(pairs), bool)
        new[1:] = (pairs["lo"][1:] != pairs["lo"][:-1]) | (pairs["hi"][1:] != pairs["hi"][:-1])
        at = np.flatnonzero(new)
        flags = (np.diff(np.append(at, len(pairs))) > 1).astype(np.uint8)
        pairs = pairs[at]
        owner = ((pairs["lo"] >> np.uint64(32)) % np.uint64(owners)).astype(np.int64)
        order = np.argsort(owner, kind="stable")
        return _letters(_shard_of(table), owner[order], pairs[order], flags[order])

    def answer_windows(key: tuple, table: pa.Table) -> pa.Table:
        hashes, flags, ends, which = _opened(table, _PAIR)
        times = np.bincount(which)
        return _replies(table, hashes, ((times > 1) | _any(which, flags & 1, len(times)))[which], ends)

    def remove(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        rows = unpacked(table["pack"])
        texts = byte_texts(rows["text"])
        repeated = [np.frombuffer(x, _PAIR) for x in replies["hashes"].to_pylist()] if len(replies) else []
        repeated = _in_order(np.concatenate(repeated)) if repeated else np.zeros(0, _PAIR)
        counts, spans, kept = [], [], []
        if len(repeated):
            words, offsets = hash_texts(texts)
            pairs = _window_pairs(words, window)
            starts = np.zeros(len(words) + 1, np.int64)
            starts[: len(pairs)] = _is_repeated(pairs, repeated) & inside(offsets, window, len(pairs))
            depth = np.cumsum(starts[: len(words)])
            covered = depth.copy()
            covered[window:] -= depth[:-window]
            covered = covered > 0
        for i, text in enumerate(texts):
            own = text.split() if text else []
            counts.append(len(own))
            gone = covered[offsets[i] : offsets[i + 1]] if len(repeated) else np.zeros(0, bool)
            if gone.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])])
                own = [w for w, g in zip(own, gone.tolist()) if not g]
            else:
                spans.append([])
            kept.append(b" ".join(own))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"doc_id": rows["doc_id"], "n_words": pa.array(counts, pa.int64()), "spans": pa.array(spans, span), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())})

    anchors = sharded.applyInArrow(probe, _LETTER).repartition(owner_tasks, "owner").groupBy("owner").applyInArrow(answer_anchors, _REPLY)
    windows = sharded.cogroup(anchors.repartition(shard_tasks, "shard").groupBy("shard")).applyInArrow(extend, _LETTER)
    repeats = windows.repartition(owner_tasks, "owner").groupBy("owner").applyInArrow(answer_windows, _REPLY).repartition(shard_tasks, "shard")
    kind = dict(rows.dtypes)["doc_id"]
    return sharded.cogroup(repeats.groupBy("shard")).applyInArrow(remove, _RESULT.format(id=kind))


def _anchor_codes(words: np.ndarray, anchor: int, owners: int) -> np.ndarray:
    """Owner of the hash in the upper 32 bits, 32 bits of the hash in the lower."""
    h = ngram_hashes(words, anchor)
    return ((h >> np.uint64(32)) % np.uint64(owners)) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)


def _window_pairs(words: np.ndarray, window: int) -> np.ndarray:
    lo = ngram_hashes(words, window, seed=1)
    out = np.empty(len(lo), _PAIR)
    out["lo"], out["hi"] = lo, ngram_hashes(words, window, seed=2) >> np.uint64(32)
    return out


def _in_order(pairs: np.ndarray) -> np.ndarray:
    return pairs[np.lexsort((pairs["hi"], pairs["lo"]))]


def _is_repeated(pairs: np.ndarray, repeated: np.ndarray) -> np.ndarray:
    lo, own = np.ascontiguousarray(repeated["lo"]), np.ascontiguousarray(pairs["lo"])
    found = np.zeros(len(pairs), bool)
    left = maybe_member(own, lo)
    at = np.searchsorted(lo, own[left])
    while len(left):  # as many rounds as windows share their lower 64 bits: one, in practice
        here = at < len(lo)
        here[here] = lo[at[here]] == own[left[here]]
        left, at = left[here], at[here]
        found[left] |= repeated["hi"][at] == pairs["hi"][left]
        at = at + 1
    return found


def _shard_of(table: pa.Table) -> int:
    return table["shard"][0].as_py()


def _letters(shard: int, owner: np.ndarray, hashes: np.ndarray, flags: np.ndarray) -> pa.Table:
    """One row for each owner; ``owner`` is in order."""
    edges = np.flatnonzero(np.diff(owner, prepend=-1))
    ends = np.append(edges[1:], len(owner))
    return pa.table({
        "owner": pa.array(owner[edges], pa.int32()),
        "shard": pa.array(np.full(len(edges), shard), pa.int32()),
        "hashes": pa.array([hashes[a:b].tobytes() for a, b in zip(edges, ends)], pa.binary()),
        "flags": pa.array([np.packbits(flags[a:b, None] >> np.arange(2, dtype=np.uint8) & 1).tobytes() for a, b in zip(edges, ends)], pa.binary()),
    })


def _opened(table: pa.Table, dtype: str | np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All hashes sent to an owner, their flags, where each letter ends, and which distinct hash each is."""
    letters = [np.frombuffer(x, dtype) for x in table["hashes"].to_pylist()]
    flags = [np.unpackbits(np.frombuffer(f, np.uint8), count=2 * len(x)).reshape(-1, 2) @ np.array([1, 2], np.uint8) for f, x in zip(table["flags"].to_pylist(), letters)]
    hashes = np.concatenate(letters)
    if hashes.dtype == _PAIR:
        order = np.lexsort((hashes["hi"], hashes["lo"]))
        lo, hi = hashes["lo"][order], hashes["hi"][order]
        new = np.concatenate([[False], (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
        which = np.empty(len(hashes), np.int64)
        which[order] = np.cumsum(new)
    else:
        which = np.unique(hashes, return_inverse=True)[1]
    return hashes, np.concatenate(flags), np.cumsum([len(x) for x in letters]), which


def _any(which: np.ndarray, flags: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(which[flags > 0], minlength=size) > 0


def _replies(table: pa.Table, hashes: np.ndarray, yes: np.ndarray, ends: np.ndarray) -> pa.Table:
    def rows() -> Iterator[tuple[int, int, bytes]]:
        begin = 0
        for shard, owner, end in zip(table["shard"].to_pylist(), table["owner"].to_pylist(), ends):
            if yes[begin:end].any():
                yield shard, owner, hashes[begin:end][yes[begin:end]].tobytes()
            begin = end

    shard, owner, sent = zip(*found) if (found := list(rows())) else ((), (), ())
    return pa.table({"shard": pa.array(shard, pa.int32()), "owner": pa.array(owner, pa.int32()), "hashes": pa.array(sent, pa.binary())})


def _codes_of(replies: pa.Table) -> np.ndarray:
    own = [np.uint64(o << 32) | np.frombuffer(x, "<u4").astype(np.uint64) for o, x in zip(replies["owner"].to_pylist(), replies["hashes"].to_pylist())]
    return np.sort(np.concatenate(own))
