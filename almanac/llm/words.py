"""Words as 64-bit numbers: what the text operators share.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return,
which is what ``bytes.split()`` yields. All of these are single bytes in UTF-8, so no character is ever cut.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Java regular expression of one word.
WORD = r"[^\x20\x09-\x0D]+"

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows by the few hundred, so that lists made of them stay small beside the batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def byte_texts(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """The texts of an Arrow column as UTF-8, without decoding them."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    return column.cast(pa.large_binary() if wide else pa.binary()).to_pylist()


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """How many bytes all texts have."""
    return docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0


#: Rows are packed when so many bytes of them have been read.
_PACK_BYTES = 1 << 25


def packs(rows: DataFrame, shard: Column) -> DataFrame:
    """shard and pack: ``rows`` by shard, as compressed Arrow data, so that texts are shuffled at a third of their size.

    Which shard a row falls into depends on the row alone, so a task that runs again says the same.
    """
    names = rows.columns

    def pack(table: pa.Table) -> Iterator[pa.RecordBatch]:
        number = table["__almanac_shard"].to_numpy()
        order = np.argsort(number, kind="stable")
        table, number = table.select(names).take(pa.array(order)).combine_chunks(), number[order]
        edges = np.flatnonzero(np.diff(number, prepend=-1))
        for a, b in zip(edges, np.append(edges[1:], len(number))):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table.slice(a, b - a))
            yield pa.RecordBatch.from_arrays([pa.array([number[a]], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["shard", "pack"])

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= _PACK_BYTES:
                yield from pack(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield from pack(pa.Table.from_batches(held))

    return rows.withColumn("__almanac_shard", shard.cast("int")).mapInArrow(deal, "shard int, pack binary")


def unpacked(column: pa.ChunkedArray) -> pa.Table:
    """The rows of a column of packs, of which there is at least one."""
    return pa.concat_tables(pa.ipc.open_stream(x).read_all() for x in column.to_pylist())


def squeeze(values: np.ndarray) -> bytes:
    """Unsigned numbers, most of them small, compressed byte by byte of the numbers."""
    planes = values.view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.compress(planes.tobytes(), 1)


def stretched(data: bytes, dtype: str) -> np.ndarray:
    """What ``squeeze`` was given."""
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1).T).view(dtype).ravel()


def numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes in order, which of them stands at each place, and where each first does.

    One sort of the hashes' upper bits, with the place in the lower ones, does the work of three; hashes of the same
    upper bits are few, and are put in order afterwards.
    """
    n = len(hashes)
    if not n:
        return hashes, np.zeros(0, np.int32), np.zeros(0, np.int64)
    low = np.uint64(max(1, (n - 1).bit_length()))
    mask = (np.uint64(1) << low) - np.uint64(1)
    keys = hashes & ~mask
    keys |= np.arange(n, dtype=np.uint64)
    keys.sort()
    at = (keys & mask).astype(np.int64)
    keys >>= low
    top, found = keys, hashes[at]
    mixed = (top[1:] == top[:-1]) & (found[1:] != found[:-1])
    if mixed.any():
        some = np.flatnonzero(np.isin(top, top[1:][mixed]))
        at[some] = at[some][np.lexsort((at[some], found[some], top[some]))]
        found = hashes[at]
    new = np.concatenate([[True], found[1:] != found[:-1]])
    which = np.empty(n, np.int32)
    which[at] = np.cumsum(new, dtype=np.int32) - 1
    return found[new], which, at[new]


def hash_words(words: list[bytes]) -> np.ndarray:
    """64 bits for each word. A call costs less than finding the word in a dictionary would."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def hash_texts(texts: list[bytes | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All word hashes of all texts in a row, and the offsets where each text's words begin (and the last ends)."""
    parts, offsets = [], np.zeros(len(texts) + 1, np.int64)
    for i, text in enumerate(texts):
        if text:
            parts.append(hash_words((text.lower() if lower else text).split()))
            offsets[i + 1] = len(parts[-1])
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.cumsum(offsets)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * _M1
    return x ^ (x >> np.uint64(32))


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _M2 + (b ^ (b >> np.uint64(31))) * _M3)


def ngram_hashes(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The hash of the n words from each place on, for all places that n words follow (also across texts).

    Hashes of 1, 2, 4, ... words are built by doubling and joined to n, so the cost grows with log n only.
    """
    length = len(words) - n + 1
    if length <= 0:
        return np.zeros(0, np.uint64)
    power, span, result, done = mix(words ^ np.uint64(seed * 0x5851F42D4C957F2D & (1 << 64) - 1)), 1, None, 0
    while True:
        if n & span:
            result = power if result is None else _join(power[: len(result) - span], result[span:])
            done += span
        if done == n:
            return result[:length]
        power = _join(power[:-span], power[span:])
        span *= 2


def inside(offsets: np.ndarray, n: int, size: int) -> np.ndarray:
    """For each of ``size`` places, whether n words from there on are of one text."""
    ends = np.repeat(offsets[1:], np.diff(offsets))[:size]
    return np.arange(size) + n <= ends


def member(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    """Which values are in the set; a table of their lowest bits, which must be as good as random, rules most out."""
    found = np.zeros(len(values), bool)
    at = maybe_member(values, sorted_set)
    place = np.searchsorted(sorted_set, values[at])
    place[place == len(sorted_set)] = 0
    found[at] = sorted_set[place] == values[at] if len(at) else False
    return found


def maybe_member(values: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Places of values whose lowest bits are those of a member; no member's place is left out."""
    if not len(members):
        return np.zeros(0, np.int64)
    mask = np.uint64((1 << min(24, len(members).bit_length() + 3)) - 1)
    table = np.zeros(int(mask) + 1, bool)
    table[members & mask] = True
    return np.flatnonzero(table[values & mask])
