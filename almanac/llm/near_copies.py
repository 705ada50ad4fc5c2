"""Near copies by the Jaccard similarity of their sets of word shingles: candidates by SimHash, each verified exactly.

A text's shingles are its runs of ``shingle`` words (A-Z lower-cased), 64 bits each. Texts of equal sets are one at
once. A set's fingerprint has 256 bytes: a bit is 1 if it is set in over half of the shingles' hashes. An inverted
index lists sets by positional bytes, two adjacent positions intersected, so each set stands in 128 lists. Pairs that
meet are tallied by the positional bytes they share; those that reach the minimum and differ in few enough bits are
candidates. The bounds follow from ``similarity``: two sets so similar differ in a bit with probability
p = acos(2s / (1 + s)) / pi, and the bounds are five standard deviations or more from what that makes expected.

What may be lost: a pair of similarity 0.8 (p = 0.152) shares no list with probability (1 - (1 - p)^16)^128 = 7e-5, one
of 0.85 with 2e-6, closer pairs with less; similarities below 0.8 lose more, 0.7 1.5 %. Majorities of few shingles are
coarser, so sets of up to 40 are listed by their first shingles too: similar ones have one of those in common, and
what meets there is compared without the bounds. Links are pairs whose sets, compared whole, are at least
``similarity`` alike, so nothing is linked by estimate.

The index is walked twice. At first with 16 bytes of each fingerprint, which tells the lists in which a set has a
neighbour at all; then, for these, with whole fingerprints. For up to two rounds, as long as there are many pairs left,
each set is compared with one other: one that is probably similar and the same for most of its neighbours, else the
nearest. What that links needs no more comparison. Then all candidates that no link connects so far are compared, which in
a large group just short of ``similarity`` are as many as its pairs. They are dealt, packed, over the cells of a board by
both sets; a set goes once to each cell that has a pair of it, at most twice the side of the board, and out of a cell
come fewer links than it has sets. No list, member or pair is capped.

Defined results: null, empty and blank texts have no shingle and are copies of each other. A text of fewer words than
a shingle is one shingle. No rows in, no rows out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.simhash import components, keep_first
from almanac.llm.words import byte_texts, hash_words, mix, ngram_hashes, slices, squeeze, stretched
from almanac.session import cut_lineage, shuffle_partitions

#: A fingerprint's 64-bit words, bytes, and lists, one for two bytes.
WORDS = 32
BYTES = 8 * WORDS
LISTS = BYTES // 2
#: So many words of a fingerprint go along when the index is walked for the first time.
SKETCH = 2
#: Sets of at most so many shingles are listed by their first shingles too. The keys of these lists have this bit.
SMALL = 40
_BY_SHINGLE = 1 << 62
_RNG = np.random.default_rng(42)
_FLIP = _RNG.integers(0, 1 << 64, WORDS, np.uint64)
_TIMES = _RNG.integers(0, 1 << 64, WORDS, np.uint64) | np.uint64(1)
_LANES = np.uint64(0x0101010101010101)
_ROUNDS = 2
#: So many pairs a member are compared without further rounds.
_FEW_PAIRS = 4
#: A part of the index has about so many bytes; so many hashes of texts go to all executors.
_PART_BYTES, _BROADCAST = 1 << 25, 1 << 21
#: A part of the lists whose members are compared has fingerprints of about so many bytes, a cell about so many pairs.
_LISTS_BYTES, _CELL_PAIRS = 1 << 23, 1 << 14
#: So many links are connected by the driver, more by rounds over all executors.
_COLLECTED = 1 << 19


class Bounds(NamedTuple):
    """Most bits a sketch differs in, least positional bytes shared, most bits differing, and bits of the probably similar."""

    sketch: int
    shared: int
    bits: int
    probable: int

    @classmethod
    def of(cls, similarity: float) -> Bounds:
        p = math.acos(2 * similarity / (1 + similarity)) / math.pi
        same = (1 - p) ** 8
        spread = lambda n, p: math.sqrt(n * p * (1 - p))
        sketch, whole = 64 * SKETCH, 64 * WORDS
        return cls(
            math.ceil(sketch * p + 5 * spread(sketch, p)),
            max(2, math.floor(BYTES * same - 5 * spread(BYTES, same))),
            math.ceil(whole * p + 6 * spread(whole, p)),
            math.floor(whole * p - spread(whole, p)),
        )


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """The distinct shingles of a text, in order."""
    words = text.lower().split() if text else []
    if len(words) >= size:
        return np.unique(ngram_hashes(hash_words(words), size))
    return hash_words([b" ".join(words)] if words else [])


def fingerprint(hashes: np.ndarray) -> bytes:
    """The bits set in over half of the hashes, each made ``WORDS`` long; nothing for an empty set."""
    if not len(hashes):
        return b""
    votes = np.zeros((8, WORDS, 8), np.int64)  # by bit of a byte, word, byte of the word
    for at in range(0, len(hashes), 255):
        x = (hashes[at : at + 255, None] ^ _FLIP) * _TIMES
        x ^= x >> np.uint64(32)
        for bit in range(8):
            lanes = (x >> np.uint64(bit) & _LANES).sum(axis=0, dtype=np.uint64)
            votes[bit] += lanes.astype("<u8").view(np.uint8).reshape(WORDS, 8)
    return np.packbits((2 * votes > len(hashes)).transpose(1, 2, 0), bitorder="little").tobytes()


def first_shingles(hashes: np.ndarray, similarity: float) -> np.ndarray:
    """Keys of a small set's first shingles: as many as it can lack of a similar set's, and one more."""
    n = len(hashes)
    some = hashes[: n - math.ceil(similarity * n - 1e-9) + 1] if 0 < n <= SMALL else hashes[:0]
    return some >> np.uint64(2) | np.uint64(_BY_SHINGLE)


def _set_id(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes())


def _signed(numbers) -> pa.Array:
    return pa.array(np.array(numbers, np.uint64).view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _signed(np.concatenate([np.zeros(0, np.uint64), *arrays])))


def signatures(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """doc_id, text_hash, the set's number and size, its fingerprint and the keys of its first shingles, one row per row."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")

    def of(batches):
        for batch in slices(batches):
            sets = [shingle_set(t, shingle) for t in byte_texts(batch.column("text"))]
            made = [
                _signed([_set_id(s) for s in sets]),
                pa.array(list(map(len, sets)), pa.int64()),
                pa.array(list(map(fingerprint, sets)), pa.binary()),
                _lists([first_shingles(s, similarity) for s in sets]),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *made], ["doc_id", "text_hash", "id", "n", "print", "first"])

    return rows.mapInArrow(of, f"doc_id {dict(rows.dtypes)['doc_id']}, text_hash long, id long, n long, print binary, first array<long>")


def shingle_sets(docs: DataFrame, text_hashes: DataFrame, shingle: int) -> DataFrame:
    """id and hashes of the sets of the texts whose hashes are given."""
    rows = docs.select(F.xxhash64("text").alias("text_hash"), "text").join(text_hashes, "text_hash", "left_semi").select("text")

    def of(batches):
        for batch in slices(batches):
            sets = [shingle_set(t, shingle) for t in byte_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([_signed([_set_id(s) for s in sets]), _lists(sets)], ["id", "hashes"])

    return rows.mapInArrow(of, "id long, hashes array<long>").dropDuplicates(["id"])


def _matrix(prints: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(prints.to_pylist()), "<u8").reshape(len(prints), -1)


def _meeting(key: np.ndarray, i: np.ndarray, step: int) -> np.ndarray:
    """Those places ``i`` of keys in order which have the same key ``step`` places on."""
    i = i[i + step < len(key)]
    return i[key[i] == key[i + step]]


def _bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def with_neighbours(key: np.ndarray, sketch: np.ndarray, most: int) -> np.ndarray:
    """Which members of the lists, keys in order, have another within ``most`` bits in their list."""
    found = np.zeros(len(key), bool)
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    number = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(key))))
    i, step = np.arange(len(key)), 1
    while len(i := _meeting(key, i, step)):
        at = i[~(found[i] & found[i + step])]
        at = at[(key[at] >= _BY_SHINGLE) | (_bits(sketch[at], sketch[at + step]) <= most)]
        found[at] = found[at + step] = True
        if step % 16 == 0:  # lists of which all have one are done
            i = i[~np.logical_and.reduceat(found, begins)[number[i]]]
        step += 1
    return found


def near_lists(nodes: DataFrame, most: int) -> DataFrame:
    """key and id: the lists in which a set of ``nodes`` has a neighbour by the first words of their fingerprints."""
    size = nodes.count() * LISTS * 28
    n_parts = max(shuffle_partitions(nodes.sparkSession), -(-size // _PART_BYTES))

    def deal(batches):
        for batch in batches:
            prints = _matrix(batch.column("print"))
            first = batch.column("first")
            n_first = np.diff(first.offsets.to_numpy())
            key = (np.arange(LISTS, dtype=np.uint64) << np.uint64(16)) | prints.view("<u2").astype(np.uint64)
            key = np.concatenate([key.ravel(), first.flatten().to_numpy().view(np.uint64)])
            row = np.concatenate([np.repeat(np.arange(len(prints)), LISTS), np.repeat(np.arange(len(prints)), n_first)])
            part = mix(key) % np.uint64(n_parts)
            order = np.lexsort((key, part))
            key, row, part = key[order], row[order], part[order]
            ids, sketch = batch.column("id").to_numpy(), np.ascontiguousarray(prints[:, :SKETCH])
            edges = np.flatnonzero(np.diff(part.astype(np.int64), prepend=-1))
            for a, b in zip(edges, np.append(edges[1:], len(part))):
                own, at = np.unique(row[a:b], return_inverse=True)
                letter = [squeeze(key[a:b]), squeeze(at.astype(np.uint32)), ids[own].tobytes(), sketch[own].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([int(part[a])], pa.int32()), *(pa.array([x], pa.binary()) for x in letter)], ["part", "keys", "at", "ids", "sketches"])

    def walk(table: pa.Table) -> pa.Table:
        keys, ids, sketches = [], [], []
        for letter in table.to_pylist():
            at = stretched(letter["at"], "<u4")
            keys.append(stretched(letter["keys"], "<u8"))
            ids.append(np.frombuffer(letter["ids"], "<i8")[at])
            sketches.append(np.frombuffer(letter["sketches"], "<u8").reshape(-1, SKETCH)[at])
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        key = key[order]
        found = with_neighbours(key, np.concatenate(sketches)[order], most)
        return pa.table({"key": key[found].view(np.int64), "id": np.concatenate(ids)[order][found]})

    letters = nodes.select("id", "print", "first").mapInArrow(deal, "part int, keys binary, at binary, ids binary, sketches binary")
    return letters.groupBy("part").applyInArrow(walk, "key long, id long")


def candidate_places(key: np.ndarray, n: np.ndarray, root: np.ndarray, prints: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of the members of lists, keys in order, that are candidates, and the bits they differ in.

    A pair that shares several lists by positional bytes is a candidate in the first of them.
    """
    bounds = Bounds.of(similarity)
    octets, pairs = prints.view(np.uint8), prints.view("<u2")
    i, step = np.arange(len(key)), 1
    while len(i := _meeting(key, i, step)):
        a = i[root[i] != root[i + step]]
        a = a[np.minimum(n[a], n[a + step]) >= similarity * np.maximum(n[a], n[a + step]) - 1e-9]
        by_shingle = key[a] >= _BY_SHINGLE
        few = by_shingle | (_bits(prints[a, :SKETCH], prints[a + step, :SKETCH]) <= bounds.sketch)
        a, by_shingle = a[few], by_shingle[few]
        for at in range(0, len(a), 1 << 14):
            x, free = a[at : at + (1 << 14)], by_shingle[at : at + (1 << 14)]
            own = (pairs[x] == pairs[x + step]).argmax(axis=1) == key[x] >> 16
            tally = (octets[x] == octets[x + step]).sum(axis=1)
            differ = _bits(prints[x], prints[x + step])
            good = free | own & (tally >= bounds.shared) & (differ <= bounds.bits)
            yield x[good], x[good] + step, differ[good]
        step += 1


def _open_lists(near: DataFrame) -> DataFrame:
    """part, id, root and keys: each set (key, id, root, part) once a part, with its lists that hold two roots or more."""

    def opened(table: pa.Table) -> pa.Table:
        key, ids, root = (table[c].to_numpy() for c in ("key", "id", "root"))
        begins = np.flatnonzero(np.diff(key[order := np.argsort(key, kind="stable")], prepend=key[order[0]] - 1))
        several = np.minimum.reduceat(root[order], begins) != np.maximum.reduceat(root[order], begins)
        at = order[np.repeat(several, np.diff(np.append(begins, len(key))))]
        at = at[np.argsort(ids[at], kind="stable")]
        firsts = np.flatnonzero(np.concatenate([[True], ids[at[1:]] != ids[at[:-1]]])) if len(at) else at
        keys = pa.ListArray.from_arrays(pa.array(np.append(firsts, len(at)), pa.int32()), pa.array(key[at]))
        part = pa.array(np.full(len(firsts), table["part"][0].as_py()), pa.int32())
        return pa.table({"part": part, "id": ids[at[firsts]], "root": root[at[firsts]], "keys": keys})

    return near.groupBy("part").applyInArrow(opened, "part int, id long, root long, keys array<long>")


def _candidates(members: DataFrame, similarity: float, squares: int = 0) -> DataFrame:
    """id, rank and other: for each of ``members`` (part, id, n, root, print, keys) one candidate a part.

    They come with a row of null id, whose rank is how many candidates its part has. With ``squares``, all candidates
    instead, as cell, a and b: packed by the cell of a board of so many squares a side, dealt by a and b.
    """
    probable = Bounds.of(similarity).probable

    def compare(table: pa.Table) -> pa.Table:
        keys = table["keys"].combine_chunks()
        key = keys.flatten().to_numpy()
        row = np.repeat(np.arange(len(keys)), np.diff(keys.offsets.to_numpy()))
        order = np.argsort(key, kind="stable")
        row = row[order]
        columns = [table[c].to_numpy()[row] for c in ("n", "root")]
        ids, none = table["id"].to_numpy()[row], np.zeros(0, np.int64)
        found = [(none, none, none), *candidate_places(key[order], *columns, _matrix(table["print"])[row], similarity)]
        a, b, differ = map(np.concatenate, zip(*found))
        a, b = ids[a], ids[b]
        if squares:
            a, b = np.minimum(a, b), np.maximum(a, b)
            side = lambda x: (mix(x.view(np.uint64)) >> np.uint64(1)).astype(np.int64) % squares
            cell = side(a) * squares + side(b)
            order = np.argsort(cell, kind="stable")
            a, b, cell = a[order], b[order], cell[order]
            edges = np.flatnonzero(np.diff(cell, prepend=-1))
            packed = [pa.array([x[i:j].tobytes() for i, j in zip(edges, np.append(edges[1:], len(x)))], pa.binary()) for x in (a, b)]
            return pa.table({"cell": pa.array(cell[edges], pa.int32()), "a": packed[0], "b": packed[1]})
        one, other, differ = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([differ, differ])
        rank = np.where(differ <= probable, (mix(other.view(np.uint64)) >> np.uint64(2)).view(np.int64), (1 << 62) + differ)
        order = np.lexsort((other, rank, one))
        best = order[np.flatnonzero(np.diff(one[order], prepend=one[order[0]] - 1 if len(one) else 0))]
        count = pa.table({"id": pa.array([None], pa.int64()), "rank": [len(a)], "other": pa.array([None], pa.int64())})
        return pa.concat_tables([pa.table({"id": one[best], "rank": rank[best], "other": other[best]}), count])

    return members.groupBy("part").applyInArrow(compare, "cell int, a binary, b binary" if squares else "id long, rank long, other long")


def _unpacked(letters: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of some rows of packed ones, by their first set."""
    a, b = (np.frombuffer(b"".join(letters[c].to_pylist()), "<i8") for c in "ab")
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    return a[new], b[new]


def shared_hashes(flat: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many hashes the sets at places a and b have in common; ``a`` is in order, no set is empty."""
    numbers = np.unique(flat, return_inverse=True)[1]
    marked, shared = np.zeros(len(flat), bool), np.zeros(len(a), np.int64)
    edges = np.flatnonzero(np.diff(a, prepend=-1))
    for begin, end in zip(edges, np.append(edges[1:], len(a))):
        own = numbers[offsets[a[begin]] : offsets[a[begin] + 1]]
        marked[own] = True
        for at in range(begin, end, 1 << 12):
            others = b[at : min(end, at + (1 << 12))]
            sizes = offsets[others + 1] - offsets[others]
            ends = np.cumsum(sizes)
            place = np.repeat(offsets[others] - ends + sizes, sizes) + np.arange(ends[-1])
            shared[at : at + len(others)] = np.add.reduceat(marked[numbers[place]], ends - sizes, dtype=np.int64)
        marked[own] = False
    return shared


def _links_of_cells(letters: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that connect what the packed pairs whose whole sets are at least so similar connect.

    A set goes once to each cell that has a pair of it, and pairs stay packed, so no row is made for a pair.
    """

    def wanted(table: pa.Table) -> pa.Table:
        ids = np.unique(np.concatenate(_unpacked(table)))
        return pa.table({"cell": pa.array(np.full(len(ids), table["cell"][0].as_py()), pa.int32()), "id": ids})

    def compare(pairs: pa.Table, given: pa.Table) -> pa.Table:
        given = given.sort_by("id").combine_chunks()
        ids, hashes = given["id"].to_numpy(), given["hashes"].combine_chunks()
        offsets = np.concatenate([[0], np.cumsum(hashes.value_lengths().to_numpy())]).astype(np.int64)
        a, b = (np.searchsorted(ids, x) for x in _unpacked(pairs))
        shared = shared_hashes(hashes.flatten().to_numpy(), offsets, a, b)
        n = np.diff(offsets)
        similar = shared / (n[a] + n[b] - shared) >= similarity
        a, b = a[similar], b[similar]
        to = least_of_components(len(ids), a, b)
        linked = np.flatnonzero(to != np.arange(len(ids)))
        return pa.table({"a": ids[to[linked]], "b": ids[linked]})

    letters = cut_lineage(letters)
    given = letters.groupBy("cell").applyInArrow(wanted, "cell int, id long").join(sets, "id").select("cell", "id", "hashes")
    return letters.groupBy("cell").cogroup(given.groupBy("cell")).applyInArrow(compare, "a long, b long")


def least_of_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least of its component by the links (a, b)."""
    to = np.arange(n)
    while len(a):
        # the larger root of a link points to the least it meets; then what points follows to the end
        np.minimum.at(to, np.maximum(a, b), np.minimum(a, b))
        while (to[to] != to).any():
            to = to[to]
        a, b = to[a], to[b]
        a, b = a[a != b], b[a != b]
    return to


def _roots(found: DataFrame) -> DataFrame:
    """id and root of what the links (a, b) connect to a smaller one. Up to some number of links the driver finds them."""
    if found.count() > _COLLECTED:
        return components(found).select(F.col("node").alias("id"), "root")
    table = found.select("a", "b").toArrow()
    ends = [table[c].to_numpy() for c in "ab"]
    ids, at = np.unique(np.concatenate(ends), return_inverse=True)
    to = least_of_components(len(ids), at[: len(ends[0])], at[len(ends[0]) :])
    below = to != np.arange(len(ids))
    return found.sparkSession.createDataFrame(pa.table({"id": pa.array(ids[below], pa.int64()), "root": pa.array(ids[to[below]], pa.int64())}))


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose whole sets are at least so similar."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = sets.join(ends, "id", "left_semi")
    of = lambda side: sets.select(F.col("id").alias(side), F.col("hashes").alias(f"in_{side}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a")
    shared = F.size(F.array_intersect("in_a", "in_b"))
    return both.where(shared / (F.size("in_a") + F.size("in_b") - shared) >= similarity).select("a", "b")


def links(docs: DataFrame, nodes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) that connect all candidates among ``nodes`` (id, n, text_hash, print, first) that are similar."""
    spark = docs.sparkSession
    near = cut_lineage(near_lists(nodes, Bounds.of(similarity).sketch))
    nodes = cut_lineage(nodes.join(near.select("id").distinct(), "id", "left_semi").select("id", "n", "text_hash", "print"))
    n_parts = max(2 * spark.sparkContext.defaultParallelism, -(-near.count() * BYTES // _LISTS_BYTES))
    near = near.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(n_parts)).cast("int"))
    found = tried = spark.createDataFrame([], "a long, b long")
    sets, few, n_pairs = None, False, 0
    for turn in range(_ROUNDS + 1):
        left = near.withColumn("root", F.col("id"))
        if turn:
            roots = _roots(found).withColumnRenamed("root", "_root")
            roots = F.broadcast(roots) if found.count() <= _COLLECTED else roots
            left = near.join(roots, "id", "left").withColumn("root", F.coalesce("_root", "id")).drop("_root")
        # only lists that still hold two components have pairs to compare
        members = _open_lists(left).join(nodes.drop("text_hash"), "id")
        if few or turn == _ROUNDS:
            squares = math.ceil(math.sqrt(max(2 * spark.sparkContext.defaultParallelism, n_pairs // _CELL_PAIRS)))
            return cut_lineage(found.unionByName(_links_of_cells(_candidates(members, similarity, squares), sets, similarity)))
        made = cut_lineage(_candidates(members, similarity))
        n_pairs = made.where("id is null").agg(F.sum("rank")).first()[0]
        if not n_pairs:
            break
        chosen = made.where("id is not null").groupBy("id").agg(F.min(F.struct("rank", "other")).alias("best"))
        few = n_pairs <= _FEW_PAIRS * chosen.count()
        pairs = chosen.select(F.least("id", "best.other").alias("a"), F.greatest("id", "best.other").alias("b")).distinct()
        pairs = cut_lineage(pairs.join(tried, ["a", "b"], "left_anti") if turn else pairs)
        if sets is None:  # each set that has a candidate has proposed one
            ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
            hashes = cut_lineage(nodes.join(ends, "id", "left_semi").select("text_hash").distinct())
            sets = cut_lineage(shingle_sets(docs, F.broadcast(hashes) if hashes.count() <= _BROADCAST else hashes, shingle))
        found = cut_lineage(found.unionByName(_alike(pairs, sets, similarity)))
        tried = tried.unionByName(pairs)
    return found


def _classes(docs: DataFrame, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """doc_id, text_hash and id (its set) of every row; and id and root of the sets that have others like them."""
    prints = cut_lineage(signatures(docs, shingle, similarity))
    distinct = prints.where("n > 0").groupBy("id").agg(*(F.min(c).alias(c) for c in ("n", "text_hash", "print")), F.first("first").alias("first"))
    roots = _roots(links(docs, cut_lineage(distinct), shingle, similarity))
    return prints.select("doc_id", "text_hash", "id"), roots


def groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, text_hash and root (the set that names its group), one row per row."""
    prints, roots = _classes(docs, shingle, similarity)
    return prints.join(roots, "id", "left").select("doc_id", "text_hash", F.coalesce("root", "id").alias("root"))


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of near copies of ``docs``, as ``simhash.keep_one`` picks it."""
    return keep_first(docs, *_classes(docs, shingle, similarity))
