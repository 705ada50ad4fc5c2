"""SimHash near-duplicates through an inverted index of bytes by position, with count filtering.

A fingerprint of 64 bits has 8 bytes. Two that differ in at most ``max_bits`` bits differ in at most as many bytes, so
they share at least ``8 - max_bits`` bytes in place. The index lists fingerprints by position and byte; pairs that
meet are tallied by the positional bytes they share, those that reach the minimum are kept, and their differing bits
are counted.

A list of one positional byte would hold a 256th of everything. Therefore lists are intersected before they are
walked: a pair that shares 4 of 8 positions shares all positions of at least one member of a small family of position
sets, so only the intersections for that family are walked (7 pairs of positions at first; sets of 3 or 4 positions
once there are so many fingerprints that lists of pairs would grow long). Within an intersection the members are listed
by each further positional byte, these lists are walked, and each pair that meets is tallied, on top of the positions
that all members share; only pairs whose tally reaches the minimum are verified. No partner is capped or lost by that.

Equal fingerprints count once. In a long list each member's tallies are taken at once, and breadth first: what is
linked is not tallied again, so a group of k near copies makes fewer than k links a list. Nodes of links are the
smallest doc_id of a fingerprint, so what names a component is its component_id, and nothing is dealt by component.
The links become components by alternating large-star and small-star steps, whose state is checkpointed.

Defined results: a null, empty or blank text has no shingle and fingerprint zero, and is linked like any other. A text
of fewer words than a shingle is one shingle. Component ids are the smallest non-null doc_id of the component (null if
all are null). Repeated rows come back as often as they are there. No rows in, no rows out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.llm.words import byte_texts, slices
from almanac.session import cut_lineage, shuffle_partitions

SEED = 42
_LANES = np.uint64(0x0101010101010101)
#: Lists at least this long are walked breadth first, shorter ones many in one sweep.
_LONG = 256
#: So many pairs of short lists are looked at together.
_PAIRS = 1 << 20


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of each shingle of ``size`` words of a text whose A-Z are lower-cased here; repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, max(1, len(words) - size + 1))


def majority_bits(hashes: np.ndarray) -> int:
    """The number whose bits are those set in over half the hashes. Eight counters of a byte share a 64-bit lane."""
    n = len(hashes)
    if not n:
        return 0
    padded = np.zeros(-(-n // 255) * 255, np.uint64)
    padded[:n] = hashes
    rows = padded.reshape(-1, 255)
    result = 0
    for bit in range(8):
        lanes = (rows >> np.uint64(bit) & _LANES).sum(axis=1, dtype=np.uint64)
        counts = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for byte in np.flatnonzero(2 * counts > n):
            result |= 1 << int(8 * byte + bit)
    return result


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, its fingerprint as a signed long, and a hash of its text, one row per row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))

    def of(batches):
        for batch in slices(batches):
            found = [majority_bits(shingle_hashes(t, shingle)) if t else 0 for t in byte_texts(batch.column("text"))]
            columns = [batch.column("doc_id"), pa.array(np.array(found, np.uint64).view(np.int64)), batch.column("text_hash")]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "text_hash"])

    return rows.mapInArrow(of, f"doc_id {dict(rows.dtypes)['doc_id']}, fp long, text_hash long")


def covering_family(shared: int, size: int, positions: int = 8) -> list[tuple[int, ...]]:
    """Sets of ``size`` positions of which every ``shared`` positions hold at least one whole.

    The smaller of two: chosen greedily, or all sets within groups so few that ``size`` of ``shared`` meet in one.
    """
    open_sets = set(combinations(range(positions), shared))
    family = []
    while open_sets:
        best = max(combinations(range(positions), size), key=lambda s: (sum(set(s) <= set(o) for o in open_sets), [-x for x in s]))
        family.append(best)
        open_sets = {o for o in open_sets if not set(best) <= set(o)}
    groups = (shared - 1) // (size - 1) if size > 1 else shared
    grouped = [s for g in range(groups) for s in combinations(range(g, positions, groups), size)]
    return min(family, grouped, key=len) if size > 1 else family


def link_lists(lists: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is linked within each list. ``lists`` is in order; the fingerprints of a list differ."""
    a, b = link_places(lists, fps, max_bits)
    return fps[a], fps[b]


def link_places(lists: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The same links by the members' places."""
    edges = np.flatnonzero(np.diff(lists, prepend=lists[0] - 1 if len(lists) else 0))
    sizes = np.diff(np.append(edges, len(lists)))
    none = np.zeros(0, np.int64)
    found = [(none, none)]
    for begin, size in zip(edges[sizes >= _LONG], sizes[sizes >= _LONG]):
        a, b = _walk(fps[begin : begin + size], max_bits)
        found.append((a + begin, b + begin))
    short = (sizes < _LONG) & (sizes > 1)
    edges, sizes = edges[short], sizes[short]
    # as many lists at a time as have a bounded number of pairs
    turn = np.cumsum(sizes * (sizes - 1) // 2) // _PAIRS
    for begin, end in zip(cuts := np.flatnonzero(np.diff(turn, prepend=-1)), [*cuts[1:], len(sizes)]):
        found.append(_sweep(edges[begin:end], sizes[begin:end], fps, max_bits))
    left, right = zip(*found)
    return np.concatenate(left), np.concatenate(right)


def _verified(fps: np.ndarray, a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    return np.bitwise_count((fps[a] ^ fps[b]).view(np.uint64)) <= max_bits


def _sweep(edges: np.ndarray, sizes: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """All links within lists that begin at ``edges``: each pair is tallied once for each byte list in which it meets."""
    member = np.repeat(edges - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    number = np.repeat(np.arange(len(sizes)), sizes)
    octets = fps[member].view(np.uint8).reshape(-1, 8)
    begins = np.cumsum(sizes) - sizes
    # a position at which a whole list agrees is one for each of its pairs
    whole = np.array([np.minimum.reduceat(octets[:, p], begins) == np.maximum.reduceat(octets[:, p], begins) for p in range(8)])
    shared = whole.sum(axis=0)
    done = shared >= 8 - max_bits  # so much in common that no further byte is needed

    def meeting(at: np.ndarray, key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of members (in order of key) that have a key in common."""
        i, step = np.arange(len(at)), 1
        while len(i := i[i + step < len(at)]) and len(i := i[key[i] == key[i + step]]):
            yield at[i], at[i + step]
            step += 1

    met = [np.zeros(0, np.int64)]
    for p in range(8):
        at = np.flatnonzero(~(whole[p] | done)[number])
        key = number[at] * 256 + octets[at, p]
        order = np.argsort(key, kind="stable")
        met += [np.minimum(x, y) * len(member) + np.maximum(x, y) for x, y in meeting(at[order], key[order])]
    pairs, tally = np.unique(np.concatenate(met), return_counts=True)
    x, y = pairs // len(member), pairs % len(member)
    enough = tally + shared[number[x]] >= 8 - max_bits
    at = np.flatnonzero(done[number])
    ends = [(x[enough], y[enough]), *meeting(at, number[at])]
    a, b = (member[np.concatenate(side)] for side in zip(*ends))
    linked = _verified(fps, a, b, max_bits)
    return a[linked], b[linked]


def _walk(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of one list's links; each member's tallies are taken from the lists of its positional bytes."""
    octets = fps.view(np.uint8).reshape(-1, 8)
    varied = [p for p in range(8) if octets[:, p].min() != octets[:, p].max()]
    postings = {}
    for p in varied:
        order = np.argsort(octets[:, p], kind="stable")
        postings[p] = order, np.searchsorted(octets[order, p], np.arange(257))
    is_open, left, right, n_open = np.ones(len(fps), bool), [], [], len(fps)
    for first in range(len(fps)):
        if not is_open[first]:
            continue
        is_open[first], queue, n_open = False, [first], n_open - 1
        while queue and n_open:
            at = queue.pop()
            tally = np.full(len(fps), 8 - len(varied), np.uint8)
            for p in varied:
                order, begins = postings[p]
                byte = octets[at, p]
                tally[order[begins[byte] : begins[int(byte) + 1]]] += 1
            near = np.flatnonzero(is_open & (tally >= 8 - max_bits))
            near = near[_verified(fps, np.full(len(near), at), near, max_bits)]
            if len(near):
                left.append(np.full(len(near), at)), right.append(near)
                is_open[near] = False
                n_open -= len(near)
                queue.extend(near.tolist())
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def links(distinct: DataFrame, n: int, max_bits: int = 4) -> DataFrame:
    """Links (a, b) between the nodes of distinct fingerprints (fp, node) that connect all that differ in max_bits or fewer.

    ``n`` is how many there are; it sets how many positions are intersected.
    """
    need = 8 - max_bits
    if not 1 <= need <= 8:
        raise ValueError("max_bits must be 0 to 7")
    return links_by(distinct, min(need, 2 if n < 1 << 26 else 3 if n < 1 << 34 else 4), max_bits)


def links_by(distinct: DataFrame, size: int, max_bits: int) -> DataFrame:
    """``links`` with lists of ``size`` positions."""
    buckets = 4 * shuffle_partitions(distinct.sparkSession)
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))

    def key(number: int, chosen: tuple[int, ...]) -> Column:
        value = F.lit(number).cast("long")
        for p in chosen:
            value = value * 256 + byte(p)
        return value

    family = covering_family(8 - max_bits, size)
    lists = distinct.select(F.explode(F.array(*[key(i, s) for i, s in enumerate(family)])).alias("list"), "fp", "node.none", "node.id")
    lists = lists.withColumn("bucket", F.pmod(F.xxhash64("list"), F.lit(buckets)).cast("int"))

    def connect(table: pa.Table) -> pa.Table:
        list_ = table["list"].to_numpy()
        table = table.take(pa.array(order := np.argsort(list_, kind="stable")))
        ends = link_places(list_[order], table["fp"].to_numpy(), max_bits)
        return pa.table({f"{side}_{c}": table[c].take(pa.array(at)) for side, at in zip("ab", ends) for c in ("none", "id", "fp")})

    kind = dict(lists.dtypes)["id"]
    found = lists.groupBy("bucket").applyInArrow(connect, ", ".join(f"{side}_none boolean, {side}_id {kind}, {side}_fp long" for side in "ab"))
    return found.select(*(F.struct(*(F.col(f"{side}_{c}").alias(c) for c in ("none", "id", "fp"))).alias(side) for side in "ab")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and the smallest node of its component, for all nodes of the edges (a, b), by alternating star steps."""

    def smaller(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy("a").agg(F.min("b").alias("m"))
        return pairs.join(least, "a")

    def large_star(pairs: DataFrame) -> DataFrame:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        return smaller(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()

    def small_star(pairs: DataFrame) -> DataFrame:
        star = smaller(pairs)
        return star.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(star.select("a", F.col("m").alias("b"))).distinct()

    state = cut_lineage(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = cut_lineage(small_star(large_star(state)))
        now = state.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def classes(prints: DataFrame, max_bits: int) -> DataFrame:
    """fp, root (the fingerprint that names its component) and component_id, one row per distinct fingerprint."""
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    kind = dict(distinct.dtypes)["first"]
    # of a component the smallest node is that of its smallest doc_id; nodes without one come last
    node = F.struct(F.isnull("first").alias("none"), F.coalesce("first", F.lit(0).cast(kind)).alias("id"), "fp")
    distinct = cut_lineage(distinct.select("fp", node.alias("node")))
    roots = components(links(distinct, distinct.count(), max_bits))
    named = distinct.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("top"))
    return named.select("fp", F.col("top.fp").alias("root"), F.when(~F.col("top.none"), F.col("top.id")).alias("component_id"))


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, one row per row."""
    prints = cut_lineage(fingerprints(docs, shingle, id_col, text_col))
    joined = prints.select("doc_id", "fp").join(classes(prints, max_bits), "fp")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row of each component of ``docs``, all its columns: that of the smallest doc_id (null last).

    Where rows of different texts share that doc_id, the smaller hash of the text decides; equal rows collapse.
    """
    prints = cut_lineage(fingerprints(docs, shingle))
    return keep_first(docs, prints.withColumnRenamed("fp", "id"), classes(prints, max_bits).select(F.col("fp").alias("id"), "root"))


def keep_first(docs: DataFrame, prints: DataFrame, roots: DataFrame) -> DataFrame:
    """Of ``docs`` the first row of each root, by doc_id and then text_hash.

    ``prints`` has doc_id, text_hash and id of each row, ``roots`` a row for each id with its root (or none, where the id
    is its own). The rows of an id, which may be a third of all, become one before they are joined.
    """
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash"))
    of_id = prints.groupBy("id").agg(first.alias("best")).join(roots, "id", "left")
    best = of_id.groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("best").alias("best"))
    chosen = best.select(_name("best.doc_id").alias("__almanac_name"), F.col("best.text_hash").alias("__almanac_hash"))
    keyed = docs.withColumns({"__almanac_name": _name("doc_id"), "__almanac_hash": F.xxhash64("text")})
    return keyed.join(chosen, ["__almanac_name", "__almanac_hash"], "left_semi").dropDuplicates(["__almanac_name", "__almanac_hash"]).drop("__almanac_name", "__almanac_hash")


def _name(doc_id: str) -> Column:
    return F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
