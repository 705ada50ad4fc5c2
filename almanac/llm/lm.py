"""Language-model scoring with a weighted backoff automaton.

The model is an n-gram model of words with absolute discounting: P(w | h) = (max(c(hw) - D, 0) + D * t(h) * P(w | h'))
/ c(h), h' being h without its first word and t(h) the number of different tokens seen after h, down to P(w) =
(c(w) + 1) / (N + V + 1), where all unseen words are one more type. D is, for each length of n-gram, the share
n1 / (n1 + 2 * n2) of n-grams seen once and twice, within 0.1 and 0.9. It is a proper distribution at each history.

As an automaton: each seen history is a state, each seen hw an arc of weight log10 P(w | h) from the state of h to that
of the longest seen suffix of hw, and each state has a failure arc of weight log10(D * t(h) / c(h)) to the state of h',
which is followed, reading nothing, until there is an arc for the next word; in the end the empty state has an arc for
any word. A text is read once from left to right, from the state of "begin" to the arc of "end", and its score is the
sum of the weights passed. ``Traversal`` does that for many stretches of text side by side: a stretch that begins
within a text first reads the ``order - 1`` words before it, after which the state is what it would be from the
beginning, as no state is longer.

Counts cover all training documents and grow with them, so no task holds them all. Documents are dealt into shards:

1. A shard sends each distinct n-gram that it holds, with its count there, once to the partition that owns the n-gram.
2. The owner answers with the total, and names one of the shards that trained on the n-gram its home.
3. Each shard counts, for each of its histories, the n-grams at home that continue it; owners of histories add these up.
4. A shard hears back all counts of its n-grams: its own part of the automaton, with every state and arc that its
   documents can pass.

A word or phrase that a third of all documents share is one number for each shard. N-grams are told apart by hashes of
20 bits more than it takes to number the bytes of all texts, so at any size fewer than one n-gram in a million meets
another's hash. A shard has ``shard_bytes`` of text.

Defined results: a null or empty text is the token "end" alone. Without training documents each word is unseen. Rows
for which ``held_out`` is null are not held out. Rows are counted and scored each, repeated or not; other columns are
ignored whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.llm.words import byte_texts, hash_words, ngram_hashes, numbered, packs, squeeze, stretched, text_bytes, unpacked
from almanac.session import shuffle_partitions

#: What stands for the borders of a text. No hash of a word is meant to equal them; one that does is taken for them.
BEGIN, END = np.uint64(0x0B0B0B0B0B0B0B0B), np.uint64(0x0E0E0E0E0E0E0E0E)
#: So many stretches of a shard's texts are read side by side.
_LANES = 4096

_LETTER = "owner int, shard int, hashes binary, counts binary, tokens long"
_TOTALS = "shard int, owner int, totals binary, tokens long, types long, once array<long>, twice array<long>"
_HISTORIES = "owner int, shard int, continued binary"
_REPLY = "shard int, owner int, totals binary, continued binary"
_RESULT = "doc_id {id}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def discount(once: int, twice: int) -> float:
    return min(0.9, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5


class Streams:
    """The tokens of a shard's documents in one row: begin, words, end; begin, words, end; ..."""

    def __init__(self, texts: list[bytes | None], order: int, bits: int = 64):
        parts, lengths = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            words = hash_words(text.lower().split()) if text else ()
            parts += [[BEGIN], words, [END]]
            lengths[i] = len(words) + 2
        stream = np.concatenate([np.asarray(p, np.uint64) for p in parts])
        del parts
        self.order, self.lengths = order, lengths
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
        self.place = (np.arange(len(stream)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
        # by order: the distinct n-grams, in order, which of them ends at each place (-1: none), and where each first ends
        self.distinct, self.which, self.first = [], [], []
        cut = np.uint64(64 - bits)
        for n in range(1, order + 1):
            ends = np.flatnonzero(self.place[n - 1 :] >= n - 1) + n - 1
            found, which, first = numbered(ngram_hashes(stream, n, seed=n)[ends - n + 1] >> cut << cut)
            every = np.full(len(stream), -1, np.int32)
            every[ends] = which
            self.distinct.append(found)
            self.which.append(every)
            self.first.append(ends[first].astype(np.int32))

    def history(self, n: int) -> np.ndarray:
        """For each distinct n-gram which (n - 1)-gram it begins with."""
        return self.which[n - 2][self.first[n - 1] - 1]

    def suffix(self, n: int) -> np.ndarray:
        """For each distinct n-gram which (n - 1)-gram it ends with."""
        return self.which[n - 2][self.first[n - 1]]


class Traversal:
    """A shard's part of the automaton, and the way of its texts through it.

    The empty state is 0; after it states are numbered as the distinct n-grams are, shorter ones first. An arc goes by
    the number of the n-gram that it completes, which is how a state and the next word find it.
    """

    def __init__(self, streams: Streams, counts: list[np.ndarray], continued: list[np.ndarray], tokens: int, types: int, discounts: list[float]):
        order = self.order = streams.order
        self.streams, self.begins = streams, np.cumsum([0, 1, *map(len, counts[: order - 1])])  # first state of n words
        p = [(counts[0] + 1) / (tokens + types + 1)]
        for n in range(2, order + 1):
            h, lower, d = streams.history(n), p[-1][streams.suffix(n)], discounts[n - 2]
            c, seen = counts[n - 2][h], counts[n - 2][h] > 0
            own = np.maximum(counts[n - 1] - d, 0) + d * continued[n - 2][h] * lower
            p.append(np.where(seen, own / np.maximum(c, 1), lower))
        self.weights = list(map(np.log10, p))
        self.is_arc = [np.ones(len(counts[0]), bool), *(c > 0 for c in counts[1:])]
        self.leads_to, self.fails_to, self.fail_weights = [], [np.zeros(1, np.int64)], [np.zeros(1)]
        for n in range(1, order + 1):
            own = self.begins[n] + np.arange(len(counts[n - 1])) if n < order else self.begins[n - 1] + streams.suffix(n) if n > 1 else np.zeros(len(counts[0]), np.int64)
            self.leads_to.append(np.where(counts[n - 1] > 0, own, 0).astype(np.int32))  # an unseen word leads to the empty state
            if n < order:
                self.fails_to.append(self.begins[n - 1] + streams.suffix(n) if n > 1 else np.zeros(len(own), np.int64))
                share = discounts[n - 1] * continued[n - 1] / np.maximum(counts[n - 1], 1)
                self.fail_weights.append(np.log10(share, where=share > 0, out=np.zeros(len(share))))
        self.fails_to, self.fail_weights = np.concatenate(self.fails_to).astype(np.int32), np.concatenate(self.fail_weights)

    def read(self) -> np.ndarray:
        """The sum of weights passed at each place, from the state before it to the arc that reads it."""
        streams, order = self.streams, self.order
        size = len(streams.place)
        length = max(4 * order, -(-size // _LANES))
        starts = np.arange(0, size, length)
        state, passed = np.zeros(len(starts), np.int64), np.zeros(size)
        for step in range(1 - order, length):
            at = starts + step
            lane = np.flatnonzero((at >= 0) & (at < size))
            at = at[lane]
            now, place = state[lane], streams.place[at]
            # "begin" is read from the empty state; its weight is no part of a score
            now[place == 0] = 0
            level = np.searchsorted(self.begins, now, side="right") - 1
            weight, after, is_open = np.zeros(len(at)), now.copy(), np.ones(len(at), bool)
            for n in range(order, 0, -1):
                try_ = np.flatnonzero(is_open & (level == n - 1))
                arc = streams.which[n - 1][at[try_]]
                has = self.is_arc[n - 1][arc]
                goes, fails = try_[has], try_[~has]
                weight[goes] += self.weights[n - 1][arc[has]]
                after[goes] = self.leads_to[n - 1][arc[has]]
                is_open[goes] = False
                weight[fails] += self.fail_weights[now[fails]]
                now[fails] = self.fails_to[now[fails]]
                level[fails] = n - 2
            state[lane] = after
            if step >= 0:
                passed[at] = weight
        return passed


def owners_of(hashes: np.ndarray, n: int, owners: int) -> np.ndarray:
    """Owners 0 .. owners - 1 have the words, the next as many the pairs, and so on. Hashes are in order, and so are these."""
    return ((hashes >> np.uint64(32)).astype(np.int64) * owners >> 32) + (n - 1) * owners


def _dealt(streams: Streams, owners: int, upto: int) -> list[tuple[int, int, int, int]]:
    """(owner, n, from, to) of each run of distinct n-grams that one owner has, for n-grams of up to ``upto`` words."""
    found = []
    for n, distinct in enumerate(streams.distinct[:upto], 1):
        own = owners_of(distinct, n, owners)
        edges = np.flatnonzero(np.diff(own, prepend=-1))
        found += [(int(own[a]), n, a, b) for a, b in zip(edges, np.append(edges[1:], len(own)))]
    return found


def _opened(letters: pa.Table, owners: int) -> tuple[pa.Table, list[int], np.ndarray, np.ndarray, np.ndarray]:
    """An owner's letters by shard, where each ends, and of all n-grams in them the number, the count there and in all."""
    letters = letters.sort_by("shard")
    hashes = [np.cumsum(stretched(x, "<u8"), dtype=np.uint64) for x in letters["hashes"].to_pylist()]
    counts = np.concatenate([stretched(x, "<u4") for x in letters["counts"].to_pylist()])
    ends = np.cumsum([len(h) for h in hashes]).tolist()
    every = np.concatenate(hashes)
    del hashes
    every <<= np.uint64(max(0, owners.bit_length() - 1))  # the bits that all of an owner's hashes share say nothing
    which = numbered(every)[1]
    del every
    return letters, ends, which, counts, np.bincount(which, counts).astype(np.uint64)


def score_texts(docs: DataFrame, held_out: Column, order: int = 3, shard_bytes: int = 8 << 20, owner_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; rows not held out train."""
    spark = docs.sparkSession
    size, pieces = text_bytes(docs), shuffle_partitions(spark)
    shards, owners = max(pieces, -(-size // shard_bytes)), max(1, pieces // order, -(-size // owner_bytes))
    shard_tasks, owner_tasks = max(pieces, -(-shards // 4)), max(pieces, -(-owners * order // 4))
    bits = min(64, size.bit_length() + 20)
    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    sharded = packs(rows, F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards))).repartition(shard_tasks, "shard").groupBy("shard")

    def opened(table: pa.Table) -> tuple[pa.Table, Streams]:
        rows = unpacked(table["pack"])
        return rows.select(["doc_id", "held_out"]), Streams(byte_texts(rows["text"]), order, bits)

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        rows, streams = opened(table)
        trains = ~rows["held_out"].to_numpy()[streams.doc]
        counted = [np.bincount(w[trains & (w >= 0)], minlength=len(d)).astype("<u4") for d, w in zip(streams.distinct, streams.which)]
        dealt = _dealt(streams, owners, order)
        tokens = np.zeros(len(dealt), np.int64)
        tokens[0] = (trains & (streams.place > 0)).sum()
        hashes = [squeeze(np.diff(streams.distinct[n - 1][a:b], prepend=np.uint64(0))) for _, n, a, b in dealt]
        counts = [squeeze(counted[n - 1][a:b]) for _, n, a, b in dealt]
        return pa.table({"owner": pa.array([x[0] for x in dealt], pa.int32()), "shard": pa.array([key[0].as_py()] * len(dealt), pa.int32()), "hashes": pa.array(hashes, pa.binary()), "counts": pa.array(counts, pa.binary()), "tokens": tokens})

    def add(key: tuple, table: pa.Table) -> pa.Table:
        letters, ends, which, counts, totals = _opened(table, owners)
        n = key[0].as_py() // owners
        trained = np.flatnonzero(counts)
        home = np.zeros(len(counts), np.uint64)
        home[trained[np.unique(which[trained], return_index=True)[1]]] = 1
        sent = [squeeze(totals[which[a:b]] << np.uint64(1) | home[a:b]) for a, b in zip([0, *ends], ends)]
        # what is said of all n-grams is said once
        once, twice, types = (np.zeros((len(sent), order), np.int64) for _ in range(3))
        once[0, n], twice[0, n], types[0, n] = (totals == 1).sum(), (totals == 2).sum(), (totals > 0).sum()
        return pa.table({"shard": letters["shard"], "owner": letters["owner"], "totals": pa.array(sent, pa.binary()), "tokens": letters["tokens"], "types": types[:, 0], "once": pa.array(list(once), pa.list_(pa.int64())), "twice": pa.array(list(twice), pa.list_(pa.int64()))})

    def continue_(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        _, streams = opened(table)
        said = dict(zip(replies["owner"].to_pylist(), replies["totals"].to_pylist()))
        dealt = _dealt(streams, owners, order)
        continued: list[np.ndarray] = []
        for n in range(2, order + 1):
            at_home = np.concatenate([stretched(said[o], "<u8") & np.uint64(1) for o, m, _, _ in dealt if m == n] or [np.zeros(0, np.uint64)])
            continued.append(np.bincount(streams.history(n)[at_home > 0], minlength=len(streams.distinct[n - 2])).astype("<u4"))
        told = [x for x in dealt if x[1] < order]
        return pa.table({"owner": pa.array([x[0] for x in told], pa.int32()), "shard": pa.array([key[0].as_py()] * len(told), pa.int32()), "continued": pa.array([squeeze(continued[n - 1][a:b]) for _, n, a, b in told], pa.binary())})

    def answer(key: tuple, table: pa.Table, histories: pa.Table) -> pa.Table:
        letters, ends, which, _, totals = _opened(table, owners)
        sums = np.zeros(len(totals), np.uint64)
        if len(histories):
            continued = np.concatenate([stretched(x, "<u4") for x in histories.sort_by("shard")["continued"].to_pylist()])
            sums = np.bincount(which, continued, len(totals)).astype(np.uint64)
        every = [(squeeze(totals[which[a:b]]), squeeze(sums[which[a:b]])) for a, b in zip([0, *ends], ends)]
        return pa.table({"shard": letters["shard"], "owner": letters["owner"], "totals": pa.array([x for x, _ in every], pa.binary()), "continued": pa.array([x for _, x in every], pa.binary())})

    def score(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        rows, streams = opened(table)
        said = {o: (a, b) for o, a, b in zip(*(replies[c].to_pylist() for c in ("owner", "totals", "continued")))}
        dealt = _dealt(streams, owners, order)
        counts, continued = ([np.concatenate([stretched(said[o][i], "<u8").astype(np.int64) for o, m, _, _ in dealt if m == n] or [np.zeros(0, np.int64)]) for n in range(1, order + 1)] for i in (0, 1))
        tokens, types, once, twice = (replies[c][0].as_py() for c in ("all_tokens", "all_types", "all_once", "all_twice"))
        # "begin" is a type only for histories
        types -= int(replies["has_begin"][0].as_py())
        model = Traversal(streams, counts, continued, tokens, types, [discount(a, b) for a, b in zip(once[1:], twice[1:])])
        real, n_docs = streams.place > 0, len(streams.lengths)
        uni = streams.which[0][real]
        sums = [np.bincount(streams.doc[real], x, n_docs) for x in (counts[0][uni] > 0, model.weights[0][uni], model.read()[real])]
        return pa.table({"doc_id": rows["doc_id"], "held_out": rows["held_out"], "n_tokens": streams.lengths - 1, "n_known": sums[0].astype(np.int64), "train_tokens": np.full(len(rows), tokens), "base_score": sums[1], "score": sums[2]})

    letters = sharded.applyInArrow(ask, _LETTER).repartition(owner_tasks, "owner")
    totals = letters.groupBy("owner").applyInArrow(add, _TOTALS).repartition(shard_tasks, "shard")
    histories = sharded.cogroup(totals.groupBy("shard")).applyInArrow(continue_, _HISTORIES).repartition(owner_tasks, "owner")
    replies = letters.groupBy("owner").cogroup(histories.groupBy("owner")).applyInArrow(answer, _REPLY).repartition(shard_tasks, "shard")
    each = lambda c: F.array(*[F.sum(F.get(c, F.lit(n))) for n in range(order)])
    all_ = totals.agg(F.sum("tokens").alias("all_tokens"), F.sum("types").alias("all_types"), each("once").alias("all_once"), each("twice").alias("all_twice"), (F.count("*") > 0).alias("_any"))
    trains = F.col("all_tokens") > 0  # "begin" was seen in training if anything was
    told = replies.crossJoin(F.broadcast(all_.withColumn("has_begin", trains).drop("_any")))  # one row
    return sharded.cogroup(told.groupBy("shard")).applyInArrow(score, _RESULT.format(id=dict(rows.dtypes)["doc_id"]))


class Automaton:
    """The same model in memory, state by state; for small corpora and for holding the distributed one against."""

    def __init__(self, texts: list[str | None], order: int = 3):
        self.order = order
        self.counts: dict[tuple, int] = {}
        self.after: dict[tuple, set] = {}
        for text in texts:
            stream = self._stream(text)
            for n in range(1, order + 1):
                for i in range(n - 1, len(stream)):
                    gram = stream[i - n + 1 : i + 1]
                    self.counts[gram] = self.counts.get(gram, 0) + 1
                    self.after.setdefault(gram[:-1], set()).add(gram[-1])
        words = {g: c for g, c in self.counts.items() if len(g) == 1 and g != (BEGIN,)}
        self.tokens, self.types = sum(words.values()), len(words)
        times = lambda n, k: sum(c == k for g, c in self.counts.items() if len(g) == n)
        self.discounts = {n: discount(times(n, 1), times(n, 2)) for n in range(2, order + 1)}

    @staticmethod
    def _stream(text: str | None) -> tuple:
        return (BEGIN, *(text or "").encode().lower().split(), END)

    def failure(self, state: tuple) -> float:
        return self.discounts[len(state) + 1] * len(self.after[state]) / self.counts[state]

    def probability(self, history: tuple, word: object) -> float:
        if not history:
            return (self.counts.get((word,), 0) + 1) / (self.tokens + self.types + 1)
        lower = self.probability(history[1:], word)
        if history not in self.counts:
            return lower
        own = max(self.counts.get((*history, word), 0) - self.discounts[len(history) + 1], 0) / self.counts[history]
        return own + self.failure(history) * lower

    def arc(self, state: tuple, word: object) -> float | None:
        """log10 weight, or None where the state has no arc for the word."""
        return float(np.log10(self.probability(state, word))) if not state or (*state, word) in self.counts else None

    def score(self, text: str | None) -> float:
        stream = self._stream(text)
        state, total = (BEGIN,) if self.order > 1 and (BEGIN,) in self.counts else (), 0.0
        for word in stream[1:]:
            read = state
            while (weight := self.arc(state, word)) is None:
                total += float(np.log10(self.failure(state)))
                state = state[1:]
            total += weight
            state = (*read, word)[-(self.order - 1) :] if self.order > 1 else ()
            while state and state not in self.counts:
                state = state[1:]
        return total
