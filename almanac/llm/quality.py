"""Quality rules by line sequence labelling.

Each line of a text is content or boilerplate. A linear-chain conditional random field scores a labelling by what each
line looks like (binary features) and by which label follows which; Viterbi decoding finds the best labelling of a
text's lines, and the share of its words that stand in content lines decides whether the text is kept.

The field is trained from labelled documents, whose labels say nothing of single lines, so evidence from within the
documents does (``line_labels``): how much commoner a line's look is in bad documents than in good ones, and whether
the line is known from many places with different neighbours (``known_lines``), as headers, licences and menus are and
the lines of copied documents aren't. A bad document's ordinary lines are content and a good one's menu is boilerplate, so labels
change within documents and the moves between labels are learned from such changes. At most ``train_docs`` labelled
documents of each class, those of the smallest hash of their id, are used, each with all its lines; a bit mask and a
hash for each line go to the driver. Training runs to convergence. Documents are decoded whole.

Defined results: a null or empty text has no words and no lines, zero in all counts, and fails the base rules. A text
without a word has content share 0. Without labels of both classes the field is flat and each line is content. Rows
are judged one by one; other columns are ignored whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.words import byte_texts, hash_words, ngram_hashes, slices

SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
_UPPER, _LOWER, _DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789"
_CONTINUATION = bytes(range(0x80, 0xC0))
#: What a line can look like, one bit each.
FEATURES = ("always", "blank", "earlier_line", "up_to_3_words", "over_40_words", "symbols_over_5%", "symbols_over_15%", "upper_over_half", "digits_over_20%", "many_bars", "ends_sentence", "begins_upper", "long_words", "few_distinct_words", "exclamations", "web_address", "known_line")
CONTENT, BOILERPLATE = 0, 1
_KNOWN = 1 << FEATURES.index("known_line")
#: A look is boilerplate where it is so many times as frequent in bad documents: in these, and in good ones.
_ODDS = {BOILERPLATE: 3.0, CONTENT: 6.0}
#: A line that stands between so many different pairs of neighbours is known as boilerplate.
_CONTEXTS = 3


def line_hash(line: bytes) -> int:
    return xxhash.xxh3_64_intdigest(line.strip())


def line_masks(text: bytes, known: frozenset[int] = frozenset()) -> tuple[np.ndarray, np.ndarray, int]:
    """A feature mask and the number of words for each line, and how many lines with a word equal an earlier one."""
    masks, sizes, seen, repeated = [], [], set(), 0
    for line in text.split(b"\n"):
        words = line.split()
        n, again = len(words), False
        if words:
            again = line in seen
            repeated += again
            seen.add(line)
        chars = b"".join(words)
        size = len(chars) or 1
        symbols = size - len(chars.translate(None, SYMBOLS)) if chars else 0
        upper = size - len(chars.translate(None, _UPPER)) if chars else 0
        letters = size - len(chars.translate(None, _LETTERS)) if chars else 0
        digits = size - len(chars.translate(None, _DIGITS)) if chars else 0
        said = (
            True, not n, again, 0 < n <= 3, n > 40, 20 * symbols > size, 100 * symbols > 15 * size, 2 * upper > letters > 0, 5 * digits > size, 10 * line.count(b"|") > n > 0,
            chars.endswith((b".", b"?", b"!", b'"')), chars[:1].isupper(), n > 0 and size > 12 * n, n >= 8 and 3 * len(set(words)) < n, 4 * line.count(b"!") > n > 0, b"://" in line or b"www." in line, bool(known) and n > 0 and line_hash(line) in known,
        )
        masks.append(sum(1 << i for i, x in enumerate(said) if x))
        sizes.append(n)
    return np.array(masks, np.int32), np.array(sizes, np.int64), repeated


def repeated_ngram_words(words: list[bytes], n: int = 3) -> int:
    """How many words stand in a window of n words that the text has twice or more."""
    h = ngram_hashes(hash_words(words), n)
    if len(h) < 2:
        return 0
    order = np.argsort(h, kind="stable")
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = h[order[1:]] == h[order[:-1]]
    starts = np.zeros(len(words) + 1, np.int64)
    starts[order[same[1:] | same[:-1]]] = 1
    depth = np.cumsum(starts[:-1])
    covered = depth.copy()
    covered[n:] -= depth[:-n]
    return int((covered > 0).sum())


@dataclass
class LineField:
    """A linear-chain conditional random field over two labels and binary features."""

    weights: np.ndarray  # label x feature
    moves: np.ndarray  # label x next label
    known: frozenset[int] = frozenset()  # hashes of lines that stand in many places

    @staticmethod
    def flat() -> LineField:
        field = LineField(np.zeros((2, len(FEATURES))), np.zeros((2, 2)))
        field.weights[CONTENT, 0] = 1
        return field

    def emissions(self, masks: np.ndarray) -> np.ndarray:
        distinct, which = np.unique(masks, return_inverse=True)
        return (_bits(distinct) @ self.weights.T)[which]

    def viterbi(self, masks: np.ndarray) -> np.ndarray:
        """The best labelling; content where both labels are as good."""
        if not len(masks):
            return np.zeros(0, np.int8)
        (cc, cb), (bc, bb) = self.moves.tolist()
        rows = self.emissions(masks).tolist()
        c, b = rows[0]
        came = []
        for ec, eb in rows[1:]:
            from_b, stay_b = b + bc > c + cc, b + bb > c + cb
            came.append((from_b, stay_b))
            c, b = ec + (b + bc if from_b else c + cc), eb + (b + bb if stay_b else c + cb)
        label = BOILERPLATE if b > c else CONTENT
        path = [label]
        for step in reversed(came):
            label = BOILERPLATE if step[label] else CONTENT
            path.append(label)
        return np.array(path[::-1], np.int8)


def _bits(masks: np.ndarray) -> np.ndarray:
    return (masks[:, None] >> np.arange(len(FEATURES)) & 1).astype(np.float64)


def known_lines(lines: list[np.ndarray]) -> frozenset[int]:
    """Of documents' hashes of lines those that stand between many different neighbours."""
    around: dict[int, set[tuple]] = {}
    for own in lines:
        padded = [None, *own[np.append(True, own[1:] != own[:-1])].tolist(), None]  # a line is no neighbour of itself
        for before, line, after in zip(padded, padded[1:], padded[2:]):
            around.setdefault(line, set()).add((before, after))
    return frozenset(line for line, places in around.items() if len(places) >= _CONTEXTS and line != line_hash(b""))


def line_labels(sequences: list[np.ndarray], kinds: list[int]) -> list[np.ndarray]:
    """A label for each line of documents of kind BOILERPLATE (bad) or CONTENT (good), from the lines' masks."""
    every = np.concatenate(sequences)
    looks, which = np.unique(every, return_inverse=True)
    kind = np.repeat(kinds, [len(s) for s in sequences])
    bad, good = (np.bincount(which[kind == k], minlength=len(looks)) + 0.5 for k in (BOILERPLATE, CONTENT))
    odds = (bad / bad.sum() / (good / good.sum()))[which]
    limit = np.where(kind == BOILERPLATE, _ODDS[BOILERPLATE], _ODDS[CONTENT])
    labels = np.where((odds > limit) | (every & _KNOWN > 0), BOILERPLATE, CONTENT)
    return np.split(labels, np.cumsum([len(s) for s in sequences])[:-1])


def fit_field(sequences: list[np.ndarray], labels: list[int] | list[np.ndarray], ridge: float = 1e-3, near: float = 1e-4) -> LineField:
    """Maximise the penalised likelihood of the labelled lines, all sequences side by side, until no slope is over ``near``.

    ``labels`` has one for each line, or one for all lines of a sequence. Sequences mostly of either label weigh the
    same in all, so that rare bad documents count.
    """
    labels = [np.broadcast_to(y, len(s)) for s, y in zip(sequences, labels)]
    if len({int(x) for y in labels for x in np.unique(y)}) < 2:
        return LineField.flat()
    # the first lines of all sequences, longest sequence first, then the second lines of those that have one, and so on
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    lengths = np.array([len(sequences[i]) for i in order])
    active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
    begin = np.concatenate([[0], np.cumsum(active)])
    masks, rank, y = np.empty(begin[-1], np.int32), np.empty(begin[-1], np.int64), np.empty(begin[-1], np.int64)
    moved = np.zeros((len(order), 2, 2))
    for r, i in enumerate(order):
        own = begin[: lengths[r]] + r
        masks[own], rank[own], y[own] = sequences[i], r, labels[i]
        np.add.at(moved[r], (labels[i][:-1], labels[i][1:]), 1)
    marks = np.array([int(2 * labels[i].sum() > len(labels[i])) for i in order])
    lines = np.array([lengths[marks == c].sum() for c in (0, 1)])
    weigh = (lines.sum() / (2 * np.maximum(lines, 1)))[marks]
    distinct, which = np.unique(masks, return_inverse=True)
    features, weight = _bits(distinct), weigh[rank]
    gold = np.where(y[:, None] == np.arange(2), weight[:, None], 0)
    gold_moves = (moved * weigh[:, None, None]).sum(0)
    total, split = weight.sum(), 2 * len(FEATURES)
    part = [slice(begin[t], begin[t + 1]) for t in range(len(active))]
    came = [slice(begin[t - 1], begin[t - 1] + active[t]) for t in range(len(active))]

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        weights, moves = x[:split].reshape(2, -1), x[split:].reshape(2, 2)
        scores = (features @ weights.T)[which]
        top, high = scores.max(1, keepdims=True), moves.max()
        emit, move = np.exp(scores - top), np.exp(moves - high)
        forward, scale = np.empty_like(emit), np.empty(len(emit))
        for t, at in enumerate(part):
            a = (forward[came[t]] @ move) * emit[at] if t else emit[at]
            scale[at] = a.sum(1)
            forward[at] = a / scale[at, None]
        backward = np.ones_like(emit)
        expected_moves = np.zeros((2, 2))
        for t in range(len(part) - 1, 0, -1):
            ahead = emit[part[t]] * backward[part[t]]
            back = ahead @ move.T
            sums = (forward[came[t]] * back).sum(1)
            expected_moves += (forward[came[t]] * (weight[part[t]] / sums)[:, None]).T @ ahead * move
            backward[came[t]] = back / back.sum(1, keepdims=True)
        p = forward * backward
        left = gold - p / p.sum(1, keepdims=True) * weight[:, None]
        steps = weight[active[0] :].sum()
        likelihood = (gold * (scores - top)).sum() - weight @ np.log(scale) + (gold_moves * moves).sum() - high * steps
        slope = np.stack([np.bincount(which, left[:, c], len(distinct)) @ features for c in (0, 1)])
        slopes = np.concatenate([slope.ravel(), (gold_moves - expected_moves).ravel()])
        return ridge / 2 * x @ x - 10 * likelihood / total, ridge * x - 10 * slopes / total

    # BFGS: the loss is convex and has few parameters
    x, inverse = np.zeros(split + 4), np.eye(split + 4)
    value, slope = loss(x)
    while np.abs(slope).max() > near:
        way, step = -inverse @ slope, 1.0
        if way @ slope >= 0:
            inverse, way = np.eye(len(x)), -slope
        while (new := loss(x + step * way))[0] > value + 1e-4 * step * (way @ slope) and step > 1e-12:
            step /= 2
        if step <= 1e-12:  # no better value can be told from this one
            break
        s, d = step * way, new[1] - slope
        x, value, slope = x + s, *new
        if (sd := s @ d) > 0:
            turn = np.eye(len(x)) - np.outer(s, d) / sd
            inverse = turn @ inverse @ turn.T + np.outer(s, s) / sd
    return LineField(x[:split].reshape(2, -1), x[split:].reshape(2, 2))


def train(docs: DataFrame, labels: DataFrame, train_docs: int = 1500) -> LineField:
    """Fit the field on at most ``train_docs`` documents of either class of ``labels`` (doc_id, quality 1 or 0)."""
    marked = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = []
    for quality in (0, 1):
        chosen += [(r.doc_id, quality) for r in marked.where(F.col("quality") == quality).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs).collect()]
    if not chosen:
        return LineField.flat()
    spark = docs.sparkSession
    sample = spark.createDataFrame(chosen, "doc_id long, quality int")
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # one row an id, however many have it

    def masks(batches):
        for batch in slices(batches):
            texts = byte_texts(batch.column("text"))
            found = [line_masks(t)[0].tobytes() for t in texts]
            lines = [np.array(list(map(line_hash, t.split(b"\n"))), np.uint64).tobytes() for t in texts]
            columns = [batch.column("doc_id"), batch.column("quality"), pa.array(found, pa.binary()), pa.array(lines, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "quality", "masks", "lines"])

    seen = sorted({(r.doc_id, r.quality, bytes(r.masks), bytes(r.lines)) for r in rows.mapInArrow(masks, "doc_id long, quality int, masks binary, lines binary").collect()})
    kinds = [CONTENT if q else BOILERPLATE for _, q, _, _ in seen]
    if len(set(kinds)) < 2:
        return LineField.flat()
    lines = [np.frombuffer(x, np.uint64) for *_, x in seen]
    known = known_lines(lines)
    listed = np.array(sorted(known), np.uint64)
    sequences = [np.frombuffer(m, np.int32) | np.where(np.isin(x, listed), _KNOWN, 0).astype(np.int32) for (_, _, m, _), x in zip(seen, lines)]
    field = fit_field(sequences, line_labels(sequences, kinds))
    return LineField(field.weights, field.moves, known)


def judge(docs: DataFrame, field: LineField, min_share: float = 0.5, keep_columns: bool = False) -> DataFrame:
    """The counts, base_failed, content_share and kept of every row; with ``keep_columns`` the rows themselves that are kept.

    A text fails the base rules with fewer than 50 words, or if more than half its words stand in repeated windows.
    """
    rows = docs if keep_columns else docs.select("doc_id", "text")
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    names = (*counts, "base_failed", "content_share", "kept")

    def measure(text: bytes | None) -> tuple:
        words = text.split() if text else []
        if not words:
            return 0, 0, 0, 0, 0, True, 0.0, False
        n, chars = len(words), text.translate(None, _SPACE)
        masks, sizes, dup_lines = line_masks(text, field.known)
        again = repeated_ngram_words(words)
        share = float(sizes[field.viterbi(masks) == CONTENT].sum()) / n
        failed = n < 50 or 100 * again > 50 * n
        return n, len(chars.translate(None, _CONTINUATION)), len(chars) - len(chars.translate(None, SYMBOLS)), dup_lines, again, failed, share, not failed and share >= min_share

    def verdicts(batches):
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
        for batch in slices(batches):
            found = list(zip(*map(measure, byte_texts(batch.column("text"))))) or [()] * len(names)
            if keep_columns:
                yield batch.filter(pa.array(found[-1], pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(found, kinds))], ["doc_id", *names])

    if keep_columns:
        return rows.mapInArrow(verdicts, rows.schema)
    return rows.mapInArrow(verdicts, f"doc_id {dict(rows.dtypes)['doc_id']}, " + ", ".join(f"{c} long" for c in counts) + ", base_failed boolean, content_share double, kept boolean")
