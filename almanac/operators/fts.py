"""Full-text search with BM25, over a scan or over a written inverted index.

Scores are those of Robertson and Zaragoza: idf = ln(1 + (N - df + 0.5) / (df + 0.5)), and for each term and field
idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average)), summed. Statistics are those of the whole corpus;
filters are applied to what is scored. Equal scores go to the smaller key.

*Scan.* Each text is tokenised into its length and the frequencies of the query's terms, once for the corpus
statistics (one row, broadcast) and once for the scores: no explode and no shuffle of postings. *Index.* ``build_index``
writes postings in folders by the hash of their term, each in order of terms, so a query reads its terms' row groups
only; ``search_index`` answers the same queries from them, with the same scores.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from almanac.functions.text import MAX_TOKEN_BYTES, bind, tokens
from almanac.session import cut_lineage, shuffle_partitions, spread

K1, B = 1.2, 0.75
LIMITS = {"quick": 5, "normal": 20, "deep": 50}


@dataclass(frozen=True)
class Clause:
    """A word or phrase that may, must or must not occur, in one field or in any, with a weight."""

    words: tuple[str, ...]
    occurs: str = "should"
    fields: tuple[str, ...] = ()
    boost: float = 1.0


@dataclass(frozen=True)
class Query:
    clauses: tuple[Clause, ...] = field(default=())

    def terms(self) -> list[str]:
        return sorted({w for c in self.clauses for w in c.words})


_TOKEN = re.compile(r'([+-]?)(?:(\w+):)?(?:"([^"]*)"|([^\s"]+))')
_WORD = re.compile(r"[^\W_]+")


def analyse(text: str) -> tuple[str, ...]:
    return tuple(w for w in (x.lower() for x in _WORD.findall(text)) if len(w.encode()) <= MAX_TOKEN_BYTES)


def parse(query: str, fields: Sequence[str] = ("text",)) -> Query:
    """Words, "phrases", +must, -must not, AND, OR, NOT, field:word and word^2; words without a sign may occur."""
    found: list[Clause] = []
    joins_next, negate = False, False
    for sign, name, phrase, word in _TOKEN.findall(query):
        if word in ("AND", "OR", "NOT") and not sign and not name:
            joins_next, negate = word == "AND", word == "NOT" or negate and word != "OR"
            if word == "AND" and found and found[-1].occurs == "should":
                found[-1] = Clause(found[-1].words, "must", found[-1].fields, found[-1].boost)
            continue
        boost = 1.0
        if m := re.fullmatch(r"(.+)\^(\d+(?:\.\d+)?)", word or ""):
            word, boost = m[1], float(m[2])
        if name and name not in fields:
            word, phrase, name = f"{name} {word or ''}" if not phrase else "", phrase and f"{name} {phrase}", ""
        occurs = "must_not" if sign == "-" or negate else "must" if sign == "+" or joins_next else "should"
        own = (name,) if name else ()
        if phrase:
            if words := analyse(phrase):
                found.append(Clause(words, occurs, own, boost))
        else:
            found += [Clause((w,), occurs, own, boost) for w in analyse(word)]
        joins_next = negate = False
    return Query(tuple(found))


def words_query(text: str) -> Query:
    """Every word of the text may occur."""
    return Query(tuple(Clause((w,)) for w in dict.fromkeys(analyse(text))))


def _frequency(words: Sequence[str], t: Column) -> Column:
    """How often the words follow one another in an array of tokens."""
    if len(words) == 1:
        return F.size(F.filter(t, lambda x: x == words[0]))
    follow = lambda i: F.coalesce(_all([F.get(t, i + k) == w for k, w in enumerate(words)]), F.lit(False))
    return F.size(F.filter(t, lambda x, i: (x == words[0]) & follow(i)))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def search(docs: DataFrame, query: Query | str, limit: int | None = 10, fields: Sequence[str] = ("text",), key: str = "doc_id", where: Column | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """key, score (6 digits) and rank (from 1) of the best documents, of all that match if ``limit`` is None.

    ``where`` filters what may be returned, on columns of ``docs``; the statistics stay those of all documents.
    A null text has no tokens; a query without words finds nothing.
    """
    query = parse(query, fields) if isinstance(query, str) else query
    if not any(c.occurs != "must_not" for c in query.clauses):
        return docs.select(key).where(F.lit(False)).select(key, F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    scored, singles = _plan(query, fields)
    # each text is tokenised once: what the query needs of it is read off the same array
    def measure(f: str) -> Column:
        parts = lambda t: F.struct(
            F.size(t).cast("long").alias("len"),
            *(_frequency(c.words, t).cast("long").alias(f"tf_{i}") for i, g, c in scored if g == f),
            *(F.array_contains(t, w).cast("long").alias(f"has_{n}") for n, (w, g) in enumerate(singles) if g == f),
        )
        return bind(tokens(F.col(f)), parts)

    measured = {f: measure(f) for f in fields}
    wide = spread(docs.select(key, *dict.fromkeys(fields), (where if where is not None else F.lit(True)).alias("_eligible")), key)
    # the number of a row's partition isn't a function of the row, so no filter moves below this and tokenises again
    found = wide.select(key, "_eligible", *(m.alias(f"_m_{f}") for f, m in measured.items()), F.spark_partition_id().alias("_part"))
    narrow = found.select(
        key, "_eligible", "_part", *(F.col(f"_m_{f}.len").alias(f"_len_{f}") for f in fields), *(F.col(f"_m_{f}.tf_{i}").alias(f"_tf_{i}_{f}") for i, f, _ in scored), *(F.col(f"_m_{f}.has_{n}").alias(f"_has_{n}") for n, (_, f) in enumerate(singles))
    )
    stats = narrow.agg(F.count("*").alias("_n"), *(F.avg(f"_len_{f}").alias(f"_avg_{f}") for f in fields), *(F.sum(f"_has_{n}").alias(f"_df_{n}") for n in range(len(singles))))
    hits = _score(narrow.where(F.col("_part") >= 0), stats, query, scored, singles, k1, b)
    return ranked(hits.select(key, "score"), "score", [key], limit)


def _score(narrow: DataFrame, stats: DataFrame, query: Query, scored: list, singles: list, k1: float, b: float) -> DataFrame:
    """``narrow`` (_eligible, _len_field, _tf_clause_field) with score, of what the query's clauses let through.

    ``stats`` is one row: _n, _avg_field, _df_word.
    """
    n = F.col("_n")

    def idf(w: str, f: str) -> Column:
        df = F.col(f"_df_{singles.index((w, f))}")
        return F.log(1 + (n - df + 0.5) / (df + 0.5))

    def part(i: int, f: str, c: Clause) -> Column:
        tf = F.col(f"_tf_{i}_{f}")
        weight = sum((idf(w, f) for w in c.words[1:]), idf(c.words[0], f))
        return c.boost * weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col(f"_len_{f}") / F.col(f"_avg_{f}")))

    matched = {i: sum((F.col(f"_tf_{j}_{f}") for j, f, _ in scored if j == i), F.lit(0)) > 0 for i, _, _ in scored}
    keep = F.col("_eligible")
    for i, c in enumerate(query.clauses):
        if c.occurs != "should":
            keep = keep & (matched[i] if c.occurs == "must" else ~matched[i])
    wanted = [i for i, c in enumerate(query.clauses) if c.occurs != "must_not"]
    any_ = matched[wanted[0]]
    for i in wanted[1:]:
        any_ = any_ | matched[i]
    parts = [F.when(F.col(f"_tf_{i}_{f}") > 0, part(i, f, c)).otherwise(0.0) for i, f, c in scored if c.occurs != "must_not"]
    return narrow.where(keep & any_).crossJoin(F.broadcast(stats)).withColumn("score", F.round(sum(parts[1:], parts[0]), 6))


def _plan(query: Query, fields: Sequence[str]) -> tuple[list, list]:
    """(number, field, clause) of all that is scored, and the words whose frequencies in a field that needs."""
    scored = [(i, f, c) for i, c in enumerate(query.clauses) for f in (c.fields or tuple(fields))]
    # a phrase weighs as much as its words' idfs together
    return scored, sorted({(w, f) for _, f, c in scored for w in c.words})


def ranked(hits: DataFrame, score: str, ties: Sequence[str], limit: int | None) -> DataFrame:
    """``hits`` with rank, from 1, by score downwards, ties by the given columns; the best ``limit``.

    Without a limit hits are sorted by ranges, in many tasks, and numbered within theirs; how many stand in the ranges
    before is added.
    """
    order = ", ".join([f"{score} desc", *ties])
    if limit is not None:
        hits = hits.orderBy(F.desc(score), *ties).limit(limit)
        return hits.withColumn("rank", F.expr(f"row_number() over (order by {order})"))
    placed = cut_lineage(hits.orderBy(F.desc(score), *ties).withColumn("_place", F.monotonically_increasing_id()))
    part, within = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    counts = sorted((r[0], r[1]) for r in placed.groupBy(part).count().collect())  # a row a task
    before = list(itertools.accumulate((n for _, n in counts), initial=0))
    starts = hits.sparkSession.createDataFrame([(p, n) for (p, _), n in zip(counts, before)], "_part int, _before long")
    numbered = placed.withColumn("_part", part.cast("int")).join(F.broadcast(starts), "_part")
    return numbered.select(*hits.columns, (within + F.col("_before") + 1).cast("int").alias("rank"))


def postings(docs: DataFrame, fields: Sequence[str] = ("text",), key: str = "doc_id", keep: Sequence[str] = (), observe: Observation | None = None) -> DataFrame:
    """key, ``keep``, field, length, term, tf and positions of every term of every document.

    A document's tokens are one array, grouped where they are, a batch of documents at a time: nothing is shuffled.
    ``observe`` is told the documents and tokens of each field on the way.
    """
    wide = spread(docs.select(key, *keep, *fields), key)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("tokens")) for f in fields]))
    found = wide.select(key, *keep, each.alias("_one")).select(key, *keep, "_one.field", "_one.tokens")
    if observe is not None:
        of = lambda f: (F.col("field") == f).cast("long")
        found = found.observe(observe, *(F.sum(of(f)).alias(f"n_{f}") for f in fields), *(F.sum(of(f) * F.size("tokens")).alias(f"tokens_{f}") for f in fields))
    types = dict(docs.dtypes)

    def group(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            if not lengths.sum():
                continue
            document = np.repeat(np.arange(len(lengths)), lengths)
            position = np.arange(len(document)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            words = lists.flatten().dictionary_encode()
            code = words.indices.to_numpy()
            order = np.lexsort((position, code, document))
            document, code, position = document[order], code[order], position[order].astype(np.int32)
            first = np.flatnonzero(np.concatenate([[True], (document[1:] != document[:-1]) | (code[1:] != code[:-1])]))
            ends = np.append(first, len(document)).astype(np.int32)
            of = pa.array(document[first])
            columns = [*(batch.column(c).take(of) for c in (key, *keep, "field")), pa.array(lengths[document[first]]), words.dictionary.take(pa.array(code[first])), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(position))]
            yield pa.RecordBatch.from_arrays(columns, [key, *keep, "field", "length", "term", "tf", "positions"])

    return found.mapInArrow(group, "".join(f"{c} {types[c]}, " for c in (key, *keep)) + "field string, length long, term string, tf long, positions array<int>")


#: Postings lie in so many folders, and a frequent term's are written by so many tasks.
BUCKETS, _TERM_PARTS = 16, 4


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build_index(docs: DataFrame, folder: str, fields: Sequence[str] = ("text",), key: str = "doc_id", keep: Sequence[str] = (), buckets: int = BUCKETS, within: str = "") -> None:
    """Write postings, each with its document's length and the columns ``keep``, and the corpus statistics below ``folder``.

    Texts are tokenised once. A rebuild replaces what is there; ``within`` (``name=value``) is a part of the index that
    is replaced for itself, as a source is.
    """
    spark, seen = docs.sparkSession, Observation()
    part = F.pmod(F.xxhash64(key), F.lit(_TERM_PARTS))
    dealt = postings(docs, fields, key, keep, seen).withColumn("bucket", _bucket(F.col("term"), buckets)).repartition(max(buckets, shuffle_partitions(spark)), "bucket", part)
    dealt.sortWithinPartitions("bucket", "term", "field").write.mode("overwrite").partitionBy("bucket").parquet("/".join(filter(None, (folder, "postings", within))))
    said = seen.get
    rows = [(f, said[f"n_{f}"] or 0, said[f"tokens_{f}"] or 0, buckets) for f in fields]
    spark.createDataFrame(rows, "field string, n long, tokens long, buckets int").coalesce(1).write.mode("overwrite").parquet("/".join(filter(None, (folder, "corpus", within))))


def search_index(spark: SparkSession, folder: str, query: Query | str, limit: int | None = 10, fields: Sequence[str] = ("text",), key: str = "doc_id", where: Column | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """What ``search`` says, from a written index, whose postings of the query's words are all that is read.

    ``where`` filters on the index's kept columns. The statistics of the corpus and of the query's words, a number for
    each field and word, come to the driver first.
    """
    query = parse(query, fields) if isinstance(query, str) else query
    corpus = {r.field: r for r in spark.read.parquet(f"{folder}/corpus").groupBy("field").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"), F.collect_set("buckets").alias("buckets")).collect()}
    every = spark.read.parquet(f"{folder}/postings")
    if not any(c.occurs != "must_not" for c in query.clauses):
        return every.where(F.lit(False)).select(key, F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    scored, singles = _plan(query, fields)
    words = sorted({w for w, _ in singles})
    sizes = sorted({n for r in corpus.values() for n in r.buckets})
    asked = spark.range(1).select(*[_bucket(F.lit(w), n) for w in words for n in sizes]).first() if sizes else ()
    read = every.where(F.col("bucket").isin(sorted(set(asked))) & F.col("term").isin(words) & F.col("field").isin([*fields]))
    df = {(r.term, r.field): r.n for r in read.groupBy("term", "field").agg(F.count("*").alias("n")).collect()}
    stats = spark.range(1).select(
        F.lit(max((r.n for r in corpus.values()), default=0)).alias("_n"), *(F.lit(corpus[f].tokens / corpus[f].n if f in corpus and corpus[f].n else 0.0).alias(f"_avg_{f}") for f in fields), *(F.lit(df.get(s, 0)).alias(f"_df_{i}") for i, s in enumerate(singles))
    )
    phrases = [c for _, _, c in scored if len(c.words) > 1]
    at = lambda w, f: (F.col("term") == w) & (F.col("field") == f)
    columns = [F.max(F.when(F.col("field") == f, F.col("length"))).alias(f"_len_{f}") for f in fields]
    columns += [F.coalesce(F.max(F.when(at(c.words[0], f), F.col("tf"))), F.lit(0)).alias(f"_tf_{i}_{f}") for i, f, c in scored if len(c.words) == 1]
    columns += [F.max(F.when(at(w, f), F.col("positions"))).alias(f"_at_{singles.index((w, f))}") for w, f in singles if any(w in c.words for c in phrases)]
    columns.append(F.first(where if where is not None else F.lit(True)).alias("_eligible"))
    grouped = read.groupBy(key).agg(*columns)

    def follow(f: str, c: Clause) -> Column:
        own = [F.col(f"_at_{singles.index((w, f))}") for w in c.words]
        begins = F.filter(own[0], lambda x: _all([F.array_contains(o, x + k) for k, o in enumerate(own[1:], 1)]))
        return F.coalesce(F.size(begins), F.lit(0)) if len(own) > 1 else F.size(own[0])

    for i, f, c in scored:
        if len(c.words) > 1:
            found = follow(f, c)
            grouped = grouped.withColumn(f"_tf_{i}_{f}", F.when(_all([F.col(f"_at_{singles.index((w, f))}").isNotNull() for w in c.words]), found).otherwise(0))
    hits = _score(grouped, stats, query, scored, singles, k1, b)
    return ranked(hits.select(key, "score"), "score", [key], limit)
