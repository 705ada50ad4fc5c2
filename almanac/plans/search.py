"""Full-text, vector, hybrid and substring queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.functions.text import document_title, snippet, strip_tags
from almanac.operators import fts, retrieval
from almanac.operators.catalog import PRIVATE, PUBLIC
from almanac.plans import Catalogue
from almanac.session import table

CATALOGUE = Catalogue()

WORDS = "aiai aian the"
#: The query vector: as long as the vectors, of fixed values.
VECTOR = tuple(((i * 37) % 101 - 50) / 100 for i in range(64))

_TOKENS = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '' and strlen(x) <= 40)"


def tokens_sql(column: str) -> str:
    return _TOKENS.format(column)


def bm25_sql(rows: str, words: str, fields: tuple[str, ...] = ("text",), key: str = "doc_id", eligible: str = "true", limit: int | None = 10, having: str = "true") -> str:
    """BM25 over the rows of a subquery, in SQL."""
    terms = ", ".join(f"('{w}')" for w in words.split())
    toks = "\n      union all ".join(f"select {key}, '{f}' field, {tokens_sql(f)} toks from src" for f in fields)
    return f"""
    with src as (select *, {eligible} eligible from ({rows})),
    toks as ({toks}),
    q(term) as (values {terms}),
    dl as (select {key}, field, len(toks) n from toks),
    st as (select field, count(*) n, avg(n) av from dl group by field),
    tf as (select {key}, field, term, len(list_filter(toks, lambda x: x = term)) tf from toks, q),
    hit as (select * from tf where tf > 0),
    df as (select field, term, count(*) df from hit group by field, term),
    sc as (select h.{key}, round(sum(ln(1 + (st.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl.n / st.av))), 6) score
           from hit h join df using (field, term) join st using (field) join dl using ({key}, field) group by h.{key}),
    ok as (select {key}, score from sc where {key} in (select {key} from src where eligible) and {having})
    select {key}, score, cast(row_number() over (order by score desc, {key}) as integer) as rank from ok
    order by score desc, {key}{f" limit {limit}" if limit else ""}"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public documents and private conversations as one corpus."""
    docs = _documents(spark, sf_dir).select(F.concat(F.lit("d"), F.col("doc_id")).alias("key"), "text", F.lit(PUBLIC).alias("privacy_level"))
    talks = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("_"), "turn").alias("key"), "text", F.lit(PRIVATE).alias("privacy_level"))
    return docs.unionByName(talks)


_MIXED = "select 'd' || doc_id as key, text, 0 privacy from documents union all select 'c' || conv_id || '_' || turn, text, 2 from conversations"


def _ranked(hits: DataFrame) -> DataFrame:
    return hits.withColumn("rank", F.col("rank").cast("int"))


@CATALOGUE.add(bm25_sql("select * from documents", WORDS))
def fts_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(fts.search(_documents(spark, sf_dir), fts.words_query(WORDS), 10))


_PAGE_FIELDS = "select page_id, html_title title, html_text body from (select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) html_title, replace(regexp_replace(html, '<[^>]*(?:>|$)', '', 'g'), '>', '') html_text from pages)"


@CATALOGUE.add(bm25_sql(_PAGE_FIELDS, "the aian onion", ("title", "body"), "page_id"))
def fts_two_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), strip_tags(F.col("html")).alias("body"))
    return _ranked(fts.search(pages, fts.words_query("the aian onion"), 10, ("title", "body"), "page_id"))


MUST_NOT_SQL = bm25_sql("select * from documents", "aian the", having=f"doc_id not in (select doc_id from toks where list_contains(toks, 'of')) and doc_id in (select doc_id from toks where list_contains(toks, 'aian'))", limit=None)


@CATALOGUE.add(MUST_NOT_SQL)
def fts_boolean_must_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(fts.search(_documents(spark, sf_dir), "the +aian -of", None))


PHRASE_SQL = f"""
    with toks as (select doc_id, {tokens_sql("text")} toks from documents),
    st as (select count(*) n, avg(len(toks)) av from toks),
    df as (select sum(list_contains(toks, 'of')::int) d1, sum(list_contains(toks, 'the')::int) d2 from toks),
    tf as (select doc_id, len(toks) dl, len(list_filter(range(1, len(toks)), lambda i: toks[i] = 'of' and toks[i + 1] = 'the')) tf from toks),
    sc as (select doc_id, round((ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) + ln(1 + (n - d2 + 0.5) / (d2 + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av)), 6) score from tf, st, df where tf > 0)
    select doc_id, score, cast(row_number() over (order by score desc, doc_id) as integer) as rank from sc"""


@CATALOGUE.add(PHRASE_SQL)
def fts_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(fts.search(_documents(spark, sf_dir), '"of the"', None))


@CATALOGUE.add(bm25_sql("select * from documents", WORDS, eligible="source = 'src1'", limit=20))
def fts_source_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(fts.search(_documents(spark, sf_dir), fts.words_query(WORDS), 20, where=F.col("source") == "src1"))


@CATALOGUE.add(bm25_sql(_MIXED, WORDS, key="key", eligible="privacy = 0", limit=20))
def fts_public_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(fts.search(_mixed(spark, sf_dir), fts.words_query(WORDS), 20, key="key", where=F.col("privacy_level") == PUBLIC))


@CATALOGUE.add(bm25_sql(_MIXED, WORDS, key="key", eligible="privacy > 0", limit=20))
def fts_personal_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(fts.search(_mixed(spark, sf_dir), fts.words_query(WORDS), 20, key="key", where=F.col("privacy_level") > PUBLIC))


def _mode(mode: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _ranked(fts.search(_mixed(spark, sf_dir), fts.words_query("le aian the"), fts.LIMITS[mode], key="key"))

    query.__name__ = f"search_mode_{mode}"
    return query


for _name, _limit in fts.LIMITS.items():
    CATALOGUE.add(bm25_sql(_MIXED, "le aian the", key="key", limit=_limit))(_mode(_name))

_VECTOR_SQL = "[" + ", ".join(map(repr, VECTOR)) + "]::double[]"


def _vector_sql(where: str = "true", limit: int = 10) -> str:
    return f"""with s as (select vec_id, round(list_cosine_similarity(embedding::double[], {_VECTOR_SQL}), 6) score from embeddings where {where})
    select vec_id, score, cast(row_number() over (order by score desc, vec_id) as integer) as rank from s order by score desc, vec_id limit {limit}"""


@CATALOGUE.add(_vector_sql())
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(retrieval.vector_search(table(spark, sf_dir, "embeddings"), VECTOR, 10))


@CATALOGUE.add(_vector_sql("label = 3", 20))
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(retrieval.vector_search(table(spark, sf_dir, "embeddings"), VECTOR, 20, where=F.col("label") == 3))


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    text = fts.search(_documents(spark, sf_dir), fts.words_query(WORDS), 40)
    vector = retrieval.vector_search(table(spark, sf_dir, "embeddings"), VECTOR, 40).withColumnRenamed("vec_id", "doc_id")
    return text, vector


_LISTS_SQL = f"with t as ({bm25_sql('select * from documents', WORDS, limit=40)}), v as (select vec_id doc_id, score, rank from ({_vector_sql(limit=40)}))"


@CATALOGUE.add(f"""{_LISTS_SQL}, f as (select doc_id, round(sum(1.0::double / (60 + rank - 1)), 9) score from (select doc_id, rank from t union all select doc_id, rank from v) group by doc_id)
    select doc_id, score, cast(row_number() over (order by score desc, doc_id) as integer) as rank from f order by score desc, doc_id limit 20""")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, vector = _lists(spark, sf_dir)
    return _ranked(retrieval.fuse([text, vector], ["doc_id"], 20))


@CATALOGUE.add(f"""{_LISTS_SQL}, f as (select doc_id, round(sum(p), 9) score from (select doc_id, (1 - 0.7::double) * score / (select max(score) from t) p from t union all select doc_id, 0.7::double * score / (select max(score) from v) from v) group by doc_id)
    select doc_id, score, cast(row_number() over (order by score desc, doc_id) as integer) as rank from f order by score desc, doc_id limit 20""")
def hybrid_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, vector = _lists(spark, sf_dir)
    return _ranked(retrieval.weighted_hybrid(text, vector, ["doc_id"], 0.7, 20))


@CATALOGUE.add("""select count(*) as n_documents, cast(sum(len(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, 3) = 'ana'))) as bigint) as n_occurrences
    from documents where contains(text, 'ana')""")
def substring_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.substring_count(_documents(spark, sf_dir), "ana")


_HITS_SQL = """with h as (select doc_id, text, strpos(text, 'the th') pos from documents where contains(text, 'the th')),
    c as (select *, greatest(1, pos - 60) b, least(length(text), pos + 5 + 60) e from h)
    select doc_id, cast(strlen(substr(text, 1, pos - 1)) as bigint) as byte_position,
           (case when b > 1 then '...' else '' end) || trim(translate(substr(text, b, e - b + 1), chr(10) || chr(13), '  '), ' ') || (case when e < length(text) then '...' else '' end) as context from c"""


@CATALOGUE.add(_HITS_SQL)
def substring_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.substring_hits(_documents(spark, sf_dir), "the th", None)


@CATALOGUE.add("""with g as (select doc_id from documents where contains(text, 'aia') and contains(text, 'iai') and contains(text, 'aiè'))
    select doc_id from g""")
def substring_trigram_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have all trigrams of ``aiaiè`` (aia, iai, aiè)."""
    return retrieval.trigram_candidates(retrieval.trigrams(_documents(spark, sf_dir)), "aiaiè")


@CATALOGUE.add("""select doc_id, case when regexp_matches(text, '(?m)^[^\\S\\n]*# ') then regexp_extract(text, '(?m)^[^\\S\\n]*# (.*?)[^\\S\\n]*$', 1) else 'doc_' || doc_id end as title from documents""")
def doc_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", document_title(F.col("text"), F.concat(F.lit("doc_"), "doc_id", F.lit(".md"))).alias("title"))


@CATALOGUE.add("select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) as heading from pages")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("heading"))


@CATALOGUE.add("""with k as (select doc_id, text, case when strlen(text) <= 100 then length(text) else list_filter(range(25, 101), lambda k: strlen(substr(text, 1, k)) >= 100)[1] end n from documents)
    select doc_id, trim(substr(text, 1, n), chr(32) || chr(9) || chr(10) || chr(13)) || (case when strlen(text) > 100 then '...' else '' end) as snippet from k""")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", snippet(F.col("text"), 200).alias("snippet"))


@CATALOGUE.add("select page_id, replace(regexp_replace(html, '<[^>]*(?:>|$)', '', 'g'), '>', '') as text from pages")
def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", strip_tags(F.col("html")).alias("text"))


@CATALOGUE.add("""select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as score
    from embeddings a join embeddings b on a.vec_id < b.vec_id where list_cosine_similarity(a.embedding::double[], b.embedding::double[]) > 0.35""")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.similar_pairs(table(spark, sf_dir, "embeddings"), 0.35)


@CATALOGUE.add(f"""with v as (select vec_id, list_cosine_similarity(embedding::double[], {_VECTOR_SQL}) sim, label from embeddings),
    u as (select user_id, max(ts) last, count(*) n from events group by user_id),
    g as (select max(ts) g, (select max(n) from u) m from events)
    select vec_id, round(0.30 * sim + 0.25 * label / 10.0::double + 0.15 * exp(-0.10 * date_diff('second', last, g) / 86400.0::double) + 0.15 * exp(-0.023 * date_diff('second', last, g) / 86400.0::double) + 0.15 * n / m::double, 6) as score
    from v join u on u.user_id = v.vec_id, g""")
def retrieval_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of users: similarity to the query, importance from the label, recency and centrality from their events."""
    from almanac.functions import vectors

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", vectors.cosine(F.col("embedding"), vectors.literal(VECTOR)).alias("similarity"))
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last"), F.count("*").alias("n"))
    bounds = users.agg(F.max("last").alias("latest"), F.max("n").alias("most"))
    seconds = F.unix_timestamp(F.col("latest").cast("timestamp")) - F.unix_timestamp(F.col("last").cast("timestamp"))
    joined = rows.join(users, rows.vec_id == users.user_id).crossJoin(F.broadcast(bounds)).withColumn("days", seconds / 86400.0)
    score = retrieval.retrieval_score(F.col("similarity"), F.col("label") / 10.0, F.col("days"), F.col("days"), F.col("n") / F.col("most"))
    return joined.select("vec_id", F.round(score, 6).alias("score"))
