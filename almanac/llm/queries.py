"""The operators over their whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm import bpe, langid, lm, mixing, quality, secrets, simhash, substring_dedup, topk, urls
from almanac.session import table

Query = Callable[[SparkSession, str], DataFrame]

#: What op6 decides by rule. Fixed values.
URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def tokenizer() -> tuple[str, str]:
    """The rank file and pattern that op5 and the pipeline encode with."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def fold(divisor: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % divisor


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=35)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return kept.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold(3) == 1, F.lit(False))  # a null id has no remainder: it isn't held out, and is learned from
    book = langid.train(docs.where(~held_out))
    return langid.identify(docs, book).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents"), *tokenizer())
    n_tokens = F.floor(F.octet_length("ids") / 4).alias("n_tokens")
    return encoded.select("doc_id", n_tokens, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is bad if the document of its number is labelled toxic or of no quality."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return urls.judge(table(spark, sf_dir, "pages"), outcomes, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, epochs=2).select("doc_id", "size", "source_size", "target", "taken")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = secrets.vocabulary_words(tokenizer()[0])
    found = secrets.scan(table(spark, sf_dir, "documents"), secrets.train(spark, dictionary=words), path_col="source", dictionary=words)
    return found.select("doc_id", F.col("place").cast("long").alias("place"), F.sha2("value", 256).alias("value_sha256"), F.length("value").alias("length"), F.round("score", 6).alias("score"), "is_secret")


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where("vec_id % 50 = 0"), k=5)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"), fold(7) == 2)


_ALL = (op1_substring_dedup, op2_simhash_near_dedup, op3_quality_rules, op4_language_id, op5_bpe, op6_url_filters, op7_mixing, op8_secret_scan, op9_topk_search, op10_lm_scoring)
QUERIES: dict[str, Query] = {f.__name__: f for f in _ALL}

_WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_OP1_SQL = f"""
with docs as (select row_number() over () as r, doc_id, {_WORDS_SQL} as words from documents),
windows as (select r, s, array_to_string(list_slice(words, s, s + 34), ' ') as w from (select r, words, unnest(range(1, len(words) - 33)) as s from docs where len(words) >= 35)),
repeats as (select r, s from windows qualify count(*) over (partition by w) > 1),
gone as (select distinct r, unnest(range(s, s + 35)) as place from repeats),
placed as (select r, unnest(words) as word, generate_subscripts(words, 1) as place from docs),
kept as (select r, count(g.place) as n_removed, string_agg(word, ' ' order by place) filter (where g.place is null) as kept from placed left join gone g using (r, place) group by r)
select doc_id, len(words) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from docs left join kept using (r)"""

_LEVEL_SQL = """
{level}_spread as (select {parent}prior, sum(n * pow(bad / n - prior, 2)) as between_, count(*) as children, sum(n) as pages from {level}_prior group by {parent}prior),
{level}_worth as (select {parent}least(greatest(1 / greatest((between_ / (prior * (1 - prior)) - children) / greatest(pages - children, 1), 1e-6) - 1, 1.0), 1000.0) as prior_worth from {level}_spread),
{level}_mean as (select p.*, (bad + prior * prior_worth) / (n + prior_worth) as mean, n + prior_worth as worth from {level}_prior p join {level}_worth w on {on}),"""


def _op6_sql(lift: float = 1.0, z: float = 1.0) -> str:
    host = r"translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    two = rf"regexp_extract(host, '(?:^|\.)((?:{'|'.join(urls.SECOND_LEVEL)})\.[^.]{{2}})$', 1)"
    rules = "null"
    for verdict, rule in sorted(URL_RULES, key=lambda r: (len(r[1]), r[1])):
        h, _, p = rule.partition("/")
        rules = f"case when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '/{p}') then '{verdict} {rule}' else {rules} end"
    levels, above = "", {"suffix": "", "domain": "suffix, ", "host": "suffix, domain, "}
    for level, parent in above.items():
        names = [x for x in parent.split(", ") if x]
        on = " and ".join(f"p.{x} = w.{x}" for x in names) or "true"
        source = f"(select {parent}{level}, sum(n) as n, sum(bad) as bad from counts group by all) c"
        prior = f"{names[-1]}_mean" if names else "root"
        joined = f"join {prior} q on {' and '.join(f'c.{x} = q.{x}' for x in names)}" if names else "cross join root q"
        levels += f"\n{level}_prior as (select c.*, q.mean as prior from {source} {joined})," + _LEVEL_SQL.format(level=level, parent=parent, on=on)
    return rf"""
with parts0 as (select page_id, {host} as host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
parts1 as (select *, case when {two} <> '' then {two} else string_split(host, '.')[-1] end as suffix from parts0),
parts2 as (select *, string_split(left(host, greatest(0, length(host) - length(suffix) - 1)), '.')[-1] as label from parts1),
parts as (select page_id, host, path, suffix, case when label = '' then suffix else label || '.' || suffix end as domain from parts2),
outcomes as (select doc_id as page_id, max(case when quality = 0 or toxic = 1 then 1 else 0 end) as bad from labels where doc_id is not null group by doc_id),
counts as (select suffix, domain, host, count(*)::double as n, sum(bad)::double as bad from parts join outcomes using (page_id) group by suffix, domain, host),
root as (select (coalesce(sum(bad), 0) + {urls.PRIOR}) / (coalesce(sum(n), 0) + 1.0) as mean from counts),{levels}
known as (
    select h.host, coalesce(a.mean, b.mean, c.mean, (select mean from root)) as mean, coalesce(a.worth, b.worth, c.worth, 1.0) as worth from (select distinct suffix, domain, host from parts) h
    left join host_mean a on h.suffix = a.suffix and h.domain = a.domain and h.host = a.host left join domain_mean b on h.suffix = b.suffix and h.domain = b.domain left join suffix_mean c on h.suffix = c.suffix),
judged as (select page_id, host, path, {rules} as matched, greatest(0.0, mean - {z} * sqrt(mean * (1 - mean) / (worth + 1))) as lower_bound from parts p join known k using (host))
select page_id, host, path, substr(matched, strpos(matched, ' ') + 1) as rule, coalesce(string_split(matched, ' ')[1], case when lower_bound > {lift} * (select mean from root) then 'block' else 'allow' end) as verdict from judged"""


_OP9_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id as vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s
qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5"""

#: The others need what SQL has not: XXH64, CRC-32, trained models, regular expressions with look-ahead.
ORACLE_SQL: dict[str, str] = {"op1_substring_dedup": _OP1_SQL, "op6_url_filters": _op6_sql(), "op9_topk_search": _OP9_SQL}
