"""Chunks, cleaning, updates, sizes, exports and profiles over the text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.functions import text as T
from almanac.operators import catalog, chunker
from almanac.plans import Catalogue
from almanac.session import table

CATALOGUE = Catalogue()

_BLANKS = "chr(32) || chr(9) || chr(13) || chr(10)"
_CHUNKS = f"""
    lines as (select doc_id, list_filter(range(1, len(l) + 1), lambda i: true) idx, l from (select doc_id, string_split(regexp_replace(coalesce(text, ''), '\\n$', ''), chr(10)) l from documents)),
    fold as (
        select doc_id, l, 1 i, 0 c, l[1] || chr(10) buf, strlen(l[1]) + 1 > 1500 as full from lines
        union all
        select doc_id, l, i + 1, c + (case when f.full then 1 else 0 end), (case when f.full then '' else buf end) || l[i + 1] || chr(10), strlen((case when f.full then '' else buf end) || l[i + 1]) + 1 > 1500
        from fold f where i < len(l)),
    bodies as (select doc_id, c, trim(arg_max(buf, i), {_BLANKS}) body from fold group by doc_id, c),
    kept as (select * from bodies where body <> ''),
    chunked as (
        select doc_id, cast(row_number() over (partition by doc_id order by c) - 1 as integer) chunk_index, body from kept
        union all select doc_id, 0, coalesce(text, '') from documents where doc_id not in (select doc_id from kept))"""


@CATALOGUE.add(f"with recursive {_CHUNKS} select doc_id, chunk_index, body as chunk, strlen(body) as byte_len from chunked")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunker.chunk(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "chunk_index", "chunk", "byte_len")


@CATALOGUE.add(f"""with recursive {_CHUNKS}, n as (select doc_id, source, count(*) n, max(strlen(body)) b from chunked join documents using (doc_id) group by doc_id, source)
    select source, cast(sum(n) as bigint) as n_chunks, max(n) as most_chunks, max(b) as longest from n group by source""")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunker.chunk(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    each = chunks.groupBy("doc_id", "source").agg(F.count("*").alias("n"), F.max("byte_len").alias("b"))
    return each.groupBy("source").agg(F.sum("n").alias("n_chunks"), F.max("n").alias("most_chunks"), F.max("b").alias("longest"))


_LICENSE = "Licensed under [^\\n]*"


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was ingested before: all documents and pages."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc_"), "doc_id").alias("external_id"), T.content_hash(F.col("text")).alias("content_hash"))
    return docs.unionByName(table(spark, sf_dir, "pages").select(F.concat(F.lit("page_"), "page_id").alias("external_id"), T.content_hash(F.col("html")).alias("content_hash")))


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is there now: documents without licence lines, and conversations; the pages are gone."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc_"), "doc_id").alias("external_id"), T.content_hash(F.regexp_replace("text", _LICENSE, "")).alias("content_hash"))
    talks = table(spark, sf_dir, "conversations").select(F.concat(F.lit("conv_"), "conv_id", F.lit("_"), "turn").alias("external_id"), T.content_hash(F.col("text")).alias("content_hash"))
    return docs.unionByName(talks)


_KNOWN = "known as (select 'doc_' || doc_id external_id, sha256(text) h from documents union all select 'page_' || page_id, sha256(html) from pages)"
_SEEN = f"seen as (select 'doc_' || doc_id external_id, sha256(regexp_replace(text, '{_LICENSE}', '', 'g')) h from documents union all select 'conv_' || conv_id || '_' || turn, sha256(text) from conversations)"


@CATALOGUE.add(f"""with {_KNOWN}, {_SEEN}
    select coalesce(k.external_id, s.external_id) as external_id, case when k.external_id is null then 'new' when s.external_id is null then 'deleted' when k.h = s.h then 'unchanged' else 'changed' end as status
    from known k full outer join seen s on k.external_id = s.external_id""")
def update_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.update_diff(_known(spark, sf_dir), _seen(spark, sf_dir))


@CATALOGUE.add(f"""with {_KNOWN}, {_SEEN}, d as (select coalesce(k.external_id, s.external_id) external_id, case when k.external_id is null then 'new' when s.external_id is null then 'deleted' when k.h = s.h then 'unchanged' else 'changed' end status
    from known k full outer join seen s on k.external_id = s.external_id) select status, count(*) as n from d group by status""")
def update_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return update_diff(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@CATALOGUE.add("""with a as (select sha256(text) h, min('doc_' || doc_id) f from documents group by 1), b as (select sha256(text) h, min(source || '/' || doc_id) t from documents group by 1)
    select f as from_id, t as to_id from a join b using (h)""")
def rename_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("content_hash", T.content_hash(F.col("text")))
    known = docs.select(F.concat(F.lit("doc_"), "doc_id").alias("external_id"), "content_hash")
    return catalog.renames(known, docs.select(F.concat("source", F.lit("/"), "doc_id").alias("external_id"), "content_hash"))


@CATALOGUE.add(f"""with known as (select source as source_id, cast(doc_id as varchar) external_id, 'doc_' || doc_id title, sha256(text) content_hash, strlen(text) content_size, 1 as indexed_at, lang language from documents),
    n as (select source as source_id, cast(doc_id as varchar) external_id, 'doc ' || doc_id title, sha256(regexp_replace(text, '{_LICENSE}', '', 'g')) content_hash, strlen(regexp_replace(text, '{_LICENSE}', '', 'g')) content_size, 2 as indexed_at, 'xx' as language from documents where contains(text, 'Licensed under')
        union all select 'talks', conv_id || '_' || turn, role, sha256(text), strlen(text), 2, 'xx' from conversations)
    select coalesce(k.source_id, n.source_id) source_id, coalesce(k.external_id, n.external_id) external_id, coalesce(n.title, k.title) title, coalesce(n.content_hash, k.content_hash) content_hash,
           cast(coalesce(n.content_size, k.content_size) as bigint) content_size, coalesce(n.indexed_at, k.indexed_at) indexed_at, coalesce(k.language, n.language) as language
    from known k full outer join n on k.source_id = n.source_id and k.external_id = n.external_id""")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents re-ingested where their licence line went, and conversations that are new; the language stays."""
    docs = table(spark, sf_dir, "documents")

    def rows(df: DataFrame, source, external_id, title, body, at: int, language) -> DataFrame:
        return df.select(source.alias("source_id"), external_id.alias("external_id"), title.alias("title"), T.content_hash(body).alias("content_hash"), F.octet_length(body).cast("long").alias("content_size"), F.lit(at).alias("indexed_at"), language.alias("language"))

    ident = F.col("doc_id").cast("string")
    known = rows(docs, F.col("source"), ident, F.concat(F.lit("doc_"), ident), F.col("text"), 1, F.col("lang"))
    licensed = docs.where(F.contains("text", F.lit("Licensed under")))
    new = rows(licensed, F.col("source"), ident, F.concat(F.lit("doc "), ident), F.regexp_replace("text", _LICENSE, ""), 2, F.lit("xx"))
    talks = table(spark, sf_dir, "conversations")
    new = new.unionByName(rows(talks, F.lit("talks"), F.concat("conv_id", F.lit("_"), "turn"), F.col("role"), F.col("text"), 2, F.lit("xx")))
    return catalog.upsert_documents(known, new)


@CATALOGUE.add("select sha256(text) as content_hash, count(*) as n_documents, min(doc_id) as first from documents where text is not null group by 1 having count(*) > 1")
def content_hash_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.duplicate_contents(table(spark, sf_dir, "documents"))


@CATALOGUE.add("""select doc_id, sha256(text) as content_hash from documents where doc_id not in (select doc_id from labels where toxic = 1)""")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content without what is labelled toxic."""
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("document_id"))
    content = table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))
    return catalog.delete_cascade({"content": (content, "doc_id")}, gone)["content"]


@CATALOGUE.add("select source, count(*) as n_documents, cast(sum(strlen(text)) as bigint) as n_bytes from documents group by source")
def source_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.source_list(table(spark, sf_dir, "documents"))


@CATALOGUE.add("select source, lang, count(*) as n_documents, cast(sum(strlen(text)) as bigint) as n_bytes, max(n_chars) as longest from documents group by source, lang")
def source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    longest = docs.groupBy("source", "lang").agg(F.count("*").alias("n_documents"), F.sum(F.octet_length("text").cast("long")).alias("n_bytes"), F.max("n_chars").alias("longest"))
    return longest


def _layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.lit("public").alias("class"), F.col("source").alias("source_name"), F.lit("article").alias("content_type"), "text")
    pages = table(spark, sf_dir, "pages").select(F.lit("public").alias("class"), F.lit("web").alias("source_name"), F.lit("page").alias("content_type"), F.col("html").alias("text"))
    talks = table(spark, sf_dir, "conversations").select(F.lit("personal").alias("class"), F.lit("chat").alias("source_name"), F.lit("conversation").alias("content_type"), "text")
    return docs.unionByName(pages).unionByName(talks)


_LAYERS = "(select 'public' as class, source source_name, 'article' content_type, text from documents union all select 'public', 'web', 'page', html from pages union all select 'personal', 'chat', 'conversation', text from conversations)"


@CATALOGUE.add(f"select class, content_type, count(*) as n_documents, cast(sum(strlen(text)) as bigint) as n_bytes from {_LAYERS} group by class, content_type")
def storage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _layers(spark, sf_dir).groupBy("class", "content_type").agg(F.count("*").alias("n_documents"), F.sum(F.octet_length("text").cast("long")).alias("n_bytes"))


@CATALOGUE.add(f"select class, source_name, content_type, count(*) as n_documents, cast(sum(strlen(text)) as bigint) as n_bytes from {_LAYERS} group by rollup (class, source_name, content_type)")
def storage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.rollup_sizes(_layers(spark, sf_dir), ["class", "source_name", "content_type"])


def _content(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("source_name"), F.concat("doc_id", F.lit(".md")).alias("filename"), "text", F.lit(0).alias("privacy_level"))
    talks = table(spark, sf_dir, "conversations").select(F.lit("chat").alias("source_name"), F.concat("conv_id", F.lit("_"), "turn", F.lit(".txt")).alias("filename"), "text", F.lit(2).alias("privacy_level"))
    return docs.unionByName(talks)


_CONTENT = "(select source source_name, doc_id || '.md' filename, text, 0 privacy_level from documents union all select 'chat', conv_id || '_' || turn || '.txt', text, 2 from conversations)"


@CATALOGUE.add(f"select source_name, filename, sha256(text) as content_hash from {_CONTENT} where privacy_level = 0")
def export_public(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.exportable(_content(spark, sf_dir)).select("source_name", "filename", T.content_hash(F.col("text")).alias("content_hash"))


@CATALOGUE.add(f"select source_name, filename, privacy_level from {_CONTENT} where privacy_level <= 1")
def privacy_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.visible(_content(spark, sf_dir), privacy_max=1).select("source_name", "filename", "privacy_level")


@CATALOGUE.add(f"select filename, sha256(text) as content_hash from {_CONTENT} where source_name = 'src3' and filename = '3.md'")
def read_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.read_document(_content(spark, sf_dir), "src3:3").select("filename", T.content_hash(F.col("text")).alias("content_hash"))


_ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@CATALOGUE.add(" union all ".join(f"select '{c}' as column_name, count(*) as n_rows, count({c}) as n_values, count(distinct {c}) as n_distinct, min(cast({c} as varchar)) as least from (select o_orderkey, o_custkey, o_orderstatus, cast(o_totalprice * 100 as bigint) o_totalprice, o_orderpriority from orders)" for c in _ORDER_COLUMNS))
def csv_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("long").alias("o_totalprice"), "o_orderpriority")
    measured = orders.agg(F.count("*").alias("n"), *(f(c).alias(f"{c}_{n}") for c in _ORDER_COLUMNS for n, f in (("v", F.count), ("d", F.countDistinct), ("m", lambda c: F.min(F.col(c).cast("string"))))))
    rows = [F.struct(F.lit(c).alias("column_name"), F.col("n").alias("n_rows"), F.col(f"{c}_v").alias("n_values"), F.col(f"{c}_d").alias("n_distinct"), F.col(f"{c}_m").alias("least")) for c in _ORDER_COLUMNS]
    return measured.select(F.inline(F.array(*rows)))


_CLEAN = f"""select doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, {_BLANKS})), lambda x: not (strlen(x) < 4 and regexp_matches(x, '^[0-9-]*$'))), chr(10)) as text from documents"""


@CATALOGUE.add(f"select doc_id, sha256(text) as content_hash, strlen(text) as n_bytes from ({_CLEAN})")
def pdf_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = table(spark, sf_dir, "documents").select("doc_id", T.clean_extracted(F.col("text")).alias("text"))
    return cleaned.select("doc_id", T.content_hash(F.col("text")).alias("content_hash"), F.octet_length("text").cast("long").alias("n_bytes"))


@CATALOGUE.add(f"""with l as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, {_BLANKS} || '#')), lambda x: x <> '')[1] x from documents)
    select doc_id, case when strlen(x) < 200 and x not like '%.' then x else 'doc_' || doc_id end as title from l""")
def pdf_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.extracted_title(F.col("text"), F.concat(F.lit("doc_"), "doc_id")).alias("title"))


#: A page in each of two markups. Fixed values.
WIKI = "{{Infobox|name={{x}}}}'''Paris''' is the [[capital city|capital]] of [[France]].<ref>a</ref>\n\n== History ==\nOld ''town''.[[File:a.png]]\n=== Roman ===\nLutetia"
WIKI_CLEAN = "**Paris** is the capital of France.\n\n## History\nOld *town*.\n### Roman\nLutetia"
SECTIONS = "# Paris\nintro\n## Geography\nriver\n### Hills\nhigh\n## History\nold"


@CATALOGUE.add("select '" + WIKI_CLEAN.replace("'", "''") + "' as text")
def wikitext_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(WIKI,)], "raw string").select(T.wikitext_to_markdown(F.col("raw")).alias("text"))


@CATALOGUE.add("select '## Geography\nriver\n### Hills\nhigh' as geography, '### Hills\nhigh' as hills, cast(null as varchar) as absent")
def read_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = spark.createDataFrame([(SECTIONS,)], "text string")
    return page.select(T.section(F.col("text"), "Geography").alias("geography"), T.section(F.col("text"), "Hills").alias("hills"), T.section(F.col("text"), "Nowhere").alias("absent"))


@CATALOGUE.add("""select doc_id, case when b >= 1073741824 then printf('%.1f GB', round(b / 1073741824.0::double, 1)) when b >= 1048576 then printf('%.1f MB', round(b / 1048576.0::double, 1)) when b >= 1024 then printf('%.1f KB', round(b / 1024.0::double, 1)) else b || ' B' end as size
    from (select doc_id, strlen(text) b from documents)""")
def document_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.human_bytes(F.octet_length("text")).alias("size"))


@CATALOGUE.add("select item_id, regexp_replace(text, '(?i)the', '**\\0**', 'g') as text from benchmark")
def highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", T.highlight(F.col("text"), F.lit("the")).alias("text"))
