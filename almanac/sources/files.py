"""Folders of text files, tables, archives of content, chat exports, tracks and encyclopedia dumps: what Spark reads itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almanac.functions.text import document_title, wikitext_to_markdown
from almanac.operators import sessions
from almanac.sources.html import html_to_markdown

GLOBS = {"markdown-dir": "*.md", "plaintext-dir": "*.txt", "html-dir": "*.{html,htm}"}


def document_columns(external_id: Column, title: Column, text: Column, content_type: str, parent: Column | None = None, depth: int = 0, privacy: int = 0) -> list[Column]:
    parent = parent if parent is not None else F.lit(None).cast("string")
    return [external_id.alias("external_id"), title.alias("title"), text.alias("text"), F.lit(content_type).alias("content_type"), parent.alias("parent_id"), F.lit(depth).alias("depth"), F.lit(privacy).alias("privacy_level")]


def text_dir(spark: SparkSession, path: str, form: str = "markdown-dir", privacy: int = 0) -> DataFrame:
    """One document a file of the folder itself; files without text are left out."""
    files = spark.read.option("pathGlobFilter", GLOBS[form]).text(path, wholetext=True)
    files = files.select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    if form == "html-dir":
        files = files.withColumn("text", html_to_markdown("text"))
    files = files.where(F.btrim("text", F.lit(" \t\r\n")) != "")
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    return files.select(*document_columns(stem, document_title(F.col("text"), F.col("name")), F.col("text"), "Article", privacy=privacy))


def delimited(spark: SparkSession, path: str) -> DataFrame:
    """The table itself, with a header line; tabs for .tsv, else commas."""
    return spark.read.csv(path, header=True, sep="\t" if path.endswith(".tsv") else ",", inferSchema=True)


def query_delimited(spark: SparkSession, path: str, sql: str) -> DataFrame:
    """What SQL says of a table in a delimited file, which it calls ``{rows}``."""
    return spark.sql(sql, rows=delimited(spark, path))


#: What a chat export's messages hold; ``text`` is a string, or an array of strings and objects with a text.
CHAT = "name string, messages array<struct<id:bigint,type:string,date:string,`from`:string,text:string,reply_to_message_id:bigint,edited:string>>"


def flat_chat_text(raw: Column) -> Column:
    """Rich text as one string, whichever of its two shapes it has."""
    parts = F.from_json(raw, "array<string>")
    one = lambda p: F.when(p.startswith("{"), F.coalesce(F.get_json_object(p, "$.text"), F.lit(""))).otherwise(p)
    return F.when(raw.startswith("["), F.array_join(F.transform(parts, one), "")).otherwise(F.coalesce(raw, F.lit("")))


def chat_messages(spark: SparkSession, path: str) -> DataFrame:
    """chat, id, ts, sender, text, reply_to and edited of every message of the exports (one JSON object a file)."""
    exported = spark.read.schema(CHAT).json(path, multiLine=True)
    rows = exported.select(F.col("name").alias("chat"), F.explode("messages").alias("m")).where("m.type = 'message'")
    return rows.select("chat", F.col("m.id").alias("id"), F.try_to_timestamp("m.date").alias("ts"), F.col("m.from").alias("sender"), flat_chat_text(F.col("m.text")).alias("text"), F.col("m.reply_to_message_id").alias("reply_to"), F.col("m.edited").isNotNull().alias("edited"))


def chat_line(ts: Column, sender: Column, text: Column, reply_to: Column, edited: Column) -> Column:
    return F.concat(F.coalesce(sender, F.lit("Unknown")), F.lit(" ["), F.date_format(ts, "HH:mm"), F.lit("]"), F.when(reply_to.isNotNull(), " (reply)").otherwise(""), F.when(edited, " (edited)").otherwise(""), F.lit(": "), text)


def chat_documents(spark: SparkSession, path: str, gap: str = "2 hours") -> DataFrame:
    """A private conversation for each stretch of a chat without a longer gap."""
    messages = sessions.gap_segments(chat_messages(spark, path).where("text <> ''"), "chat", "ts", "id", gap)
    line = chat_line(F.col("ts"), F.col("sender"), F.col("text"), F.col("reply_to"), F.col("edited"))
    texts = sessions.render(messages, ["chat", "segment"], "id", line)
    name = sessions.segment_name(F.col("segment"))
    return texts.select(*document_columns(name, F.concat("chat", F.lit(" "), name), F.concat(F.lit("["), "chat", F.lit("]\n"), "text"), "Conversation", privacy=2))


def track_points(spark: SparkSession, path: str) -> DataFrame:
    """track, n, lat, lon, ele and time of the points of GPX files, in order of the file."""
    points = spark.read.format("xml").option("rowTag", "trkpt").schema("_lat double, _lon double, ele double, time timestamp").load(path)
    located = points.select(F.col("_metadata.file_name").alias("track"), F.monotonically_increasing_id().alias("n"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), "ele", "time")
    return located.where("lat is not null and lon is not null")


def track_documents(spark: SparkSession, path: str, gap: str = "2 hours", epsilon: float = 1e-4) -> DataFrame:
    """A private segment for each stretch of a track without a longer gap: what track_stats says about it."""
    from almanac.operators.tracks import simplify, track_stats

    points = track_points(spark, path).withColumn("ts", F.coalesce("time", F.timestamp_seconds(F.lit(0))))
    cut = sessions.gap_segments(points, "track", "ts", "n", gap).withColumn("piece", F.concat_ws("#", "track", "segment"))
    stats = track_stats(simplify(cut, "piece", "n", epsilon), ["track", "segment"], "time")
    said = F.concat(
        F.format_string("Points: %d\nDistance: %.2f km", "n_points", "distance_km"), F.coalesce(F.format_string("\nMax elevation: %.0f m", "max_elevation"), F.lit("")),
        F.coalesce(F.concat(F.lit("\nFrom: "), F.col("first").cast("string"), F.lit("\nTo: "), F.col("last").cast("string")), F.lit("")),
    )
    name = F.format_string("%s_%04d", F.regexp_replace("track", r"\.gpx$", ""), F.col("segment").cast("int"))
    return stats.select(*document_columns(name, name, said, "GpsSegment", privacy=2))


def mediawiki_documents(spark: SparkSession, path: str, min_chars: int = 200) -> DataFrame:
    """Articles of an XML dump as Markdown, without redirects and short ones."""
    pages = spark.read.format("xml").option("rowTag", "page").schema("title string, ns int, revision struct<text:string>").load(path)
    body = pages.where("coalesce(ns, 0) = 0").select("title", F.col("revision.text").alias("raw"))
    body = body.where(F.col("raw").isNotNull() & ~F.lower("raw").startswith("#redirect")).withColumn("text", wikitext_to_markdown(F.col("raw")))
    body = body.where(F.char_length("text") >= min_chars)
    return body.select(*document_columns(F.translate("title", " /\\:", "____"), F.col("title"), F.concat(F.lit("# "), "title", F.lit("\n\n"), "text"), "Article"))


def json_lines(spark: SparkSession, path: str, text: str = "text", key: str = "id", title: str = "title") -> DataFrame:
    """Documents from objects, one a line; objects without a text are left out."""
    rows = spark.read.text(path).select(F.get_json_object("value", f"$.{key}").alias("key"), F.get_json_object("value", f"$.{title}").alias("name"), F.get_json_object("value", f"$.{text}").alias("body"))
    rows = rows.where("body is not null").withColumn("key", F.coalesce("key", F.sha2("body", 256)))
    return rows.select(*document_columns(F.col("key"), F.coalesce("name", "key"), F.col("body"), "Article"))


_TRIPLE = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"\S*)\s*\.\s*$'


def triples(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """relations (subject_id, predicate, object_id) and facts (subject_id, predicate, value) of N-Triples files."""
    part = lambda n: F.regexp_extract("value", _TRIPLE, n)
    bare = lambda c: F.regexp_replace(c, "^<|>$", "")
    rows = spark.read.text(path).select(bare(part(1)).alias("subject_id"), part(2).alias("predicate"), part(3).alias("object")).where("subject_id <> ''")
    literal = F.col("object").startswith('"')
    relations = rows.where(~literal).select("subject_id", "predicate", bare(F.col("object")).alias("object_id"))
    value = F.regexp_extract("object", r'^"((?:[^"\\]|\\.)*)"', 1)
    return relations, rows.where(literal).select("subject_id", "predicate", F.regexp_replace(value, r'\\(["\\])', "$1").alias("value"))


#: Properties of entity dumps that become relations or facts. Fixed values.
PROPERTIES = {
    "P31": "instance_of", "P279": "subclass_of", "P17": "country", "P36": "capital", "P131": "located_in", "P625": "coordinates", "P1082": "population", "P569": "date_of_birth",
    "P570": "date_of_death", "P19": "place_of_birth", "P27": "citizenship", "P106": "occupation", "P50": "author", "P571": "inception", "P856": "website",
}
LANGUAGES = ("en", "ru", "de", "fr", "es", "zh", "ja")
_VALUE = "struct<mainsnak:struct<datavalue:struct<type:string,value:string>>>"
ENTITY = f"id string, type string, labels map<string,struct<value:string>>, descriptions map<string,struct<value:string>>, claims map<string,array<{_VALUE}>>"


def entity_dump(spark: SparkSession, path: str, types: Sequence[str] | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """entities, relations (to other entities) and facts (literal values) of a line-delimited dump, gzipped or not.

    Items with an English label; of each property the first claim that says something; lines that can't be read
    are left out. ``types`` keeps what is an instance of one of them.
    """
    lines = spark.read.text(path).select(F.regexp_replace(F.btrim("value", F.lit(" \t\r")), ",$", "").alias("line")).where("line not in ('', '[', ']')")
    items = lines.select(F.from_json("line", ENTITY).alias("e")).where("e.id is not null and e.type = 'item' and e.labels['en'].value is not null").select("e.*")
    decoded = F.map_filter(F.transform_values("claims", lambda k, c: F.get(F.filter(F.transform(c, lambda x: claim_value(x)), lambda v: v["value"].isNotNull()), F.lit(0))), lambda k, v: v.isNotNull() & k.isin(*PROPERTIES))
    items = items.withColumn("values", F.coalesce(decoded, F.create_map().cast("map<string,struct<kind:string,value:string>>")))
    if types is not None:
        items = items.where(F.element_at("values", "P31")["value"].isin(*types))
    if limit is not None:
        items = items.orderBy("id").limit(limit)
    iri = F.concat(F.lit("wikidata:"), "id")
    pick = lambda c: F.transform_values(F.map_filter(c, lambda k, v: k.isin(*LANGUAGES)), lambda k, v: v["value"])
    entities = items.select(iri.alias("id"), F.col("labels")["en"]["value"].alias("canonical_name"), pick("labels").alias("labels"), F.col("descriptions")["en"]["value"].alias("description"), F.create_map(F.lit("wikidata"), "id").alias("external_ids"))
    said = items.select(iri.alias("subject_id"), F.explode("values").alias("property", "v")).withColumn("predicate", F.element_at(F.create_map(*[F.lit(x) for pair in PROPERTIES.items() for x in pair]), F.col("property")))
    relations = said.where("v.kind = 'entity'").select("subject_id", "predicate", F.concat(F.lit("wikidata:"), "v.value").alias("object_id"), F.lit(1.0).alias("confidence"))
    facts = said.where("v.kind <> 'entity'").select("subject_id", "predicate", F.col("v.kind").alias("kind"), F.col("v.value").alias("value"))
    return entities, relations, facts


def claim_value(claim: Column) -> Column:
    """kind and value of a claim: an entity's id, a string, a quantity without its plus sign, or ``lat,lon``; else null."""
    data = claim["mainsnak"]["datavalue"]
    kind, raw = data["type"], data["value"]
    inside = lambda path: F.get_json_object(raw, path)
    value = (
        F.when(kind == "wikibase-entityid", inside("$.id")).when(kind == "string", raw).when(kind == "quantity", F.regexp_replace(inside("$.amount"), r"^\+", ""))
        .when(kind == "globecoordinate", F.concat_ws(",", inside("$.latitude"), inside("$.longitude")))
    )
    return F.struct(F.when(kind == "wikibase-entityid", "entity").otherwise(kind).alias("kind"), value.alias("value"))


def mail_threads(messages: DataFrame) -> DataFrame:
    """A private document for each thread of messages (message_id, in_reply_to, ts, sender, subject, body)."""
    rooted = messages.join(sessions.thread_closure(messages.where("message_id is not null"), "message_id", "in_reply_to"), "message_id", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "message_id", F.sha2(F.concat_ws("|", "sender", "subject", "body"), 256)))
    line = F.concat(F.lit("**From:** "), F.coalesce("sender", F.lit("")), F.lit("\n**Date:** "), F.coalesce(F.col("ts").cast("string"), F.lit("")), F.lit("\n\n"), F.col("body"), F.lit("\n"))
    order = F.concat_ws("|", F.date_format("ts", "yyyyMMddHHmmss"), "message_id")
    texts = sessions.render(rooted.withColumn("_order", order), ["root"], "_order", line)
    first = rooted.groupBy("root").agg(F.min_by("subject", order).alias("subject"), F.min(order).alias("_first"))
    numbered = texts.join(first, "root").withColumn("_n", F.row_number().over(Window.orderBy("_first", "root")) - 1)
    return numbered.select(*document_columns(F.format_string("thread_%04d", "_n"), F.col("subject"), F.concat(F.lit("# "), "subject", F.lit("\n\n"), "text"), "Conversation", privacy=2))
