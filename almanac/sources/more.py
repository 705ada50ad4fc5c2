"""Exports of chats, calendars, places and graphs that are lines or JSON, read by Spark itself."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.sources import DOCUMENT, binary
from almanac.sources.files import document_columns

#: What the messages of all chat exports become.
MESSAGE = ("chat", "ts", "sender", "text")


def concept_edges(spark: SparkSession, path: str) -> DataFrame:
    """subject_id, predicate, object_id and confidence of a ConceptNet table (uri, relation, start, end, JSON with a weight)."""
    rows = spark.read.csv(path, sep="\t", quote="", schema="uri string, rel string, start string, end string, info string")
    named = rows.where("rel is not null and start is not null and end is not null")
    return named.select(F.col("start").alias("subject_id"), F.regexp_replace("rel", "^/r/", "").alias("predicate"), F.col("end").alias("object_id"), F.get_json_object("info", "$.weight").cast("double").alias("confidence"))


_SAID = r"^\x{200e}?\[?(\d{1,2}[./]\d{1,2}[./]\d{2,4}),? (\d{1,2}:\d{2}(?::\d{2})?)\]?(?: -)? ([^:]+): (?s:(.*))$"


def whatsapp_messages(spark: SparkSession, path: str, day_format: str = "d/M/yy") -> DataFrame:
    """MESSAGE of text exports: ``31/12/23, 10:00 - Ann: text`` or with the time in brackets; other lines go on with the text before."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("chat"), "value")
    begins = F.regexp_replace("value", r"(?m)^(?=\x{200e}?\[?\d{1,2}[./]\d{1,2}[./]\d{2,4},? \d{1,2}:\d{2})", "\0")
    lines = whole.select("chat", F.explode(F.split(begins, "\0")).alias("line")).where(F.col("line").rlike(_SAID))
    part = lambda n: F.regexp_extract("line", _SAID, n)
    ts = F.coalesce(*(F.try_to_timestamp(F.concat_ws(" ", F.replace(part(1), F.lit("."), F.lit("/")), part(2)), F.lit(f"{day} {clock}")) for day in (day_format, day_format.replace("yy", "yyyy")) for clock in ("H:mm", "H:mm:ss")))
    return lines.select("chat", ts.alias("ts"), F.btrim(part(3)).alias("sender"), F.btrim(part(4), F.lit(" \r\n")).alias("text"))


def slack_messages(spark: SparkSession, path: str) -> DataFrame:
    """MESSAGE of a workspace's export: a folder for each channel, in it a JSON list of messages for each day."""
    rows = spark.read.schema("type string, ts string, user string, text string").option("recursiveFileLookup", True).json(path, multiLine=True)
    channel = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return rows.where("type = 'message'").select(F.url_decode(channel).alias("chat"), F.timestamp_millis((F.col("ts").cast("double") * 1000).cast("long")).alias("ts"), F.col("user").alias("sender"), F.coalesce("text", F.lit("")).alias("text"))


def discord_messages(spark: SparkSession, path: str) -> DataFrame:
    """MESSAGE of channel exports: one JSON object a file with a channel and its messages."""
    form = "channel struct<name:string>, messages array<struct<timestamp:string,author:struct<name:string>,content:string>>"
    rows = spark.read.schema(form).json(path, multiLine=True).select(F.col("channel.name").alias("chat"), F.explode("messages").alias("m"))
    return rows.select("chat", F.try_to_timestamp("m.timestamp").alias("ts"), F.col("m.author.name").alias("sender"), F.coalesce("m.content", F.lit("")).alias("text"))


def calendar_events(spark: SparkSession, path: str) -> DataFrame:
    """Documents of an iCalendar file's events: what, when, where and the description, folded lines joined."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "\r?\n[ \t]", "").alias("value"))
    events = whole.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)BEGIN:VEVENT\r?\n(.*?)END:VEVENT"), F.lit(1))).alias("event"))
    said = lambda name: F.regexp_extract("event", rf"(?m)^{name}(?:;[^:\n]*)?:(.*?)\r?$", 1)
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, r"\\[nN]", "\n"), r"\\([,;\\])", "$1")
    line = lambda label, name: F.when(said(name) != "", F.concat(F.lit(f"\n{label}: "), plain(said(name)))).otherwise("")
    text = F.concat(F.lit("# "), plain(said("SUMMARY")), F.lit("\n"), line("From", "DTSTART"), line("To", "DTEND"), line("Where", "LOCATION"), line("About", "DESCRIPTION"))
    key = F.when(said("UID") != "", said("UID")).otherwise(F.sha2("event", 256))
    return events.select(*document_columns(key, plain(said("SUMMARY")), text, "Record", privacy=2))


def location_history(spark: SparkSession, path: str) -> DataFrame:
    """ts, lat, lon and accuracy of a location export's points."""
    form = "locations array<struct<timestamp:string,timestampMs:string,latitudeE7:bigint,longitudeE7:bigint,accuracy:int>>"
    rows = spark.read.schema(form).json(path, multiLine=True).select(F.explode("locations").alias("p"))
    ts = F.coalesce(F.try_to_timestamp("p.timestamp"), F.timestamp_millis(F.col("p.timestampMs").cast("long")))
    degrees = lambda c: F.col(c) / 1e7
    return rows.select(ts.alias("ts"), degrees("p.latitudeE7").alias("lat"), degrees("p.longitudeE7").alias("lon"), F.col("p.accuracy").alias("accuracy")).where("lat is not null and lon is not null")


def linked_data(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """relations (subject_id, predicate, object_id) and facts (subject_id, predicate, value) of JSON-LD, an object a line
    with or without ``@graph``, whose values are taken as they stand.
    """
    rows = spark.read.text(path)
    nodes = rows.select(F.explode(F.coalesce(F.from_json(F.get_json_object("value", "$['@graph']"), "array<string>"), F.array("value"))).alias("node"))
    pairs = nodes.select(F.get_json_object("node", "$['@id']").alias("subject_id"), F.explode(F.from_json("node", "map<string,string>")).alias("predicate", "raw")).where("subject_id is not null and predicate not like '@%'")
    each = pairs.select("subject_id", "predicate", F.explode(F.when(F.col("raw").startswith("["), F.from_json("raw", "array<string>")).otherwise(F.array("raw"))).alias("value"))
    target = F.get_json_object("value", "$['@id']")
    literal = F.coalesce(F.get_json_object("value", "$['@value']"), "value")
    relations = each.where(target.isNotNull()).select("subject_id", "predicate", target.alias("object_id"))
    return relations, each.where(target.isNull()).select("subject_id", "predicate", literal.alias("value"))


def sqlite_documents(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """A document for each row of each table of SQLite files: its columns and values."""

    def rows(name: str, content: bytes) -> Iterator[dict]:
        base = sqlite3.connect(":memory:")
        base.deserialize(content)
        for (table,) in base.execute("select name from sqlite_master where type = 'table' and name not like 'sqlite_%' order by name").fetchall():
            found = base.execute(f'select * from "{table.replace(chr(34), chr(34) * 2)}"')
            names = [c[0] for c in found.description]
            for n, row in enumerate(found):
                text = "\n".join(f"{k}: {v}" for k, v in zip(names, row) if v is not None)
                yield dict(zip([c.split()[0] for c in DOCUMENT.split(", ")], (f"{table}_{n:06d}", f"{table} {n}", text, "Record", None, 0, 0)))

    return binary.parsed(spark, path, pattern, rows, DOCUMENT)
