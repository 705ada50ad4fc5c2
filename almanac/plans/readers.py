"""Readers, stores and indexes: inputs are made of driver tables in the shared folder and read back.

The nations, of which there are 25, become files of each format; documents and vectors become stores and indexes.
"""

from __future__ import annotations

import io
import json
import sqlite3
import struct
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterable
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from almanac.functions import registry, text as T
from almanac.functions.geo import dms_to_degrees
from almanac.operators import enrich, fts, retrieval, storage
from almanac.plans import Catalogue
from almanac.plans.search import _PAGE_FIELDS, MUST_NOT_SQL, PHRASE_SQL, VECTOR, WORDS, _HITS_SQL, _ranked, _vector_sql, bm25_sql
from almanac.session import shared_folder, table
from almanac.sources import binary, files, more
from almanac.streaming import live

CATALOGUE = Catalogue()


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/inputs-{uuid.uuid4().hex}/{name}"


def _put(spark: SparkSession, path: str, content: str | bytes) -> str:
    """Write one small file where driver and executors see it."""
    with storage.created(spark, path) as out:
        out.write(content.encode() if isinstance(content, str) else content)
    return path


def _nations(spark: SparkSession, sf_dir: str) -> list[Row]:
    """A dimension table of a fixed size."""
    return sorted(table(spark, sf_dir, "nation").collect())


def _files(spark: SparkSession, sf_dir: str, name: str, suffix: str, content: Callable[[Row], str]) -> str:
    folder = _folder(spark, name)
    for n in _nations(spark, sf_dir):
        _put(spark, f"{folder}/nation_{n.n_nationkey}.{suffix}", content(n))
    return folder


@CATALOGUE.add("select 'nation_' || n_nationkey as external_id, n_name as title, '# ' || n_name || chr(10) || chr(10) || 'Nation ' || n_nationkey || '.' as text from nation")
def read_markdown_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _files(spark, sf_dir, "md", "md", lambda n: f"# {n.n_name}\n\nNation {n.n_nationkey}.")
    return files.text_dir(spark, folder).select("external_id", "title", "text")


@CATALOGUE.add("select 'nation_' || n_nationkey as external_id, 'nation_' || n_nationkey as title, 'Nation ' || n_name as text from nation where n_nationkey % 5 > 0")
def read_plaintext_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without text, here every fifth, are left out."""
    folder = _files(spark, sf_dir, "txt", "txt", lambda n: f"Nation {n.n_name}" if n.n_nationkey % 5 else " \n")
    return files.text_dir(spark, folder, "plaintext-dir").select("external_id", "title", "text")


@CATALOGUE.add("select 'nation_' || n_nationkey as external_id, n_name as title, '# ' || n_name || chr(10) || chr(10) || 'Nation **' || n_nationkey || '** of *region* ' || n_regionkey || '.' as text from nation")
def read_html_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = "<html><head><title>x</title><script>no()</script></head><body><h1>{}</h1><p>Nation <b>{}</b> of <i>region</i> {}.</p></body></html>"
    folder = _files(spark, sf_dir, "html", "html", lambda n: page.format(n.n_name, n.n_nationkey, n.n_regionkey))
    return files.text_dir(spark, folder, "html-dir").select("external_id", "title", F.btrim("text", F.lit(" \n")).alias("text"))


@CATALOGUE.add("""select 'book' as external_id, 'Nations' as title, cast(null as varchar) as parent_id, 0 as depth from (select 1) union all
    select 'chapter_' || lpad(cast(row_number() over (order by n_nationkey desc) - 1 as varchar), 3, '0'), n_name, 'book', 1 from nation where n_nationkey % 4 > 0""")
def read_epub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book whose spine goes through the nations backwards; every fourth chapter is empty."""
    nations, data = _nations(spark, sf_dir), io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        items = "".join(f'<item id="n{n.n_nationkey}" href="n{n.n_nationkey}.xhtml"/>' for n in nations)
        spine = "".join(f'<itemref idref="n{n.n_nationkey}"/>' for n in nations[::-1])
        z.writestr("OPS/book.opf", f'<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Nations</dc:title></metadata><manifest>{items}</manifest><spine>{spine}</spine></package>')
        for n in nations:
            z.writestr(f"OPS/n{n.n_nationkey}.xhtml", f"<h1>{n.n_name}</h1><p>said</p>" if n.n_nationkey % 4 else "<p> </p>")
    folder = _folder(spark, "books")
    _put(spark, f"{folder}/nations.epub", data.getvalue())
    return binary.epub(spark, folder).select("external_id", "title", "parent_id", "depth")


@CATALOGUE.add("select 'nation_' || n_nationkey as external_id, n_name as title, n_name || chr(10) || 'Region ' || n_regionkey as text from nation")
def read_pdf_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "pdf")
    for n in _nations(spark, sf_dir):
        stream = zlib.compress(f"BT ({n.n_name}) Tj (Region {n.n_regionkey}) Tj ET".encode())
        _put(spark, f"{folder}/nation_{n.n_nationkey}.pdf", b"%PDF-1.4\n1 0 obj <<>> stream\n" + stream + b"\nendstream endobj")
    return binary.pdf(spark, folder).select("external_id", "title", "text")


@CATALOGUE.add("""select 'Nations' as chat, n_nationkey as id, 'P' || n_regionkey as sender, case when n_nationkey % 2 = 0 then n_name else 'see ' || n_name || '!' end as text,
    case when n_nationkey % 3 = 0 then n_nationkey - 1 end as reply_to, n_nationkey % 7 = 0 as edited from nation where n_nationkey > 0""")
def read_chat_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain and rich texts; what isn't a message is left out."""

    def message(n: Row) -> dict:
        k = n.n_nationkey
        said = n.n_name if k % 2 == 0 else ["see ", {"type": "bold", "text": n.n_name}, "!"]
        return {"id": k, "type": "message" if k else "service", "date": "2024-01-01T10:00:00", "from": f"P{n.n_regionkey}", "text": said} | ({"reply_to_message_id": k - 1} if k % 3 == 0 else {}) | ({"edited": "x"} if k % 7 == 0 else {})

    path = _put(spark, f"{_folder(spark, 'chat')}/result.json", json.dumps({"name": "Nations", "messages": list(map(message, _nations(spark, sf_dir)))}))
    return files.chat_messages(spark, path).select("chat", F.col("id").cast("int").alias("id"), "sender", "text", F.col("reply_to").cast("int").alias("reply_to"), "edited")


@CATALOGUE.add("""select 'thread_' || lpad(cast(row_number() over (order by n_regionkey) - 1 as varchar), 4, '0') as external_id, 'Region ' || n_regionkey as title, count(*) as n_messages from nation group by n_regionkey""")
def read_mail_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thread for each region: its first nation writes, each next one answers the one before."""
    box, last = "", {}
    for n in _nations(spark, sf_dir):
        answers = f"In-Reply-To: <{last[n.n_regionkey]}@x>\n" if n.n_regionkey in last else ""
        re_ = "Re: " if answers else ""
        box += f"From a@x Mon Jan  1 00:00:00 2024\nMessage-ID: <{n.n_nationkey}@x>\n{answers}From: {n.n_name} <n{n.n_nationkey}@x>\nSubject: {re_}Region {n.n_regionkey}\nDate: Mon, 01 Jan 2024 {n.n_regionkey:02}:{n.n_nationkey:02}:00 +0000\n\nhello\n\n"
        last[n.n_regionkey] = n.n_nationkey
    path = _put(spark, f"{_folder(spark, 'mail')}/box.mbox", box)
    threads = files.mail_threads(binary.mbox(spark, path))
    return threads.select("external_id", "title", F.regexp_count("text", F.lit(r"\*\*From:\*\*")).cast("long").alias("n_messages"))


@CATALOGUE.add("select 'walk.gpx' as track, row_number() over (order by n_nationkey) - 1 as nth, n_nationkey + 0.5::double as lat, n_regionkey - 0.25::double as lon, 10.0 * n_nationkey::double as ele from nation")
def read_gpx(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = "".join(f'<trkpt lat="{n.n_nationkey + 0.5}" lon="{n.n_regionkey - 0.25}"><ele>{10 * n.n_nationkey}</ele><time>2024-01-01T10:{n.n_nationkey:02}:00Z</time></trkpt>' for n in _nations(spark, sf_dir))
    path = _put(spark, f"{_folder(spark, 'gpx')}/walk.gpx", f'<?xml version="1.0"?><gpx><trk><trkseg>{points}</trkseg></trk></gpx>')
    nth = F.expr("row_number() over (partition by track order by n)").cast("long") - 1
    return files.track_points(spark, path).select("track", nth.alias("nth"), "lat", "lon", "ele")


def _photo(n: Row) -> bytes:
    """A JPEG with a TIFF block: a camera and a place on the southern and western hemisphere."""
    heap_at = 8 + 2 * 2 + 12 * 6 + 4 * 2
    heap = n.n_name.encode() + b"\0"
    rational = lambda *v: b"".join(struct.pack("<II", x, 1) for x in v)
    lat_at = heap_at + len(heap)
    heap += rational(n.n_nationkey, 30, 0) + rational(n.n_regionkey, 15, 0)
    entry = lambda tag, kind, count, value: struct.pack("<HHI", tag, kind, count) + value
    main = [entry(0x0110, 2, len(n.n_name) + 1, struct.pack("<I", heap_at)), entry(0x8825, 4, 1, struct.pack("<I", 8 + 2 + 12 * 2 + 4))]
    gps = [entry(1, 2, 2, b"S\0\0\0"), entry(2, 5, 3, struct.pack("<I", lat_at)), entry(3, 2, 2, b"W\0\0\0"), entry(4, 5, 3, struct.pack("<I", lat_at + 24))]
    block = lambda entries: struct.pack("<H", len(entries)) + b"".join(entries) + struct.pack("<I", 0)
    return b"\xff\xd8\xff\xe1\0\0Exif\0\0" + b"II" + struct.pack("<HI", 42, 8) + block(main) + block(gps) + heap


@CATALOGUE.add("select 'nation_' || n_nationkey || '.jpg' as name, n_name as camera, -(n_nationkey + 0.5)::double as lat, -(n_regionkey + 0.25)::double as lon from nation")
def read_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "photos")
    for n in _nations(spark, sf_dir):
        _put(spark, f"{folder}/nation_{n.n_nationkey}.jpg", _photo(n))
    return binary.photos(spark, folder).select("name", "camera", "lat", "lon")


def _history(spark: SparkSession, sf_dir: str, form: str, ddl: str, clock: Callable[[int], int]) -> DataFrame:
    with tempfile.NamedTemporaryFile() as local:  # a database needs a file of its own to be written
        base = sqlite3.connect(local.name)
        base.execute(f"create table {ddl}")
        rows = [(f"http://{n.n_name.lower()}/", n.n_name, n.n_regionkey + 1, clock(n.n_nationkey)) for n in _nations(spark, sf_dir)]
        base.executemany(f"insert into {ddl.split('(')[0]} values (?, ?, ?, ?)", rows)
        base.commit()
        base.close()
        path = _put(spark, f"{_folder(spark, form)}/history", open(local.name, "rb").read())
    return binary.history(spark, path, form).select("external_id", "url", "title", F.col("visits").cast("int").alias("visits"), F.unix_timestamp("last_visit").alias("seconds"))


_HISTORY_SQL = """select 'url_' || lpad(cast(row_number() over (order by n_nationkey desc) - 1 as varchar), 6, '0') as external_id, 'http://' || lower(n_name) || '/' as url, n_name as title,
    n_regionkey + 1 as visits, 1700000000 + 60 * n_nationkey::bigint as seconds from nation"""


@CATALOGUE.add(_HISTORY_SQL)
def read_chrome_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir, "chrome-history", "urls(url, title, visit_count, last_visit_time)", lambda k: (1_700_000_000 + 60 * k + 11_644_473_600) * 1_000_000)


@CATALOGUE.add(_HISTORY_SQL)
def read_firefox_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir, "firefox-history", "moz_places(url, title, visit_count, last_visit_date)", lambda k: (1_700_000_000 + 60 * k) * 1_000_000)


@CATALOGUE.add("""select n_name as title, '# ' || n_name || chr(10) || chr(10) || '**' || n_name || '** is in region ' || n_regionkey || '.' || repeat(' word', 60) as text from nation where n_nationkey % 5 > 0""")
def read_mediawiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redirects, here every fifth page, are left out; templates go at any depth."""
    page = lambda n: f"'''{n.n_name}''' is in {{{{a|{{{{b|{{{{c|{{{{d|{{{{e}}}}}}}}}}}}}}}}}}}}[[Region {n.n_regionkey}|region {n.n_regionkey}]]." + " word" * 60 if n.n_nationkey % 5 else "#REDIRECT [[X]]"
    pages = "".join(f"<page><title>{escape(n.n_name)}</title><ns>0</ns><revision><text>{escape(page(n))}</text></revision></page>" for n in _nations(spark, sf_dir))
    path = _put(spark, f"{_folder(spark, 'wiki')}/dump.xml", f"<mediawiki>{pages}</mediawiki>")
    return files.mediawiki_documents(spark, path).select("title", "text")


@CATALOGUE.add("select 'wikidata:Q' || n_nationkey as subject_id, 'country' as predicate, 'wikidata:Q' || (1000 + n_regionkey) as object_id, n_name as name from nation")
def read_entity_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's entity beside its relation to a region."""
    claim = lambda n: {"P17": [{"mainsnak": {"datavalue": {"type": "wikibase-entityid", "value": {"id": f"Q{1000 + n.n_regionkey}"}}}}]}
    lines = [json.dumps({"id": f"Q{n.n_nationkey}", "type": "item", "labels": {"en": {"value": n.n_name}}, "descriptions": {}, "claims": claim(n)}) for n in _nations(spark, sf_dir)]
    path = _put(spark, f"{_folder(spark, 'dump')}/dump.json", "[\n" + ",\n".join(lines) + "\n]\n")
    entities, relations, _ = files.entity_dump(spark, path)
    return relations.join(entities.select(F.col("id").alias("subject_id"), F.col("canonical_name").alias("name")), "subject_id").select("subject_id", "predicate", "object_id", "name")


@CATALOGUE.add("select n_regionkey, count(*) as n, min(n_name) as first from nation group by n_regionkey")
def csv_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL over a delimited file."""
    rows = "".join(f"{n.n_nationkey},{n.n_name},{n.n_regionkey}\n" for n in _nations(spark, sf_dir))
    path = _put(spark, f"{_folder(spark, 'csv')}/nation.csv", "n_nationkey,n_name,n_regionkey\n" + rows)
    return files.query_delimited(spark, path, "select n_regionkey, count(*) as n, min(n_name) as first from {rows} group by n_regionkey")


@CATALOGUE.add("select 'n' || n_nationkey as external_id, n_name as title, 'about ' || n_name as text from nation where n_nationkey % 6 > 0")
def read_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = [json.dumps({"id": f"n{n.n_nationkey}", "title": n.n_name} | ({"text": f"about {n.n_name}"} if n.n_nationkey % 6 else {})) for n in _nations(spark, sf_dir)]
    path = _put(spark, f"{_folder(spark, 'jsonl')}/nations.jsonl", "\n".join(lines))
    return files.json_lines(spark, path).select("external_id", "title", "text")


@CATALOGUE.add("select '/c/en/' || n_name as subject_id, 'PartOf' as predicate, '/c/en/region_' || n_regionkey as object_id, n_regionkey + 0.5::double as confidence from nation")
def read_concept_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = "\n".join(f"/a/x\t/r/PartOf\t/c/en/{n.n_name}\t/c/en/region_{n.n_regionkey}\t" + json.dumps({"weight": n.n_regionkey + 0.5}) for n in _nations(spark, sf_dir))
    return more.concept_edges(spark, _put(spark, f"{_folder(spark, 'concepts')}/edges.tsv", rows))


_MESSAGES_SQL = "select '{}' as chat, 'P' || n_regionkey as sender, {} as text, 1704103200 + 60 * n_nationkey::bigint as seconds from nation"


def _messages(df: DataFrame) -> DataFrame:
    return df.select("chat", "sender", "text", F.unix_timestamp("ts").alias("seconds"))


@CATALOGUE.add(_MESSAGES_SQL.format("trip", "n_name || ': yes' || chr(10) || 'more'"))
def read_whatsapp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of two lines and with a colon; a notice without a sender is left out."""
    said = "\n".join(f"1/1/24, 10:{n.n_nationkey:02} - P{n.n_regionkey}: {n.n_name}: yes\nmore" for n in _nations(spark, sf_dir))
    return _messages(more.whatsapp_messages(spark, _put(spark, f"{_folder(spark, 'whatsapp')}/trip.txt", "1/1/24, 09:00 - Messages are encrypted\n" + said)))


@CATALOGUE.add(_MESSAGES_SQL.format("general", "n_name"))
def read_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "slack")
    rows = [{"type": "message", "ts": f"{1704103200 + 60 * n.n_nationkey}.000100", "user": f"P{n.n_regionkey}", "text": n.n_name} for n in _nations(spark, sf_dir)]
    for day, part in (("2024-01-01", rows[:12]), ("2024-01-02", [*rows[12:], {"type": "join", "ts": "1", "user": "x"}])):
        _put(spark, f"{folder}/general/{day}.json", json.dumps(part))
    return _messages(more.slack_messages(spark, folder))


@CATALOGUE.add(_MESSAGES_SQL.format("den", "n_name"))
def read_discord(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [{"timestamp": f"2024-01-01T10:{n.n_nationkey:02}:00+00:00", "author": {"name": f"P{n.n_regionkey}"}, "content": n.n_name} for n in _nations(spark, sf_dir)]
    return _messages(more.discord_messages(spark, _put(spark, f"{_folder(spark, 'discord')}/den.json", json.dumps({"channel": {"name": "den"}, "messages": rows}))))


@CATALOGUE.add("""select 'n' || n_nationkey as external_id, n_name || ', day' as title, '# ' || n_name || ', day' || chr(10) || chr(10) || 'From: 20240101T100000Z' || chr(10) || 'Where: Region ' || n_regionkey || chr(10) || 'About: long and folded' as text from nation""")
def read_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = "BEGIN:VEVENT\r\nUID:n{}\r\nSUMMARY:{}\\, day\r\nDTSTART:20240101T100000Z\r\nLOCATION;LANGUAGE=en:Region {}\r\nDESCRIPTION:long and \r\n folded\r\nEND:VEVENT\r\n"
    said = "".join(event.format(n.n_nationkey, n.n_name, n.n_regionkey) for n in _nations(spark, sf_dir))
    path = _put(spark, f"{_folder(spark, 'calendar')}/c.ics", f"BEGIN:VCALENDAR\r\n{said}END:VCALENDAR\r\n")
    return more.calendar_events(spark, path).select("external_id", "title", "text")


@CATALOGUE.add("select 1704103200 + 60 * n_nationkey::bigint as seconds, n_nationkey + 0.25::double as lat, -(n_regionkey + 0.5)::double as lon from nation")
def read_location_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both clocks that exports have had; a point without a place is left out."""
    place = lambda n: {"latitudeE7": n.n_nationkey * 10**7 + 2_500_000, "longitudeE7": -(n.n_regionkey * 10**7 + 5_000_000)}
    clock = lambda k: {"timestamp": f"2024-01-01T10:{k:02}:00Z"} if k % 2 else {"timestampMs": str((1704103200 + 60 * k) * 1000)}
    rows = [place(n) | clock(n.n_nationkey) for n in _nations(spark, sf_dir)] + [{"timestamp": "2024-01-01T10:00:00Z"}]
    path = _put(spark, f"{_folder(spark, 'places')}/records.json", json.dumps({"locations": rows}))
    return more.location_history(spark, path).select(F.unix_timestamp("ts").alias("seconds"), "lat", "lon")


@CATALOGUE.add("select 'n:' || n_nationkey as subject_id, 'in' as predicate, 'r:' || n_regionkey as object_id, 'relation' as kind from nation union all select 'n:' || n_nationkey, 'name', n_name, 'fact' from nation union all select 'n:' || n_nationkey, 'name', 'N' || n_nationkey, 'fact' from nation")
def read_linked_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = lambda n: {"@id": f"n:{n.n_nationkey}", "@type": "Nation", "in": {"@id": f"r:{n.n_regionkey}"}, "name": [n.n_name, {"@value": f"N{n.n_nationkey}"}]}
    nations = list(map(node, _nations(spark, sf_dir)))
    path = _put(spark, f"{_folder(spark, 'linked')}/n.jsonld", json.dumps({"@graph": nations[:10]}) + "\n" + "\n".join(map(json.dumps, nations[10:])))
    relations, facts = more.linked_data(spark, path)
    return relations.withColumn("kind", F.lit("relation")).unionByName(facts.withColumnRenamed("value", "object_id").withColumn("kind", F.lit("fact")))


@CATALOGUE.add("select 'nation_' || lpad(cast(row_number() over (order by n_nationkey) - 1 as varchar), 6, '0') as external_id, 'n_nationkey: ' || n_nationkey || chr(10) || 'n_name: ' || n_name as text from nation")
def read_sqlite(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = sqlite3.connect(":memory:")
    base.execute("create table nation(n_nationkey, n_name, n_void)")
    base.executemany("insert into nation values (?, ?, null)", [(n.n_nationkey, n.n_name) for n in _nations(spark, sf_dir)])
    base.commit()
    folder = _folder(spark, "sqlite")
    _put(spark, f"{folder}/n.db", base.serialize())
    return more.sqlite_documents(spark, folder).select("external_id", "text")


@CATALOGUE.add("select 'nation_' || n_nationkey || '.epub' as name from nation where n_nationkey % 3 = 0")
def unreadable_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files of a folder the reader left out."""
    folder, data = _folder(spark, "bad"), io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("b.opf", "<package><metadata/><manifest/><spine/></package>")
    for n in _nations(spark, sf_dir):
        _put(spark, f"{folder}/nation_{n.n_nationkey}.epub", data.getvalue() if n.n_nationkey % 3 else b"no archive")
    return binary.unreadable(spark, folder, "epub").select("name")


# Stores


def _content(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("source").alias("source_name"), F.concat(F.lit("d"), "doc_id", F.lit(".md")).alias("filename"), "text", F.lit(0).cast("tinyint").alias("privacy_level"))


@CATALOGUE.add("select 'd' || doc_id || '.md' as filename, sha256(text) as hash from documents where source = 'src1'")
def content_store_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "content")
    storage.write_content(_content(spark, sf_dir), folder)
    return storage.list_files(spark, folder, "src1").select("filename", F.sha2("text", 256).alias("hash"))


@CATALOGUE.add("select source as source_name, 'd' || doc_id || '.md' as filename, sha256(text) as hash from documents")
def archive_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive of all documents, written and read again."""
    path = f"{_folder(spark, 'archive')}/all.tar.zst"
    storage.export_archive(_content(spark, sf_dir), path)
    return storage.import_archive(spark, path).select("source_name", "filename", F.sha2("text", 256).alias("hash"))


# Indexes


def _indexed(spark: SparkSession, sf_dir: str, query: fts.Query | str, limit: int | None, where: Column | None = None) -> DataFrame:
    folder = _folder(spark, "fts")
    fts.build_index(table(spark, sf_dir, "documents"), folder, keep=("source",))
    return _ranked(fts.search_index(spark, folder, query, limit, where=where))


@CATALOGUE.add(bm25_sql("select * from documents", WORDS))
def fts_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(spark, sf_dir, fts.words_query(WORDS), 10)


@CATALOGUE.add(bm25_sql("select * from documents", WORDS, eligible="source = 'src1'", limit=20))
def fts_index_source_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(spark, sf_dir, fts.words_query(WORDS), 20, F.col("source") == "src1")


@CATALOGUE.add(PHRASE_SQL)
def fts_index_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(spark, sf_dir, '"of the"', None)


@CATALOGUE.add(MUST_NOT_SQL)
def fts_index_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(spark, sf_dir, "the +aian -of", None)


@CATALOGUE.add(bm25_sql(_PAGE_FIELDS, "the aian onion", ("title", "body"), "page_id"))
def fts_index_two_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "fts")
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), T.strip_tags(F.col("html")).alias("body"))
    fts.build_index(pages, folder, ("title", "body"), "page_id")
    return _ranked(fts.search_index(spark, folder, fts.words_query("the aian onion"), 10, ("title", "body"), "page_id"))


@CATALOGUE.add(_vector_sql())
def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "vectors")
    table(spark, sf_dir, "embeddings").write.parquet(folder)
    return _ranked(retrieval.vector_search(spark.read.parquet(folder), VECTOR, 10))


@CATALOGUE.add(_HITS_SQL)
def substring_index_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by written trigrams, verified on their texts."""
    folder, docs = _folder(spark, "trigrams"), table(spark, sf_dir, "documents")
    retrieval.trigrams(docs).repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(folder)
    candidates = retrieval.trigram_candidates(spark.read.parquet(folder), "the th")
    return retrieval.substring_hits(docs.join(candidates, "doc_id", "left_semi"), "the th", None)


# Functions


@CATALOGUE.add("""select n_nationkey, n_name as target, 2 as n from nation union all select n_nationkey, 'b ' || n_regionkey, 1 from nation""")
def wikilink_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.format_string("[[%s|x]] and [[%s#part]], [[:%s]], [[File:a.png|[[in]] side]], [[b %d]] [[ ]] [[open", "n_name", "n_name", "n_name", "n_regionkey")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(registry.wikilink_counts(said)).alias("target", "n"))
    return rows


@CATALOGUE.add("""select n_nationkey, 'a' || n_name || '|b' as targets, replace(replace(n_name || '/x:y', '/', '_'), ':', '_') as file_name,
    -(n_nationkey + 0.5 + n_regionkey / 3600.0::double) as degrees from nation""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link targets, file names and degrees."""
    said = F.format_string("[[a%s|t]] [[b#c]] [[Category:d]] [[:e]]", "n_name")
    number = lambda c: F.col(c).cast("double")
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(T.wikilinks(said), "|").alias("targets"), T.safe_file_name(F.concat("n_name", F.lit("/x:y"))).alias("file_name"), dms_to_degrees(number("n_nationkey"), F.lit(30.0), number("n_regionkey"), F.lit("S")).alias("degrees"))


# Streams and steps


@CATALOGUE.add("select 'nation_' || n_nationkey || '.md' as name, n_name as text from nation")
def watch_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a watched folder, taken in batches of ten."""
    folder, taken = _files(spark, sf_dir, "watched", "md", lambda n: n.n_name), _folder(spark, "taken")
    live.watch_files(spark, folder, lambda df, _: df.select("name", "text").write.mode("append").parquet(taken), max_files=10, once=True).awaitTermination()
    return spark.read.parquet(taken)


@CATALOGUE.add("select doc_id, substr(text, 1, 20) as head from documents where length(text) > 500")
def pipeline_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps in order; one that is off and one that fails and may be skipped change nothing."""

    def fails(df: DataFrame) -> DataFrame:
        raise ValueError("no")

    steps: Iterable[enrich.Step] = [
        enrich.Step("long", lambda df: df.where(F.length("text") > 500)), enrich.Step("off", lambda df: df.limit(0), enabled=False),
        enrich.Step("broken", fails, fallback="skip"), enrich.Step("head", lambda df: df.select("doc_id", F.substring("text", 1, 20).alias("head"))),
    ]
    return enrich.run_steps(table(spark, sf_dir, "documents").select("doc_id", "text"), list(steps))[0]


@CATALOGUE.add("select doc_id, text || chr(10) || chr(10) || '## Summary' || chr(10) || chr(10) || 'In short: ' || length(text) as text from documents where doc_id < 40")
def enrich_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a model, here one that counts, added to the first documents."""
    docs = table(spark, sf_dir, "documents").where("doc_id < 40").select("doc_id", "text")
    answers = enrich.enrich(docs.withColumn("text", F.length("text").cast("string")), "summarize", _Counts())
    return docs.join(answers, "doc_id").select("doc_id", F.concat("text", F.lit(f"\n\n## {enrich.SECTIONS['summarize']}\n\n"), "answer").alias("text"))


class _Counts:
    def complete(self, prompt: str) -> str:
        return f"In short: {prompt.rsplit(chr(10), 1)[-1]}"
