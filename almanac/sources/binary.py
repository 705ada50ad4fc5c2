"""Binary formats, parsed on the executors from ``binaryFile`` rows: books, mail boxes, photographs, papers, histories.

A file that can't be read yields no row, and everything else goes on; ``unreadable`` says which those are and why.
"""

from __future__ import annotations

import email
import email.policy
import io
import posixpath
import re
import sqlite3
import struct
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterable, Iterator
from email.utils import parsedate_to_datetime
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.functions.geo import dms_to_degrees, unix_time, webkit_time
from almanac.functions.text import clean_extracted, extracted_title
from almanac.sources import DOCUMENT
from almanac.sources.html import to_markdown

_DOCUMENT_COLUMNS = [c.split()[0] for c in DOCUMENT.split(", ")]


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.col("_metadata.file_name").alias("name"), "content")


def _each(files: DataFrame, parse: Callable[[str, bytes], Iterable[dict]], schema: str) -> DataFrame:
    """Rows that ``parse`` finds in each file; files that it can't read are left out."""
    columns = [c.split()[0] for c in re.sub(r"<[^>]*>", "", schema).split(", ")]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"]):
                try:
                    rows = list(parse(name, content))
                except Exception:
                    rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    return files.mapInPandas(run, schema)


def parsed(spark: SparkSession, path: str, pattern: str, parse: Callable[[str, bytes], Iterable[dict]], schema: str) -> DataFrame:
    """Rows that ``parse`` finds in the files of that pattern."""
    return _each(_files(spark, path, pattern), parse, schema)


def unreadable(spark: SparkSession, path: str, form: str) -> DataFrame:
    """name and error of the files of a folder that the format's reader leaves out."""
    pattern, parse = PARSERS[form]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bad = []
            for name, content in zip(batch["name"], batch["content"]):
                try:
                    for _ in parse(name, content):
                        pass
                except Exception as error:  # whatever it is, it is what is asked for
                    bad.append((name, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(bad, columns=["name", "error"])

    return _files(spark, path, pattern).mapInPandas(run, "name string, error string")


# Books


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def book_rows(name: str, content: bytes) -> Iterator[dict]:
    """The book (no text) and its chapters in the order of its spine, without empty ones."""
    stem = name.rsplit(".", 1)[0]
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        order, title = [], stem
        opf = next((n for n in names if n.endswith(".opf")), None)
        if opf:
            root = ET.fromstring(z.read(opf))
            title = next((e.text for e in root.iter() if _local(e.tag) == "title" and e.text), stem)
            manifest = {e.get("id"): e.get("href", "") for e in root.iter() if _local(e.tag) == "item"}
            by_base = {posixpath.basename(n): n for n in names}
            for ref in (e.get("idref") for e in root.iter() if _local(e.tag) == "itemref"):
                href = unquote(manifest.get(ref, ""))
                full = posixpath.normpath(posixpath.join(posixpath.dirname(opf), href))
                found = full if full in names else by_base.get(posixpath.basename(href))
                if href and found:
                    order.append(found)
        order = order or sorted(n for n in names if n.lower().endswith((".xhtml", ".html", ".htm")))
        yield dict(zip(_DOCUMENT_COLUMNS, ("book", title, None, "Book", None, 0, 1)))
        n = 0
        for part in order:
            text = to_markdown(z.read(part).decode("utf-8", "replace"))
            if text:
                heading = re.search(r"(?m)^# (.+)$", text)
                yield dict(zip(_DOCUMENT_COLUMNS, (f"chapter_{n:03d}", heading[1].strip() if heading else f"Chapter {n + 1}", text, "Chapter", "book", 1, 1)))
                n += 1


def epub(spark: SparkSession, path: str) -> DataFrame:
    return _each(_files(spark, path, "*.epub"), book_rows, DOCUMENT)


# Papers


def pdf(spark: SparkSession, path: str, extract: Callable[[bytes], str] | None = None) -> DataFrame:
    """Papers through ``extract`` (file content to text), which defaults to the text operators of simple files."""
    read = extract or simple_pdf_text
    texts = _each(_files(spark, path, "*.pdf"), lambda name, content: [{"name": name, "raw": read(content)}], "name string, raw string").where("raw <> ''")
    stem = F.regexp_replace("name", r"\.pdf$", "")
    cleaned = texts.select(stem.alias("external_id"), clean_extracted(F.col("raw")).alias("text"))
    return cleaned.select("external_id", extracted_title(F.col("text"), F.col("external_id")).alias("title"), "text", F.lit("Paper").alias("content_type"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("depth"), F.lit(1).alias("privacy_level"))


def simple_pdf_text(content: bytes) -> str:
    """Text that stands in literal strings of a file's content streams, deflated or not; one line for each Tj or TJ."""
    import zlib

    lines = []
    for stream in re.findall(rb"stream\r?\n(.*?)\r?\nendstream", content, re.S):
        try:
            stream = zlib.decompress(stream)
        except zlib.error:
            pass
        for run in re.findall(rb"(\[(?:[^\]\\]|\\.)*\]|\((?:[^()\\]|\\.)*\))\s*T[jJ]", stream, re.S):
            parts = re.findall(rb"\(((?:[^()\\]|\\.)*)\)", run, re.S)
            lines.append(re.sub(rb"\\([()\\])", rb"\1", b"".join(parts)).decode("latin-1"))
    return "\n".join(lines)


# Mail

MAIL = "message_id string, in_reply_to string, sender string, recipient string, subject string, date string, body string"


def split_mbox(content: bytes) -> list[bytes]:
    """Messages of a mail box: they begin at ``From `` lines at its start or after a blank line."""
    starts = [m.end() for m in re.finditer(rb"(?:\A|\r?\n\r?\n|\A\r?\n)(?=From )", content)]
    return [content[a:b] for a, b in zip(starts, [*starts[1:], len(content)])]


def mail_rows(name: str, content: bytes) -> Iterator[dict]:
    for raw in split_mbox(content):
        message = email.message_from_bytes(raw.split(b"\n", 1)[-1], policy=email.policy.default)
        part = message.get_body(preferencelist=("plain", "html"))
        body = (part.get_content() if part else "").strip()
        if part is not None and part.get_content_subtype() == "html":
            body = to_markdown(body) or ""
        subject = str(message["subject"] or "(no subject)")
        if not body and subject == "(no subject)":
            continue
        try:
            date = parsedate_to_datetime(str(message["date"])).strftime("%Y-%m-%dT%H:%M:%S%z")
        except (TypeError, ValueError):
            date = None
        strip = lambda h: str(h).strip().strip("<>") if h else None
        yield dict(message_id=strip(message["message-id"]), in_reply_to=strip(message["in-reply-to"]), sender=str(message["from"] or ""), recipient=str(message["to"] or ""), subject=subject, date=date, body=body)


def mbox(spark: SparkSession, path: str) -> DataFrame:
    """message_id, in_reply_to, sender, recipient, subject, ts and body of every message."""
    rows = _each(_files(spark, path, "*.mbox"), mail_rows, MAIL)
    return rows.withColumn("ts", F.try_to_timestamp("date", F.lit("yyyy-MM-dd'T'HH:mm:ssZ"))).drop("date")


# Photographs

_EXIF = {0x010F: "make", 0x0110: "model", 0x9003: "taken", 0x0132: "modified", 0x829A: "exposure", 0x829D: "f_number", 0x8827: "iso", 0xA002: "width", 0xA003: "height", 0x0100: "width", 0x0101: "height"}
_GPS = {1: "lat_ref", 2: "lat", 3: "lon_ref", 4: "lon"}
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
PHOTO = "name string, make string, model string, taken string, width double, height double, exposure double, f_number double, iso double, lat_ref string, lat array<double>, lon_ref string, lon array<double>"


def exif_tags(content: bytes) -> dict:
    """Tags of a TIFF file, or of the TIFF block in a JPEG."""
    if content[:2] == b"\xff\xd8":
        at = content.find(b"Exif\0\0")
        if at < 0:
            return {}
        content = content[at + 6 :]
    order = {b"II": "<", b"MM": ">"}[content[:2]]
    found: dict = {}

    def value(kind: int, count: int, field: bytes) -> object:
        size = _SIZES.get(kind, 1) * count
        data = field[:size] if size <= 4 else content[(p := struct.unpack(order + "I", field)[0]) : p + size]
        if kind == 2:
            return data.split(b"\0")[0].decode("utf-8", "replace").strip()
        if kind in (5, 10):
            pairs = struct.unpack(order + ("II" if kind == 5 else "ii") * count, data)
            out = [n / d if d else 0.0 for n, d in zip(pairs[::2], pairs[1::2])]
        else:
            out = [float(x) for x in struct.unpack(order + {1: "B", 3: "H", 4: "I", 7: "B", 9: "i"}[kind] * count, data)]
        return out if count > 1 else out[0]

    def directory(at: int, names: dict[int, str]) -> None:
        for i in range(struct.unpack_from(order + "H", content, at)[0]):
            tag, kind, count = struct.unpack_from(order + "HHI", content, at + 2 + 12 * i)
            field = content[at + 10 + 12 * i : at + 14 + 12 * i]
            if tag in (0x8769, 0x8825) and names is _EXIF:
                directory(struct.unpack(order + "I", field)[0], _GPS if tag == 0x8825 else _EXIF)
            elif tag in names and kind in _SIZES:
                found.setdefault(names[tag], value(kind, count, field))

    directory(struct.unpack_from(order + "I", content, 4)[0], _EXIF)
    return found


def photo_rows(name: str, content: bytes) -> Iterator[dict]:
    tags = exif_tags(content)
    if tags:
        tags["taken"] = tags.get("taken") or tags.get("modified")
        yield {"name": name, **{k: tags.get(k) for k in ("make", "model", "taken", "width", "height", "exposure", "f_number", "iso", "lat_ref", "lat", "lon_ref", "lon")}}


def photos(spark: SparkSession, path: str) -> DataFrame:
    """name, camera, taken, size, exposure, f_number, iso, lat and lon of JPEG and TIFF files that say something."""
    rows = _each(_files(spark, path, "*.{jpg,jpeg,tif,tiff,JPG,JPEG,TIF,TIFF}"), photo_rows, PHOTO)
    degrees = lambda c, ref: dms_to_degrees(F.get(c, F.lit(0)), F.coalesce(F.get(c, F.lit(1)), F.lit(0.0)), F.coalesce(F.get(c, F.lit(2)), F.lit(0.0)), F.col(ref))
    return rows.select("name", F.trim(F.concat_ws(" ", "make", "model")).alias("camera"), F.try_to_timestamp("taken", F.lit("yyyy:MM:dd HH:mm:ss")).alias("taken"), "width", "height", "exposure", "f_number", "iso", degrees("lat", "lat_ref").alias("lat"), degrees("lon", "lon_ref").alias("lon"))


def photo_documents(spark: SparkSession, path: str) -> DataFrame:
    line = lambda label, c, form="%s": F.coalesce(F.format_string(f"{label}: {form}\n", c), F.lit(""))
    known = lambda c: F.when(F.col(c).isNotNull(), F.col(c))
    said = F.concat(*(F.when(F.col(c).isNull(), "").otherwise(line(label, known(c), form)) for label, c, form in (("Camera", "camera", "%s"), ("Exposure", "exposure", "%.5f s"), ("Aperture", "f_number", "f/%.1f"), ("ISO", "iso", "%.0f"), ("Latitude", "lat", "%.6f"), ("Longitude", "lon", "%.6f"))))
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    return photos(spark, path).select(stem.alias("external_id"), stem.alias("title"), said.alias("text"), F.lit("MediaMeta").alias("content_type"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("depth"), F.lit(2).alias("privacy_level"))


# Browser histories

#: form: query of url, title, visits, time. Fixed values.
HISTORIES = {
    "chrome-history": "SELECT url, title, visit_count, last_visit_time FROM urls",
    "firefox-history": "SELECT url, title, visit_count, last_visit_date FROM moz_places WHERE visit_count > 0",
}


def history_rows(query: str) -> Callable[[str, bytes], Iterator[dict]]:
    def rows(name: str, content: bytes) -> Iterator[dict]:
        base = sqlite3.connect(":memory:")
        try:
            base.deserialize(content[:18] + b"\x01\x01" + content[20:])  # as if without a write-ahead log, which memory has none of
            for url, title, visits, at in base.execute(query):
                yield {"url": url, "title": title, "visits": visits, "at": at}
        finally:
            base.close()

    return rows


def history(spark: SparkSession, path: str, form: str) -> DataFrame:
    """external_id (url_000000 for the last visit, and so on), url, title, visits and last_visit."""
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("name"), "content")
    rows = _each(files, history_rows(HISTORIES[form]), "url string, title string, visits long, at long")
    clock = webkit_time if form == "chrome-history" else unix_time
    number = F.expr("row_number() over (order by at desc nulls last, url) - 1")
    return rows.select(F.format_string("url_%06d", number).alias("external_id"), "url", "title", "visits", clock(F.col("at")).alias("last_visit"))


#: Which files a format has, and what reads one.
PARSERS: dict[str, tuple[str, Callable[[str, bytes], Iterable[dict]]]] = {"epub": ("*.epub", book_rows), "mbox": ("*.mbox", mail_rows), "exif-dir": ("*.{jpg,jpeg,JPG,JPEG,tif,tiff,TIF,TIFF}", photo_rows), "pdf-dir": ("*.pdf", lambda name, content: [{"raw": simple_pdf_text(content)}])}
