import gzip
import io
import json
import sqlite3
import struct
import zipfile
import zlib

import pytest
import zstandard

from almanac.sources import binary, files, zim
from almanac.sources.html import to_markdown


def write(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def test_text_folders(spark, tmp_path):
    write(tmp_path / "Paris.md", "# The City\ntext")
    write(tmp_path / "empty.md", "  \n")
    write(tmp_path / "note.txt", "plain")
    write(tmp_path / "page.html", "<h1>Title</h1><p>Hello <b>world</b></p><script>x</script>")
    write(tmp_path / "sub/deep.md", "not read")
    rows = files.text_dir(spark, str(tmp_path)).collect()
    assert [(r.external_id, r.title) for r in rows] == [("Paris", "The City")]
    assert files.text_dir(spark, str(tmp_path), "plaintext-dir").first().title == "note"
    page = files.text_dir(spark, str(tmp_path), "html-dir").first()
    assert page.title == "Title" and "**world**" in page.text and "x" not in page.text


def test_markdown_of_html():
    html = "<ul><li>a<ul><li>b</li></ul></li></ul><ol><li>one</li><li>two</li></ol><pre>x  y\n z</pre><a href='/u'>l</a><br>&amp;<img alt='i' src='s'>"
    text = to_markdown(html)
    for part in ("- a", "- b", "1. one", "2. two", "```\nx  y\n z\n```", "[l](/u)", "&", "![i](s)"):
        assert part in text, part
    assert to_markdown(None) is None and to_markdown("") == ""


def test_chat_export(spark, tmp_path):
    message = lambda i, date, who, text, **more: {"id": i, "type": "message", "date": date, "from": who, "text": text, **more}
    export = {"name": "Trip", "type": "personal_chat", "id": 7, "messages": [
        message(1, "2024-01-01T10:00:00", "Alice", "hello"), message(2, "2024-01-01T11:00:00", "Bob", ["see ", {"type": "link", "text": "this"}, "!"], reply_to_message_id=1),
        {"id": 3, "type": "service", "date": "2024-01-01T11:01:00"}, message(4, "2024-02-01T11:30:00", "Alice", "later", edited="2024-02-01T12:00:00"),
    ]}
    path = write(tmp_path / "result.json", json.dumps(export))
    docs = {r.external_id: r.text for r in files.chat_documents(spark, path).collect()}
    assert docs["segment_0000"] == "[Trip]\nAlice [10:00]: hello\nBob [11:00] (reply): see this!"
    assert docs["segment_0001"] == "[Trip]\nAlice [11:30] (edited): later"


MBOX = """From a@x Mon Jan  1 00:00:00 2024
Message-ID: <1@x>
From: Ann <a@x>
To: b@x
Subject: Plans
Date: Mon, 01 Jan 2024 10:00:00 +0000

First
>From here

From b@x Mon Jan  1 00:00:00 2024
Message-ID: <2@x>
In-Reply-To: <1@x>
From: Bob <b@x>
To: a@x
Subject: Re: Plans
Date: Mon, 01 Jan 2024 11:00:00 +0000
Content-Type: text/html

<p>Second <b>one</b></p>

From b@x Mon Jan  1 00:00:00 2024
Message-ID: <3@x>
In-Reply-To: <2@x>
From: Ann <a@x>
Subject: Re: Re: Plans
Date: Mon, 01 Jan 2024 12:00:00 +0000

Third

From c@x Mon Jan  1 00:00:00 2024
Message-ID: <4@x>
From: Cy <c@x>
Subject: Other
Date: Tue, 02 Jan 2024 12:00:00 +0000

Alone
"""


def test_mail(spark, tmp_path):
    path = write(tmp_path / "box.mbox", MBOX)
    rows = binary.mbox(spark, path)
    assert rows.count() == 4 and "**one**" in rows.where("message_id = '2@x'").first().body
    threads = {r.external_id: r for r in files.mail_threads(rows).collect()}
    assert {k: r.title for k, r in threads.items()} == {"thread_0000": "Plans", "thread_0001": "Other"}
    text = threads["thread_0000"].text
    assert text.index("First") < text.index("Second") < text.index("Third")  # a reply to a reply belongs to it


def test_tracks(spark, tmp_path):
    point = lambda lat, lon, ele, time: f'<trkpt lat="{lat}" lon="{lon}"><ele>{ele}</ele><time>{time}</time></trkpt>'
    points = point(48.85, 2.35, 35, "2024-01-01T10:00:00Z") + point(48.86, 2.36, 42, "2024-01-01T11:00:00Z") + point(48.87, 2.30, 30, "2024-01-01T15:00:00Z")
    path = write(tmp_path / "walk.gpx", f'<?xml version="1.0"?><gpx><metadata><bounds minlat="1" minlon="2"/></metadata><trk><trkseg>{points}</trkseg></trk></gpx>')
    docs = {r.external_id: r.text for r in files.track_documents(spark, path).collect()}
    assert sorted(docs) == ["walk_0000", "walk_0001"] and "Points: 2" in docs["walk_0000"] and "Max elevation: 42 m" in docs["walk_0000"]


def test_tables(spark, tmp_path):
    from almanac.operators.catalog import profile_document

    path = write(tmp_path / "c.csv", 'country,population\n"Fr, ance",67\nSpain,47\n')
    said = profile_document(files.delimited(spark, path), "c")
    assert "Total rows: 2" in said and "| Fr, ance | 67 |" in said and "- population" in said
    assert files.delimited(spark, write(tmp_path / "t.tsv", "a\tb\n1\t2\n")).columns == ["a", "b"]


def test_entity_dump(spark, tmp_path):
    claim = lambda kind, value: [{"mainsnak": {"datavalue": {"type": kind, "value": value}}}]
    item = {"id": "Q90", "type": "item", "labels": {"en": {"value": "Paris"}, "xx": {"value": "no"}}, "descriptions": {"en": {"value": "city"}}, "claims": {
        "P17": claim("wikibase-entityid", {"id": "Q142"}), "P1082": claim("quantity", {"amount": "+2100000"}), "P625": claim("globecoordinate", {"latitude": 48.5, "longitude": 2.25}), "P569": claim("time", {"time": "x"}), "P9999": claim("string", "no"), "P856": claim("string", "http://p"),
    }}
    other = {"id": "Q1", "type": "item", "labels": {"fr": {"value": "sans"}}, "claims": {}}
    text = "[\n" + json.dumps(item) + ",\n" + json.dumps(other) + ",\n{broken,\n]\n"
    path = str(tmp_path / "dump.json.gz")
    with gzip.open(path, "wt") as f:
        f.write(text)
    entities, relations, facts = files.entity_dump(spark, path)
    assert [(r.id, r.canonical_name, r.labels, r.description) for r in entities.collect()] == [("wikidata:Q90", "Paris", {"en": "Paris"}, "city")]
    assert [(r.predicate, r.object_id) for r in relations.collect()] == [("country", "wikidata:Q142")]
    assert {(r.predicate, r.value) for r in facts.collect()} == {("population", "2100000"), ("coordinates", "48.5,2.25"), ("website", "http://p")}


def test_mediawiki(spark, tmp_path):
    page = lambda title, text: f"<page><title>{title}</title><ns>0</ns><revision><text>{text}</text></revision></page>"
    path = write(tmp_path / "dump.xml", "<mediawiki>" + page("A B", "'''A''' is [[b|c]]. " + "word " * 60) + page("R", "#REDIRECT [[A]]") + page("S", "short") + "</mediawiki>")
    rows = files.mediawiki_documents(spark, path).collect()
    assert [(r.external_id, r.title) for r in rows] == [("A_B", "A B")] and rows[0].text.startswith("# A B\n\n**A** is c.")


def test_books(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("OPS/book.opf", '<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>My Book</dc:title></metadata><manifest><item id="b" href="two.xhtml"/><item id="a" href="one.xhtml"/><item id="e" href="none.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="e"/><itemref idref="b"/></spine></package>')
        z.writestr("OPS/one.xhtml", "<h1>Start</h1><p>once</p>")
        z.writestr("OPS/two.xhtml", "<p>end</p>")
        z.writestr("OPS/none.xhtml", "<p> </p>")
    write(tmp_path / "b.epub", data.getvalue())
    write(tmp_path / "broken.epub", b"no zip")
    rows = binary.epub(spark, str(tmp_path)).collect()
    assert [(r.external_id, r.title, r.parent_id, r.depth) for r in rows] == [("book", "My Book", None, 0), ("chapter_000", "Start", "book", 1), ("chapter_001", "Chapter 2", "book", 1)]


def test_papers(spark, tmp_path):
    stream = zlib.compress(b"BT (A Title) Tj (12) Tj [(bo) -3 (dy \\(x\\))] TJ ET")
    write(tmp_path / "p.pdf", b"%PDF-1.4\n1 0 obj <<>> stream\n" + stream + b"\nendstream endobj")
    row = binary.pdf(spark, str(tmp_path)).first()
    assert (row.external_id, row.title, row.text) == ("p", "A Title", "A Title\nbody (x)")


def photo(order="<"):
    """A TIFF block with a camera, a date, and a place in the south-west."""
    pack = lambda form, *v: struct.pack(order + form, *v)
    at, data, main, gps = 8, b"", [], []
    heap_at = 8 + (2 + 12 * 3 + 4) + (2 + 12 * 4 + 4)

    def put(blob):
        nonlocal data
        where = heap_at + len(data)
        data += blob
        return pack("I", where)

    rational = lambda *v: b"".join(pack("II", int(x * 100), 100) for x in v)
    gps_at = 8 + 2 + 12 * 3 + 4
    main.append(pack("HHI", 0x0110, 2, 9) + put(b"Camera X\0"))
    main.append(pack("HHI", 0x0132, 2, 20) + put(b"2024:05:06 07:08:09\0"))
    main.append(pack("HHI", 0x8825, 4, 1) + pack("I", gps_at))
    gps.append(pack("HHI", 1, 2, 2) + b"S\0\0\0")
    gps.append(pack("HHI", 2, 5, 3) + put(rational(48, 30, 0)))
    gps.append(pack("HHI", 3, 2, 2) + b"W\0\0\0")
    gps.append(pack("HHI", 4, 5, 3) + put(rational(2, 15, 36)))
    body = lambda entries: pack("H", len(entries)) + b"".join(entries) + pack("I", 0)
    return (b"II" if order == "<" else b"MM") + pack("HI", 42, at) + body(main) + body(gps) + data


@pytest.mark.parametrize("order", ["<", ">"])
def test_photographs(spark, tmp_path, order):
    write(tmp_path / "a.jpg", b"\xff\xd8\xff\xe1\0\0Exif\0\0" + photo(order))
    write(tmp_path / "b.JPG", b"no picture")
    row = binary.photos(spark, str(tmp_path)).collect()
    assert len(row) == 1 and row[0].camera == "Camera X" and str(row[0].taken) == "2024-05-06 07:08:09"
    assert row[0].lat == pytest.approx(-48.5) and row[0].lon == pytest.approx(-2.26)
    assert "Latitude: -48.5" in binary.photo_documents(spark, str(tmp_path)).first().text


def test_histories(spark, tmp_path):
    for name, ddl, rows in (
        ("chrome", "urls(url, title, visit_count, last_visit_time)", [("http://a/", "A", 2, 13_350_000_000_000_000), ("http://b/", "", 1, 13_360_000_000_000_000)]),
        ("firefox", "moz_places(url, title, visit_count, last_visit_date)", [("http://a/", "A", 2, 1_705_526_400_000_000), ("http://never/", None, 0, None)]),
    ):
        base = sqlite3.connect(tmp_path / name)
        base.execute("pragma journal_mode=wal")
        base.execute(f"create table {ddl}")
        base.executemany(f"insert into {ddl.split('(')[0]} values (?, ?, ?, ?)", rows)
        base.commit()
        base.close()
    chrome = binary.history(spark, str(tmp_path / "chrome"), "chrome-history").collect()
    assert [(r.external_id, r.url) for r in sorted(chrome)] == [("url_000000", "http://b/"), ("url_000001", "http://a/")]
    firefox = binary.history(spark, str(tmp_path / "firefox"), "firefox-history").collect()
    assert len(firefox) == 1 and str(firefox[0].last_visit).startswith("2024-01-17")


def archive(kind):
    """Two articles in two clusters, an image and a redirect."""
    pages = [b"<h1>One</h1><p>first</p>", b"<p>second</p>"]
    entry = lambda mime, space, cluster, path, title: struct.pack("<HBcIII", mime, 0, space, 0, cluster, 0) + path + b"\0" + title + b"\0"
    entries = [entry(0, b"C", 0, b"One", b"Article One"), entry(0, b"A", 1, b"Two", b""), entry(1, b"C", 1, b"pic", b""), struct.pack("<HBcII", 0xFFFF, 0, b"C", 0, 0) + b"r\0r\0"]
    mimes = b"text/html\0image/png\0\0"
    clusters = []
    for page in pages:
        raw = struct.pack("<II", 8, 8 + len(page)) + page
        clusters.append(bytes([kind]) + (zstandard.ZstdCompressor().compress(raw) if kind == 5 else __import__("lzma").compress(raw) if kind == 4 else raw))
    at = 80
    out = mimes
    offsets = []
    for e in entries:
        offsets.append(at + len(out))
        out += e
    paths_at = at + len(out)
    out += b"".join(struct.pack("<Q", o) for o in offsets)
    clusters_at = at + len(out)
    first = clusters_at + 16
    out += struct.pack("<QQ", first, first + len(clusters[0])) + b"".join(clusters)
    head = struct.pack("<IHH16sIIQQQQ", zim.MAGIC, 5, 0, b"u" * 16, len(entries), 2, paths_at, 0, clusters_at, at)
    return head + b"\0" * (80 - len(head)) + out


@pytest.mark.parametrize("kind", [1, 4, 5])
def test_zim(spark, tmp_path, kind):
    path = write(tmp_path / "t.zim", archive(kind))
    rows = zim.zim_documents(spark, path, pieces=2).collect()
    assert sorted((r.external_id, r.title, r.text) for r in rows) == [("One", "Article One", "# One\n\nfirst"), ("Two", "Two", "second")]


def test_json_lines_and_triples(spark, tmp_path):
    path = write(tmp_path / "d.jsonl", '{"id": "a", "title": "A", "text": "one"}\n{"text": "two"}\n{"id": "x"}\nbroken\n')
    rows = files.json_lines(spark, path).collect()
    assert sorted(r.text for r in rows) == ["one", "two"] and {r.title for r in rows if r.text == "one"} == {"A"}
    path = write(tmp_path / "d.nt", '<http://a> <http://p> <http://b> .\n<http://a> <http://n> "say \\"hi\\""@en .\n# no\n_:x <http://p> _:y .\n')
    relations, facts = files.triples(spark, path)
    assert sorted(map(tuple, relations.collect())) == [("_:x", "http://p", "_:y"), ("http://a", "http://p", "http://b")]
    assert [tuple(r) for r in facts.collect()] == [("http://a", "http://n", 'say "hi"')]
