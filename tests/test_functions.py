import math

import pytest
from pyspark.sql import functions as F

from almanac.functions import geo, vectors
from almanac.functions import text as T
from almanac.operators.chunker import chunk


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"]).select(column.alias("out")).first().out


@pytest.mark.parametrize(("text", "name", "title"), [("\n  # Paris \nx", "a.md", "Paris"), ("none", "Some_Page.md.md", "Some_Page"), ("#no", "b.txt.txt", "b"), ("## two\n# one", "c.md", "one")])
def test_document_title(spark, text, name, title):
    assert one(spark, T.document_title(F.col("t"), F.col("n")), t=text, n=name) == title


def test_snippet_counts_bytes_and_cuts_characters_whole(spark):
    assert one(spark, T.snippet(F.col("t")), t="é" * 80) == "é" * 50 + "..."
    assert one(spark, T.snippet(F.col("t")), t="a" * 100) == "a" * 100
    assert one(spark, T.snippet(F.col("t")), t=" short ") == "short"


def test_strip_tags(spark):
    assert one(spark, T.strip_tags(F.col("t")), t="<p>a &amp; b</p> > <open") == "a &amp; b  "


def test_wikilinks(spark):
    text = "[[Paris|city]] [[France#History]] [[File:a.png]] [[:Category:X]] [[ ]] [[:Seine]] [[Paris]]"
    assert one(spark, T.wikilinks(F.col("t")), t=text) == ["Paris", "France", "Paris"]


def test_entity_id(spark):
    assert one(spark, T.entity_id("person", F.col("t")), t="Ann Lee <a@b.c>") == "person:ann_lee__a_b.c_"


def test_occurrences_overlap(spark):
    assert one(spark, T.occurrences(F.col("t"), "ana"), t="banana.ana") == 3
    assert one(spark, T.occurrences(F.col("t"), "m^2"), t="E=mc^2 m^2") == 1
    assert one(spark, T.occurrences(F.col("t"), ""), t="x") == 0


def test_highlight(spark):
    assert one(spark, T.highlight(F.col("t"), F.lit("a.c")), t="A.C abc a.c") == "**A.C** abc **a.c**"


def test_clean_extracted(spark):
    assert one(spark, T.clean_extracted(F.col("t")), t=" 12 \n\nﬁrst ﬂow\n - \nlong 1234\n123\n1234") == "first flow\nlong 1234\n1234"
    assert one(spark, T.extracted_title(F.col("t"), F.lit("f")), t="\n\nA Title\nbody") == "A Title"
    assert one(spark, T.extracted_title(F.col("t"), F.lit("f")), t="A sentence.\nbody") == "f"


def test_human_bytes_and_file_names(spark):
    assert [one(spark, T.human_bytes(F.col("n")), n=n) for n in (5, 1536, 3 << 20, 5 << 30)] == ["5 B", "1.5 KB", "3.0 MB", "5.0 GB"]
    assert one(spark, T.safe_file_name(F.col("t")), t="a/b\\c:d") == "a_b_c_d"


def test_geo(spark):
    km = one(spark, geo.haversine_km(F.lit(48.8566), F.lit(2.3522), F.lit(51.5074), F.lit(-0.1278)))
    assert km == pytest.approx(343.5, abs=1)
    assert one(spark, geo.dms_to_degrees(F.lit(48.0), F.lit(51.0), F.lit(30.0), F.lit("S"))) == pytest.approx(-48.858333, abs=1e-6)
    assert str(one(spark, geo.webkit_time(F.col("n")), n=13_350_000_000_000_000)).startswith("2024-01-17 21:20")
    assert one(spark, geo.webkit_time(F.col("n")), n=0) is None


def test_cosine(spark):
    assert one(spark, vectors.cosine(F.col("a"), F.col("b")), a=[1.0, 1.0], b=[1.0, 0.0]) == pytest.approx(1 / math.sqrt(2))
    assert one(spark, vectors.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 0.0]) == 0


PARIS = "# Paris\nintro\n## Geography\nriver\n## History\nold\n## Landmarks\nmany\n### Eiffel Tower\ntall\n### Louvre Museum\nwide\n## Demographics\nmany\n"


def test_heading_lines(spark):
    assert [tuple(r) for r in one(spark, T.heading_lines(F.col("t")), t="# a\nx\n## b\n### c\n#no")] == [(0, "a"), (2, "b")]


def test_chunker_sections(spark):
    rows = chunk(spark.createDataFrame([(1, PARIS)], "doc_id long, text string")).orderBy("chunk_index").collect()
    assert [r.section_path for r in rows] == [None, "Geography", "History", "Landmarks", "Eiffel Tower", "Louvre Museum", "Demographics"]
    assert rows[0].chunk == "# Paris\nintro" and rows[4].chunk == "### Eiffel Tower\ntall"


def test_chunker_sizes(spark):
    texts = {1: "x" * 4000, 2: "\n".join(["y" * 700] * 5), 3: "", 4: "  \n ", 5: None, 6: "# a\r\n" + "é" * 751 + "\n" + "tail"}
    rows = chunk(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    by = {i: [r.chunk for r in sorted(rows, key=lambda r: r.chunk_index) if r.doc_id == i] for i in texts}
    assert by[1] == ["x" * 4000]
    assert [len(c) for c in by[2]] == [2102, 1401]
    assert by[3] == [""] and by[4] == ["  \n "] and by[5] == [""]
    assert by[6] == ["# a\r\n" + "é" * 751, "tail"]
