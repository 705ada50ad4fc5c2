import io
import json
import random
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from almanac import cli, serve
from almanac.api import KnowledgeBase
from almanac.functions import registry
from almanac.functions.geo import haversine_km
from almanac.operators import graph
from almanac.operators.chunker import chunk


@pytest.fixture(scope="module")
def kb(spark, tmp_path_factory):
    raw = tmp_path_factory.mktemp("raw")
    (raw / "Paris.md").write_text("# Paris\nCapital of [[France]].\n## Geography\nThe river runs.")
    base = KnowledgeBase(spark, str(tmp_path_factory.mktemp("kb")))
    base.add_source("wiki", str(raw), "markdown-dir")
    base.add_documents("diary", spark.createDataFrame([("d1", "my river walk")], "external_id string, text string"), privacy=2)
    return base


def test_nested_links():
    assert registry.nested_links("[[a|b]] [[a#c]] [[File:x|[[inner]] text]] [[:Paris]] [[ ]] [[open") == {"a": 2}
    assert registry.nested_links(None) == {} and registry.nested_links("[[a [[b]] c]]") == {"a [[b]] c": 1}


def test_sql_functions(spark):
    registry.register(spark)
    texts = ["# a\n## b\nbody\n### c\n" + "x" * 30 + "\n" + "y" * 30 + "\ntail", "", "  ", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.createOrReplaceTempView("chunk_test_docs")
    udtf = spark.sql("select doc_id, c.* from chunk_test_docs d, lateral chunk_text(d.text, 40) c").collect()
    fold = chunk(docs, max_bytes=40).select("doc_id", "chunk_index", "section_path", "chunk").collect()
    assert sorted(map(repr, map(tuple, udtf))) == sorted(map(repr, map(tuple, fold)))
    row = spark.sql("select html_to_markdown('<b>x</b>') m, wikilink_counts('[[a]] [[a]]') w, embed_text('one two') e, embed_text(' ') n").first()
    assert row.m == "**x**" and row.w == {"a": 2} and sum(x * x for x in row.e) == pytest.approx(1) and row.n is None


def test_citation(spark):
    row = spark.createDataFrame([("wiki", "Eiffel", "Eiffel Tower", 0), ("diary", "d", "d", 2)], "s string, e string, t string, p int")
    said = row.select(registry.citation(F.col("s"), F.col("e"), F.col("t"), F.col("p"), "http://w/{title}", "/kb/").alias("c")).collect()
    assert said[0].c.web_url == "http://w/Eiffel_Tower" and said[0].c.file_path == "/kb/Eiffel" and said[1].c.web_url is None


def test_places_match_like_brute_force(spark):
    rng = random.Random(5)
    some = lambda n: [(f"e{i}", rng.choice([rng.uniform(-90, 90), rng.uniform(88, 90)]), rng.choice([rng.uniform(-180, 180), rng.uniform(179, 180), rng.uniform(-180, -179)])) for i in range(n)]
    a, b = (spark.createDataFrame(some(150), "id string, lat double, lon double") for _ in range(2))
    for km in (50.0, 700.0, 4000.0):
        pairs = a.select(F.col("id").alias("left_id"), F.col("lat").alias("x"), F.col("lon").alias("y")).crossJoin(b.withColumnRenamed("id", "right_id"))
        expected = pairs.where(haversine_km(F.col("x"), F.col("y"), F.col("lat"), F.col("lon")) <= km).select("left_id", "right_id").collect()
        assert sorted(graph.match_entities(a, b, "place", km).collect()) == sorted(expected) and expected
    named = spark.createDataFrame([("x", "Eiffel-Tower")], "id string, canonical_name string")
    other = spark.createDataFrame([("y", "eiffel tower")], "id string, canonical_name string")
    assert [tuple(r) for r in graph.match_entities(named, other).collect()] == [("x", "y")] and graph.match_entities(named, other, "id").count() == 0


def test_skills_and_vectors(kb):
    assert kb.ask("personal", "river").first().source_name == "diary"
    assert {r.source_name for r in kb.ask("research", "river").collect()} == {"wiki", "diary"}
    assert kb.ask("define", "river").first().source_name == "wiki" and kb.ask("lookup", "co_occurs of river").count() >= 0
    hits = kb.vector_search("river walk")
    assert hits.first().title == "d1" and kb.vector_search("  ").count() == 0
    assert {r.source_name for r in kb.search("river", vector_hits=hits).collect()} == {"wiki", "diary"}


def test_http(kb):
    server = serve.http_server(kb, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    get = lambda path: json.load(urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{path}"))
    try:
        assert {h["title"] for h in get("/api/search?q=river&limit=5")} == {"Paris", "d1"}
        assert [h["title"] for h in get("/api/search?q=river&source=diary")] == ["d1"]
        assert "Geography" in get("/api/read/wiki/Paris")["text"] and get("/api/entity/france")["id"] == "wiki:france"
        assert {s["source_name"] for s in get("/api/sources")} == {"wiki", "diary"} and get("/api/status")
        for missing in ("/api/entity/nobody", "/api/read/wiki/None", "/other"):
            with pytest.raises(urllib.error.HTTPError) as caught:
                get(missing)
            assert caught.value.code == 404
    finally:
        server.shutdown()
        server.server_close()


def test_tools(kb):
    ask = lambda method, **params: {"jsonrpc": "2.0", "id": 1, "method": method, "params": params}
    lines = [ask("initialize"), {"jsonrpc": "2.0", "method": "notifications/initialized"}, ask("tools/list"), ask("tools/call", name="read", arguments={"reference": "wiki:Paris", "section": "Geography"}), ask("tools/call", name="read", arguments={"reference": "wiki:No"}), ask("nothing")]
    out = io.StringIO()
    serve.stdio(kb, io.StringIO("\n".join(map(json.dumps, lines)) + "\n{broken\n"), out)
    said = [json.loads(x) for x in out.getvalue().splitlines()]
    assert said[0]["result"]["serverInfo"]["name"] == "almanac" and len(said[1]["result"]["tools"]) == 5
    assert said[2]["result"]["content"][0]["text"] == "## Geography\nThe river runs." and said[3]["result"]["isError"]
    assert said[4]["error"]["code"] == -32601 and said[5]["error"]["code"] == -32700


def test_command_line(kb, capsys, tmp_path):
    run = lambda *argv: (cli.main(["--base", kb.folder, *argv], kb), capsys.readouterr().out)[1]
    assert {h["title"] for h in json.loads(run("search", "river"))} == {"Paris", "d1"}
    assert run("read", "wiki:Paris", "--section", "Geography") == "## Geography\nThe river runs.\n"
    assert json.loads(run("entity", "France"))[0]["mention_count"] == 1 and json.loads(run("entity", "Fra"))["suggestions"][0]["id"] == "wiki:france"
    assert json.loads(run("substring", "river runs"))[0]["document"] == "wiki:Paris"
    assert json.loads(run("export", str(tmp_path / "x.tar.zst"))) == {"documents": 1}
    assert json.loads(run("enrich", "summarize")) == [] and json.loads(run("sources")) and json.loads(run("status"))
    assert json.loads(run("ask", "personal", "river"))[0]["title"] == "d1" and json.loads(run("lookup", "what of river"))
