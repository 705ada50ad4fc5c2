import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from almanac.operators import catalog, enrich, fts, graph, retrieval, sessions, storage, tracks

DOCS = [(1, "Red fish, blue fish", "s"), (2, "one fish two fish red", "s"), (3, "blue moon", "t"), (4, None, "t"), (5, "red red red", "t")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, source string")


@pytest.mark.parametrize(("query", "found"), [
    ("red", {1, 2, 5}), ("+red -fish", {5}), ('"red fish"', {1}), ('"fish red"', {2}), ('"fish blue red"', set()), ("red AND fish", {1, 2}), ("blue NOT moon", {1}), ("blue OR moon", {1, 3}), ("text:moon", {3}), ("", set()), ("-red", set()), ("nothing^2 moon", {3}), ("source:x moon", {3}),
])
def test_query_grammar(docs, query, found):
    assert {r.doc_id for r in fts.search(docs, query, None).collect()} == found


def test_boost_and_limit(docs):
    hits = fts.search(docs, "moon^9 red", 2).collect()
    assert [r["rank"] for r in hits] == [1, 2] and hits[0].doc_id == 3


def test_index_equals_scan(spark, docs, tmp_path):
    fts.build_index(docs, str(tmp_path))
    for words in ("red fish", "blue moon one", "absent"):
        scan = fts.search(docs, fts.words_query(words), 3).collect()
        assert sorted(map(tuple, fts.search_index(spark, str(tmp_path), words, 3).collect())) == sorted(map(tuple, scan))


@pytest.mark.parametrize("query", ["red fish", "+red -blue moon", '"red fish"', '"blue moon"^2 one', "text:red title:b", 'title:"b c" red', "-red", "+absent red", "red AND fish", "red NOT blue"])
def test_index_says_what_the_scan_says(spark, docs, tmp_path, query):
    two = docs.select("doc_id", "text", F.concat(F.lit("a b c "), F.substring("text", 1, 7)).alias("title"), (F.col("doc_id") % 2).alias("half"))
    fields = ("text", "title")
    fts.build_index(two, str(tmp_path), fields, keep=("half",), buckets=3)
    for where in (None, F.col("half") == 1):
        for limit in (2, None):
            scan = fts.search(two, query, limit, fields, where=where).collect()
            assert sorted(map(tuple, fts.search_index(spark, str(tmp_path), query, limit, fields, where=where).collect())) == sorted(map(tuple, scan))


def test_ranks_without_a_limit(spark):
    rows = [(i, float(i * 7 % 10)) for i in range(500)]
    found = fts.ranked(spark.createDataFrame(rows, "k long, score double").repartition(7), "score", ["k"], None).collect()
    expected = {k: n for n, (k, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    assert {r.k: r["rank"] for r in found} == expected
    assert fts.ranked(spark.createDataFrame([], "k long, score double"), "score", ["k"], None).count() == 0


def test_paths(spark):
    from almanac.operators import graph

    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "a"), ("x", "x")], "subject_id string, object_id string")
    assert graph.shortest_path(edges, "a", "e") == ["a", "b", "d", "e"]
    assert graph.shortest_path(edges, "b", "a") == ["b", "d", "e", "a"]
    assert graph.shortest_path(edges, "a", "x") is None and graph.shortest_path(edges, "a", "e", 2) is None and graph.shortest_path(edges, "x", "x") == ["x"]


def test_fusion_adds_every_hit(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("x", 3)], "key string, rank int")
    b = spark.createDataFrame([("y", 1)], "key string, rank int")
    fused = {r.key: r.score for r in retrieval.fuse([a, b], ["key"]).collect()}
    assert fused["x"] == pytest.approx(1 / 60 + 1 / 62) and fused["y"] == pytest.approx(1 / 61 + 1 / 60)


def test_hybrid_without_vectors_keeps_scores(spark, docs):
    hits = fts.search(docs, "moon", 5)
    none = hits.where("1 = 0")
    assert retrieval.hybrid(hits, none, ["doc_id"]).first().score == hits.first().score


def test_similar_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(60, 4))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    expected = {(i, j) for i in range(60) for j in range(i + 1, 60) if unit[i] @ unit[j] > 0.9}
    for block in (7, 1000):
        found = retrieval.similar_pairs(rows, 0.9, block=block).collect()
        assert len(found) == len(expected) and {(r.a, r.b) for r in found} == expected


def test_hits_stay_inside_the_document(docs):
    hit = retrieval.substring_hits(docs, "fish", 1).first()
    assert hit.byte_position == 4 and hit.context == "Red fish, blue fish"


def test_upsert_keeps_and_replaces(spark):
    schema = "source_id string, external_id string, title string, content_hash string, content_size long, indexed_at int, language string"
    known = spark.createDataFrame([("s", "1", "old", "h", 1, 1, "en"), ("s", "2", "two", "h", 1, 1, "en")], schema)
    new = spark.createDataFrame([("s", "1", "new", "g", 2, 2, "xx"), ("s", "1", "newer", "f", 3, 3, "xx"), ("s", "3", "three", "e", 3, 2, "de")], schema)
    found = {r.external_id: (r.title, r.content_hash, r.language) for r in catalog.upsert_documents(known, new).collect()}
    assert found == {"1": ("newer", "f", "en"), "2": ("two", "h", "en"), "3": ("three", "e", "de")}


def test_renames_and_diff(spark):
    known = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", None)], "external_id string, content_hash string")
    seen = spark.createDataFrame([("a", "1"), ("b", "9"), ("z", "3"), ("d", None)], "external_id string, content_hash string")
    assert {r.external_id: r.status for r in catalog.update_diff(known, seen).collect()} == {"a": "unchanged", "b": "changed", "c": "deleted", "z": "new", "d": "unchanged"}
    assert [tuple(r) for r in catalog.renames(known, seen).collect()] == [("c", "z")]


def test_visibility(spark):
    rows = spark.createDataFrame([("a", 0), ("b", 2)], "source_name string, privacy_level int")
    assert catalog.visible(rows, personal_only=True, public_only=True).count() == 0
    assert catalog.visible(rows, privacy_max=1).count() == 1 and catalog.visible(rows, source="b").count() == 1


def test_wikilink_graph(spark):
    pages = spark.createDataFrame([("Paris", ["France", "Seine", "Eiffel Tower"]), ("France", ["Europe", "Eiffel Tower", "eiffel tower"])], "doc_id string, names array<string>")
    mentions = graph.mentions_of(pages, F.col("names"))
    entities = {r.id: r.mention_count for r in graph.entities_of(mentions).collect()}
    assert entities["wiki:eiffel_tower"] == 2 and len(entities) == 4 and mentions.count() == 5
    pairs = graph.cooccurrences(mentions).collect()
    assert len(pairs) == 4 and all(p.subject_id < p.object_id for p in pairs)


def test_facts(spark):
    entities = spark.createDataFrame([("e:fr", "France", "a country", ["c"], 1), ("e:pa", "Paris", None, ["c"], 1)], "id string, canonical_name string, description string, entity_types array<string>, mention_count long")
    relations = spark.createDataFrame([("e:fr", "capital", "e:pa", "s", 1.0), ("e:fr", "capital_city", "e:fr", "s", 0.2)], "subject_id string, predicate string, object_id string, source_name string, confidence double")
    answer = lambda q: [r.answer for r in graph.fact_lookup(entities, relations, q).collect()]
    assert answer("capital of france") == ["France: capital → Paris"] and answer("capital France") == ["France: capital → Paris"]
    assert answer("money of France") == ["France: a country"] and answer("river of Paris") == [] and answer("x of Nowhere") == []


def test_threads_close_over_long_chains_and_cycles(spark):
    rows = [(f"m{i}", f"m{i - 1}" if i else None) for i in range(40)] + [("a", "b"), ("b", "a"), ("lost", "gone")]
    closed = sessions.thread_closure(spark.createDataFrame(rows, "id string, up string"), "id", "up").collect()
    by = {r.id: (r.root, r.depth) for r in closed}
    assert by["m39"] == ("m0", 39) and by["m0"] == ("m0", 0) and by["lost"] == ("lost", 0) and {"a", "b"} <= set(by)


def test_sliding_windows(spark):
    rows = sessions.sliding_windows(spark.createDataFrame([("c", i) for i in range(12)], "chat string, n int"), "chat", "n", 10, 5).collect()
    windows = {}
    for r in rows:
        windows.setdefault(r.window_start, []).append(r.n)
    assert {k: sorted(v) for k, v in windows.items()} == {0: list(range(10)), 5: list(range(5, 12)), 10: [10, 11]}


def test_gap_is_strict(spark):
    rows = spark.createDataFrame([("c", 1, "2024-01-01 10:00:00"), ("c", 2, "2024-01-01 12:00:00"), ("c", 3, "2024-01-01 14:00:01")], "chat string, id int, t string").withColumn("ts", F.to_timestamp("t"))
    assert [r.segment for r in sessions.gap_segments(rows, "chat", "ts", "id").orderBy("id").collect()] == [0, 0, 1]


def test_simplification():
    line = np.array([[0, 0], [1, 0.00001], [2, 0], [3, 1], [4, 0.0]])
    assert tracks.simplified(line, 1e-4).tolist() == [True, False, True, True, True]
    assert tracks.simplified(np.zeros((0, 2)), 1).tolist() == [] and tracks.simplified(np.zeros((3, 2)), 1).tolist() == [True, False, True]


def test_nearby_boxes_lose_nothing(spark):
    rng = random.Random(3)
    rows = spark.createDataFrame([(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(500)], "lat double, lon double")
    from almanac.functions.geo import haversine_km

    for lat, lon, km in ((0.0, 179.5, 3000.0), (89.0, 0.0, 1500.0), (-45.0, 20.0, 2500.0)):
        all_ = rows.withColumn("km", haversine_km(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))).where(F.col("km") <= km).count()
        assert tracks.nearby(rows, lat, lon, km).count() == all_


def test_enrichment(docs):
    class Echo:
        def complete(self, prompt):
            return "- Paris\n-  \n" + "x" * 100 + "\nSeine" if "organisations" in prompt else None

    assert enrich.enrich(docs, "summarize", enrich.Skip()).count() == 0
    answers = enrich.enrich(docs, "extract_entities", Echo(), limit=2)
    assert answers.count() == 2
    assert {r.entity_id for r in enrich.entities_from(answers).collect()} == {"ner:paris", "ner:seine"}
    assert enrich.entity_lines("- a\n\n b ") == ["a", "b"] and enrich.prefix("éé", 3) == "é"


def test_steps_fall_back(docs):
    tries = []

    def fails(df):
        tries.append(1)
        raise ValueError

    def second_time(df):
        tries.append(2)
        return df.limit(2) if tries.count(2) > 1 else fails(df)

    steps = [enrich.Step("off", fails, enabled=False), enrich.Step("skipped", fails, fallback="skip"), enrich.Step("retried", second_time, fallback="retry"), enrich.Step("last", lambda d: d.limit(1))]
    out, report = enrich.run_steps(docs, steps)
    assert out.count() == 1 and report.ran == ["retried", "last"] and report.skipped == ["off", "skipped"] and report.rows == {"retried": 2, "last": 1}
    with pytest.raises(ValueError):
        enrich.run_steps(docs, [enrich.Step("aborts", fails)])


def test_archives_round_trip(spark, tmp_path):
    content = spark.createDataFrame([("a", "x.md", "one é", 0), ("a", "y/z.md", "", 0), ("b", "p.txt", "secret", 2)], "source_name string, filename string, text string, privacy_level int")
    assert storage.export_archive(content, f"{tmp_path}/public.tar.zst") == 2
    assert storage.export_archive(content, f"{tmp_path}/all.tar.zst", include_personal=True) == 3
    back = storage.import_archive(spark, f"{tmp_path}/public.tar.zst").collect()
    assert sorted(map(tuple, back)) == [("a", "x.md", "one é"), ("a", "y/z.md", "")]


def test_content_store(spark, tmp_path):
    content = spark.createDataFrame([("a", "x.md", "one", 0), ("b", "y.md", "two", 0)], "source_name string, filename string, text string, privacy_level int")
    storage.write_content(content, f"{tmp_path}/content")
    storage.replace_documents(content.where("source_name = 'a'").withColumn("text", F.lit("new")), f"{tmp_path}/content")
    assert {(r.source_name, r.text) for r in storage.list_files(spark, f"{tmp_path}/content").collect()} == {("a", "new"), ("b", "two")}
    assert storage.list_files(spark, f"{tmp_path}/content", "b").count() == 1
    assert catalog.read_document(content, "a:x").first().text == "one" and catalog.read_document(content, "a:y").first() is None
