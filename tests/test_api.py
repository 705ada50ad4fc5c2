import pytest

from almanac.api import KnowledgeBase


@pytest.fixture
def base(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "Paris.md").write_text("# Paris\nCapital of [[France]] on the [[Seine]].\n## Geography\nThe river runs.\n## History\nOld.")
    (raw / "France.md").write_text("# France\nA country in [[Europe]] with [[Seine]] water.")
    kb = KnowledgeBase(spark, str(tmp_path / "kb"))
    kb.add_source("wiki", str(raw), "markdown-dir")
    kb.add_documents("diary", spark.createDataFrame([("d1", "my river walk")], "external_id string, text string"), privacy=2)
    return kb, raw, tmp_path


def test_search_and_filters(base):
    kb = base[0]
    hits = kb.search("river").collect()
    assert {(h.source_name, h.title) for h in hits} == {("wiki", "Paris"), ("diary", "d1")} and hits[0]["rank"] in (1, 2)
    assert {h.source_name for h in kb.search("river", public_only=True).collect()} == {"wiki"}
    assert {h.source_name for h in kb.search("river", personal_only=True).collect()} == {"diary"}
    assert kb.search("river", personal_only=True, public_only=True).count() == 0
    assert [r.document for r in kb.substring("river runs").collect()] == ["wiki:Paris"]


def test_read(base):
    kb = base[0]
    assert "## Geography" in kb.read("wiki:Paris")
    assert kb.read("wiki:Paris", "Geography") == "## Geography\nThe river runs."
    for missing in (("wiki:Rome", None), ("wiki:Paris", "Nowhere")):
        with pytest.raises(KeyError):
            kb.read(*missing)


def test_entities(base):
    kb = base[0]
    card = kb.entity("seine").first()
    assert card.mention_count == 2 and card.documents == ["France", "Paris"]
    assert [r.canonical_name for r in kb.suggest("e").collect()] == ["Europe"]
    assert "Seine" in kb.lookup("co_occurs of France").first().answer
    assert kb.lookup("who runs the river").count() > 0
    assert kb.enrich("summarize").count() == 0


def test_update_delete_export_import(base, spark):
    kb, raw, tmp = base
    assert kb.update_source("wiki", str(raw), "markdown-dir") == {"new": 0, "changed": 0, "unchanged": 2, "deleted": 0}
    (raw / "France.md").unlink()
    (raw / "Rome.md").write_text("# Rome\nall roads")
    (raw / "Paris.md").write_text("# Paris\nshort")
    assert kb.update_source("wiki", str(raw), "markdown-dir") == {"new": 1, "changed": 1, "unchanged": 0, "deleted": 1}
    assert kb.search("country").count() == 0 and kb.search("roads").count() == 1
    with pytest.raises(ValueError):
        kb.add_source("wiki", str(raw), "markdown-dir")
    assert kb.export(str(tmp / "a.tar.zst")) == 2 and kb.export(str(tmp / "b.tar.zst"), include_personal=True) == 3
    other = KnowledgeBase(spark, str(tmp / "other"))
    assert other.import_(str(tmp / "b.tar.zst")) == ["diary", "wiki"]
    assert other.search("roads").count() == 1
    kb.delete("diary")
    assert [r.source_name for r in kb.list_sources().collect()] == ["wiki"] and kb.status().count() == 3


def saying(answer):
    class Says:  # here, so that it goes to the workers with what it says
        def complete(self, prompt):
            return answer

    return Says()


def test_answers_are_kept(base):
    kb = base[0]
    kb.model = saying("Zanzibar is mentioned")
    assert kb.enrich("summarize", source="wiki").count() == 2
    assert kb.read("wiki:Paris", "Summary") == "## Summary\n\nZanzibar is mentioned"
    assert kb.search("zanzibar").count() == 2 and kb.search("walk").count() == 1
    kb.model = saying("- Old Town\n- Seine Bank")
    assert kb.enrich("extract_entities", source="diary").count() == 1
    assert kb.entity("old town").first().documents == ["d1"]
    assert kb.entity("seine").first().mention_count == 2


def test_verbs_read_what_was_derived(base):
    kb = base[0]
    assert kb.chunks().where("source_name = 'wiki'").count() == 4 and kb.embed().count() == 5
    before = sorted(map(tuple, kb.search("river").collect()))
    kb.build_index()
    assert sorted(map(tuple, kb.search("river").collect())) == before
    assert [r.title for r in kb.search('+river -walk').collect()] == ["Paris"]
    assert {r.title for r in kb.search('"river runs"').collect()} == {"Paris"}
    fused = kb.search_all("river", expand=True).collect()
    assert {r.title for r in fused} >= {"Paris", "d1"} and fused[0]["rank"] == 1
    kb.delete("wiki")
    assert kb.search("river").count() == 1 and kb.mentions().count() == 0 and kb.embed().count() == 1 and kb.substring("river").count() == 1


def test_an_empty_base(spark, tmp_path):
    kb = KnowledgeBase(spark, str(tmp_path / "none"))
    assert kb.search("x").count() == 0 and kb.entity("x").count() == 0 and kb.lookup("x of y").count() == 0 and kb.substring("abc").count() == 0 and kb.vector_search("x").count() == 0


def test_odd_source_names(base, spark):
    kb = base[0]
    for name in ("2024", "a b/c=d"):
        kb.add_documents(name, spark.createDataFrame([("n1", "lighthouse keeper")], "external_id string, text string"))
        assert {h.source_name for h in kb.search("lighthouse").collect()} == {name}
        kb.delete(name)
        assert kb.search("lighthouse").count() == 0


def test_soft_deletion(base):
    kb, raw, _ = base
    text = (raw / "France.md").read_text()
    (raw / "France.md").unlink()
    assert kb.update_source("wiki", str(raw), "markdown-dir", deletions="soft")["deleted"] == 1
    assert kb.search("country").count() == 0 and kb.content().where("source_name = 'wiki'").count() == 1 and kb._stored().where("source_name = 'wiki'").count() == 2
    assert kb.update_source("wiki", str(raw), "markdown-dir", deletions="soft") == {"new": 0, "changed": 0, "unchanged": 1, "deleted": 0}
    (raw / "France.md").write_text(text)
    assert kb.update_source("wiki", str(raw), "markdown-dir", deletions="soft")["new"] == 1
    assert kb.search("country").count() == 1 and kb._stored().where("source_name = 'wiki'").count() == 2
    with pytest.raises(ValueError):
        kb.update_source("wiki", str(raw), "markdown-dir", deletions="perhaps")
