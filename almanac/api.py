"""The knowledge base as one object: the verbs that a command line, an HTTP service or a tool server would offer.

Content and everything derived from it are Parquet tables below one folder. Sources are added, updated (replaced by
document), deleted with all that was derived from them, searched, read, exported and imported.

Whatever a verb needs beyond a document's text is derived when content is written, by source, and read by the verb:
chunks, the full-text index, vectors, trigrams, mentions, entities and relations. A source's part of each is replaced
when its content is, and nothing of other sources is touched; counts and statistics are summed over sources when read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.functions.text import content_hash, snippet, wikilinks
from almanac.functions.text import section as section_of
from almanac.operators import catalog, chunker, enrich, fts, graph, retrieval, storage
from almanac.session import cut_lineage
from almanac.sources import DOCUMENT, binary, files, zim

READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "markdown-dir": lambda s, p: files.text_dir(s, p, "markdown-dir"),
    "plaintext-dir": lambda s, p: files.text_dir(s, p, "plaintext-dir"),
    "html-dir": lambda s, p: files.text_dir(s, p, "html-dir"),
    "epub": binary.epub,
    "pdf-dir": binary.pdf,
    "zim": zim.zim_documents,
    "telegram-export": files.chat_documents,
    "mbox": lambda s, p: files.mail_threads(binary.mbox(s, p)),
    "gpx": files.track_documents,
    "exif-dir": binary.photo_documents,
    "csv": lambda s, p: _profiled(s, p),
    "tsv": lambda s, p: _profiled(s, p),
    "mediawiki": files.mediawiki_documents,
    "jsonl": files.json_lines,
    "chrome-history": lambda s, p: _visited(s, p, "chrome-history"),
    "firefox-history": lambda s, p: _visited(s, p, "firefox-history"),
}
_CONTENT = "source_name string, external_id string, title string, text string, content_type string, parent_id string, depth int, privacy_level int, content_hash string, content_size long"
_DELETED = "Deleted"
#: What is derived of a source, by table; the full-text index has folders of its own.
_DERIVED = {
    "chunks": "source_name string, chunk_id string, external_id string, title string, text string, privacy_level int",
    "vectors": "source_name string, chunk_id string, title string, vector array<float>, privacy_level int",
    "trigrams": "source_name string, document string, gram string",
    "mentions": "source_name string, entity_id string, document_id string, mention_text string",
    "named": "source_name string, entity_id string, document_id string, mention_text string",
    "entities": "source_name string, id string, canonical_name string, description string, entity_types array<string>, mention_count long",
    "relations": "source_name string, subject_id string, predicate string, object_id string, confidence double",
}


def _profiled(spark: SparkSession, path: str) -> DataFrame:
    name = path.rstrip("/").rpartition("/")[2].rpartition(".")[0]
    said = catalog.profile_document(files.delimited(spark, path), name)
    return spark.createDataFrame([(name, name, said, "Record", None, 0, 0)], DOCUMENT)


def _visited(spark: SparkSession, path: str, form: str) -> DataFrame:
    rows = binary.history(spark, path, form)
    said = F.concat(F.lit("URL: "), "url", F.lit("\nVisits: "), F.coalesce(F.col("visits").cast("string"), F.lit("0")), F.coalesce(F.concat(F.lit("\nLast visit: "), F.col("last_visit").cast("string")), F.lit("")))
    return rows.select("external_id", F.coalesce(F.when(F.col("title") != "", F.col("title")), "url").alias("title"), said.alias("text"), F.lit("Record").alias("content_type"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("depth"), F.lit(2).alias("privacy_level"))


#: Named ways to ask: which sources (a pattern of their names), how, and the shape of the answer. Fixed values.
SKILLS = {
    "lookup": {"sources": ".*", "mode": "quick", "shape": "answer"},
    "define": {"sources": "(?i).*(wik|dict|lex).*", "mode": "quick", "shape": "hits"},
    "fact-check": {"sources": "(?i).*wik.*", "mode": "normal", "shape": "hits"},
    "research": {"sources": ".*", "mode": "deep", "shape": "by_source"},
    "personal": {"sources": ".*", "mode": "normal", "shape": "hits", "personal_only": True},
}


@dataclass
class KnowledgeBase:
    spark: SparkSession
    folder: str
    model: enrich.Backend = enrich.Skip()

    # Tables

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def _stored(self) -> DataFrame:
        return self._read("content", _CONTENT)

    def content(self) -> DataFrame:
        """All documents but those that an update has only marked as deleted."""
        return self._stored().where(F.col("content_type") != _DELETED)

    def _replace(self, source: str, rows: DataFrame) -> None:
        """Put a source's documents in place of those it had, and derive anew what is derived of them.

        They are written aside first, as rows may come from them, in a folder of this call's own.
        """
        aside = f"{self.folder}/.aside-{uuid.uuid4().hex}"
        try:
            rows.select(*[c.split()[0] for c in _CONTENT.split(", ")]).write.parquet(aside)
            fresh = self.spark.read.parquet(aside)
            if fresh.isEmpty():
                self.delete(source)
            else:
                self._write("content", fresh)
                self.build_index(source)
        finally:
            self._remove(aside)

    def _write(self, name: str, rows: DataFrame, order: Sequence[str] = ()) -> None:
        """Replace the parts of a table that belong to the sources of ``rows``; within files rows are in order."""
        sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows
        sorted_.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_name").option("compression", "zstd").parquet(f"{self.folder}/{name}")

    def _remove(self, path: str) -> None:
        sc = self.spark.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)

    def _part(self, source: str) -> str:
        return f"source_name={self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(source)}"

    def build_index(self, source: str | None = None) -> None:
        """Derive all that is derived of a source, or of every one."""
        if source is None:
            for row in self.content().select("source_name").distinct().collect():
                self.build_index(row.source_name)
            return
        own = self.content().where(F.col("source_name") == source)
        for name in _DERIVED:
            if name != "named":
                self._remove(f"{self.folder}/{name}/{self._part(source)}")
        self._write("chunks", self._chunked(own), ["chunk_id"])
        chunks = self._table("chunks").where(F.col("source_name") == source)
        fts.build_index(chunks.select("chunk_id", "text", "title", "privacy_level"), f"{self.folder}/fts", ("text", "title"), "chunk_id", ("privacy_level",), within=self._part(source))
        from almanac.functions.registry import embed_text

        self._write("vectors", chunks.select("source_name", "chunk_id", "title", embed_text("text").alias("vector"), "privacy_level"))
        documents = own.withColumn("document", F.concat_ws(":", "source_name", "external_id"))
        self._write("trigrams", retrieval.trigrams(documents, "document").withColumn("source_name", F.lit(source)), ["gram", "document"])
        found = graph.mentions_of(documents, wikilinks(F.col("text")), key="document", source=F.col("source_name"))
        self._write("mentions", found, ["entity_id"])
        self._relate(source)

    def _relate(self, source: str) -> None:
        """Entities and relations of a source's mentions."""
        mentions = self.mentions().where(F.col("source_name") == source)
        named = mentions.withColumn("kind", F.when(F.col("entity_id").startswith("ner:"), "Named").otherwise("Concept"))
        entities = None
        for kind in ("Concept", "Named"):
            own = graph.entities_of(named.where(F.col("kind") == kind), kind)
            entities = own if entities is None else entities.unionByName(own)
        for name in ("entities", "relations"):
            self._remove(f"{self.folder}/{name}/{self._part(source)}")
        self._write("entities", entities.withColumn("source_name", F.lit(source)), ["id"])
        self._write("relations", graph.cooccurrences(mentions), ["subject_id"])

    def _table(self, name: str) -> DataFrame:
        return self._read(name, _DERIVED[name])

    # Sources

    def _load(self, name: str, path: str, form: str, privacy: int | None) -> DataFrame:
        rows = READERS[form](self.spark, path)
        level = F.col("privacy_level") if privacy is None else F.greatest(F.col("privacy_level"), F.lit(privacy))
        return rows.select(F.lit(name).alias("source_name"), *[c.split()[0] for c in DOCUMENT.split(", ")[:-1]], level.cast("int").alias("privacy_level"), content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("content_size"))

    def add_source(self, name: str, path: str, form: str, privacy: int | None = None) -> dict[str, int]:
        """Ingest a new source; its metrics."""
        if not self.content().where(F.col("source_name") == name).isEmpty():
            raise ValueError(f"source {name} already exists")
        self._replace(name, self._load(name, path, form, privacy))
        return self.metrics(name)

    def metrics(self, name: str) -> dict[str, int]:
        """documents, bytes and chunks of a source."""
        own = self.content().where(F.col("source_name") == name)
        said = own.agg(F.count("text").alias("documents"), F.coalesce(F.sum("content_size"), F.lit(0)).alias("bytes")).first()
        return {"documents": said.documents, "bytes": said.bytes, "chunks": self.chunks().where(F.col("source_name") == name).count()}

    def add_documents(self, name: str, rows: DataFrame, privacy: int = 0) -> None:
        """A source from rows with external_id and text, and title if there is one."""
        title = F.col("title") if "title" in rows.columns else F.col("external_id")
        made = rows.select(F.lit(name).alias("source_name"), F.col("external_id").cast("string").alias("external_id"), title.alias("title"), "text", F.lit("Article").alias("content_type"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("depth"), F.lit(privacy).alias("privacy_level"), content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("content_size"))
        self._replace(name, made)

    def update_source(self, name: str, path: str, form: str, privacy: int | None = None, deletions: str = "delete") -> dict[str, int]:
        """Replace by document; how many are new, changed, unchanged and deleted.

        ``deletions``: "delete" what is gone, "keep" it, or "soft": it stays in the store, marked, until it is there
        again or deleted, and no verb sees it.
        """
        if deletions not in ("delete", "keep", "soft"):
            raise ValueError(f"no such policy: {deletions}")
        seen = self._load(name, path, form, privacy)
        known = self.content().where(F.col("source_name") == name)
        if deletions == "keep":
            seen = seen.unionByName(known.join(seen, "external_id", "left_anti").select(*seen.columns))
        diff = catalog.update_diff(known, seen).groupBy("status").count().collect()
        report = {s: 0 for s in ("new", "changed", "unchanged", "deleted")} | {r["status"]: r["count"] for r in diff}
        if report["new"] or report["changed"] or report["deleted"]:
            if deletions == "soft":
                stored = self._stored().where(F.col("source_name") == name)
                seen = seen.unionByName(stored.join(seen, "external_id", "left_anti").withColumn("content_type", F.lit(_DELETED)).select(*seen.columns))
            self._replace(name, seen)
        return report

    def delete(self, name: str) -> None:
        """The source's content and all that was derived of it."""
        for table in ("content", *_DERIVED, "fts/postings", "fts/corpus"):
            self._remove(f"{self.folder}/{table}/{self._part(name)}")

    def list_sources(self) -> DataFrame:
        return catalog.source_list(self.content(), "source_name")

    def status(self) -> DataFrame:
        return catalog.rollup_sizes(self.content(), ["source_name", "content_type"])

    # Search

    def _visible(self, source: str | None, personal_only: bool, public_only: bool):
        where = F.lit(True)
        if source is not None:
            where = where & (F.col("source_name") == source)
        if personal_only:
            where = where & (F.col("privacy_level") > 0)
        if public_only:
            where = where & (F.col("privacy_level") == 0)
        return where

    def _chunked(self, content: DataFrame) -> DataFrame:
        rows = content.where("text is not null")
        article = chunker.chunk(rows.where("content_type <> 'Conversation'"))
        every = article.unionByName(chunker.chunk(rows.where("content_type = 'Conversation'"), conversation=True))
        named = every.withColumn("chunk_id", F.concat_ws("#", "source_name", "external_id", "chunk_index")).withColumnRenamed("chunk", "text")
        return named.select("source_name", "chunk_id", "external_id", "title", "text", "privacy_level")

    def chunks(self) -> DataFrame:
        return self._table("chunks")

    def _found(self, hits: DataFrame, *columns: str) -> DataFrame:
        """``hits`` (chunk_id, of a bounded number) with columns of their chunks, of which no others are read."""
        top = hits.collect()
        hits = self.spark.createDataFrame(top, hits.schema)
        chunks = self.chunks().where(F.col("chunk_id").isin([r.chunk_id for r in top]))
        return F.broadcast(hits).join(chunks.select("chunk_id", *columns), "chunk_id")

    def search(self, query: str, mode: str = "normal", limit: int | None = None, source: str | None = None, personal_only: bool = False, public_only: bool = False, vector_hits: DataFrame | None = None) -> DataFrame:
        """source_name, title, score, rank and snippet. ``vector_hits`` (source_name, title, rank) are fused in."""
        limit = limit or fts.LIMITS[mode]
        named = self._hits(query, 2 * limit, source, personal_only, public_only)
        fused = retrieval.hybrid(named, vector_hits, ["source_name", "title"], limit) if vector_hits is not None else None
        first = named.groupBy("source_name", "title").agg(F.max("score").alias("score"), F.min_by("text", "rank").alias("text"))
        if fused is None:
            return fts.ranked(first.select("source_name", "title", "score", snippet(F.col("text")).alias("snippet")), "score", ["source_name", "title"], limit)
        return fused.join(first.select("source_name", "title", snippet(F.col("text")).alias("snippet")), ["source_name", "title"], "left").orderBy("rank")

    def _hits(self, query: str, limit: int, source: str | None, personal_only: bool, public_only: bool) -> DataFrame:
        """chunk_id, score, rank, source_name, title and text of the best chunks by the full-text index."""
        try:
            hits = fts.search_index(self.spark, f"{self.folder}/fts", query, limit, ("text", "title"), "chunk_id", self._visible(source, personal_only, public_only))
        except AnalysisException:  # nothing was written yet
            hits = self.spark.createDataFrame([], "chunk_id string, score double, rank int")
        return self._found(hits, "source_name", "title", "text")

    def search_all(self, query: str, limit: int = 20, source: str | None = None, personal_only: bool = False, public_only: bool = False, weights: Sequence[float] = (1.0, 1.0, 1.0), expand: bool = False) -> DataFrame:
        """source_name, title, score and rank by full text, vectors and exact substring, fused by rank.

        With ``expand`` the query also asks for the entities most related to those it names.
        """
        asked = query
        if expand:
            words = [w for c in fts.parse(query, ("text", "title")).clauses for w in c.words]
            near = [r.object_name for w in words for r in self._related(w, 3)]
            asked = " ".join([query, *(f'"{n}"^0.5' if " " not in n else f'"{n}"' for n in near)])
        text = self._hits(asked, 2 * limit, source, personal_only, public_only).select("source_name", "title", "rank")
        vector = self.vector_search(query, 2 * limit, source, personal_only, public_only).select("source_name", "title", "rank")
        holds = self.substring(query, 2 * limit, self._visible(source, personal_only, public_only))
        exact = holds.select(F.substring_index("document", ":", 1).alias("source_name"), "title", F.expr("row_number() over (order by document)").alias("rank"))
        return retrieval.fuse([text, vector, exact], ["source_name", "title"], limit, weights=weights)

    def _related(self, name: str, limit: int) -> list:
        entity = graph.find_entity(self.entities(), name).first()
        if entity is None:
            return []
        return graph.relations_from(self._table("relations"), self.entities(), entity.id).groupBy("object_name").count().orderBy(F.desc("count"), "object_name").limit(limit).collect()

    def ask(self, skill: str, question: str) -> DataFrame:
        """A search by one of SKILLS: an answer, hits, or hits gathered by source."""
        how = SKILLS[skill]
        if how["shape"] == "answer":
            return self.lookup(question)
        hits = self.search(question, how["mode"], personal_only=how.get("personal_only", False)).where(F.col("source_name").rlike(how["sources"]))
        if how["shape"] == "by_source":
            return hits.groupBy("source_name").agg(F.count("*").alias("n_hits"), F.max("score").alias("best"), F.sort_array(F.collect_list("title")).alias("titles"))
        return hits

    def embed(self, model: Callable | None = None) -> DataFrame:
        """chunk_id, source_name, title, vector and privacy_level of every chunk, by a given or the bundled embedder.

        A given embedder's vectors are put in place of those that are kept; ``vector_search`` then needs its questions'.
        """
        if model is not None:
            made = self.chunks().select("source_name", "chunk_id", "title", model("text").alias("vector"), "privacy_level")
            self._write("vectors", made)
        return self._table("vectors")

    def vector_search(self, question: str, limit: int = 20, source: str | None = None, personal_only: bool = False, public_only: bool = False, asked: Sequence[float] | None = None) -> DataFrame:
        """source_name, title, score and rank of the nearest chunks' documents, by the kept vectors.

        ``asked`` is the question's vector; the bundled embedder's if none is given.
        """
        from almanac.functions.registry import hashed_vector

        asked, rows = hashed_vector(question) if asked is None else asked, self._table("vectors")
        if asked is None:
            return rows.select("source_name", "title", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).where("1 = 0")
        hits = retrieval.vector_search(rows, asked, limit, "chunk_id", "vector", self._visible(source, personal_only, public_only))
        return self._found(hits, "source_name", "title").select("source_name", "title", "score", "rank").orderBy("rank")

    def substring(self, pattern: str, limit: int = 10, where: Column | None = None) -> DataFrame:
        """document, byte position, context and title of documents that hold the literal, verified on candidates by trigrams."""
        rows = self.content().withColumn("document", F.concat_ws(":", "source_name", "external_id"))
        rows = rows if where is None else rows.where(where)
        if len(pattern) >= 3:
            rows = rows.join(retrieval.trigram_candidates(self._table("trigrams"), pattern, "document"), "document", "left_semi")
        return retrieval.substring_hits(rows, pattern, limit, "document", carry=("title",))

    def read(self, reference: str, section: str | None = None) -> str:
        """The text of ``source:document``, or one section of it."""
        rows = self.content().select("source_name", F.col("external_id").alias("filename"), "text")
        text = F.col("text") if section is None else section_of(F.col("text"), section)
        found = catalog.read_document(rows, reference).select(text.alias("text")).first()
        if found is None or found.text is None:
            raise KeyError(reference if section is None else f"{reference}#{section}")
        return found.text

    # Entities

    def mentions(self) -> DataFrame:
        return self._table("mentions").unionByName(self._table("named"))

    def entities(self) -> DataFrame:
        """Entities of all sources: a name is the first of its spellings, counts are summed."""
        return self._table("entities").groupBy("id").agg(
            F.min("canonical_name").alias("canonical_name"), F.first("description", ignorenulls=True).alias("description"), F.min("entity_types").alias("entity_types"), F.sum("mention_count").alias("mention_count")
        )

    def _known(self, name: str) -> tuple[DataFrame, DataFrame]:
        """All entities, and the relations that go out from the one of that name."""
        entities = self.entities()
        found = graph.find_entity(entities, name).first()
        return entities, self._table("relations").where(F.col("subject_id") == (found.id if found else ""))

    def entity(self, name: str) -> DataFrame:
        entities, relations = self._known(name)
        titles = self.content().select(F.concat_ws(":", "source_name", "external_id").alias("document_id"), "title")
        return graph.entity_card(entities, relations, self.mentions(), titles, name)

    def suggest(self, prefix: str, limit: int = 5) -> DataFrame:
        return graph.prefix_search(self.entities(), prefix, limit)

    def lookup(self, question: str) -> DataFrame:
        """A fact (answer), or else the best three search results."""
        entities, relations = self._known(graph.parse_fact(question)[1])
        fact = graph.fact_lookup(entities, relations, question)
        return fact if not fact.isEmpty() else self.search(question, limit=3).select(F.concat("title", F.lit(": "), "snippet").alias("answer"))

    def enrich(self, step: str, limit: int = 0, source: str | None = None) -> DataFrame:
        """document_id and answer of what the model answered, which is kept: added to the document as a section and
        indexed with it, or as entities of the document.
        """
        rows = self.content().withColumn("document_id", F.concat_ws(":", "source_name", "external_id"))
        rows = rows if source is None else rows.where(F.col("source_name") == source)
        answers = cut_lineage(enrich.enrich(rows, step, self.model, "document_id", limit=limit).where("answer <> ''"))
        touched = rows.join(answers, "document_id", "left_semi").select("source_name").distinct()
        for name in sorted(r.source_name for r in touched.collect()):
            own = self._stored().where(F.col("source_name") == name).withColumn("document_id", F.concat_ws(":", "source_name", "external_id"))
            if step in enrich.SECTIONS:
                added = F.concat("text", F.lit(f"\n\n## {enrich.SECTIONS[step]}\n\n"), "answer")
                joined = own.join(answers, "document_id", "left").withColumn("text", F.coalesce(added, "text"))
                self._replace(name, joined.withColumns({"content_hash": content_hash(F.coalesce("text", F.lit(""))), "content_size": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")}))
            else:
                named = enrich.entities_from(answers.join(own.select("document_id"), "document_id", "left_semi"), "document_id")
                known = self._table("named").where(F.col("source_name") == name).select("entity_id", "document_id", "mention_text")
                self._write("named", cut_lineage(named.unionByName(known).dropDuplicates(["entity_id", "document_id"]).withColumn("source_name", F.lit(name))))
                self._relate(name)
        return answers

    # Archives

    def export(self, path: str, include_personal: bool = False) -> int:
        rows = self.content().select("source_name", F.col("external_id").alias("filename"), "text", "privacy_level")
        return storage.export_archive(rows, path, include_personal)

    def import_(self, path: str) -> Sequence[str]:
        """Sources of an archive, each in place of what it had; their names."""
        rows = storage.import_archive(self.spark, path).withColumnRenamed("filename", "external_id")
        names = sorted(r.source_name for r in rows.select("source_name").distinct().collect())
        for name in names:
            self.add_documents(name, rows.where(F.col("source_name") == name))
        return names
