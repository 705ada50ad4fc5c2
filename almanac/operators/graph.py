"""Entities, mentions and relations; cards, facts, prefix search and traversal over them.

Tables: entities (id, canonical_name, description, entity_types, mention_count), mentions (entity_id, document_id,
source_name, mention_text; one row for a document and entity), relations (subject_id, predicate, object_id,
source_name, confidence; rows may repeat, as different documents may say the same).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions.geo import EARTH_KM, haversine_km
from almanac.functions.text import entity_id


def mentions_of(docs: DataFrame, names: Column, kind: str = "wiki", key: str = "doc_id", source: Column | None = None) -> DataFrame:
    """One row for each document and entity that its array of names mentions, with the first of its spellings."""
    exploded = docs.select(F.col(key).cast("string").alias("document_id"), (source if source is not None else F.lit("")).alias("source_name"), F.explode(names).alias("mention_text"))
    named = exploded.where(F.col("mention_text").isNotNull() & (F.col("mention_text") != "")).withColumn("entity_id", entity_id(kind, F.col("mention_text")))
    return named.groupBy("entity_id", "document_id", "source_name").agg(F.min("mention_text").alias("mention_text"))


def entities_of(mentions: DataFrame, entity_type: str = "Concept") -> DataFrame:
    """One row for each entity, named by the first of its spellings; mention_count counts documents."""
    return mentions.groupBy(F.col("entity_id").alias("id")).agg(
        F.min("mention_text").alias("canonical_name"), F.lit(None).cast("string").alias("description"), F.array(F.lit(entity_type)).alias("entity_types"), F.countDistinct("document_id").alias("mention_count")
    )


def cooccurrences(mentions: DataFrame, subjects: DataFrame | None = None) -> DataFrame:
    """Relations ``co_occurs_with`` between entities of one document, the smaller id as subject, one for each document.

    With ``subjects`` (id) only theirs, from the documents that mention them.
    """
    own = mentions if subjects is None else mentions.join(subjects.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    a = own.select("document_id", "source_name", F.col("entity_id").alias("subject_id"))
    b = mentions.select("document_id", F.col("entity_id").alias("object_id"))
    pairs = a.join(b, "document_id").where("subject_id < object_id")
    return pairs.select("subject_id", F.lit("co_occurs_with").alias("predicate"), "object_id", "source_name", F.lit(0.5).alias("confidence"))


def upsert_entities(known: DataFrame, new: DataFrame) -> DataFrame:
    """Counts add up, the first name and types stay, the last description that isn't null wins."""
    every = known.withColumn("_turn", F.lit(0)).unionByName(new.withColumn("_turn", F.lit(1)))
    merged = every.groupBy("id").agg(
        F.min_by("canonical_name", "_turn").alias("canonical_name"),
        F.max_by("description", F.when(F.col("description").isNotNull(), F.col("_turn"))).alias("description"),
        F.min_by("entity_types", "_turn").alias("entity_types"),
        F.sum("mention_count").alias("mention_count"),
    )
    return merged


def valid_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations both of whose ends are entities, whenever those arrived."""
    ids = entities.select("id")
    return relations.join(ids.withColumnRenamed("id", "subject_id"), "subject_id", "left_semi").join(ids.withColumnRenamed("id", "object_id"), "object_id", "left_semi").select(*relations.columns)


def find_entity(entities: DataFrame, name: str) -> DataFrame:
    """The entity of that name, whatever its case; of several the smallest id."""
    return entities.where(F.lower("canonical_name") == name.lower()).orderBy("id").limit(1)


def prefix_search(entities: DataFrame, prefix: str, limit: int | None = 5) -> DataFrame:
    """Names that begin so, whatever their case, most mentioned first."""
    found = entities.where(F.startswith(F.lower("canonical_name"), F.lit(prefix.lower()))).select("id", "canonical_name", "mention_count")
    return found if limit is None else found.orderBy(F.desc("mention_count"), "canonical_name", "id").limit(limit)


def relations_from(relations: DataFrame, entities: DataFrame, subjects: DataFrame | str) -> DataFrame:
    """subject_id, predicate, object_id, object_name and confidence of what goes out from the subjects."""
    out = relations.where(F.col("subject_id") == subjects) if isinstance(subjects, str) else relations.join(subjects.select(F.col("id").alias("subject_id")), "subject_id", "left_semi")
    names = entities.select(F.col("id").alias("object_id"), F.col("canonical_name").alias("object_name"))
    return out.join(names, "object_id").select("subject_id", "predicate", "object_id", "object_name", "confidence")


def documents_of(mentions: DataFrame, titles: DataFrame, entity: str, limit: int = 50) -> DataFrame:
    """document_id and title of an entity's documents, by title."""
    found = mentions.where(F.col("entity_id") == entity).select("document_id").join(titles.select("document_id", "title"), "document_id")
    return found.orderBy("title", "document_id").limit(limit)


def entity_card(entities: DataFrame, relations: DataFrame, mentions: DataFrame, titles: DataFrame, name: str, documents: int = 50) -> DataFrame:
    """The entity's row with arrays of its relations (surest first) and of its documents' titles."""
    entity = find_entity(entities, name)
    ids = entity.select("id")
    rel = relations_from(relations, entities, ids).groupBy(F.col("subject_id").alias("id"))
    rel = rel.agg(F.sort_array(F.collect_list(F.struct((-F.col("confidence")).alias("order"), "predicate", F.col("object_name").alias("target")))).alias("relations"))
    per_entity = mentions.join(ids.withColumnRenamed("id", "entity_id"), "entity_id", "left_semi").join(titles.select("document_id", "title"), "document_id")
    docs = per_entity.orderBy("title", "document_id").limit(documents).groupBy(F.col("entity_id").alias("id")).agg(F.sort_array(F.collect_list("title")).alias("documents"))
    return entity.join(rel, "id", "left").join(docs, "id", "left")


def parse_fact(question: str) -> tuple[str, str]:
    """(hint, entity): ``hint of entity``, else the first word and the rest."""
    hint, of, entity = question.strip().partition(" of ")
    if not of:
        hint, _, entity = question.strip().partition(" ")
    return hint.strip().lower(), entity.strip()


def fact_lookup(entities: DataFrame, relations: DataFrame, question: str) -> DataFrame:
    """One row with an answer: the surest relation whose predicate holds the hint or is held by it, else the
    entity's description; no row where there is neither.
    """
    hint, name = parse_fact(question)
    entity = find_entity(entities, name)
    said = relations_from(relations, entities, entity.select("id"))
    predicate = F.lower("predicate")
    fits = said.where(F.contains(predicate, F.lit(hint)) | F.contains(F.lit(hint), predicate)).withColumnRenamed("subject_id", "id")
    best = fits.orderBy(F.desc("confidence"), "predicate", "object_name").limit(1)
    answered = entity.select("id", "canonical_name", "description").join(best, "id", "left")
    relation = F.concat("canonical_name", F.lit(": "), "predicate", F.lit(" → "), "object_name")
    about = F.concat("canonical_name", F.lit(": "), "description")
    return answered.select(F.coalesce(relation, about).alias("answer")).where("answer is not null")


def hops(relations: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """start, node and distance (at least 1, the shortest) of all that directed paths of at most ``depth`` edges reach.

    Breadth first: each round joins the frontier only, and what was reached before is taken out of it.
    """
    from almanac.session import cut_lineage

    edges = cut_lineage(relations.select("subject_id", "object_id").distinct())
    frontier = starts.select(F.col("id").alias("start"), F.col("id").alias("node")).distinct()
    reached = None
    for distance in range(1, depth + 1):
        step = frontier.join(edges, frontier.node == edges.subject_id).select("start", F.col("object_id").alias("node")).distinct()
        step = step.where("start <> node")
        if reached is not None:
            step = step.join(reached, ["start", "node"], "left_anti")
        # each round is written, so that the plan doesn't double with the next
        found = cut_lineage(step.withColumn("distance", F.lit(distance))) if depth > 2 else step.withColumn("distance", F.lit(distance))
        reached = found if reached is None else reached.unionByName(found)
        frontier = found.select("start", "node")
    return reached


def shortest_path(relations: DataFrame, start: str, end: str, depth: int = 6) -> list[str] | None:
    """Nodes of a shortest directed path of at most ``depth`` edges, the first by id at each step; None if there is none.

    Breadth first from the start; each round keeps for a node the smallest of those it was reached from.
    """
    from almanac.session import cut_lineage

    if start == end:
        return [start]
    edges = relations.select("subject_id", "object_id").where("subject_id <> object_id").distinct()
    spark = relations.sparkSession
    seen = frontier = spark.createDataFrame([(start, None)], "node string, came string")
    for _ in range(depth):
        step = edges.join(frontier.select(F.col("node").alias("subject_id")), "subject_id").groupBy(F.col("object_id").alias("node")).agg(F.min("subject_id").alias("came"))
        frontier = cut_lineage(step.join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            return None
        seen = seen.unionByName(frontier)
        if not frontier.where(F.col("node") == end).isEmpty():
            break
    else:
        return None
    path = [end]
    while path[-1] != start:  # as many steps as the path has
        path.append(seen.where(F.col("node") == path[-1]).first().came)
    return path[::-1]


def degree_centrality(relations: DataFrame) -> DataFrame:
    """id, degree (edges in and out) and centrality, the degree's share of the largest."""
    ends = relations.select(F.explode(F.array("subject_id", "object_id")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    most = ends.agg(F.max("degree").alias("_most"))
    return ends.crossJoin(F.broadcast(most)).select("id", "degree", F.round(F.col("degree") / F.col("_most"), 9).alias("centrality"))


def match_entities(left: DataFrame, right: DataFrame, by: str = "title", threshold: float = 0.0) -> DataFrame:
    """left_id, right_id of entities of two sources that are one by ``id``, by normalised ``title``, or by ``place``.

    Places (lat, lon) match within ``threshold`` kilometres: an equi-join on cells of a grid at least that coarse, each
    left place standing in the cells around its own, then the exact distance.
    """
    if by == "id":
        return left.select(F.col("id").alias("left_id")).join(right.select(F.col("id").alias("right_id")), F.col("left_id") == F.col("right_id"))
    if by == "place":
        return _match_places(left, right, threshold)
    norm = F.regexp_replace(F.lower("canonical_name"), r"[^\p{L}\p{N}]+", "")
    a = left.select(F.col("id").alias("left_id"), norm.alias("_title")).where("_title <> ''")
    return a.join(right.select(F.col("id").alias("right_id"), norm.alias("_title")), "_title").select("left_id", "right_id")


def _match_places(left: DataFrame, right: DataFrame, km: float) -> DataFrame:
    """Cells are bands of latitude by bands of longitude that widen with the band's largest |latitude|; both wrap."""
    step = max(1e-6, math.degrees(km / EARTH_KM))
    band = F.floor(F.col("lat") / step)
    widest = lambda b: F.least(F.lit(90.0), (F.greatest(F.abs(b), F.abs(b + 1)) + 1) * step)  # noqa: E731  of the band and its neighbours
    # how far apart in longitude two such places can lie at most, in degrees; all around near the poles
    reach = lambda b: F.degrees(2 * F.asin(F.least(F.lit(1.0), math.sin(math.radians(min(180.0, step)) / 2) / F.cos(F.radians(widest(b))))))
    columns = lambda b: F.greatest(F.lit(1), F.floor(360 / reach(b)))
    column = lambda b, lon: F.floor(F.pmod(lon + 180, F.lit(360.0)) / 360 * columns(b))
    a = left.select(F.col("id").alias("left_id"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon")).where("_lat is not null and _lon is not null")
    a = a.withColumn("_band", F.explode(F.sequence(F.floor(F.col("_lat") / step) - 1, F.floor(F.col("_lat") / step) + 1)))
    around = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(column(F.col("_band"), F.col("_lon")) + d, columns(F.col("_band")))))
    a = a.withColumn("_column", F.explode(around))
    b = right.where("lat is not null and lon is not null").select(F.col("id").alias("right_id"), "lat", "lon", band.alias("_band"))
    b = b.withColumn("_column", F.pmod(column(F.col("_band"), F.col("lon")), columns(F.col("_band"))))
    near = a.join(b, ["_band", "_column"]).where(haversine_km(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")) <= km)
    return near.select("left_id", "right_id").distinct()


def current_facts(facts: DataFrame, key: Sequence[str] = ("subject_id", "predicate")) -> DataFrame:
    """Of bi-temporal facts (valid_from, valid_until), those still valid; a later one supersedes its forerunners."""
    w = Window.partitionBy(*key).orderBy(F.desc("valid_from"), "object_id")
    return facts.where("valid_until is null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
