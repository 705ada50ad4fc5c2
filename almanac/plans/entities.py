"""Link entities of pages, and the star schema as a graph of entities and relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.functions import text as T
from almanac.operators import graph
from almanac.plans import Catalogue
from almanac.session import table

CATALOGUE = Catalogue()


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.transform(T.links(F.col("html")), lambda x: F.regexp_replace(x, "^/", ""))
    return graph.mentions_of(table(spark, sf_dir, "pages"), names, key="page_id", source=F.lit("web"))


_MENTIONS = """m0 as (select cast(page_id as varchar) document_id, unnest(list_transform(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda x: regexp_replace(x, '^/', ''))) mention_text from pages),
    mentions as (select 'wiki:' || translate(lower(mention_text), ' <>@', '____') entity_id, document_id, 'web' as source_name, min(mention_text) mention_text from m0 where mention_text <> '' group by 1, 2),
    entities as (select entity_id id, min(mention_text) canonical_name, count(distinct document_id) mention_count from mentions group by 1)"""


@CATALOGUE.add(f"with {_MENTIONS} select * from mentions")
def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mentions(spark, sf_dir)


@CATALOGUE.add(f"with {_MENTIONS} select id, canonical_name, mention_count from entities")
def link_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.entities_of(_mentions(spark, sf_dir)).select("id", "canonical_name", "mention_count")


@CATALOGUE.add(f"with {_MENTIONS} select a.entity_id as subject_id, b.entity_id as object_id, count(*) as n from mentions a join mentions b using (document_id) where a.entity_id < b.entity_id group by 1, 2")
def entity_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cooccurrences(_mentions(spark, sf_dir)).groupBy("subject_id", "object_id").agg(F.count("*").alias("n"))


def _page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("document_id"), T.html_title(F.col("html")).alias("title"))


_TITLES = "titles as (select cast(page_id as varchar) document_id, regexp_extract(html, '<title[^>]*>(.*?)</title>', 1) title from pages)"


@CATALOGUE.add(f"with {_MENTIONS}, {_TITLES} select document_id, title from mentions join titles using (document_id) where entity_id = 'wiki:the' order by title, document_id limit 50")
def entity_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.documents_of(_mentions(spark, sf_dir), _page_titles(spark, sf_dir), "wiki:the")


@CATALOGUE.add(f"with {_MENTIONS} select id, canonical_name, mention_count from entities where starts_with(lower(canonical_name), 'th') order by mention_count desc, canonical_name, id limit 5")
def entity_prefix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.prefix_search(graph.entities_of(_mentions(spark, sf_dir)), "Th", 5)


@CATALOGUE.add(f"""with {_MENTIONS}, {_TITLES}, e as (select * from entities where lower(canonical_name) = 'the' order by id limit 1),
    d as (select title from mentions join titles using (document_id) where entity_id = (select id from e) order by title, document_id limit 50),
    r as (select count(*) n from mentions a join mentions b using (document_id) where a.entity_id = (select id from e) and b.entity_id > a.entity_id)
    select id, canonical_name, mention_count, (select string_agg(title, '|' order by title) from d) as documents, cast((select n from r) as integer) as n_relations from e""")
def entity_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = _mentions(spark, sf_dir)
    entities = graph.entities_of(mentions)
    card = graph.entity_card(entities, graph.cooccurrences(mentions, graph.find_entity(entities, "THE")), mentions, _page_titles(spark, sf_dir), "THE")
    return card.select("id", "canonical_name", "mention_count", F.array_join("documents", "|").alias("documents"), F.coalesce(F.size("relations"), F.lit(0)).alias("n_relations"))


# The star schema: regions, nations, customers and suppliers


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    read = lambda name: table(spark, sf_dir, name)
    ident = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c))
    parts = [(read("region"), "region", "r_regionkey", "r_name"), (read("nation"), "nation", "n_nationkey", "n_name"), (read("customer"), "customer", "c_custkey", "c_name"), (read("supplier"), "supplier", "s_suppkey", "s_name")]
    nodes = [df.select(ident(kind, key).alias("id"), F.col(name).alias("canonical_name"), F.lit(f"a {kind}").alias("description"), F.array(F.lit(kind)).alias("entity_types"), F.lit(1).cast("long").alias("mention_count")) for df, kind, key, name in parts]
    ends = [("nation", "n_nationkey", "in_region", "region", "n_regionkey"), ("customer", "c_custkey", "has_nation", "nation", "c_nationkey"), ("supplier", "s_suppkey", "has_nation", "nation", "s_nationkey")]
    edges = [read(a).select(ident(a, k).alias("subject_id"), F.lit(p).alias("predicate"), ident(b, fk).alias("object_id"), F.lit("star").alias("source_name"), F.lit(1.0).alias("confidence")) for a, k, p, b, fk in ends]
    entities, relations = nodes[0], edges[0]
    for n in nodes[1:]:
        entities = entities.unionByName(n)
    for e in edges[1:]:
        relations = relations.unionByName(e)
    return entities, graph.valid_relations(relations, entities)


_GRAPH = """nodes as (select 'region:' || r_regionkey id, r_name name, 'a region' about from region union all select 'nation:' || n_nationkey, n_name, 'a nation' from nation
        union all select 'customer:' || c_custkey, c_name, 'a customer' from customer union all select 'supplier:' || s_suppkey, s_name, 'a supplier' from supplier),
    edges0 as (select 'nation:' || n_nationkey s, 'in_region' p, 'region:' || n_regionkey o from nation union all select 'customer:' || c_custkey, 'has_nation', 'nation:' || c_nationkey from customer
        union all select 'supplier:' || s_suppkey, 'has_nation', 'nation:' || s_nationkey from supplier),
    edges as (select * from edges0 where s in (select id from nodes) and o in (select id from nodes))"""


@CATALOGUE.add(f"with {_GRAPH} select s as subject_id, p as predicate, o as object_id, name as object_name, 1.0::double as confidence from edges join nodes on o = id")
def entity_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, relations = _graph(spark, sf_dir)
    return graph.relations_from(relations, entities, entities.select("id"))


@CATALOGUE.add(f"""with {_GRAPH}, first as (select name from nodes where id = 'nation:7')
    select n.name || ': in_region → ' || r.name as answer from nodes n join edges on s = n.id join nodes r on o = r.id where n.name = (select name from first)
    union all select name || ': a customer' from nodes where id = 'customer:1'""")
def fact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region of a nation, and what is known of a customer whose age no relation tells."""
    entities, relations = _graph(spark, sf_dir)
    nation, customer = (entities.where(F.col("id") == i).first().canonical_name for i in ("nation:7", "customer:1"))
    return graph.fact_lookup(entities, relations, f"region of {nation}").unionByName(graph.fact_lookup(entities, relations, f"age of {customer}"))


@CATALOGUE.add(f"""with {_GRAPH} select a.s as start, a.o as node, 1 as distance from edges a where a.s like 'customer:%' union all select a.s, b.o, 2 from edges a join edges b on a.o = b.s where a.s like 'customer:%'""")
def graph_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, relations = _graph(spark, sf_dir)
    return graph.hops(relations, entities.where(F.array_contains("entity_types", "customer")).select("id"), 2)


@CATALOGUE.add(f"""with recursive {_GRAPH}, r as (select s as start, o as node, 1 as distance from edges union all select r.start, e.o, r.distance + 1 from r join edges e on r.node = e.s where r.distance < 4)
    select start, node, min(distance) as distance from r group by start, node""")
def graph_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, relations = _graph(spark, sf_dir)
    return graph.hops(relations, entities.select("id"), 4)


@CATALOGUE.add(f"""with {_GRAPH}, d as (select id, count(*) degree from (select s id from edges union all select o from edges) group by id)
    select id, degree, round(degree / (select max(degree) from d)::double, 9) as centrality from d""")
def degree_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degree_centrality(_graph(spark, sf_dir)[1])


@CATALOGUE.add("""select cast(o_custkey as varchar) as subject_id, o_orderstatus as object_id, o_orderdate as valid_from from orders
    qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderstatus) = 1""")
def current_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's last order status; a later order supersedes."""
    orders = table(spark, sf_dir, "orders")
    facts = orders.select(F.col("o_custkey").cast("string").alias("subject_id"), F.lit("status").alias("predicate"), F.col("o_orderstatus").alias("object_id"), F.col("o_orderdate").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_until"))
    return graph.current_facts(facts).select("subject_id", "object_id", "valid_from")


@CATALOGUE.add(f"""with {_MENTIONS}, more as (select id, canonical_name, 1 mention_count from entities union all select 'wiki:' || translate(lower(n_name), ' <>@', '____'), n_name, 1 from nation)
    select e.id as id, coalesce(min(k.canonical_name), min(e.canonical_name)) as canonical_name, cast(coalesce(min(k.mention_count), 0) + sum(e.mention_count) as bigint) as mention_count from more e left join entities k on k.id = e.id group by e.id""")
def entity_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link entities, met once more each, together with nations that are new."""
    known = graph.entities_of(_mentions(spark, sf_dir))
    again = known.withColumn("mention_count", F.lit(1).cast("long"))
    nations = table(spark, sf_dir, "nation").select(T.entity_id("wiki", F.col("n_name")).alias("id"), F.col("n_name").alias("canonical_name"), F.lit(None).cast("string").alias("description"), F.array(F.lit("nation")).alias("entity_types"), F.lit(1).cast("long").alias("mention_count"))
    return graph.upsert_entities(known, again.unionByName(nations)).select("id", "canonical_name", "mention_count")
