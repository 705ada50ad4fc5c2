"""Places and clocks, and what addresses say. Coordinates are read off the vectors' first components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.functions import geo
from almanac.operators import tracks
from almanac.plans import Catalogue
from almanac.session import table

CATALOGUE = Catalogue()


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("label", "vec_id", (e[0] * 90).alias("lat"), (e[1] * 180).alias("lon"), (e[2] * 1000).alias("ele"))


_POINTS = "pts as (select label, vec_id, embedding[1]::double * 90 lat, embedding[2]::double * 180 lon, embedding[3]::double * 1000 ele from embeddings)"
_HAVERSINE = "2 * 6371.0::double * asin(least(1.0::double, sqrt(pow(sin(radians({1} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({1})) * pow(sin(radians({3} - {2}) / 2), 2))))"


@CATALOGUE.add(f"""with {_POINTS}, w as (select *, {_HAVERSINE.format('lag(lat) over p', 'lat', 'lag(lon) over p', 'lon')} km from pts window p as (partition by label order by vec_id))
    select label, count(*) as n_points, round(sum(coalesce(km, 0)), 4) as distance_km, round(max(ele), 6) as max_elevation, min(vec_id) as first, max(vec_id) as last from w group by label""")
def haversine_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = tracks.track_stats(_points(spark, sf_dir), ["label"], "vec_id")
    return stats.select("label", "n_points", F.round("distance_km", 4).alias("distance_km"), F.round("max_elevation", 6).alias("max_elevation"), "first", "last")


@CATALOGUE.add(f"with {_POINTS} select vec_id, round({_HAVERSINE.format('10.0::double', 'lat', '20.0::double', 'lon')}, 6) as distance_km from pts where {_HAVERSINE.format('10.0::double', 'lat', '20.0::double', 'lon')} <= 1500")
def nearby(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.nearby(_points(spark, sf_dir), 10.0, 20.0, 1500.0).select("vec_id", F.round("distance_km", 6).alias("distance_km"))


@CATALOGUE.add(None)
def simplify_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.simplify(_points(spark, sf_dir), "label", "vec_id", 20.0).select("label", "vec_id")


@CATALOGUE.add("""select event_id, make_timestamp((epoch_us(date_trunc('second', ts)) + 11644473600000000) - 11644473600000000) as chrome, make_timestamp(epoch_us(date_trunc('second', ts))) as firefox from events""")
def browser_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", geo.webkit_time(us + geo.WEBKIT_OFFSET).cast("timestamp_ntz").alias("chrome"), geo.unix_time(us).cast("timestamp_ntz").alias("firefox"))


@CATALOGUE.add("select page_id, regexp_extract(url, '://([^/?#]*)', 1) as host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) as path, regexp_extract(url, '\\?([^#]*)', 1) as query from pages")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda pattern: F.regexp_extract("url", pattern, 1)
    return table(spark, sf_dir, "pages").select("page_id", part("://([^/?#]*)").alias("host"), part("://[^/?#]*([^?#]*)").alias("path"), part(r"\?([^#]*)").alias("query"))


@CATALOGUE.add("""select 'wiki:' || lower(replace(name, ' ', '_')) as id, min(name) as canonical_name, count(distinct page_id) as mention_count
    from (select page_id, replace(regexp_extract(url, '://[^/]*/[a-z]+/([^/?#.]*)', 1), '_', ' ') as name from pages) where name <> '' group by 1""")
def url_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the path of an address names, below its language."""
    from almanac.functions.text import entity_id

    name = F.translate(F.regexp_extract("url", "://[^/]*/[a-z]+/([^/?#.]*)", 1), "_", " ")
    rows = table(spark, sf_dir, "pages").select("page_id", name.alias("name")).where("name <> ''")
    return rows.groupBy(entity_id("wiki", F.col("name")).alias("id")).agg(F.min("name").alias("canonical_name"), F.countDistinct("page_id").alias("mention_count"))
