"""Segments, windows, threads and sessions of the message and event tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.operators import catalog, sessions
from almanac.plans import Catalogue
from almanac.session import shared_folder, table
from almanac.streaming import live

CATALOGUE = Catalogue()

_GAPS = """gaps as (select *, case when ts > lag(ts) over (partition by user_id order by ts, event_id) + interval 2 hours then 1 else 0 end g from events),
    seg as (select *, cast(sum(g) over (partition by user_id order by ts, event_id) as bigint) segment from gaps)"""


@CATALOGUE.add(f"with {_GAPS} select event_id, user_id, segment from seg")
def gap_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.gap_segments(table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("event_id", "user_id", "segment")


@CATALOGUE.add(f"with {_GAPS} select user_id, printf('segment_%04d', segment) as name, count(*) as n_events, string_agg(event_type, ',' order by event_id) as types from seg group by user_id, segment")
def gap_segment_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = sessions.gap_segments(table(spark, sf_dir, "events"), "user_id", "ts", "event_id")
    texts = sessions.render(cut, ["user_id", "segment"], "event_id", F.col("event_type"))
    return texts.select("user_id", sessions.segment_name(F.col("segment")).alias("name"), F.col("n_messages").alias("n_events"), F.replace("text", F.lit("\n"), F.lit(",")).alias("types"))


@CATALOGUE.add("select conv_id, count(*) as n_messages, string_agg(role || ': ' || text, chr(10) order by turn) as text from conversations group by conv_id")
def chat_segments_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.render(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", F.concat("role", F.lit(": "), "text"))


@CATALOGUE.add("""with n as (select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 n from conversations),
    w as (select conv_id, turn, n, unnest(range(0, n + 1, 2)) window_start from n)
    select conv_id, turn, cast(window_start as bigint) as window_start from w where n - window_start < 3""")
def chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.sliding_windows(table(spark, sf_dir, "conversations"), "conv_id", "turn", 3, 2).select("conv_id", "turn", "window_start")


@CATALOGUE.add("select distinct 'person:' || translate(lower(role), ' <>@', '____') as id, role as canonical_name from conversations")
def contacts_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.contacts(table(spark, sf_dir, "conversations"), "role")


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda turn: F.concat_ws("_", "conv_id", turn)
    return table(spark, sf_dir, "conversations").select(name(F.col("turn")).alias("message_id"), name(F.col("turn") - 1).alias("in_reply_to"))


@CATALOGUE.add("select conv_id || '_' || turn as message_id from conversations c where not exists (select 1 from conversations p where p.conv_id = c.conv_id and p.turn = c.turn - 1)")
def thread_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.thread_roots(_answers(spark, sf_dir), "message_id", "in_reply_to").select("message_id")


@CATALOGUE.add("""with recursive t as (select conv_id, turn, conv_id || '_' || turn root, 0 depth from conversations c where not exists (select 1 from conversations p where p.conv_id = c.conv_id and p.turn = c.turn - 1)
    union all select c.conv_id, c.turn, t.root, t.depth + 1 from t join conversations c on c.conv_id = t.conv_id and c.turn = t.turn + 1)
    select conv_id || '_' || turn as message_id, root, cast(depth as bigint) as depth from t""")
def thread_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.thread_closure(_answers(spark, sf_dir), "message_id", "in_reply_to")


_SESSIONS = f"with {_GAPS} select user_id, min(ts) as session_start, max(ts) as session_end, count(*) as n_events from seg group by user_id, segment"


@CATALOGUE.add(_SESSIONS)
def batch_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = live.sessions(table(spark, sf_dir, "events"))
    return found.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n_events")


@CATALOGUE.add(_SESSIONS)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream over the table's files, run until it is exhausted."""
    path, folder = f"{sf_dir}/[e]vents.parquet", f"{shared_folder(spark)}/sessions-{uuid.uuid4().hex}"
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(path)  # a pattern names a file or a folder alike
    found = live.sessions(events).select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n_events")
    writer = found.writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/out"))
    writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@CATALOGUE.add("select event_type, date_trunc('hour', ts) as window_start, count(*) as n_events from events group by 1, 2")
def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = live.counts(table(spark, sf_dir, "events"), "1 hour", by=["event_type"])
    return found.select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n_events")


@CATALOGUE.add("select event_id, user_id, ts, event_type from events where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-12'")
def timeline_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.where((F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-12").cast("timestamp_ntz"))).select("event_id", "user_id", "ts", "event_type")


@CATALOGUE.add("""select a.event_id as signup_id, b.event_id as purchase_id from events a join events b on a.event_type = 'signup' and b.event_type = 'purchase'
    and abs(epoch(date_trunc('second', a.ts)) - epoch(date_trunc('second', b.ts))) <= 30""")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    a = events.where("event_type = 'signup'").select(F.col("event_id").alias("signup_id"), F.col("ts").alias("a_ts"))
    b = events.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), F.col("ts").alias("b_ts"))
    return catalog.interval_join(a, b, "a_ts", "b_ts", 30).select("signup_id", "purchase_id")
