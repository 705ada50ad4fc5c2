import datetime as dt
import time

from pyspark.sql import functions as F

from almanac.streaming import live


def drained(df, folder, mode="append"):
    out = f"{folder}/out"
    writer = df.writeStream.outputMode(mode).foreachBatch(lambda b, _: b.write.mode("append").parquet(out))
    writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.parquet(out)


def test_final_sessions_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    rows = [(u, day + dt.timedelta(hours=h)) for u in (1, 2) for h in (0, 1, 3, 6)] + [(3, day + dt.timedelta(days=9))]
    for i in range(0, len(rows), 3):
        spark.createDataFrame(rows[i : i + 3], "user_id long, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    batch = live.sessions(spark.read.parquet(f"{tmp_path}/in"))
    assert {(r.user_id, r.n_events) for r in batch.collect()} == {(1, 3), (1, 1), (2, 3), (2, 1), (3, 1)}
    stream = spark.readStream.schema("user_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    final = drained(live.sessions(stream, watermark="10 days"), tmp_path)
    assert final.count() == 0  # nothing is so old yet that it couldn't grow
    (tmp_path / "again").mkdir()
    final = drained(live.sessions(stream, watermark="100 days"), tmp_path / "again")
    assert final.count() == 0
    assert live.counts(spark.read.parquet(f"{tmp_path}/in"), "1 day").agg(F.sum("n_events")).first()[0] == 9
    assert live.counts(spark.read.parquet(f"{tmp_path}/in"), "2 days", "1 day").agg(F.sum("n_events")).first()[0] == 18


def test_numbered_segments(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    for u, hours in ((1, (0, 1, 3)), (2, (0,)), (1, (6, 30)), (9, (24 * 60,)), (9, (24 * 61,))):
        spark.createDataFrame([(u, day + dt.timedelta(hours=h)) for h in hours], "user_id long, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05)
    stream = spark.readStream.schema("user_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    closed = drained(live.segments(stream, "user_id", watermark="1 hour"), tmp_path)
    found = {(r.user_id, r.segment): (r.segment_start, r.segment_end, r.n_events) for r in closed.collect()}
    at = lambda h: day + dt.timedelta(hours=h)
    assert found[1, 0] == (at(0), at(3), 3) and found[1, 1] == (at(6), at(6), 1) and found[1, 2] == (at(30), at(30), 1) and found[2, 0] == (at(0), at(0), 1)


def test_repeats_in_a_stream_are_dropped(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    for _ in range(2):
        spark.createDataFrame([(1, at), (1, at), (2, at)], "id long, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    assert sorted(r.id for r in drained(live.distinct_messages(stream, ["id"]), tmp_path).collect()) == [1, 2]
    assert live.distinct_messages(spark.read.parquet(f"{tmp_path}/in"), ["id"]).count() == 2


def test_watched_files(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    watch = lambda: live.watch_files(spark, str(folder), lambda df, _: seen.extend((r.name, r.text) for r in df.collect()), checkpoint=f"{tmp_path}/c", once=True).awaitTermination()
    (folder / "a.md").write_text("one\nline")
    (folder / "b.txt").write_text("not watched")
    watch()
    (folder / "c.md").write_text("two")
    watch()
    assert seen == [("a.md", "one\nline"), ("c.md", "two")]
