"""Segments of streams of messages: gaps, windows, threads, rendering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions.text import entity_id


def gap_segments(messages: DataFrame, by: str, ts: str, order: str, gap: str = "2 hours") -> DataFrame:
    """``messages`` with segment, from 0: a new one begins where more than ``gap`` lies behind a message's forerunner."""
    within = Window.partitionBy(by).orderBy(ts, order)
    begins = F.lag(ts).over(within) < F.expr(f"{ts} - interval {gap}")
    return messages.withColumn("segment", F.sum(F.coalesce(begins, F.lit(False)).cast("long")).over(within.rowsBetween(Window.unboundedPreceding, 0)))


def segment_name(segment: Column) -> Column:
    return F.format_string("segment_%04d", segment.cast("int"))


def render(messages: DataFrame, by: Sequence[str], order: str, line: Column) -> DataFrame:
    """The lines of each group, in order, as one text; a group is one conversation's segment."""
    lines = F.sort_array(F.collect_list(F.struct(F.col(order).alias("_order"), line.alias("_line"))))
    grouped = messages.groupBy(*by).agg(F.count("*").alias("n_messages"), lines.alias("_lines"))
    return grouped.select(*by, "n_messages", F.array_join(F.transform("_lines", lambda x: x["_line"]), "\n").alias("text"))


def sliding_windows(messages: DataFrame, by: str, order: str, size: int = 10, step: int = 5) -> DataFrame:
    """Messages once for each window that holds them: window_start is the number, from 0, of its first message.

    Windows begin every ``step`` messages, as long as there are any.
    """
    numbered = messages.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1)
    first = F.greatest(F.lit(0), F.floor((F.col("_n") - size) / step) + 1)
    starts = F.transform(F.sequence(first, F.floor(F.col("_n") / step)), lambda w: w * step)
    return numbered.withColumn("window_start", F.explode(starts)).drop("_n")


def thread_roots(messages: DataFrame, key: str, parent: str) -> DataFrame:
    """Messages that answer none that is there."""
    known = messages.select(F.col(key).alias("_known"))
    return messages.join(known, messages[parent] == known["_known"], "left_anti")


def thread_closure(messages: DataFrame, key: str, parent: str) -> DataFrame:
    """key, root and depth: each message with the root of its thread, by pointer jumping.

    After n rounds paths of 2^n answers are resolved. As long as a path is open each round resolves some, so rounds end
    when none is left or no fewer are. These answer in a circle: their root is its smallest key, their depth null.
    """
    from almanac.session import cut_lineage

    known = messages.select(F.col(key).alias("node"), F.col(parent).alias("up"))
    there = known.select(F.col("node").alias("up"))
    inner = known.join(there, "up", "left_semi").select("node", "up", F.lit(1).cast("long").alias("depth"))
    tops = known.join(there, "up", "left_anti").select("node", F.col("node").alias("up"), F.lit(0).cast("long").alias("depth"))
    state, top, before = tops.unionByName(inner), tops.select(F.col("node").alias("up")), None
    while True:
        open_ = state.join(top, "up", "left_anti").agg(F.count_distinct("node")).first()[0]
        if open_ in (0, before):
            break
        before = open_
        above = state.select(F.col("node").alias("up"), F.col("up").alias("_top"), F.col("depth").alias("_more"))
        state = cut_lineage(state.join(above, "up").select("node", F.col("_top").alias("up"), (F.col("depth") + F.col("_more")).alias("depth")))
    if open_:
        ring = known.join(state.join(top, "up", "left_anti").select("node").distinct(), "node", "left_semi").select("node", "up", F.col("node").alias("least"))
        covered = 1
        while covered < open_:
            above = ring.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("least").alias("_least"))
            ring = cut_lineage(ring.join(above, "up").select("node", F.col("_up").alias("up"), F.least("least", "_least").alias("least")))
            covered *= 2
        # so far up, each has come to its circle
        circles = ring.select("node", "up").join(ring.select(F.col("node").alias("up"), "least"), "up").select("node", F.col("least").alias("up"), F.lit(None).cast("long").alias("depth"))
        state = state.join(top, "up", "left_semi").select("node", "up", "depth").unionByName(circles)
    return state.select(F.col("node").alias(key), F.col("up").alias("root"), "depth")


def contacts(messages: DataFrame, name: str) -> DataFrame:
    """id and canonical_name of the distinct people who wrote."""
    people = messages.where(F.col(name).isNotNull() & (F.col(name) != "")).select(F.col(name).alias("canonical_name")).distinct()
    return people.select(entity_id("person", F.col("canonical_name")).alias("id"), "canonical_name")
