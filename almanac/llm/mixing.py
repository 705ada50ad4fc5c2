"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks. DataFrame operations only.

1. *Targets.* Sources weigh ``weights`` in turn, by code point, null last, and share ``share`` of all words. A target
   stops at ``epochs`` times its source's size; the excess goes to the others by weight until none is above.
2. *Quotas.* All blocks of ``block`` words are dealt to sources by highest quotients target / (2 seats + 1), and each
   source's blocks to its shards in the same way by the shards' sizes. A divisor gives each party its rounded share;
   only the few seats that remain are then ranked by quotient, so no list of all quotients is made.
3. *Selection.* A shard's words are one row of blocks. Each block is taken as often as the quota goes into the number
   of blocks, and for the remainder the blocks of the smallest seeded hash once more, so none exceeds ``epochs``.

Documents fall into shards by a hash of id and text, a shard for each ``shard_words`` words of its source, so a source
that holds a third of all rows is many shards. The documents are shuffled once, without their texts.

Defined results: null or empty texts have size 0 and take no words. A null source is a source. Equal rows (of one id
and text) lie next to each other and are told apart by nothing, so their words taken are dealt evenly: each takes the
mean, rounded down, and the first ones what is over. No rows in, no rows out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm.words import WORD
from almanac.session import shuffle_partitions


#: Lists within a row are no longer than this.
_PAGE = 4096


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """source, source_size, target: one row per source of ``sizes`` (source, source_size).

    Resharing until no target is above its cap ends where every capped source's ratio of cap to weight is at most that
    of the others, so sources in order of that ratio are capped one after the other as long as the next one must be.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))
    parties = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * epochs)
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    all_ = Window.partitionBy()
    pool = F.sum("source_size").over(all_) * F.lit(float(share))
    level = (pool - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    capped = parties.withColumn("level", level).withColumn("is_capped", F.col("cap") <= F.col("level") * F.col("weight"))
    # the first that is not capped has the level of all that follow
    final = F.min(F.when(~F.col("is_capped"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(all_)["level"]
    # all capped (the share can't be reached): the caps themselves
    target = F.when(F.col("is_capped"), F.col("cap").cast("double")).otherwise(F.least(final * F.col("weight"), F.col("cap").cast("double")))
    return capped.select("source", "source_size", target.alias("target"))


def apportion(parties: DataFrame, group: Sequence[str], seats: str, claim: str, order: Sequence[str]) -> DataFrame:
    """``parties`` with quota: the ``seats`` of a group dealt to its parties by Sainte-Laguë on ``claim``, ties by order.

    Claims are first rounded at the multiplier x = seats / sum(claim). With n claims above zero the multiplier that deals
    all seats lies within n / 2 / sum(claim) of x, as each rounding is off by half a seat at most, so a party gains or
    loses no more than claim * n / 2 / sum(claim) + 1 seats. So many moves of each party are listed, which are fewer than
    3 n in all, and the best of them by quotient are made: the result is that of highest quotients, whatever the claims.
    """
    whole = Window.partitionBy(*group)
    total = F.sum(claim).over(whole)
    rounded = F.when(total > 0, F.floor(F.col(claim) * F.col(seats) / total + 0.5)).otherwise(0).cast("long")
    first = parties.withColumns({"_total": total, "_claims": F.sum((F.col(claim) > 0).cast("long")).over(whole)}).withColumn("_first", rounded)
    first = first.withColumn("_left", F.col(seats) - F.sum("_first").over(whole))
    first = first.withColumn("_turn", F.row_number().over(whole.orderBy(*order)))
    room = F.least(F.abs("_left"), F.ceil(F.col("_claims") * F.col(claim) / (2 * F.col("_total"))) + 2).cast("int")  # one more, for doubles
    moves = F.when((F.col("_total") > 0) & (F.col(claim) > 0) & (room > 0), F.sequence(F.lit(1), room)).otherwise(F.array().cast("array<int>"))
    many = first.withColumn("_move", F.explode_outer(moves))
    gained = F.col(claim) / (2 * (F.col("_first") + F.col("_move")) - 1)
    held = F.col("_first") - F.col("_move") + 1  # the seat that this move would give back
    lost = F.when(held > 0, F.col(claim) / (2 * held - 1))
    rank = F.when(F.col("_left") >= 0, -gained).otherwise(lost)
    ranked = Window.partitionBy(*group).orderBy(rank.asc_nulls_last(), F.when(F.col("_left") >= 0, F.col("_turn")).otherwise(-F.col("_turn")), "_move")
    moved = F.col("_move").isNotNull() & rank.isNotNull() & (F.row_number().over(ranked) <= F.abs("_left"))
    names = parties.columns
    summed = many.withColumn("_moved", moved.cast("long")).groupBy(*names, "_first", "_left").agg(F.sum("_moved").alias("_moved"))
    return summed.withColumn("quota", F.col("_first") + F.signum("_left").cast("long") * F.col("_moved")).select(*names, "quota")


def plan_mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, epochs: int = 2, block: int = 16, shard_words: int = 1 << 20, seed: int = 11) -> DataFrame:
    """One row for each distinct (source, doc_id, text_hash): how many ``copies`` it has, size, source_size, target,
    ``full`` (whole takes of each copy), ``extra`` (words that its copies give beyond these) and their ``runs``.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "source", word_count().alias("size"))
    same = ["source", "doc_id", "text_hash", "size"]
    rows = rows.groupBy(*same).agg(F.count("*").alias("copies"))
    goals = targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")), weights, share, epochs)
    goals = goals.withColumn("seats", F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long"))
    goals = apportion(goals, (), "seats", "target", ["source"])
    goals = goals.withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long"))
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))
    goals = goals.drop("seats").withColumnRenamed("quota", "source_quota").withColumn("key", key)
    # a source's documents meet its goal in several tasks; were they dealt by source alone, so would be all that follows
    # (never null, or a filter for that would make this another plan than the one below goals, and scan texts again)
    salts = shuffle_partitions(docs.sparkSession)
    salt = F.coalesce(F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(salts)).cast("int"), F.lit(0))
    goals = goals.drop("source").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = rows.withColumns({"key": key, "salt": salt}).join(goals, ["key", "salt"]).drop("salt")
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_hash"), F.col("n_shards")))

    shards = dealt.groupBy("key", "shard", "source_quota").agg(F.sum(F.col("size") * F.col("copies")).alias("shard_size"))
    shards = apportion(shards, ["key"], "source_quota", "shard_size", ["shard"])
    shards = shards.withColumn("n_blocks", F.ceil(F.col("shard_size") / block))
    shards = shards.withColumn("quota", F.least("quota", F.col("n_blocks") * epochs)).select("key", "shard", "n_blocks", "quota")

    # in as many parts as stated, as few bytes here become many rows
    dealt = dealt.repartition(shuffle_partitions(docs.sparkSession), "key", "shard")
    placed = dealt.join(shards, ["key", "shard"])
    within = Window.partitionBy("key", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "text_hash"), F.col("doc_id"), "text_hash", "size")
    placed = placed.withColumn("words", F.col("size") * F.col("copies"))
    placed = placed.withColumn("from", F.sum("words").over(within) - F.col("words"))
    placed = placed.withColumn("full", F.when(F.col("n_blocks") > 0, F.floor(F.col("quota") / F.col("n_blocks"))).otherwise(0))
    placed = placed.withColumn("over", F.when(F.col("n_blocks") > 0, F.col("quota") % F.col("n_blocks")).otherwise(0))
    # a row's blocks are listed by the page, so that no list is as long as a document that is there many times
    first, last = F.floor(F.col("from") / block), F.floor((F.col("from") + F.col("words") - 1) / block)
    pages = F.when(F.col("words") > 0, F.sequence(first, last, F.lit(_PAGE).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    cut = placed.withColumn("page", F.explode_outer(pages))
    in_page = F.when(F.col("page").isNotNull(), F.sequence("page", F.least(last, F.col("page") + (_PAGE - 1)))).otherwise(F.array().cast("array<bigint>"))
    cut = cut.withColumn("block", F.explode_outer(in_page))
    ranked = Window.partitionBy("key", "shard").orderBy(F.col("block").isNull(), F.xxhash64(F.lit(seed + 2), "key", "shard", "block"), "block")
    begin = F.greatest(F.col("block") * block, F.col("from"))
    end = F.least((F.col("block") + 1) * block, F.col("from") + F.col("words"))
    chosen = F.col("block").isNotNull() & (F.dense_rank().over(ranked) <= F.col("over"))
    cut = cut.withColumn("run", F.when(chosen, F.struct((begin - F.col("from")).alias("start"), (end - F.col("from")).alias("end"))))
    kept = [*same, "key", "shard", "copies", "source_size", "target", "full"]
    merged = cut.groupBy(*kept).agg(F.sum(F.col("run.end") - F.col("run.start")).alias("extra"), F.sort_array(F.collect_list(F.when(F.col("copies") == 1, F.col("run")))).alias("all_runs"))
    merged = merged.withColumn("extra", F.coalesce("extra", F.lit(0)))
    return merged


def _own_share(nth: Column) -> Column:
    """Of a plan's extra words, those of its nth copy, from 0."""
    return F.floor(F.col("extra") / F.col("copies")) + (nth < F.col("extra") % F.col("copies")).cast("long")


def mix(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, size, source, source_size, target and taken (words, repeats counted), one row per row of ``docs``."""
    plans = plan_mix(docs, **settings)
    # copies are counted out by the page, so that no row holds a list as long as a document has copies
    pages = plans.withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(_PAGE).cast("long"))))
    rows = pages.withColumn("nth", F.explode(F.sequence("page", F.least(F.col("page") + _PAGE, F.col("copies")) - 1)))
    taken = F.col("full") * F.col("size") + _own_share(F.col("nth"))
    return rows.select("doc_id", "size", "source", "source_size", "target", taken.alias("taken"))


def mixed_texts(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself, in the columns of ``docs``: a row for each whole take of a document, and one for its runs.

    The runs' words stand as they do in the text, with the white space that follows each; n_chars, where there is such
    a column, is counted anew.
    """
    name, source_key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))
    plans = plan_mix(docs, **settings).where("full > 0 or extra > 0")
    plans = plans.select(name.alias("__almanac_name"), F.col("text_hash").alias("__almanac_hash"), source_key.alias("__almanac_source"), "copies", "full", "extra", F.col("all_runs").alias("runs"))
    plans = plans.select("__almanac_name", "__almanac_hash", "__almanac_source", F.struct("copies", "full", "extra", "runs").alias("__almanac_plan"))
    key = ["__almanac_name", "__almanac_hash", "__almanac_source"]
    joined = docs.withColumns({"__almanac_name": name, "__almanac_hash": F.xxhash64("text"), "__almanac_source": source_key}).join(plans, key)
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1))) - 1
    share = F.floor(F.col("__almanac_plan.extra") / F.col("__almanac_plan.copies")) + (nth < F.col("__almanac_plan.extra") % F.col("__almanac_plan.copies")).cast("long")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), share.alias("end")))
    joined = joined.withColumn("__almanac_runs", F.when(F.col("__almanac_plan.extra") == 0, F.array().cast("array<struct<start:bigint,end:bigint>>")).when(F.col("__almanac_plan.copies") == 1, F.col("__almanac_plan.runs")).otherwise(whole))
    words = F.regexp_extract_all(F.col("text"), F.lit(rf"{WORD}[\x20\x09-\x0D]*"), F.lit(0))
    has_runs = F.exists("__almanac_runs", lambda r: r["end"] > r["start"])
    joined = joined.withColumn("__almanac_words", F.when(has_runs, words))
    cut = F.array_join(F.flatten(F.transform("__almanac_runs", lambda r: F.slice("__almanac_words", (r["start"] + 1).cast("int"), (r["end"] - r["start"]).cast("int")))), "")
    texts = F.concat(F.array_repeat("text", F.col("__almanac_plan.full").cast("int")), F.when(has_runs, F.array(cut)).otherwise(F.array().cast("array<string>")))
    out = joined.withColumn("text", F.explode(texts))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
