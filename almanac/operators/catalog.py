"""The relational catalogue: sources, documents, their updates, deletions, sizes, and what may leave the base."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Privacy levels, in order. Fixed values.
PUBLIC, INTERNAL, PRIVATE, SECRET = range(4)
DOCUMENT_KEY = ("source_id", "external_id")


def update_diff(known: DataFrame, seen: DataFrame, key: Sequence[str] = ("external_id",), hash_col: str = "content_hash") -> DataFrame:
    """key and status (new, changed, unchanged, deleted) of everything that is known or seen; one full outer join."""
    a = known.select(*key, F.col(hash_col).alias("_known"), F.lit(True).alias("_was"))
    b = seen.select(*key, F.col(hash_col).alias("_seen"), F.lit(True).alias("_is"))
    joined = a.join(b, list(key), "full_outer")
    status = F.when(F.col("_was").isNull(), "new").when(F.col("_is").isNull(), "deleted").when(F.col("_known").eqNullSafe(F.col("_seen")), "unchanged").otherwise("changed")
    return joined.select(*key, status.alias("status"))


def renames(known: DataFrame, seen: DataFrame, key: str = "external_id", hash_col: str = "content_hash") -> DataFrame:
    """from_id, to_id: deleted documents whose content came back under a new id; of several the smallest of each."""
    status = update_diff(known, seen, (key,), hash_col)
    gone = known.join(status.where("status = 'deleted'"), key, "left_semi").groupBy(hash_col).agg(F.min(key).alias("from_id"))
    come = seen.join(status.where("status = 'new'"), key, "left_semi").groupBy(hash_col).agg(F.min(key).alias("to_id"))
    return gone.join(come, hash_col).select("from_id", "to_id")


def upsert_documents(known: DataFrame, new: DataFrame, key: Sequence[str] = DOCUMENT_KEY, updated: Sequence[str] = ("title", "content_hash", "content_size", "indexed_at")) -> DataFrame:
    """Rows of ``known`` with the ``updated`` columns of a new row of their key, and new rows as they are.

    Of several new rows of a key the last by indexed_at counts.
    """
    latest = Window.partitionBy(*key).orderBy(F.desc_nulls_last("indexed_at"), *[F.desc(c) for c in updated if c != "indexed_at"])
    new = new.withColumn("_n", F.row_number().over(latest)).where("_n = 1").select(*known.columns)
    renamed = new.select(*key, *[F.col(c).alias(f"_{c}") for c in new.columns if c not in key], F.lit(True).alias("_is"))
    joined = known.withColumn("_was", F.lit(True)).join(renamed, list(key), "full_outer")

    def merged(c: str) -> Column:
        if c in key:
            return F.col(c)
        theirs_first = F.col("_is") if c in updated else F.col("_was").isNull()
        return F.when(theirs_first, F.col(f"_{c}")).otherwise(F.col(c)).alias(c)

    return joined.select(*map(merged, known.columns))


def delete_cascade(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows whose document column is among ``gone`` (document_id)."""
    ids = gone.select("document_id").distinct()
    return {name: df.join(ids.withColumnRenamed("document_id", column), column, "left_anti").select(*df.columns) for name, (df, column) in tables.items()}


def duplicate_contents(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """content_hash, n_documents and first of every text that stands twice or more."""
    hashed = docs.where(F.col(text_col).isNotNull()).select(key, F.sha2(text_col, 256).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.count("*").alias("n_documents"), F.min(key).alias("first")).where("n_documents > 1")


def source_list(docs: DataFrame, source: str = "source", text_col: str = "text") -> DataFrame:
    """source, n_documents and n_bytes."""
    return docs.groupBy(source).agg(F.count("*").alias("n_documents"), F.coalesce(F.sum(F.octet_length(text_col).cast("long")), F.lit(0)).alias("n_bytes"))


def rollup_sizes(docs: DataFrame, levels: Sequence[str], text_col: str = "text") -> DataFrame:
    """Documents and bytes at each level and above; null stands for all of a level."""
    return docs.rollup(*levels).agg(F.count("*").alias("n_documents"), F.coalesce(F.sum(F.octet_length(text_col).cast("long")), F.lit(0)).alias("n_bytes"))


def visible(rows: DataFrame, personal_only: bool = False, public_only: bool = False, privacy_max: int | None = None, source: str | None = None, source_col: str = "source_name") -> DataFrame:
    """Rows that the filters let through; personal and public at once let none through."""
    if personal_only:
        rows = rows.where(F.col("privacy_level") > PUBLIC)
    if public_only:
        rows = rows.where(F.col("privacy_level") == PUBLIC)
    if privacy_max is not None:
        rows = rows.where(F.col("privacy_level") <= privacy_max)
    return rows.where(F.col(source_col) == source) if source is not None else rows


def exportable(rows: DataFrame, include_personal: bool = False) -> DataFrame:
    return rows if include_personal else rows.where(F.col("privacy_level") == PUBLIC)


def read_document(content: DataFrame, reference: str) -> DataFrame:
    """The content of ``source:document``: the file of that name with .md, else with .txt, else as it is."""
    source, _, name = reference.partition(":")
    order = F.when(F.col("filename") == f"{name}.md", 1).when(F.col("filename") == f"{name}.txt", 2).when(F.col("filename") == name, 3)
    return content.where(F.col("source_name") == source).withColumn("_order", order).where("_order is not null").orderBy("_order").limit(1).drop("_order")


def profile(table: DataFrame, sample: int = 5) -> tuple[list[str], int, list]:
    """Columns, row count and some rows of a table, which is all that its record document says."""
    return table.columns, table.count(), table.limit(sample).collect()


def profile_document(table: DataFrame, title: str, sample: int = 5) -> str:
    """A table's record document in Markdown."""
    columns, n, rows = profile(table, sample)
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|")
    head = [f"# {title}", "", "## Schema", "", *(f"- {c}" for c in columns), "", f"Total rows: {n}", "", "## Sample", ""]
    body = [f"| {' | '.join(columns)} |", f"|{'---|' * len(columns)}", *(f"| {' | '.join(map(cell, r))} |" for r in rows)]
    return "\n".join([*head, *body]) + "\n"


def bounded_by(a: Column, b: Column, tolerance: int) -> Column:
    """Whether two times in seconds lie within a tolerance; join on ``time_buckets`` first."""
    return F.abs(a - b) <= tolerance


def time_buckets(seconds: Column, tolerance: int) -> Column:
    """The buckets of twice the tolerance in which a partner within it can lie; explode one side, floor the other."""
    width = 2 * tolerance
    return F.array_distinct(F.array(F.floor((seconds - tolerance) / width), F.floor((seconds + tolerance) / width)))


def interval_join(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, tolerance: int) -> DataFrame:
    """All pairs whose times lie within ``tolerance`` seconds: an equi-join by bucket of time, then the exact test."""
    width = 2 * tolerance
    at = F.unix_timestamp(F.col(left_ts).cast("timestamp"))
    other = F.unix_timestamp(F.col(right_ts).cast("timestamp"))
    a = left.withColumn("_at", at).withColumn("_bucket", F.explode(time_buckets(F.col("_at"), tolerance)))
    b = right.withColumn("_other", other).withColumn("_bucket", F.floor(F.col("_other") / width))
    return a.join(b, "_bucket").where(bounded_by(F.col("_at"), F.col("_other"), tolerance)).drop("_bucket", "_at", "_other")
