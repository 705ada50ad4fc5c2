"""From raw documents to token ids: five stages, each over all that the one before it kept.

Quality rules drop documents, near-dedup leaves one document of each group, the secret scan masks secrets, mixing
repeats and cuts documents to the sources' target weights, and the rest is encoded. Between stages the documents are
written as Parquet and read again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm import bpe, mixing, near_copies, quality, secrets
from almanac.llm.queries import tokenizer
from almanac.session import shared_folder, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")), keep_columns=True)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs, shingle=5, similarity=0.8)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    words = secrets.vocabulary_words(tokenizer()[0])
    return secrets.masked(docs, secrets.train(spark, dictionary=words), path_col="source", dictionary=words)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_texts(docs, weights=(3, 1, 2), share=1.5, epochs=2)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(docs, *tokenizer())
    n_tokens = F.floor(F.octet_length("ids") / 4).alias("n_tokens")
    return encoded.select("doc_id", n_tokens, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("near_dedup", keep_one_of_each),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: The field of the first stage is trained and its lines are decoded, which SQL can't say; tests hold the stages to
#: brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what each returns is written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
