"""Session construction and the few facts about a session that operators need."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "almanac", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings every entry point shares; on a cluster spark-submit's own settings win."""
    builder = SparkSession.builder.appName(name)
    if cpus is not None or "SPARK_MASTER" not in os.environ:
        builder = builder.master(f"local[{cpus or os.cpu_count()}]")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": str(max(8, cpus or 8)),
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    return builder.config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    """How many pieces keyed work is dealt into. Follows the session, which a cluster sizes by its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over all cores where by Spark's own estimate it is read in fewer pieces than there are cores; else as it is.

    Small files hold one row group, which one task reads; work that is heavy for each row would be that task's alone.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    piece = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(cores, key) if 0 < size < cores * piece else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``; one on this machine only
    where that is unset and all executors are in this process, as in tests.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="almanac-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that losing executors can't undo it."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
