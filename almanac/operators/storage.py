"""Content on disk: Parquet by source, archives out and in, and vectors."""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTENT = "source_name string, filename string, text string, privacy_level tinyint"


def write_content(content: DataFrame, folder: str, mode: str = "append") -> None:
    """Partitioned by source, zstd, about a thousand documents a file."""
    content.write.mode(mode).partitionBy("source_name").option("compression", "zstd").option("maxRecordsPerFile", 1000).parquet(folder)


def replace_documents(content: DataFrame, folder: str) -> None:
    """Overwrite the sources that ``content`` has, and no others."""
    content.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_name").option("compression", "zstd").parquet(folder)


def list_files(spark: SparkSession, folder: str, source: str | None = None) -> DataFrame:
    files = spark.read.parquet(folder)
    return files.where(F.col("source_name") == source) if source is not None else files


class created:
    """A new file at any path that Spark can write to, as a binary stream of the driver."""

    def __init__(self, spark: SparkSession, path: str):
        sc = spark.sparkContext
        self.where = sc._jvm.org.apache.hadoop.fs.Path(path)
        self.system = self.where.getFileSystem(sc._jsc.hadoopConfiguration())

    def __enter__(self) -> created:
        self.out = self.system.create(self.where, True)
        return self

    def write(self, data: bytes) -> int:
        self.out.write(bytearray(data))
        return len(data)

    def __exit__(self, *_: object) -> None:
        self.out.close()


def _packed(entries: Iterable[tuple[str, str]], end: bool = False) -> bytes:
    """A compressed frame of tar entries; frames one after the other are an archive, of which the last has its end."""
    plain = io.BytesIO()
    with tarfile.open(fileobj=plain, mode="w") as tar:
        for name, text in entries:
            data = text.encode()
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
        size = plain.tell()
    return zstandard.ZstdCompressor(level=3).compress(plain.getvalue() if end else plain.getvalue()[:size])


def export_archive(content: DataFrame, path: str, include_personal: bool = False) -> int:
    """A .tar.zst with a manifest and ``source/<name>/<file>`` entries; how many documents it has.

    Entries are packed and compressed where they lie, a batch of documents to a frame; the driver writes one frame after
    the other.
    """
    from almanac.operators.catalog import exportable

    spark, chosen = content.sparkSession, exportable(content, include_personal)
    sources = {r.source_name: r.n for r in chosen.groupBy("source_name").agg(F.count("*").alias("n")).collect()}

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                names, files, texts = (batch.slice(at, 256).column(c).to_pylist() for c in ("source_name", "filename", "text"))
                frame = _packed((f"source/{n}/{f}", t or "") for n, f, t in zip(names, files, texts))
                yield pa.RecordBatch.from_arrays([pa.array([frame], pa.binary())], ["frame"])

    frames = chosen.select("source_name", "filename", "text").mapInArrow(pack, "frame binary")
    with created(spark, path) as out:
        out.write(_packed([("manifest.json", json.dumps({"version": 1, "sources": sources}, sort_keys=True))]))
        for r in frames.toLocalIterator():
            out.write(bytes(r.frame))
        out.write(_packed([], end=True))
    return sum(sources.values())


def import_archive(spark: SparkSession, path: str) -> DataFrame:
    """source_name, filename and text of an archive's entries, read where the archive lies."""

    def unpack(batches):
        import pandas as pd

        for batch in batches:
            for data in batch["content"]:
                with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True) as plain, tarfile.open(fileobj=plain, mode="r|") as tar:
                    for entry in tar:
                        parts = entry.name.split("/", 2)
                        if entry.isfile() and len(parts) == 3 and parts[0] == "source":
                            yield pd.DataFrame({"source_name": [parts[1]], "filename": [parts[2]], "text": [tar.extractfile(entry).read().decode("utf-8", "replace")]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, "source_name string, filename string, text string")
