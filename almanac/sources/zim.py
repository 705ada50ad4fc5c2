"""ZIM archives as a Spark data source: one input partition for each run of clusters.

    spark.dataSource.register(ZimSource); spark.read.format("zim").option("path", ...).load()

Rows: path, title, mime, html; entries of namespaces C and A whose type is HTML. Clusters may be plain, xz or zstd.
"""

from __future__ import annotations

import lzma
import struct
from collections import defaultdict
from collections.abc import Iterator

import pyarrow.fs as pafs
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from almanac.sources.html import html_to_markdown

MAGIC, MAX_CLUSTER = 72173914, 256 << 20
SCHEMA = "path string, title string, mime string, html string"


class Archive:
    """Random access to an archive's entries and blobs."""

    def __init__(self, path: str):
        store, inside = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))
        self.file = store.open_input_file(inside)
        head = self._at(0, 80)
        magic, self.major, _, _, self.n_entries, self.n_clusters, self.paths_at, _, self.clusters_at, self.mimes_at = struct.unpack_from("<IHH16sIIQQQQ", head)
        if magic != MAGIC:
            raise ValueError(f"{path} is no ZIM archive")
        self.mimes = self._mimes()

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def _mimes(self) -> list[str]:
        self.file.seek(self.mimes_at)
        data = b""
        while b"\0\0" not in data and (more := self.file.read(4096)):
            data += more
        return data.split(b"\0\0")[0].decode("utf-8", "replace").split("\0")

    def entry(self, i: int) -> tuple[str, str, str, str, int, int] | None:
        """namespace, path, title, mime, cluster and blob; None for redirects and the like."""
        at = struct.unpack("<Q", self._at(self.paths_at + 8 * i, 8))[0]
        data = self._at(at, 4096)
        mime = struct.unpack_from("<H", data)[0]
        if mime >= len(self.mimes):
            return None
        cluster, blob = struct.unpack_from("<II", data, 8)
        while data.count(b"\0", 16) < 2 and (more := self._at(at + len(data), 4096)):
            data += more
        path, title = data[16:].split(b"\0", 2)[:2]
        path = path.decode("utf-8", "replace")
        return chr(data[3]), path, title.decode("utf-8", "replace") or path, self.mimes[mime], cluster, blob

    def cluster(self, i: int) -> list[bytes]:
        begin = struct.unpack("<Q", self._at(self.clusters_at + 8 * i, 8))[0]
        later = struct.unpack("<Q", self._at(self.clusters_at + 8 * (i + 1), 8))[0] if i + 1 < self.n_clusters else None
        info = self._at(begin, 1)[0]
        data = self._at(begin + 1, (later - begin - 1) if later and later > begin else MAX_CLUSTER)
        kind, wide = info & 0x0F, bool(info & 0x10)
        if kind == 4:
            data = lzma.LZMADecompressor().decompress(data, MAX_CLUSTER)
        elif kind == 5:
            data = zstandard.ZstdDecompressor().decompressobj().decompress(data)[:MAX_CLUSTER]
        elif kind not in (0, 1):
            raise ValueError(f"cluster compression {kind}")
        form, size = ("<Q", 8) if wide else ("<I", 4)
        n = struct.unpack_from(form, data)[0] // size
        offsets = struct.unpack_from(f"<{n}{form[1]}", data)
        return [data[a:b] for a, b in zip(offsets, offsets[1:])]


class Clusters(InputPartition):
    def __init__(self, begin: int, end: int):
        super().__init__((begin, end))
        self.begin, self.end = begin, end


class ZimReader(DataSourceReader):
    def __init__(self, path: str, pieces: int):
        self.path, self.pieces = path, pieces

    def partitions(self) -> list[InputPartition]:
        n = Archive(self.path).n_clusters
        step = max(1, -(-n // self.pieces))
        return [Clusters(a, min(n, a + step)) for a in range(0, n, step)]

    def read(self, partition: Clusters) -> Iterator[tuple]:
        archive = Archive(self.path)
        wanted = defaultdict(list)
        for i in range(archive.n_entries):
            found = archive.entry(i)
            if found and found[0] in "CA" and "html" in found[3] and partition.begin <= found[4] < partition.end:
                wanted[found[4]].append(found)
        for cluster in sorted(wanted):
            try:
                blobs = archive.cluster(cluster)
            except (ValueError, struct.error, lzma.LZMAError, zstandard.ZstdError):
                continue
            for _, path, title, mime, _, blob in wanted[cluster]:
                if blob < len(blobs):
                    yield path, title, mime, blobs[blob].decode("utf-8", "replace")


class ZimSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zim"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ZimReader(self.options["path"], int(self.options.get("pieces", "64")))


def zim_documents(spark: SparkSession, path: str, pieces: int = 64) -> DataFrame:
    """Articles as Markdown; pages without text are left out.

    Each piece of the directory is read once, by one task, and its entries go to the tasks that have their clusters.
    """
    n = Archive(path).n_entries

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archive = Archive(path)
        for batch in batches:
            found = (archive.entry(int(i)) for i in batch["id"])
            rows = [x[1:] for x in found if x and x[0] in "CA" and "html" in x[3]]
            yield pd.DataFrame(rows, columns=["path", "title", "mime", "cluster", "blob"])

    def blobs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archive, at, held = Archive(path), -1, []
        for batch in batches:
            out = []
            for path_, title, _, cluster, blob in batch.itertuples(index=False):
                if cluster != at:
                    try:
                        at, held = cluster, archive.cluster(int(cluster))
                    except (ValueError, struct.error, lzma.LZMAError, zstandard.ZstdError):
                        held = []
                if blob < len(held):
                    out.append((path_, title, held[blob].decode("utf-8", "replace")))
            yield pd.DataFrame(out, columns=["path", "title", "html"])

    listed = spark.range(0, n, 1, pieces).mapInPandas(entries, "path string, title string, mime string, cluster long, blob long")
    rows = listed.repartition(pieces, "cluster").sortWithinPartitions("cluster").mapInPandas(blobs, "path string, title string, html string")
    texts = rows.select(F.translate("path", "/\\:", "___").alias("external_id"), "title", html_to_markdown("html").alias("text")).where("text <> ''")
    return texts.select("external_id", "title", "text", F.lit("Article").alias("content_type"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("depth"), F.lit(0).alias("privacy_level"))
