"""Functions for SQL users, and the Python ones behind them: what built-in functions can't say."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from almanac.sources.html import html_to_markdown

#: Size of the bundled embedder's vectors.
DIMENSIONS = 384


def nested_links(text: str | None) -> dict[str, int]:
    """Targets of ``[[...]]`` with how often they are linked; brackets may nest, an open one swallows what follows."""
    counts: dict[str, int] = {}
    depth, begin, i = 0, 0, 0
    text = text or ""
    while i < len(text) - 1:
        two = text[i : i + 2]
        if two == "[[":
            depth += 1
            if depth == 1:
                begin = i + 2
            i += 2
        elif two == "]]" and depth:
            depth -= 1
            i += 2
            if not depth and (target := link_target(text[begin : i - 2])):
                counts[target] = counts.get(target, 0) + 1
        else:
            i += 1
    return counts


def link_target(inner: str) -> str | None:
    """The page a link's inside names: before ``|`` and ``#``; None for files and the like, and after a leading colon."""
    target = inner.split("|", 1)[0].split("#", 1)[0].strip()
    if inner.strip().startswith(":") or not target or len(target.encode()) > 200 or re.match(r"(?i)(?:file|image|category):", target):
        return None
    return target


@F.pandas_udf(T.MapType(T.StringType(), T.IntegerType()))
def wikilink_counts(text: pd.Series) -> pd.Series:
    return text.map(nested_links)


def hashed_vector(text: str | None, dimensions: int = DIMENSIONS) -> list[float] | None:
    """A unit vector of a text's words and neighbouring pairs, by signed feature hashing; None for no text."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    if not words:
        return None
    vector = np.zeros(dimensions)
    for feature in [*words, *map(" ".join, zip(words, words[1:]))]:
        h = zlib.crc32(feature.encode())
        vector[h % dimensions] += 1 if h >> 31 else -1
    length = math.sqrt(float(vector @ vector))
    return (vector / length).astype(np.float32).tolist() if length else None


@F.pandas_udf(T.ArrayType(T.FloatType()))
def embed_text(text: pd.Series) -> pd.Series:
    return text.map(hashed_vector)


class ChunkText:
    """SELECT d.doc_id, c.* FROM documents d, LATERAL chunk_text(d.text, 1500) c"""

    @staticmethod
    def analyze(text: AnalyzeArgument, max_bytes: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(T.StructType().add("chunk_index", T.IntegerType()).add("section_path", T.StringType()).add("chunk", T.StringType()))

    def eval(self, text: str | None, max_bytes: int) -> Iterator[tuple[int, str | None, str]]:
        pieces, buffer, section = [], "", None
        text = text or ""
        for line in text.removesuffix("\n").split("\n"):
            if line.startswith(("## ", "### ")):
                if buffer.strip(" \t\r\n"):
                    pieces.append((section, buffer.strip(" \t\r\n")))
                    buffer = ""
                section = re.sub("^#{2,3} ", "", line).strip(" \t\r")
            buffer += line + "\n"
            if len(buffer.encode()) > max_bytes:
                if buffer.strip(" \t\r\n"):
                    pieces.append((section, buffer.strip(" \t\r\n")))
                buffer = ""
        if buffer.strip(" \t\r\n"):
            pieces.append((section, buffer.strip(" \t\r\n")))
        for i, (name, body) in enumerate(pieces or [(None, text)]):
            yield i, name, body


def register(spark: SparkSession) -> None:
    """html_to_markdown, wikilink_counts, embed_text and the table function chunk_text for SQL."""
    spark.udf.register("html_to_markdown", html_to_markdown)
    spark.udf.register("wikilink_counts", wikilink_counts)
    spark.udf.register("embed_text", embed_text)
    spark.udtf.register("chunk_text", F.udtf(ChunkText))


def citation(source: Column, external_id: Column, title: Column, privacy: Column, template: str | None = None, folder: str | None = None) -> Column:
    """A STRUCT that says where a hit comes from: display, local view, web address (public only), file, privacy."""
    web = F.when(privacy == 0, F.replace(F.lit(template), F.lit("{title}"), F.replace(title, F.lit(" "), F.lit("_")))) if template else F.lit(None).cast("string")
    path = F.concat(F.lit(f"{folder.rstrip('/')}/"), external_id) if folder else F.lit(None).cast("string")
    return F.struct(F.concat(title, F.lit(" ("), source, F.lit(")")).alias("display"), F.concat(F.lit("/api/read/"), source, F.lit("/"), external_id).alias("local_view"), web.alias("web_url"), path.alias("file_path"), privacy.alias("privacy_level"))
