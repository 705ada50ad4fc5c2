"""Semantic chunking: sections at headings, and no chunk that grows past a size.

Lines are appended to a buffer; a ``## `` or ``### `` line closes what stands before it, and a buffer of more than
``max_bytes`` closes after the line that took it there, so a line is never split. The fold runs over each document's
lines inside one expression: no shuffle, no Python, and documents of any number of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.session import spread

MAX_BYTES = 1500
_PIECE = "struct<section:string,body:string>"


def fold_lines(text: Column, max_bytes: int = MAX_BYTES, by_heading: bool = True) -> Column:
    """The pieces of a text, an array of (section, body); a blank text is one piece as it stands."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.split(F.regexp_replace(whole, r"\n$", ""), "\n")
    blank = lambda b: F.btrim(b, F.lit(" \t\r\n")) == ""
    piece = lambda s: F.array(F.struct(s["section"].alias("section"), F.btrim(s["buffer"], F.lit(" \t\r\n")).alias("body")))
    state = lambda out, buffer, section: F.struct(out.cast(f"array<{_PIECE}>").alias("out"), buffer.alias("buffer"), section.cast("string").alias("section"))

    def step(s: Column, line: Column) -> Column:
        heading = line.startswith("## ") | line.startswith("### ") if by_heading else F.lit(False)
        closed = F.when(heading & ~blank(s["buffer"]), F.concat(s["out"], piece(s))).otherwise(s["out"])
        section = F.when(heading, F.btrim(F.regexp_replace(line, "^#{2,3} ", ""), F.lit(" \t\r"))).otherwise(s["section"])
        kept = F.when(heading & ~blank(s["buffer"]), F.lit("")).otherwise(s["buffer"])
        buffer = F.concat(kept, line, F.lit("\n"))
        full = F.octet_length(buffer) > max_bytes
        after = F.struct(section.alias("section"), buffer.alias("buffer"))
        return state(F.when(full & ~blank(buffer), F.concat(closed, piece(after))).otherwise(closed), F.when(full, F.lit("")).otherwise(buffer), section)

    start = state(F.array(), F.lit(""), F.lit(None))
    pieces = F.aggregate(lines, start, step, lambda s: F.when(blank(s["buffer"]), s["out"]).otherwise(F.concat(s["out"], piece(s))))
    alone = F.array(F.struct(F.lit(None).cast("string").alias("section"), whole.alias("body"))).cast(f"array<{_PIECE}>")
    return F.when(F.size(pieces) == 0, alone).otherwise(pieces)


def chunk(docs: DataFrame, text_col: str = "text", max_bytes: int = MAX_BYTES, conversation: bool = False) -> DataFrame:
    """``docs`` without the text, and chunk_index, section_path, chunk and byte_len of each of its chunks.

    Conversations have no headings; they are one chunk unless they grow past the size.
    """
    pieces = fold_lines(F.col(text_col), max_bytes, by_heading=not conversation)
    rest = [c for c in docs.columns if c != text_col]
    docs = spread(docs, rest[0]) if rest else docs
    exploded = docs.select(*rest, F.posexplode(pieces).alias("chunk_index", "_piece"))
    return exploded.select(*rest, "chunk_index", F.col("_piece.section").alias("section_path"), F.col("_piece.body").alias("chunk"), F.octet_length("_piece.body").cast("long").alias("byte_len"))
