"""Titles, snippets, tokens, markup stripping and cleaning as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token of the full-text index: letters and digits of any script; longer ones than this many bytes are left out.
TOKEN_BREAK, MAX_TOKEN_BYTES = r"[^\p{L}\p{N}]+", 40


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often and in whatever loop it is used."""
    return F.transform(F.array(value), body)[0]


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN_BREAK), lambda t: (t != "") & (F.octet_length(t) <= MAX_TOKEN_BYTES))


def file_title(name: Column) -> Column:
    """A file name without its trailing .md's, then without its trailing .txt's."""
    return F.regexp_replace(F.regexp_replace(name, r"(\.md)+$", ""), r"(\.txt)+$", "")


def document_title(text: Column, name: Column) -> Column:
    """What follows ``# `` on the first line that begins so once trimmed; else the file's name without suffixes."""
    heading = F.regexp_extract(text, r"(?m)^[^\S\n]*# (.*?)[^\S\n]*$", 1)
    return F.coalesce(F.when(heading != "", heading), file_title(name))


def byte_prefix(text: Column, n: int) -> Column:
    """The shortest prefix of whole characters that has at least n bytes; all of a shorter text."""
    enough = F.filter(F.sequence(F.lit(n // 4), F.lit(n)), lambda k: F.octet_length(F.left(text, k)) >= n)
    return F.when(F.octet_length(text) <= n, text).otherwise(F.left(text, enough[0]))


def snippet(text: Column, length: int = 200) -> Column:
    """A document's first ``length / 2`` bytes, trimmed, with dots if there is more."""
    half = length // 2
    return F.concat(F.btrim(byte_prefix(text, half), F.lit(" \t\n\r")), F.when(F.octet_length(text) > half, "...").otherwise(""))


def strip_tags(html: Column) -> Column:
    """What stands outside ``<...>``; entities stay, a stray ``>`` goes, an open ``<`` swallows the rest."""
    return F.replace(F.regexp_replace(html, r"<[^>]*(?:>|$)", ""), F.lit(">"), F.lit(""))


def html_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def links(html: Column) -> Column:
    """Targets of ``<a href>``, in order."""
    return F.regexp_extract_all(html, F.lit(r'<a href="([^"]*)"'), F.lit(1))


def wikilinks(text: Column) -> Column:
    """Targets of flat ``[[target|label]]`` links, cut at ``#``, in order; no files, images, categories, nor links that
    begin with a colon, which lead to other wikis.
    """
    inner = F.filter(F.regexp_extract_all(text, F.lit(r"\[\[([^\[\]]+)\]\]"), F.lit(1)), lambda x: ~F.ltrim(x).startswith(":"))
    target = F.transform(inner, lambda x: F.trim(F.substring_index(F.substring_index(x, "|", 1), "#", 1)))
    return F.filter(target, lambda x: (x != "") & (F.octet_length(x) <= 200) & ~F.lower(x).rlike("^(?:file|image|category):"))


def entity_id(kind: str, name: Column) -> Column:
    """``kind:name``, lower-cased, spaces as underscores; of mail addresses ``<>@`` too."""
    return F.concat(F.lit(f"{kind}:"), F.translate(F.lower(name), " <>@", "____"))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def safe_file_name(name: Column) -> Column:
    return F.translate(name, "/\\:", "___")


def human_bytes(n: Column) -> Column:
    """12 B, 1.5 KB, 2.0 MB, 3.2 GB."""
    shown = lambda power, unit: F.format_string(f"%.1f {unit}", n / float(1 << power))
    return F.when(n >= 1 << 30, shown(30, "GB")).when(n >= 1 << 20, shown(20, "MB")).when(n >= 1 << 10, shown(10, "KB")).otherwise(F.format_string("%d B", n))


def highlight(text: Column, query: Column) -> Column:
    """Each occurrence of the query, whatever its case, between ``**``."""
    quoted = F.concat(F.lit(r"(?i)\Q"), F.replace(query, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.when(query == "", text).otherwise(F.regexp_replace(text, quoted, F.lit("**$0**")))


def clean_extracted(text: Column) -> Column:
    """Lines of extracted pages: trimmed, without blank ones and page numbers, ligatures spelled out."""
    trimmed = F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\r")))
    kept = F.filter(trimmed, lambda x: ~((F.octet_length(x) < 4) & x.rlike("^[0-9-]*$")))
    joined = F.array_join(kept, "\n")
    for ligature, letters in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        joined = F.replace(joined, F.lit(ligature), F.lit(letters))
    return joined


def extracted_title(text: Column, fallback: Column) -> Column:
    """The first line that isn't blank, if it has under 200 bytes and doesn't end as a sentence."""
    first = F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\r#"))), lambda x: x != "")
    line = F.get(first, F.lit(0))
    return F.when((F.octet_length(line) < 200) & ~line.endswith("."), line).otherwise(fallback)


def without_templates(text: Column) -> Column:
    """What stands outside of ``{{...}}``, which may hold others at any depth; an open one swallows nothing.

    One pass over the marks keeps how deep it is and what it has kept; an unclosed template's text is put back.
    """
    parts = F.split(F.regexp_replace(text, r"(\{\{|\}\})", "\0$1\0"), "\0")
    state = lambda depth, kept, held: F.struct(depth.cast("int").alias("depth"), kept.cast("array<string>").alias("kept"), held.cast("array<string>").alias("held"))

    def step(s: Column, part: Column) -> Column:
        opens, closes, inside = part == "{{", (part == "}}") & (s["depth"] > 0), s["depth"] > 0
        depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        held = F.when(opens | inside, F.concat(s["held"], F.array(part))).otherwise(s["held"])
        done = closes & (s["depth"] == 1)
        return state(depth, F.when(opens | inside, s["kept"]).otherwise(F.concat(s["kept"], F.array(part))), F.when(done, F.array().cast("array<string>")).otherwise(held))

    read = lambda ps: F.aggregate(ps, state(F.lit(0), F.array(), F.array()), step, lambda s: F.array_join(F.concat(s["kept"], s["held"]), ""))
    return F.when(F.contains(text, F.lit("{{")), read(parts)).otherwise(text)


def wikitext_to_markdown(text: Column) -> Column:
    """Headings, lists, links, emphasis and references of wikitext; templates are dropped, however deep they go."""
    text = without_templates(text)
    text = F.regexp_replace(text, r"(?s)<ref[^>/]*/>|<ref[^>]*>.*?</ref>|<!--.*?-->", "")
    for level in (6, 5, 4, 3, 2):
        mark = "=" * level
        text = F.regexp_replace(text, rf"(?m)^{mark}\s*([^=\n]+?)\s*{mark}\s*$", "#" * level + " $1")
    text = F.regexp_replace(text, r"(?m)^\*\s*(?=\S)", "- ")
    text = F.regexp_replace(text, r"\[\[(?:File|Image|Category):[^\[\]]*\]\]", "")
    text = F.regexp_replace(text, r"\[\[[^\[\]|]*\|([^\[\]]*)\]\]", "$1")
    text = F.regexp_replace(text, r"\[\[([^\[\]]*)\]\]", "$1")
    text = F.regexp_replace(F.regexp_replace(text, "'''([^'\n]+)'''", "**$1**"), "''([^'\n]+)''", "*$1*")
    return F.btrim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", ""), "\n{3,}", "\n\n"), F.lit(" \t\n\r"))


def section(text: Column, name: str) -> Column:
    """From the line ``## name`` or ``### name`` up to the next line that begins ``## ``; null if there is none."""

    def cut(lines: Column) -> Column:
        begin = F.array_position(F.transform(lines, lambda x: F.rtrim(x).isin(f"## {name}", f"### {name}")), F.lit(True))
        after = F.slice(lines, (begin + 1).cast("int"), F.size(lines))
        stop = F.array_position(F.transform(after, lambda x: x.startswith("## ")), F.lit(True))
        body = F.slice(after, F.lit(1), F.when(stop > 0, (stop - 1).cast("int")).otherwise(F.size(after)))
        return F.when(begin > 0, F.array_join(F.concat(F.slice(lines, begin.cast("int"), F.lit(1)), body), "\n"))

    return bind(F.split(text, "\n"), cut)


def heading_lines(text: Column) -> Column:
    """line (from 0) and heading of each line that begins ``# `` or ``## ``, in order."""
    numbered = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("line"), F.btrim(F.regexp_replace(x, "^#{1,2} ", "")).alias("heading"), x.rlike("^#{1,2} ").alias("is_one")))
    return F.transform(F.filter(numbered, lambda s: s["is_one"]), lambda s: F.struct(s["line"].alias("line"), s["heading"].alias("heading")))


def occurrences(text: Column, pattern: str) -> Column:
    """How often a literal occurs, overlapping ones included."""
    if not pattern:
        return F.lit(0).cast("long")
    quoted = "(?=" + "".join(f"\\x{{{ord(c):x}}}" for c in pattern) + ")"
    return F.coalesce(F.regexp_count(text, F.lit(quoted)), F.lit(0)).cast("long")
