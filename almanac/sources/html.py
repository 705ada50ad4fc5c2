"""HTML to Markdown with the standard library's parser, as an Arrow-batched function."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SKIPPED = {"script", "style", "head", "template", "noscript"}
_BLOCKS = {"p", "div", "section", "article", "header", "footer", "nav", "table", "tr", "ul", "ol", "blockquote", "pre", "figure", "main", "aside"}


class _Writer(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0
        self.lists: list[list] = []
        self.hrefs: list[str | None] = []
        self.pre = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _SKIPPED:
            self.skip += 1
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "a":
            self.hrefs.append(dict(attrs).get("href"))
            self.out.append("[")
        elif tag == "img":
            own = dict(attrs)
            self.out.append(f"![{own.get('alt') or ''}]({own.get('src') or ''})")
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.out.append("\n" + "  " * max(0, len(self.lists) - 1) + (f"{kind[1]}. " if kind[0] == "ol" else "- "))
        elif tag in ("td", "th"):
            self.out.append(" | ")
        if tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        if tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag in _BLOCKS:
            self.out.append("\n\n" if not (tag in ("ul", "ol") and len(self.lists) > 1) else "")

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "a" and self.hrefs:
            href = self.hrefs.pop()
            self.out.append(f"]({href})" if href else "]")
        if tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        if tag == "pre" and self.pre:
            self.pre -= 1
            self.out.append("\n```\n\n")
        elif tag in _BLOCKS:
            self.out.append("\n\n")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def to_markdown(html: str | None) -> str | None:
    """Markdown of a page; where the parser fails, its text without tags."""
    if html is None:
        return None
    try:
        writer = _Writer()
        writer.feed(html)
        writer.close()
        text = "".join(writer.out)
    except Exception:  # whatever a page holds, its document must not be lost
        text = re.sub(r"<[^>]*(?:>|$)", "", html).replace(">", "")
    parts = re.split(r"(```\n.*?\n```)", text, flags=re.S)  # what is preformatted stays as it is
    parts[::2] = [re.sub(r"(?m)^[ \t]+(?=\S)(?![-\d])", "", re.sub(r"[ \t]+\n", "\n", p)) for p in parts[::2]]
    parts[::2] = [re.sub(r"\n{3,}", "\n\n", p) for p in parts[::2]]
    return "".join(parts).strip()


@F.pandas_udf(T.StringType())
def html_to_markdown(html: pd.Series) -> pd.Series:
    return html.map(to_markdown)
