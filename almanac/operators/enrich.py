"""Enrichment by language models, and a runner for ordered steps with fallbacks."""

from __future__ import annotations

import json
import re
import time
import urllib.request
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Backend(Protocol):
    def complete(self, prompt: str) -> str | None: ...


class Skip:
    """Answers nothing, so nothing is enriched."""

    def complete(self, prompt: str) -> None:
        return None


@dataclass
class HttpBackend:
    """A chat service at ``url``: ``kind`` is "ollama" or "openai" (any service that speaks its protocol)."""

    kind: str
    url: str
    model: str
    max_tokens: int = 512
    temperature: float = 0.3
    timeout: float = 120

    def complete(self, prompt: str) -> str | None:
        if self.kind == "ollama":
            path, body = "/api/generate", {"model": self.model, "prompt": prompt, "stream": False, "options": {"num_predict": self.max_tokens, "temperature": self.temperature}}
        else:
            path, body = "/v1/chat/completions", {"model": self.model, "messages": [{"role": "user", "content": prompt}], "max_tokens": self.max_tokens, "temperature": self.temperature}
        request = urllib.request.Request(self.url.rstrip("/") + path, json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as response:
            said = json.load(response)
        return said.get("response") if self.kind == "ollama" else said["choices"][0]["message"]["content"]


def backend(spec: dict | str) -> Backend:
    """``"skip"``, or a mapping with kind, url and model."""
    return Skip() if spec in ("skip", None) else HttpBackend(**spec)


#: step: how much of the text goes into its prompt, in bytes, and the prompt.
STEPS = {
    "summarize": (2000, "You shorten reference articles. Say briefly, in plain words, what the article below is about and what matters in it.\n\nArticle:\n{text}"),
    "image_describe": (500, "Below is what a camera recorded beside a picture. Tell a reader in a single sentence what it reveals of place, time and subject.\n\nRecord:\n{text}"),
    "extract_entities": (2000, "Which persons, organisations and places does the article below mention? Answer with their names alone, each on its own line.\n\nArticle:\n{text}"),
}
#: Under which heading a step's answer is added to its document.
SECTIONS = {"summarize": "Summary", "image_describe": "Description"}


def prefix(text: str, size: int) -> str:
    """The first bytes of a text, whole characters only."""
    return text.encode()[:size].decode(errors="ignore")


def entity_lines(answer: str) -> list[str]:
    lines = (re.sub(r"^-(?:\s+|$)", "", line.strip()) for line in answer.split("\n"))
    return [x for x in lines if x and len(x.encode()) < 100]


def enrich(docs: DataFrame, step: str, model: Backend, key: str = "doc_id", text_col: str = "text", limit: int = 0) -> DataFrame:
    """key and answer of the documents that the model answered; ``limit`` of them, by key, or all if 0."""
    size, prompt = STEPS[step]
    rows = docs.select(key, text_col).where(F.col(text_col).isNotNull())
    rows = rows.orderBy(key).limit(limit) if limit else rows

    def ask(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            answers = [model.complete(prompt.format(text=prefix(t, size))) for t in batch[text_col]]
            out = pd.DataFrame({key: batch[key], "answer": answers})
            yield out[out["answer"].notna()]

    return rows.mapInPandas(ask, f"{key} {dict(docs.dtypes)[key]}, answer string")


def entities_from(answers: DataFrame, key: str = "doc_id") -> DataFrame:
    """Mentions from the answers to extract_entities: lines, without dashes, under 100 bytes."""
    lines = F.transform(F.split("answer", "\n"), lambda x: F.btrim(F.regexp_replace(F.btrim(x), r"^-(?:\s+|$)", "")))
    names = F.filter(lines, lambda x: (x != "") & (F.octet_length(x) < 100))
    named = answers.select(F.col(key).cast("string").alias("document_id"), F.explode(names).alias("mention_text"))
    return named.select(F.concat(F.lit("ner:"), F.replace(F.lower("mention_text"), F.lit(" "), F.lit("_"))).alias("entity_id"), "document_id", "mention_text").dropDuplicates(["entity_id", "document_id"])


@dataclass
class Step:
    """A named transform; ``fallback`` says what happens if it fails: abort, skip (go on without it) or retry."""

    name: str
    run: Callable[[DataFrame], DataFrame]
    enabled: bool = True
    fallback: str = "abort"
    retries: int = 2


@dataclass
class Report:
    ran: list[str] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)
    seconds: dict[str, float] = field(default_factory=dict)
    rows: dict[str, int] = field(default_factory=dict)


def run_steps(df: DataFrame, steps: Sequence[Step], materialise: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, Report]:
    """Steps in order, each materialised (checkpointed by default) so that a failure is this step's own."""
    from almanac.session import cut_lineage

    materialise, report = materialise or cut_lineage, Report()
    for step in steps:
        if not step.enabled:
            report.skipped.append(step.name)
            continue
        began, tries = time.monotonic(), 1 + (step.retries if step.fallback == "retry" else 0)
        for attempt in range(1, tries + 1):
            try:
                out = materialise(step.run(df))
                break
            except Exception:
                if step.fallback == "skip":
                    out = None
                    break
                if attempt == tries:
                    raise
        report.seconds[step.name] = time.monotonic() - began
        if out is None:
            report.skipped.append(step.name)
            continue
        df = out
        report.ran.append(step.name)
        report.rows[step.name] = df.count()
    return df, report
