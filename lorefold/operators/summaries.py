"""Summaries of document sections by a language-model provider, with map and reduce over long scopes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorefold.operators.sections import SUMMARY_LIMIT, SUMMARY_OVERLAP, SUMMARY_SIZE

Provider = Callable[[str, int], str]


def token_budget(kind: str, level: int | None) -> int:
    """Most tokens of a reply: summaries of deeper headings are shorter; other kinds have one size."""
    if kind == "summary" and level is not None:
        return 400 if level <= 1 else 250 if level == 2 else 200
    return {"summary": 500, "tag": 100, "note": 300, "highlight": 400}[kind]


def parts(text: str, limit: int = SUMMARY_LIMIT, size: int = SUMMARY_SIZE, overlap: int = SUMMARY_OVERLAP) -> list[str]:
    """A scope over the limit as overlapping parts, others whole."""
    return [text] if len(text) <= limit else [text[i : i + size] for i in range(0, len(text), size - overlap)]


def summarise(text: str, level: int | None, provider: Provider) -> str:
    """One call for a short scope, else one per part and one over their summaries."""
    pieces = parts(text)
    if len(pieces) == 1:
        return provider(text, token_budget("summary", level))
    return provider("\n\n".join(provider(p, token_budget("note", None)) for p in pieces), token_budget("summary", level))


def first_sentences(text: str, tokens: int) -> str:
    """A provider for tests: the beginning of the text within the budget."""
    return text[: tokens * 4].rsplit(".", 1)[0]


def summaries(scopes: DataFrame, model: str, provider: Provider = first_sentences) -> DataFrame:
    """(doc_id, idx, model, summary, error) of (doc_id, idx, level, text); errors stay with their row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                try:
                    rows.append((r.doc_id, r.idx, model, summarise(r.text or "", None if pd.isna(r.level) else int(r.level), provider), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((r.doc_id, r.idx, model, None, str(e)))
            yield pd.DataFrame(rows, columns=["doc_id", "idx", "model", "summary", "error"])

    return scopes.select("doc_id", "idx", "level", "text").mapInPandas(run, "doc_id string, idx int, model string, summary string, error string")


def task_progress(rows: DataFrame) -> DataFrame:
    """One row: tasks by state and in all."""
    count = lambda s: F.count_if(F.col("state") == s).alias(s)
    return rows.agg(count("pending"), count("completed"), count("failed"), count("skipped"), F.count("*").alias("total"))
