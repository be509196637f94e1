"""Settings, and what a client shows of items: pure projections."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits and their bounds, and messages that are the caller's fault.
BOUNDS = {"saved_list_limit": (10, 200), "request_timeout_ms": (3000, 60000)}
CALLER_ERRORS = (
    "server_fetch does not support file://", "Expected HTML", "candidateId", "too large", "Timed out fetching", "Path escapes knowledge store", "Unsafe relative path", "unsupported_file_type", "pandoc_missing", "parse_failed",
    "EPUB file is required", "fileBase64 is required", "multipart", "Knowledge item does not exist", "Document does not exist", "Asset does not exist", "reparse currently supports epub items only",
    "store clear confirmation is required", "store parsed-results clear confirmation is required",
)


@dataclass(frozen=True)
class Settings:
    """What a client may set."""

    server_url: str = "http://127.0.0.1:18765"
    token: str = ""
    input_mode: str = "browser_html"
    allow_server_fetch: bool = True
    request_timeout_ms: int = 15000
    saved_list_limit: int = 50

    @classmethod
    def of(cls, stored: Mapping[str, object] | None) -> Settings:
        """Stored values made valid: addresses without a slash at their end, unknown modes and numbers that cannot
        be read as the default, numbers within their bounds."""
        stored = stored or {}
        plain = cls()
        mode = stored.get("input_mode")
        numbers = {}
        for name, (least, most) in BOUNDS.items():
            try:
                numbers[name] = min(most, max(least, round(float(stored.get(name)))))  # type: ignore[arg-type]
            except (TypeError, ValueError, OverflowError):
                numbers[name] = getattr(plain, name)
        return cls(
            str(stored.get("server_url") or plain.server_url).strip().rstrip("/") or plain.server_url,
            str(stored.get("token") or plain.token),
            mode if mode in ("server_fetch", "browser_html") else plain.input_mode,
            stored.get("allow_server_fetch") is not False,
            **numbers,
        )

    def shown(self) -> dict[str, object]:
        """The settings for diagnostics, the token hidden."""
        return asdict(self) | {"token": "*" * 8 if self.token else ""}


@dataclass(frozen=True)
class Limits:
    """Limits of ingestion."""

    fetch_timeout_ms: int = 15000
    max_html_bytes: int = 10 << 20
    max_import_bytes: int = 100 << 20

    @classmethod
    def of(cls, environment: Mapping[str, str] = os.environ) -> Limits:
        """From LOREFOLD_FETCH_TIMEOUT_MS, LOREFOLD_MAX_HTML_BYTES and LOREFOLD_MAX_IMPORT_BYTES."""
        plain = asdict(cls())
        return cls(**{k: int(environment.get(f"LOREFOLD_{k.upper()}", v)) for k, v in plain.items()})


def badge(state: Column) -> Column:
    """What a client shows beside a saved address."""
    return F.when(state == "parsed", "OK").when(state == "captured", "RAW").otherwise("")


def page_title_choice(content_title: Column, meta_title: Column, raw_title: Column) -> Column:
    """The page's title: that of the document's meta data if it differs from the content's, else that of the
    raw capture if it does, else the content's."""
    differs = lambda x: x.isNotNull() & (x != "") & ((x != content_title) | content_title.isNull())
    return F.when(differs(meta_title), meta_title).when(raw_title.isNotNull() & ((raw_title != content_title) | content_title.isNull()), raw_title).otherwise(content_title)


def parser_method(version: Column) -> Column:
    """The method a parser version names behind its last colon."""
    return F.when(F.contains(version, F.lit(":")), F.substring_index(version, ":", -1)).otherwise("unknown")


def error_status(message: Column) -> Column:
    """400 for what the caller did wrong, else 500."""
    return F.when(F.exists(F.array(*[F.lit(e) for e in CALLER_ERRORS]), lambda e: F.contains(message, e)), 400).otherwise(500)


def formatted_bytes(n: Column) -> Column:
    """A number of bytes, as MiB if it is a whole number of them."""
    mib = F.lit(1 << 20)
    return F.when(n % mib == 0, F.concat((n / mib).cast("bigint").cast("string"), F.lit(" MiB"))).otherwise(F.concat(n.cast("string"), F.lit(" bytes")))


def summary_headings(sections: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(doc_id, section_id, valid): the sections to summarise. Without wanted, all headings that have an id; with it
    (doc_id, section_id), those, marked by whether each is a heading of its document."""
    headings = sections.where("type = 'heading' and section_id is not null").select("doc_id", "section_id").distinct()
    if wanted is None:
        return headings.withColumn("valid", F.lit(True))
    marked = wanted.select("doc_id", "section_id").distinct().join(headings.withColumn("valid", F.lit(True)), ["doc_id", "section_id"], "left")
    return marked.withColumn("valid", F.coalesce("valid", F.lit(False)))


def parsed_impact(items: DataFrame, documents: DataFrame, chunks: DataFrame, members: DataFrame) -> DataFrame:
    """One row: items, web_items, rows, collection_refs that clearing the parsed results would touch."""
    parsed = items.where("active_doc_id is not null")
    a = parsed.agg(F.count("*").alias("items"), F.count_if(F.col("source_type") == "url").alias("web_items"), F.lit(1).alias("_one"))
    rows = documents.select(F.lit(1).alias("x")).unionAll(chunks.select(F.lit(1).alias("x"))).agg(F.count("*").alias("rows"), F.lit(1).alias("_one"))
    refs = members.join(parsed.select(F.col("item_id").alias("member")), "member", "left_semi").agg(F.count("*").alias("collection_refs"), F.lit(1).alias("_one"))
    return a.join(rows, "_one").join(refs, "_one").drop("_one")
