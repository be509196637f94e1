"""Imports: candidates are checked against what is there, read, identified and reported, one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorefold.functions.text import normalize_inline
from lorefold.functions.urls import normalize_url, url_hash
from lorefold.operators import extract, library
from lorefold.sources import epub, files


def _meta(html: Column, key: str, value: str) -> Column:
    """Content of a meta element, whichever attribute comes first."""
    quoted = r"[\"']?" + value.replace(".", r"\.") + r"[\"']?"
    tail = r"[^>]*?\bcontent\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
    one = F.concat(F.regexp_extract(html, rf"(?is)<meta\b[^>]*\b{key}\s*=\s*{quoted}{tail}", 1), F.regexp_extract(html, rf"(?is)<meta\b[^>]*\b{key}\s*=\s*{quoted}{tail}", 2))
    two = F.regexp_extract(html, rf"(?is)<meta\b[^>]*?\bcontent\s*=\s*\"([^\"]*)\"[^>]*\b{key}\s*=\s*{quoted}", 1)
    return F.coalesce(F.nullif(F.trim(one), F.lit("")), F.nullif(F.trim(two), F.lit("")))


def _decoded(text: Column) -> Column:
    """The usual character references resolved."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def head_metadata(html: Column) -> dict[str, Column]:
    """title, canonical_url, original_url and author of a page's head, by expressions alone: the title
    element, then Open Graph, then Twitter; the canonical link before og:url, and the other way round
    for the original address."""
    some = lambda c: F.nullif(normalize_inline(_decoded(c)), F.lit(""))
    title = F.regexp_replace(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1), "<[^>]+>", " ")
    link = F.coalesce(F.nullif(F.regexp_extract(html, r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical[\"']?[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1), F.lit("")), F.nullif(F.regexp_extract(html, r"(?is)<link\b[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)[\"']?[^>]*\brel\s*=\s*[\"']?canonical", 1), F.lit("")))
    og = _meta(html, "property", "og:url")
    return {
        "title": F.coalesce(some(title), some(_meta(html, "property", "og:title")), some(_meta(html, "name", "twitter:title"))),
        "canonical_url": F.coalesce(some(link), some(og)),
        "original_url": F.coalesce(some(og), some(link)),
        "author": F.coalesce(some(_meta(html, "name", "author")), some(_meta(html, "property", "article:author"))),
    }


def without_parsed(candidates: DataFrame, items: DataFrame, key: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """(candidates to import, rows of the report for those that are there already, parsed)."""
    done = items.where("state = 'parsed'").select(F.col("item_id").alias(key)).distinct()
    return candidates.join(done, key, "left_anti"), candidates.join(done, key, "left_semi").withColumn("state", F.lit("skipped"))


def import_books(spark_files: DataFrame, items: DataFrame, skip_existing: bool = True, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """(books, report) of (path, content) rows of a library's tree. A folder must hold one book and a
    metadata file; the identity is the book's content. report: (path, item_id, state, error_code)."""
    scanned = files.scan_library(spark_files.select("path"))
    single = scanned.where("state = 'candidate'").withColumn("error_code", F.when(F.size("epubs") != 1, "multiple_epub_files"))
    refused = scanned.where("state <> 'candidate'").select(F.col("folder").alias("path"), F.lit(None).cast("string").alias("item_id"), F.lit("skipped").alias("state"), F.col("state").alias("error_code"))
    refused = refused.unionByName(single.where("error_code is not null").select(F.col("folder").alias("path"), F.lit(None).cast("string").alias("item_id"), F.lit("failed").alias("state"), "error_code"))
    wanted = single.where("error_code is null").select(F.col("epubs")[0].alias("path"), "opf")
    loaded = wanted.join(spark_files.select("path", "content"), "path").join(spark_files.select(F.col("path").alias("opf"), F.col("content").cast("string").alias("opf_text")), "opf").select("path", "content", F.col("opf_text").alias("opf"), F.concat(F.lit("epub:sha256:"), F.sha2("content", 256)).alias("item_id"))
    fresh, skipped = without_parsed(loaded, items) if skip_existing else (loaded, loaded.limit(0).withColumn("state", F.lit("skipped")))
    books = epub.books(fresh.limit(0) if dry_run else fresh)
    state = F.when(F.col("error").isNull(), "dry_run" if dry_run else "imported").otherwise("failed")
    done = fresh.select("path", "item_id").withColumn("error", F.lit(None).cast("string")) if dry_run else books.select("path", "item_id", "error")
    report = done.select("path", "item_id", state.alias("state"), F.when(F.col("error").isNotNull(), library.error_code(F.col("error"))).alias("error_code"))
    report = report.unionByName(skipped.select("path", "item_id", "state", F.lit(None).cast("string").alias("error_code"))).unionByName(refused)
    return books.where("error is null"), report


def import_pages(pages: DataFrame, items: DataFrame, skip_existing: bool = True) -> tuple[DataFrame, DataFrame]:
    """(documents, report) of (path, html) rows: identity by the address a page names, else by content."""
    meta = head_metadata(F.col("html"))
    named = pages.select("path", "html", *[c.alias(k) for k, c in meta.items()])
    address = F.coalesce(F.when(F.col("canonical_url").rlike("^https?://"), F.col("canonical_url")), F.when(F.col("original_url").rlike("^https?://"), F.col("original_url")))
    named = named.withColumn("normalized_url", normalize_url(address))
    named = named.withColumn("item_id", F.when(F.col("normalized_url").isNotNull(), F.concat(F.lit("url:sha256:"), url_hash(F.col("normalized_url")))).otherwise(F.concat(F.lit("singlefile_html:sha256:"), F.sha2("html", 256))))
    fresh, skipped = without_parsed(named, items) if skip_existing else (named, named.limit(0).withColumn("state", F.lit("skipped")))
    null = F.lit(None).cast("string")
    parsed = extract.select_candidates(extract.candidates(fresh.select(F.col("path").alias("rawdoc_id"), "html", null.alias("text"), F.coalesce("normalized_url", F.concat(F.lit("file://"), F.col("path"))).alias("page_url"), "title", F.col("title").alias("page_title"), null.alias("selection_html"))))
    documents = fresh.select("path", "item_id", "normalized_url", "author").join(parsed.withColumnRenamed("page_id", "path"), "path")
    report = documents.select("path", "item_id", F.when(F.col("sections_n") > 0, "imported").otherwise("failed").alias("state"), F.when(F.col("sections_n") == 0, "parse_failed").alias("error_code"))
    return documents, report.unionByName(skipped.select("path", "item_id", "state", null.alias("error_code")))


def import_urls(urls: DataFrame, fetched: DataFrame, items: DataFrame) -> DataFrame:
    """(url, item_id, state, error_code): addresses against their replies; a reply that is missing failed."""
    replies = files.accept_fetched(fetched)
    rows = urls.select("url").distinct().join(replies, "url", "left").withColumn("item_id", F.concat(F.lit("url:sha256:"), url_hash(F.col("normalized_url"))))
    fresh, skipped = without_parsed(rows, items)
    state = F.when(F.col("error_code").isNull() & F.col("html").isNotNull(), "imported").otherwise("failed")
    code = F.coalesce("error_code", F.when(F.col("html").isNull(), "fetch_failed"))
    return fresh.select("url", "item_id", state.alias("state"), code.alias("error_code")).unionByName(skipped.select("url", "item_id", "state", F.lit(None).cast("string").alias("error_code")))
