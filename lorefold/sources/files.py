"""Sources from file systems and lists: library folders, pages, address lists, sidebars and captures."""

from __future__ import annotations

import re
from pathlib import PurePosixPath
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lorefold.functions.urls import normalize_url
from lorefold.operators.adapters import fetch_url

MAX_HTML_BYTES = 10 * 1024 * 1024
# Folders of projects that hold no pages.
SKIPPED_FOLDERS = ("node_modules", "dist", "build")
CONTENT_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml", "md": "text/markdown", "json": "application/json", "html": "text/html"}


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of all files below a folder, their contents not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")


def scan_library(files: DataFrame) -> DataFrame:
    """(folder, state, epubs, opf, cover, toc): folders with books and a metadata file are candidates and end
    the descent; folders with one of the two only are skipped and name what is missing."""
    name, folder = F.element_at(F.split("path", "/"), -1), F.regexp_replace("path", "/[^/]*$", "")
    low = F.lower(name)
    pick = lambda cond: F.min(F.when(cond, F.col("path")))
    rows = files.select("path", folder.alias("folder"), low.alias("low")).groupBy("folder").agg(
        F.sort_array(F.collect_list(F.when(F.col("low").endswith(".epub"), F.col("path")))).alias("epubs"),
        pick(F.col("low") == "metadata.opf").alias("opf"),
        F.coalesce(pick(F.col("low").rlike(r"^cover\.(jpe?g|png|webp)$")), pick(F.col("low").rlike(r"\.(jpe?g|png|webp)$"))).alias("cover"),
        pick(F.col("low") == "toc.json").alias("toc"),
    )
    books, meta = F.size("epubs") > 0, F.col("opf").isNotNull()
    rows = rows.withColumn("state", F.when(books & meta, "candidate").when(books, "missing_opf").when(meta, "missing_epub")).where("state is not null")
    parents = rows.where("state = 'candidate'").select(F.col("folder").alias("parent"))
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split("folder", "/")) - 1, F.lit(1))), lambda i: F.array_join(F.slice(F.split("folder", "/"), 1, i), "/"))
    inside = rows.select("folder", F.explode(above).alias("parent")).join(parents, "parent").where("folder <> parent").select("folder").distinct()
    return rows.join(inside, "folder", "left_anti").select("folder", "state", "epubs", "opf", "cover", "toc")


def scan_pages(files: DataFrame, root: str) -> DataFrame:
    """Paths of HTML files below root, without hidden and build folders."""
    below = F.substring("path", F.lit(1) + F.instr("path", root.rstrip("/")) + len(root.rstrip("/")) - 1, F.length("path"))
    skipped = "/(?:" + r"\.[^/]*|" + "|".join(SKIPPED_FOLDERS) + ")(?:/|$)"
    return files.where(F.lower("path").rlike(r"\.html?$") & ~below.rlike(skipped)).select("path")


def scan_urls(lines: DataFrame) -> DataFrame:
    """(url, line) of an address list (line, value): blanks and comments dropped, the first of equals kept."""
    value = F.trim("value")
    rows = lines.select("line", value.alias("url")).where("url <> '' and not startswith(url, '#')")
    return rows.groupBy("url").agg(F.min("line").alias("line"))


def parse_sidebar(text: str, base: str) -> list[dict]:
    """Entries (depth, title, url, parent, folder) of a contents page: indentation gives the depth, bold
    entries are folders; parent is the number of the entry above."""
    out: list[dict] = []
    stack: list[tuple[int, int, list[str]]] = []
    for line in text.split("\n"):
        m = re.match(r"^(\s*)[-*]\s+(?:\[(.+?)\]\((.+?)\)|<strong>(.+?)</strong>)", line)
        if not m:
            continue
        bold = m.group(4) is not None
        depth, title = len(m.group(1)) // 2, (m.group(2) or m.group(4)).strip()
        url = urljoin(base, m.group(3)) if m.group(3) else ""
        if depth == 0 and not bold:
            stack = []
        while stack and stack[-1][0] >= depth:
            stack.pop()
        parent = stack[-1][1] if stack else None
        above = stack[-1][2] if stack else []
        folder = [*above, file_name(title)] if bold else above
        out.append({"depth": depth, "title": title, "url": url, "parent": parent, "folder": "/".join(folder)})
        stack.append((depth, len(out) - 1, folder))
    return out


def file_name(text: str) -> str:
    return re.sub(r'[<>:"/\\|?*\n\r]', "", text).strip()[:100] or "untitled"


def safe_path(root: str, relative: str) -> str:
    """A path below root; absolute, drive and escaping paths are refused."""
    if relative.startswith(("/", "\\")) or re.match(r"^[A-Za-z]:", relative):
        raise ValueError(f"Path escapes the store: {relative}")
    parts: list[str] = []
    for p in PurePosixPath(relative.replace("\\", "/")).parts:
        if p == "..":
            if not parts:
                raise ValueError(f"Path escapes the store: {relative}")
            parts.pop()
        elif p != ".":
            parts.append(p)
    return "/".join([root.rstrip("/"), *parts])


def is_html(content_type: Column) -> Column:
    low = F.lower(content_type)
    return low.contains("text/html") | low.contains("application/xhtml+xml")


def accept_snapshots(snapshots: DataFrame, max_bytes: int = MAX_HTML_BYTES, html: str = "html", url: str = "page_url") -> DataFrame:
    """snapshots with normalized_url and error_code: html_too_large, invalid_url or null if accepted."""
    norm = normalize_url(F.col(url))
    return snapshots.withColumn("normalized_url", norm).withColumn("error_code", F.when(F.octet_length(html) > max_bytes, "html_too_large").when(F.col("normalized_url").isNull(), "invalid_url"))


def accept_fetched(fetched: DataFrame, max_bytes: int = MAX_HTML_BYTES) -> DataFrame:
    """Replies (url, final_url, status, content_type, html) with the identity of the final address and an
    error_code: http_status, unsupported_content, html_too_large, invalid_url or null."""
    error = F.when((F.col("status") < 200) | (F.col("status") >= 300), "http_status").when(~is_html(F.coalesce("content_type", F.lit(""))), "unsupported_content").when(F.octet_length("html") > max_bytes, "html_too_large")
    rows = fetched.withColumn("normalized_url", normalize_url(F.coalesce("final_url", "url")))
    return rows.withColumn("error_code", F.coalesce(error, F.when(F.col("normalized_url").isNull(), "invalid_url")))


def fetch_targets(urls: list[str]) -> list[tuple[str, str]]:
    """(address, address to fetch) by the adapters' rules."""
    return [(u, fetch_url(u)) for u in urls]


def asset_rows(files: DataFrame) -> DataFrame:
    """(path, asset_id, content_type) of stored images: named by content."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kinds = F.create_map(*[F.lit(x) for pair in sorted(CONTENT_TYPES.items()) for x in pair])
    return files.select("path", F.concat(F.substring(F.sha2("content", 256), 1, 16), F.lit("."), F.when(ext == "", "bin").otherwise(ext)).alias("asset_id"), F.coalesce(F.element_at(kinds, ext), F.lit("application/octet-stream")).alias("content_type"))


def latest_capture(rawdocs: DataFrame) -> DataFrame:
    """The last written capture of each item, for reading again."""
    w = W.partitionBy("item_id").orderBy(F.col("created_at").desc(), "rawdoc_id", F.xxhash64(*[c for c, kind in rawdocs.dtypes if not kind.startswith("map")]))
    return rawdocs.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
