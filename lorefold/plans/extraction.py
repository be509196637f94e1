"""Queries on page extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorefold.functions import urls as u
from lorefold.operators import adapters as ad
from lorefold.operators import extract as ex
from lorefold.operators import links
from lorefold.operators.latest import holding_rows
from lorefold.session import materialise
from lorefold.session import table as t


def _pages(s, d):  # noqa: ANN001, ANN202
    """Snapshots, repeats of a capture removed; of different ones the latest holds."""
    return holding_rows(t(s, d, "page_snapshots"), ["rawdoc_id"], "captured_at", ["page_url", "title", "page_title", "html", "text", "selection_html"])


def _candidates(s, d):  # noqa: ANN001, ANN202
    return ex.candidates(_pages(s, d))


def _measured(s, d):  # noqa: ANN001, ANN202
    """Candidates without their sections, read once from a written table."""
    return materialise(_candidates(s, d).drop("sections"), "candidates")


def _rules(s):  # noqa: ANN001, ANN202
    """The adapters' address rules as a table of at most a few dozen rows: (adapter, priority, kind, rule)."""
    rows = [(a.id, a.priority, kind, rule) for a in ad.ADAPTERS for kind, rules in (("host", a.hosts), ("suffix", a.suffixes), ("path", a.paths), ("url", a.urls)) for rule in rules]
    return s.createDataFrame(rows, "adapter string, priority int, kind string, rule string")


# Addresses of sites with adapters, so that the rules have something to meet in any table.
ADDRESSES = [f"https://{host}/{path}" for a in ad.ADAPTERS for host in (*a.hosts, *("www" + x for x in a.suffixes if x.startswith("."))) for path in ("", "abs/2401.00001", "r/x/comments/1", "docs/a", "p/a-long-title")]


def adapter_match(s, d):  # noqa: ANN001, ANN201
    """(item_id, adapter, match_score): pages held against all adapter rules. The rules are a fixed table
    of the program, so the theta join broadcasts them."""
    fixed = s.createDataFrame([(x,) for x in ADDRESSES], "original_url string")
    urls = t(s, d, "knowledge_items").where("original_url is not null").select("original_url").union(fixed).distinct().withColumn("host", F.lower(F.regexp_extract("original_url", "://([^/?#:]+)", 1))).withColumn("path", u.path_of(F.col("original_url")))
    rules = F.broadcast(_rules(s))
    met = F.when(F.col("kind") == "host", F.col("host") == F.col("rule")).when(F.col("kind") == "suffix", F.endswith(F.col("host"), F.col("rule"))).when(F.col("kind") == "path", F.expr("path rlike rule")).otherwise(F.expr("original_url rlike rule"))
    worth = F.when(F.col("kind") == "host", 100).when(F.col("kind") == "suffix", 80).when(F.col("kind") == "path", 50).otherwise(40)
    hits = urls.join(rules, met).groupBy("original_url", "adapter", "priority").agg(F.sum(worth).alias("score"))
    return hits.select("original_url", "adapter", (F.col("score") + F.col("priority") / 10).alias("match_score"))


_FIXED = ", ".join(f"'{x}'" for x in ADDRESSES)
_RULES = ", ".join("('{}', {}, '{}', '{}')".format(a.id, a.priority, kind, rule) for a in ad.ADAPTERS for kind, rules in (("host", a.hosts), ("suffix", a.suffixes), ("path", a.paths), ("url", a.urls)) for rule in rules)

QUERIES = {
    "adapter_match": adapter_match,
    "html_candidates": lambda s, d: _candidates(s, d).drop("sections", "authors", "tags", "warnings"),
    "html_sections": lambda s, d: ex.select_candidates(_candidates(s, d)).select("page_id", "method", F.posexplode("sections").alias("idx", "x")).select("page_id", "method", "idx", "x.type", "x.level", "x.content"),
    "candidate_score": lambda s, d: _measured(s, d).select("page_id", "id", F.round(ex.score(F.col("method"), F.col("base"), F.col("text_length"), F.col("sections_n"), F.col("headings"), F.col("images"), F.col("tables"), F.col("codes"), F.col("link_density"), F.size("warnings")), 4).alias("score")),
    "candidate_select": lambda s, d: ex.select_candidates(_measured(s, d)).select("page_id", "id", "method", F.round("score", 4).alias("score")),
    "candidate_requested": lambda s, d: (lambda c: ex.select_candidates(c, c.where("ord = 1").select("page_id", F.col("id").alias("candidate"))).select("page_id", "id", "error"))(_measured(s, d)),
    "candidate_diagnostics": lambda s, d: ex.candidate_diagnostics(_measured(s, d)),
    "page_references": lambda s, d: ex.page_references(_pages(s, d)),
    "article_links": lambda s, d: links.article_links(links.page_links(_pages(s, d))),
    "candidate_previews": lambda s, d: ex.previews(_measured(s, d)).select("page_id", "id", "preview", "selected"),
}

ORACLE = {
    "adapter_match": f"with rules(adapter, priority, kind, rule) as (values {_RULES}), urls as (select distinct original_url, lower(regexp_extract(original_url, '://([^/?#:]+)', 1)) host, case when regexp_extract(original_url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' then '/' else regexp_extract(original_url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) end as path from (select original_url from knowledge_items union select unnest([{_FIXED}])) where original_url is not null)"
    " select original_url, adapter, cast(sum(case kind when 'host' then 100 when 'suffix' then 80 when 'path' then 50 else 40 end) + priority / 10.0 as double) match_score from urls join rules on case kind when 'host' then host = rule when 'suffix' then ends_with(host, rule) when 'path' then regexp_matches(path, rule) else regexp_matches(original_url, rule) end group by original_url, adapter, priority",
}
