"""Links of list pages that may lead to articles."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorefold.functions.dom import Node, parse_html

# Path steps of pages that are no articles, and parameters that only track.
NO_ARTICLES = "about privacy terms tags categories category authors author login register subscribe contact careers jobs press".split()
TRACKING = r"[?&](?:utm_|fbclid|gclid|ref|source=|mc_cid|mc_eid)[^&#]*"
_ASIDE = ("footer", "social", "share")
_HEADS = "h1,h2,h3,h4,h5,h6"


def _aside(link: Node) -> bool:
    """Whether the link stands in a footer or among sharing buttons, or asks not to be followed."""
    node = link
    while node is not None:
        if node.tag == "footer" or any(word in (node.get("class") or "").lower() for word in _ASIDE):
            return True
        node = node.parent
    return "nofollow" in (link.get("rel") or "").lower()


def _words(text: str | None) -> str | None:
    return " ".join((text or "").split()) or None


def page_links(pages: DataFrame, page_id: str = "rawdoc_id", html: str = "html", url: str = "page_url") -> DataFrame:
    """(page_id, page_url, ord, url, text, aside): every link of each page in order. The text is that of a heading in the link, else
    its own, else its label or title. Pages without html or address have none; repeated rows give
    repeated links."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, h, u in zip(b["p"], b["h"], b["u"]):
                for i, link in enumerate(parse_html(h).select("a[href]")):
                    head = link.first(_HEADS)
                    text = (_words(head.text()) if head is not None else None) or _words(link.text()) or link.get("aria-label") or link.get("title")
                    try:
                        target = urljoin(u, (link.get("href") or "").strip())
                    except ValueError:
                        continue
                    out.append((p, u, i, target, text, _aside(link)))
            yield pd.DataFrame(out, columns=["page_id", "page_url", "ord", "url", "text", "aside"])

    rows = pages.select(F.col(page_id).alias("p"), F.col(html).alias("h"), F.col(url).alias("u")).where("h is not null and u is not null")
    return rows.mapInPandas(run, "page_id string, page_url string, ord int, url string, text string, aside boolean")


def article_links(links: DataFrame) -> DataFrame:
    """(page_id, ord, url, text): links of page_links to other pages of the same origin that may be articles, without
    fragments and tracking parameters, each address once a page, where it stands first."""
    origin = lambda c: F.lower(F.regexp_extract(c, r"^(https?://[^/?#]+)", 1))
    path = lambda c: F.regexp_extract(c, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    whole = lambda c: F.when(path(c) == "", "/").otherwise(path(c))
    ok = (origin("url") != "") & (origin("url") == origin("page_url")) & (whole("url") != whole("page_url")) & ~F.col("aside")
    steps = r"(?i)/(?:" + "|".join(NO_ARTICLES) + r")(?:/|$)"
    clean = F.regexp_replace(F.regexp_replace("url", r"#.*$", ""), f"(?i){TRACKING}", "")
    rows = links.where(ok & ~path("url").rlike(steps)).withColumn("url", clean)
    return rows.groupBy("page_id", "url").agg(F.min_by(F.struct("ord", "text"), "ord").alias("f")).select("page_id", "f.ord", "url", "f.text")
