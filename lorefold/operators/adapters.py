"""Site adapters: rules by which pages of known sites are read, as data."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

_NOISE = ("script", "style", "button", "form", "aside")


@dataclass(frozen=True)
class Adapter:
    """One site. exclude holds what is left out of the content beyond `remove`."""

    id: str
    priority: int
    bonus: int
    min_text: int
    hosts: tuple[str, ...]
    selectors: tuple[str, ...]
    exclude: tuple[str, ...] = ()
    remove: tuple[str, ...] = _NOISE
    suffixes: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()
    urls: tuple[str, ...] = ()
    title: tuple[str, ...] = ("h1", "meta[property='og:title']", "title")
    author: tuple[str, ...] = ("meta[name='author']",)
    published: tuple[str, ...] = ("meta[property='article:published_time']", "time[datetime]")
    unwrap: tuple[str, ...] = ()
    cards: bool = False
    fallback_cleanup: bool = True
    tags: tuple[str, ...] = ()

    @property
    def image(self) -> tuple[str, ...]:
        return ("meta[property='og:image']", f"{self.selectors[0]} img")


# The sites known, what their addresses look like and where their articles stand.
ADAPTERS = (
    Adapter("allthings_distributed", 76, 22, 160, ("www.allthingsdistributed.com", "allthingsdistributed.com"), ("span[itemprop='articleBody']", "main section span[itemprop='articleBody']", "main section"), (*_NOISE, "nav", "footer", "[class*='recommended']", "[class*='related']", "[class*='share']"), (*_NOISE, "nav", "footer", "[class*='recommended']", "[class*='share']"), title=("meta[property='og:title']", "main section > h2", "title"), published=("meta[property='article:published_time']", "p.meta time[datetime]", "time[datetime]")),
    Adapter("arxiv_html", 100, 45, 200, ("arxiv.org", "www.arxiv.org"), ("article.ltx_document", "article"), ("nav", "header", "footer", ".ltx_page_footer", ".ltx_role_navigation"), ("script", "style", "button", "form", "nav", "header", "footer"), paths=("^/(abs|html|pdf)/",), title=("h1.ltx_title_document", "meta[name='citation_title']", "meta[property='og:title']", "title"), author=(".ltx_authors .ltx_personname", "meta[name='citation_author']"), published=("meta[name='citation_publication_date']", "meta[name='citation_online_date']")),
    Adapter("blog_google", 80, 25, 140, ("blog.google", "www.blog.google"), ("div.rich-text", "article div.rich-text", "main div.rich-text"), (*_NOISE, "[class*='newsletter']", "[class*='share']", "[class*='related']"), (*_NOISE, "[class*='newsletter']", "[class*='share']"), title=("meta[property='og:title']", "h1", "title"), author=("meta[name='authors']", "meta[name='article-author']", "meta[name='author']"), published=("meta[name='published_time']", "meta[property='article:published_time']", "time[datetime]")),
    Adapter("brendan_gregg_blog", 74, 20, 140, ("www.brendangregg.com", "brendangregg.com"), ("div.site div.post", "div.post", "main"), (*_NOISE, "nav", "footer", "[class*='sidebar']", "[class*='related']"), (*_NOISE, "nav", "footer", "[class*='sidebar']"), title=("div.site h2.big", "h1", "meta[property='og:title']", "title"), published=("div.site p.meta", "time[datetime]", "meta[property='article:published_time']")),
    Adapter("engineering_fb", 82, 28, 160, ("engineering.fb.com", "www.engineering.fb.com"), ("main#main article.hentry div.entry-content", "main article.type-post div.entry-content", "article.post div.entry-content"), (*_NOISE, ".robots-nocontent", ".sharedaddy", "[class*='jetpack']", "[class*='share']", "[class*='related']"), (*_NOISE, ".robots-nocontent", ".sharedaddy", "[class*='jetpack']"), title=("main#main article.hentry .entry-title", "main article.type-post .entry-title", "meta[property='og:title']", "title"), author=("main#main article.hentry .entry-authors a.author", "meta[name='twitter:data1']", "meta[name='author']")),
    Adapter("fern_docs", 80, 25, 120, ("docs.cohere.com",), ("main article", "article", "main .fern-layout-page", "main"), ("#fern-sidebar", "#fern-sidebar-spacer", "#fern-toc", "#fern-footer", ".fern-header-content", "#fern-search-button", "#fern-ask-ai-button", "[data-testid='search-button']"), (*_NOISE, "nav", "header", "footer"), suffixes=(".docs.buildwithfern.com",), paths=("^/(docs|reference|v[0-9]+)/",), author=(), published=("time[datetime]", "meta[property='article:published_time']"), tags=("docs-platform:fern",)),
    Adapter("freedium", 90, 30, 120, ("freedium-mirror.cfd",), ("article", ".main-content", "main", ".container"), ("nav", "header", "footer", "#problemModal", ".storage-notification-container", "[class*='notification']", "[class*='subscribe']", "[class*='recommend']", "[class*='related']"), urls=(r"^https?://freedium-mirror\.cfd/https?://medium\.com/",), author=("a[href*='medium.com/@']", "[rel='author']", "meta[name='author']"), published=("time[datetime]", "meta[property='article:published_time']", "[class*='date']"), unwrap=(".main-content > div",), cards=True),
    Adapter("juejin", 72, 18, 120, ("juejin.cn", "www.juejin.cn"), ("#article-root .article-viewer.markdown-body", "#article-root", "article"), (*_NOISE, "[class*='recommend']", "[class*='comment']", "[class*='share']", "[class*='sidebar']"), (*_NOISE, "[class*='recommend']", "[class*='comment']", "[class*='share']"), paths=("^/post/",), title=("meta[itemprop='headline']", "h1", "meta[property='og:title']", "title"), author=("div[itemprop='author'] meta[itemprop='name']", "meta[name='author']"), published=("meta[itemprop='datePublished']", "meta[property='article:published_time']", "time[datetime]")),
    Adapter("medium", 70, 20, 120, ("medium.com",), ("article", "main article", "main"), ("nav", "header", "footer", "aside", "[aria-label*='clap' i]", "[class*='meter']", "[class*='recommend']", "[class*='related']"), suffixes=(".medium.com",), author=("a[rel='author']", "a[href*='/@']", "meta[name='author']"), published=("time[datetime]", "meta[property='article:published_time']"), cards=True),
    Adapter("meituan_tech", 85, 30, 180, ("tech.meituan.com", "www.tech.meituan.com"), ("div.post-content div.content", "article div.content", "main"), (*_NOISE, ".qrcode", "[class*='qr']", "[class*='share']", "[class*='recommend']", "[class*='related']"), (*_NOISE, ".qrcode", "[class*='share']"), title=("h1.post-title a", "h1.post-title", "meta[property='og:title']", "title"), author=("div.post-container > div.meta-box:not(.post-bottom-meta-box) .m-post-nick", "meta[name='author']"), published=("meta[property='article:published_time']", "div.post-container > div.meta-box:not(.post-bottom-meta-box) .m-post-date")),
    Adapter("reddit", 85, 25, 80, ("www.reddit.com", "reddit.com", "old.reddit.com"), ("shreddit-post [property='schema:articleBody']", "shreddit-post [slot='text-body']", "shreddit-post", ".thing.link .usertext-body .md"), ("nav", "header", "footer", "aside", "shreddit-comment", "[slot='comment']", "[data-testid='reddit-chat-client']", "[class*='sidebar' i]", "[class*='recommend' i]", "[class*='related' i]"), (*_NOISE, "nav", "header", "footer"), paths=("^/r/[^/]+/comments/",), title=("shreddit-post[post-title]", "h1", "a.title", "title"), author=("shreddit-post[author]", ".thing.link[data-author]", "[slot='credit-bar'] a[href*='/user/']"), published=("shreddit-post[created-timestamp]", "time[datetime]"), fallback_cleanup=False),
    Adapter("smashing_magazine", 78, 24, 180, ("www.smashingmagazine.com", "smashingmagazine.com"), ("article.article div.c-garfield-the-cat", "div.c-garfield-the-cat", "article.article"), (*_NOISE, ".l-author-bio", ".article__comments", "[class*='ad']", "[class*='newsletter']", "[class*='related']", "[class*='share']"), (*_NOISE, ".l-author-bio", ".article__comments", "[class*='ad']", "[class*='newsletter']"), title=(".c-garfield-header h1", "article.article h1", "meta[property='og:title']", "title"), author=(".c-garfield-header .author-post__author-title", ".c-garfield-header a[href*='/author/']", "meta[name='author']")),
)


def checked(adapters: Iterable[Adapter]) -> tuple[Adapter, ...]:
    """The adapters, if their ids differ."""
    out = tuple(adapters)
    seen: set[str] = set()
    for a in out:
        if a.id in seen:
            raise ValueError(f"two adapters have the id {a.id}")
        seen.add(a.id)
    return out


@dataclass(frozen=True)
class Match:
    adapter: Adapter
    score: float
    reason: str


def match_adapters(url: str, original_url: str | None = None, adapters: tuple[Adapter, ...] = ADAPTERS) -> list[Match]:
    """Adapters whose rules meet one of the page's addresses, the best score first, then the higher
    priority. Rules on paths hold for any host."""
    found = []
    labelled = [("url", url)] + ([("originalUrl", original_url)] if original_url and original_url != url else [])
    for a in adapters:
        best: tuple[float, str] | None = None
        for label, value in labelled:
            try:
                parts = urlsplit(value)
                host, path = (parts.hostname or "").lower(), parts.path or "/"
            except ValueError:
                continue
            if not parts.scheme:
                continue
            reasons = [(100, f"{label}:host:{host}")] if host in a.hosts else []
            reasons += [(80, f"{label}:hostSuffix:{s}") for s in a.suffixes if host.endswith(s)]
            reasons += [(50, f"{label}:path:{p}") for p in a.paths if re.search(p, path)]
            reasons += [(40, f"{label}:url:{p}") for p in a.urls if re.search(p, value)]
            score = sum(n for n, _ in reasons)
            if score and (best is None or score > best[0]):
                best = (score, ", ".join(r for _, r in reasons))
        if best:
            found.append(Match(a, best[0] + a.priority / 10, best[1]))
    return sorted(found, key=lambda m: (-m.score, -m.adapter.priority))


def arxiv_id(url: str) -> str | None:
    try:
        parts = urlsplit(url)
    except ValueError:
        return None
    if (parts.hostname or "").lower() not in ("arxiv.org", "www.arxiv.org"):
        return None
    steps = [p for p in parts.path.split("/") if p]
    if steps and steps[0].lower() in ("abs", "html", "pdf"):
        steps = steps[1:]
    tail = re.sub(r"\.pdf$", "", "/".join(steps), flags=re.IGNORECASE)
    return tail if re.fullmatch(r"(\d{4}\.\d{4,5}|[a-z][a-z0-9-]*(?:\.[a-z]{2})?/\d{7})(?:v\d+)?", tail, re.IGNORECASE) else None


def adapter_tags(adapter: Adapter, url: str) -> list[str]:
    if adapter.id == "arxiv_html":
        paper = arxiv_id(url)
        return ([f"paper:work_id:arxiv:{paper}"] if paper else []) + ["paper:variant:preprint"]
    return list(adapter.tags)


def mirrored_url(url: str) -> str | None:
    """The address a mirror carries in its path."""
    try:
        parts = urlsplit(url)
    except ValueError:
        return None
    if (parts.hostname or "").lower() != "freedium-mirror.cfd":
        return None
    inner = unquote(parts.path[1:])
    return inner if re.match(r"https?://", inner) else None


def fetch_url(url: str) -> str:
    paper = arxiv_id(url)
    return f"https://arxiv.org/html/{paper}" if paper else url


def canonical_url(original: str, page_canonical: str | None = None) -> str:
    return mirrored_url(original) or page_canonical or original
