"""Page boilerplate mixed with main content.

Method: tree scoring. Each paragraph of a page passes points for its length and commas to its
ancestors; a container's points are discounted by its link density; the best container and those
siblings that carry points of their own are kept. Inside the kept blocks, lines by which sites mark
bylines, sharing, notices, advertisements, comments and other pages are left out, last of all the
lines that recur over the pages of the host.

The tree is built from one regular-expression pass over the markup, and a page is one row of work,
so the operator is a map over pages; only hashes of kept lines are shuffled, to be held against the
counts of lines by host.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorefold.functions.text import host_key
from lorefold.llm.template_residue import _BYLINE, _FURNITURE, _TRAILER, article_weight, by_sentences, evidence, has_placeholder, masked, page_keys, page_lines, site_name
from lorefold.operators.skew import salted_lookup
from lorefold.session import materialise

# A kept line is boilerplate if it stands on this many pages of its host and on this share of them,
# or, if it names the site, on pages of this many hosts.
MIN_PAGES, MIN_SHARE, MIN_HOSTS = 4, 0.08, 10

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|([^<]+|<)", re.DOTALL | re.IGNORECASE)
_ATTR = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)

# Roles of HTML elements.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul li".split())
_SIDE_TAGS = frozenset("nav aside footer header dialog form".split())
# Words of class and id that name side matter.
_SIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|by|byline|bottom|com|comments?|consent|cookies?|dialog|disclaimer|footer|foot|legal|login|masthead|menu|meta|modal|nav\w*|newsletter|pagination|popup|promo|recommend\w*|rel|related|search|share|sharing|sidebar|skip|social|sponsor\w*|subscribe|tags|teaser|toolbar|topbar|tracking|widget)(?:$|[\s_-])",
    re.IGNORECASE,
)
# Beginnings and forms of side lines, in the corpus' languages.
_SIDE_LINE = re.compile(
    r"^(?:share|teilen|partager|compartir|partilhar|分享)\s*[:：]|^(?:advertisement|anzeige|werbung|publicité|publicidad|publicidade|广告|sponsored)\W*$"
    r"|^(?:skip to|zum inhalt|aller au contenu|saltar al|ir para o|跳到)|^(?:back to top|nach oben|haut de page|volver arriba|voltar ao topo|返回顶部)\W*$"
    r"|^(?:subscribe|sign up|newsletter)\b|\bcookies?\b.{0,80}(?:accept|aceptar|aceitar|accepter|akzeptieren|choose|接受)|(?:we use|agree to|usamos|utilisons|verwenden|utiliza|使用).{0,40}cookie|^©|^\(c\)\s|^copyright|all rights reserved|^(?:imprint|impressum|mentions légales|aviso legal|版权声明)\b",
    re.IGNORECASE,
)
_AD_LABEL = re.compile(r"^(?:advertisement|anzeige|werbung|publicité|publicidad|publicidade|广告|sponsored)\W*$", re.IGNORECASE)
_OWN_BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 li pre blockquote figcaption dt dd".split())
_BULLET = re.compile(r"^\s*(?:[•·▪◦*–—-]|\d{1,3}[.)])\s+")
_SPACE = re.compile(r"\s+")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")


class Page:
    """Containers and blocks of a page. A block is text between boundaries: block-level tags, line
    breaks and new lines of the source."""

    __slots__ = ("parent", "tag", "name", "block_node", "text", "links", "title_at")

    def __init__(self, source: str) -> None:
        self.parent, self.tag, self.name = [-1], ["#root"], [""]
        self.block_node: list[int] = []
        self.text: list[str] = []
        self.links: list[int] = []
        self.title_at = -1
        node, in_head, in_link, buffer, linked = 0, 0, 0, [], 0
        pre = 0

        def flush() -> None:
            nonlocal linked
            if buffer:
                value = "".join(buffer).strip() if pre else _SPACE.sub(" ", "".join(buffer)).strip() if "\t" not in buffer else _row(buffer)
                if value:
                    self.block_node.append(node)
                    self.text.append(value)
                    self.links.append(min(linked, len(value)))
                buffer.clear()
            linked = 0

        for m in _TOKEN.finditer(source):
            tag = m.group(3)
            if tag is None:
                raw = m.group(5)
                if raw is None or in_head:
                    continue
                for i, piece in enumerate(raw.split("\n")):
                    if i:
                        flush()
                    if piece:
                        if "&" in piece:
                            piece = entities.unescape(piece)
                        buffer.append(piece.replace("\t", " "))
                        if in_link:
                            linked += len(piece)
                continue
            tag, closing = tag.lower(), m.group(2)
            if tag in ("head", "title"):
                in_head = 0 if closing and tag == "head" else in_head + (tag == "head" and not closing)
                if tag == "head":
                    continue
                in_head += -1 if closing else 1
                in_head = max(0, in_head)
                continue
            if tag == "body":
                in_head = 0
            if tag == "a":
                in_link = 0 if closing else 1
                continue
            if tag in _INLINE:
                continue
            if tag in ("td", "th"):
                if not closing and buffer:
                    buffer.append("\t")
                continue
            flush()
            if tag in _VOID or tag in ("html", "tbody", "thead", "tfoot"):
                continue
            if closing:
                up = node
                while up > 0 and self.tag[up] != tag:
                    up = self.parent[up]
                if up > 0:
                    node = self.parent[up]
                if tag == "pre":
                    pre = 0
                continue
            if tag in _CLOSES_P:
                up = node
                while up > 0 and self.tag[up] in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                    up = self.parent[up]
                node = up
            if tag == "li" and self.tag[node] == "li":
                node = self.parent[node]
            if tag == "pre":
                pre = 1
            self.parent.append(node)
            self.tag.append(tag)
            attrs = m.group(4)
            self.name.append(" ".join(x or y or z for x, y, z in _ATTR.findall(attrs)) if "=" in attrs else "")
            node = len(self.tag) - 1
            if tag == "h1" and self.title_at < 0:
                self.title_at = node
        flush()


def _row(cells: list[str]) -> str:
    return "\t".join(_SPACE.sub(" ", c).strip() for c in "".join(cells).split("\t")).strip()


def _wide(text: str) -> int:
    return sum("぀" <= c <= "鿿" for c in text) if not text.isascii() else 0


def main_blocks(page: Page, title: str | None) -> list[bool]:
    """Which blocks belong to the main body."""
    n = len(page.tag)
    points, chars, linked = [0.0] * n, [0] * n, [0] * n
    side = [page.tag[i] in _SIDE_TAGS or bool(page.name[i] and _SIDE.search(page.name[i])) for i in range(n)]
    for i in range(1, n):
        side[i] = side[i] or side[page.parent[i]]
    trailing = [False] * n  # containers that open with a header of comments or other pages
    first_seen = [False] * n
    headed = page.title_at
    for at, text, links in zip(page.block_node, page.text, page.links):
        size = len(text)
        up = at
        while up >= 0:
            chars[up] += size
            linked[up] += links
            if not first_seen[up]:
                first_seen[up] = True
                trailing[up] = bool(size < 90 and _TRAILER.search(text))
            up = page.parent[up]
        if headed < 0 and title and text == title:
            headed = at
        weight = size + 2 * _wide(text)
        if weight < 25 or side[at] or 2 * links > size:
            continue
        gain = 1 + min(3.0, weight / 100) + sum(text.count(c) for c in ",，、")
        up, share = (at if page.tag[at] not in ("p", "li", "blockquote", "pre", "tr", "td") else page.parent[at]), 1.0
        while up >= 0 and share > 0.1:
            points[up] += gain * share
            up, share = page.parent[up], share / 2 if share == 1 else share * 2 / 3
    bonus = 25.0
    up = page.parent[headed] if headed > 0 and page.tag[headed] == "h1" else headed
    while up > 0 and bonus > 5:
        points[up] += bonus
        up, bonus = page.parent[up], bonus / 2
    score = [p * (1 - linked[i] / chars[i]) * (0.2 if trailing[i] else 1) if chars[i] else 0.0 for i, p in enumerate(points)]
    best = max(range(n), key=score.__getitem__, default=0)
    if not score or score[best] <= 1:
        return [False] * len(page.text)
    keep = {best}
    for i in range(1, n):
        if i != best and page.parent[i] == page.parent[best] and best > 0 and not side[i] and not trailing[i] and page.tag[i] not in ("h1", "h2", "h3", "h4", "h5", "h6"):
            prose = chars[i] > 80 and linked[i] < 0.25 * chars[i]
            if prose and score[i] >= max(6.0, 0.2 * score[best]):
                keep.add(i)
    inside = [False] * n
    for i in range(n):
        inside[i] = i in keep or (page.parent[i] >= 0 and inside[page.parent[i]])
    out = []
    for at, text, links in zip(page.block_node, page.text, page.links):
        ok = inside[at] or at == headed
        if ok and side[at] and not _side_ancestor_kept(page, at, keep, side):
            ok = False
        if ok and 2 * links > len(text) and len(text) < 200 and page.tag[at] not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "td"):
            ok = False
        out.append(ok)
    return out


def _side_ancestor_kept(page: Page, at: int, keep: set[int], side: list[bool]) -> bool:
    """Whether the block is side matter only because the kept container itself is named so."""
    while at >= 0 and at not in keep:
        if page.tag[at] in _SIDE_TAGS or (page.name[at] and _SIDE.search(page.name[at])):
            return False
        at = page.parent[at]
    return at >= 0 and side[at]


def side_line(line: str) -> bool:
    """Byline, sharing, notice, advertisement, legal or skip line."""
    return bool(_BYLINE.match(line)) or by_sentences(line, _side_sentence) is not None


def _side_sentence(sentence: str) -> str | None:
    return "side" if _SIDE_LINE.search(sentence) else None


def main_lines(source: str | None, text: str, title: str | None = None) -> list[int]:
    """Numbers of the lines of text that belong to the main body; empty if there is no article."""
    lines = text.split("\n")
    title = _SPACE.sub(" ", title).strip() if title else None
    page = Page(source) if source else None
    chosen: list[int] = []
    tags: dict[int, str] = {}
    marks: list[tuple[int, bool | None]] = []  # of each line: kept by tree scoring, left out, or not in the markup
    if page is not None and page.text:
        kept = main_blocks(page, title)
        where: dict[str, list[int]] = {}
        heads: dict[str, list[int]] = {}
        keys = [_key(t) for t in page.text]
        for i, t in enumerate(keys):
            where.setdefault(t, []).append(i)
            heads.setdefault(t[:4], []).append(i)
        pointer = 0
        for no, line in enumerate(lines):
            key = _key(line)
            if not key:
                continue
            at = next((i for i in where.get(key, ()) if i >= pointer), None)
            if at is None and key not in where:
                at = next((i for i in heads.get(key[:4], ()) if i >= pointer and (key.startswith(keys[i]) or keys[i].startswith(key))), None)
            if at is not None:
                pointer = at + (1 if key == keys[at] else 0)
                tags[no] = page.tag[page.block_node[at]]
            marks.append((no, None if at is None else kept[at]))
    else:
        marks = [(no, None) for no, line in enumerate(lines) if line.strip()]
    found = any(k for _, k in marks)
    j = 0
    while j < len(marks):
        to = j + 1
        if marks[j][1] is None:  # a run of lines that the markup does not hold
            while to < len(marks) and marks[to][1] is None:
                to += 1
            run = [no for no, _ in marks[j:to]]
            first = next((no for no in run if title and lines[no].strip() == title), None)
            if first is None and not found:
                first = _untitled_start(lines, run)
            if first is not None:
                chosen += [no for no in run if no >= first]
            elif j and to < len(marks) and marks[j - 1][1] and marks[to][1]:
                chosen += run
        elif marks[j][1]:
            chosen.append(marks[j][0])
        j = to
    if not chosen:
        return []
    # what follows a header of comments or other pages is not the article; a header may stand before
    # the article in the order of the source, so only those behind its title count, if it is kept
    start = next((no for no in chosen if title and _clean(lines[no]) == title), None)
    if start is None and page is not None and page.title_at >= 0:
        heading = next((_key(t) for at, t in zip(page.block_node, page.text) if at == page.title_at), None)
        start = next((no for no in chosen if _key(_clean(lines[no])) == heading), None)
    end = next((no for no in range(0 if start is None else start + 1, len(lines)) if len(lines[no]) < 90 and _TRAILER.search(_clean(lines[no]))), len(lines))
    # the headline behind an advertisement's label belongs to it
    shown = [no for no, line in enumerate(lines) if line.strip()]
    promoted = {b for a, b in zip(shown, shown[1:]) if _AD_LABEL.match(_clean(lines[a])) and tags.get(b) not in _OWN_BLOCKS and _headline(_clean(lines[b]))}
    out, weight = [], 0
    for no in chosen:
        if no >= end:
            break
        s = _clean(lines[no])
        if side_line(s) or no in promoted:
            continue
        out.append(no)
        if weight < 2 and evidence(s) is None and not has_placeholder(s):
            weight += 2 if no == start else article_weight(s)
    return out if weight >= 2 else []


def _untitled_start(lines: list[str], shown: list[int]) -> int | None:
    """Where, in a run of lines, an article begins whose title is not known: at the first line of prose or
    byline, or the heading-like lines right above it."""
    weights = [0 if evidence(s) or has_placeholder(s) or (side_line(s) and article_weight(s) < 2) else article_weight(s) for s in (_clean(lines[no]) for no in shown)]
    first = next((i for i, w in enumerate(weights) if w == 2), None)
    if first is None or any(_TRAILER.search(_clean(lines[no])) for no in shown[:first]):
        return None
    if first and _BYLINE.match(_clean(lines[shown[first]])) and _headline(_clean(lines[shown[first - 1]])) and not _FURNITURE.search(lines[shown[first - 1]]) and not re.search(r"\S\s{2,}\S", lines[shown[first - 1]]):
        first -= 1  # the title right above a byline may be short
    while first and weights[first - 1] == 1:
        first -= 1
    return shown[first]


def _headline(line: str) -> bool:
    return len(line) < 90 and "\t" not in line and not _BULLET.match(line) and not re.search(r"[.!?…。！？;:{}()=]$", line)


def _clean(line: str) -> str:
    return _INVISIBLE.sub("", line).strip()


def _key(line: str) -> str:
    return _SPACE.sub(" ", _BULLET.sub("", line)).strip()


def candidate_lines(snapshots: DataFrame) -> DataFrame:
    """(rawdoc_id, host, line_no, line, is_title): lines that tree scoring keeps."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r, h, s, t, ti in zip(b["rawdoc_id"], b["host"], b["html"], b["text"], b["title"]):
                lines = t.split("\n")
                name = _SPACE.sub(" ", ti).strip() if ti else None
                out += [(r, h, no, lines[no], _clean(lines[no]) == name) for no in main_lines(s, t, ti)]
            yield pd.DataFrame(out, columns=["rawdoc_id", "host", "line_no", "line", "is_title"])

    url = F.coalesce("page_url", "canonical_url")
    rows = snapshots.select("rawdoc_id", F.coalesce(host_key(url), F.lit("")).alias("host"), "html", "text", "title").where("rawdoc_id is not null and text is not null")
    return rows.mapInPandas(run, "rawdoc_id string, host string, line_no int, line string, is_title boolean")


def site_boilerplate(snapshots: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, min_hosts: int = MIN_HOSTS) -> tuple[DataFrame, DataFrame]:
    """(host, key) of lines that recur over a host's pages, and keys of lines naming their site that
    recur over hosts."""
    line = masked(F.col("line"), F.col("name"))
    keyed = page_lines(snapshots).select("host", "page", line.alias("line")).select("host", F.xxhash64("line").alias("key"), F.contains("line", F.lit("@")).alias("named"), "page")
    counts = keyed.distinct().groupBy("host", "key", "named").agg(F.count("*").alias("pages"))
    counts = materialise(counts, "site-lines")  # read twice below
    pages = page_keys(snapshots).distinct().groupBy("host").agg(F.count("*").alias("all"))
    here = counts.where(F.col("pages") >= min_pages).join(pages, "host").where(F.col("pages") >= F.col("all") * min_share).select("host", "key")
    there = counts.where("named").groupBy("key").agg(F.count("*").alias("hosts")).where(F.col("hosts") >= min_hosts).select("key")
    return here, there


def main_content(snapshots: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, min_hosts: int = MIN_HOSTS) -> DataFrame:
    """(rawdoc_id, line_no): the lines of the main body of each capture.

    Null texts have no rows, nor have pages without an article. If html is null or only a shell, the
    lines from the page's title on are taken. Repeated rows count once. Lines of a capture without
    a host are held against all captures without one. Empty tables give an empty result; columns
    other than those named here are not read."""
    found = candidate_lines(snapshots)
    here, there = site_boilerplate(snapshots, min_pages, min_share, min_hosts)
    keyed = found.select("rawdoc_id", "host", "line_no", "is_title", "line", site_name(F.col("host")).alias("name")).select("rawdoc_id", "host", "line_no", "is_title", F.xxhash64(masked(F.col("line"), F.col("name"))).alias("key"))
    keyed = materialise(keyed, "kept-lines")  # the lookups count their keys; pages are parsed once
    marked = salted_lookup(keyed, here.withColumn("here", F.lit(True)), ["host", "key"], ["rawdoc_id"], how="left")
    marked = salted_lookup(marked, there.withColumn("there", F.lit(True)), ["key"], ["rawdoc_id"], how="left")
    return marked.where("is_title or (here is null and there is null)").select("rawdoc_id", "line_no").distinct()
