"""Template residue and error-page text.

Method: normalised lines are counted by host, recurrent boilerplate is subtracted, and a capture is
excluded if what is left of it is error, placeholder, filler or script-required evidence. An
unfilled placeholder counts wherever it stands, unless its sentence discusses placeholders.

Plan: one pass over the texts finds the captures that hold any evidence at all (a small share) and
counts all lines of all captures by (host, line) with the count combined before its shuffle. Only
the lines of captures with evidence are then joined to the counts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache, lru_cache
from typing import TypeVar
from urllib.parse import unquote

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorefold.functions.text import host_key, line_key
from lorefold.operators.skew import salted_lookup
from lorefold.session import materialise

T = TypeVar("T")

# A line is boilerplate if it stands on MIN_PAGES pages of its host and MIN_SHARE of them, or, with the
# site's own name masked, on pages of MIN_HOSTS hosts.
MIN_PAGES, MIN_SHARE, MIN_HOSTS = 4, 0.01, 10

# Names that template fields usually have.
FIELDS = (
    "address|author|body|category|city|company|content|country|date|description|email|excerpt|first_?name|heading|headline|id|image|keywords?|"
    "last_?name|link|name|path|phone|post_id|price|product|slug|subtitle|summary|tags?|text|title|url|user|username|var|variable|placeholder|page|site"
)
_PLACEHOLDERS = re.compile(
    r"\{\{[^{}\n]{1,80}\}\}|\{%[^%\n]{1,80}%\}|<%[^%\n]{1,80}%>|[$#]\{[A-Za-z_][\w.\[\] |]{0,60}\}|\[\[[A-Z][A-Z0-9_]{1,40}\]\]|\[%[^%\n]{1,60}%\]"
    r"|%%[A-Z][A-Z0-9_]{1,40}%%|(?<![A-Za-z0-9_])__[A-Z][A-Z0-9_]{1,40}__(?![A-Za-z0-9_])|<<[A-Za-z_][\w ]{0,40}>>|@Model\.[A-Za-z_]\w*"
    r"|\[(?:YOUR|Your|your|INSERT|Insert|insert|ENTER|Enter) [A-Za-z][A-Za-z _]{0,40}\]|\[object [A-Z]\w*\]"
    r"|%(?:" + FIELDS.upper().replace("_?", "_?") + r")%"
)
_FIELD_ONLY = re.compile(r"(?:(?<![\w$#{])\{\s*(?:[a-z]\w*\.)?(?:" + FIELDS + r")\s*\}(?!\})|«(?:" + FIELDS + r")»)")
_EMPTY_LINE = re.compile(r"\s*(?:undefined|null|NaN|None|nil|\(null\)|\[object [A-Z]\w*\])\s*")

# Words of sentences that discuss placeholders instead of leaving them unfilled.
_DISCUSSES = re.compile(
    r"template (?:language|engine|syntax)|templating|placeholder|\bvariables?\b|syntax|\bwriting\b|is (?:rendered|replaced|printed|expanded)|then replaces|for example|e\.g\.|as an example|"
    r"Platzhalter|Vorlagensprache|Variablen?|zum Beispiel|langage de gabarit|espace réservé|par exemple|marcador de posición|plantillas?|por ejemplo|"
    r"marcador de posição|modelos de página|por exemplo|variáve(?:l|is)|占位符|模板语言|变量|例如",
    re.IGNORECASE,
)
_CODE = re.compile(r"[;=]\s*$|^\s*(?:return|if|for|while|let|const|var|def|class|import|print|echo|#)\b|\w\(.*\)|\s=\s|=>|`")

# Error and refusal messages, demands for scripts and filler, in the corpus' languages.
_ERROR = re.compile(
    r"^(?:(?:http|error|fehler|erreur|erro|código)[ :]*)?\d{3}(?:\s*[-–:]?\s*(?:error|not found|forbidden|bad gateway|bad request|unauthorized|gone|internal server error|service unavailable|gateway time-?out|too many requests))?\W*$"
    r"|requested url was rejected|checking that you are human|application error|server-side exception|page (?:not|could not be|cannot be) found|(?:could not|couldn.t|cannot|can.t) find (?:that|this|the) page|page (?:has gone|is|went) missing|page (?:you (?:asked|are looking|requested)\b.{0,20})(?:is not here|does not exist|doesn.t exist|no longer exists|was not found|has been moved)"
    r"|nothing lives at this address|address (?:you asked for|requested)? ?(?:was|is|has been) limited|this page (?:does not|doesn.t) exist"
    r"|access denied|permission denied|you (?:do not|don.t) have (?:permission|access)|this account has been (?:suspended|disabled)|account suspended|session has (?:expired|timed out)|sign in again|please (?:log|sign) in to continue|are you (?:a )?(?:human|robot)|verify (?:that )?you are (?:a )?human|unusual traffic|captcha"
    r"|too many requests|rate limit(?:ed)? exceeded|internal server error|bad gateway|gateway time-?out|service (?:temporarily )?unavailable|temporarily unavailable|down for maintenance|under maintenance|upstream did not answer|try again (?:in a few minutes|later)"
    r"|error establishing (?:a|the) (?:connection to the database|database connection)|fatal error|uncaught \w*(?:error|exception)|traceback \(most recent call last\)|stack trace|^file \".*\", line \d+|^\w*(?:error|exception): |unhandled exception|parse error: |warning: \w+\(\)"
    r"|(?:seite|dokument) (?:wurde )?nicht gefunden|(?:diese )?seite (?:existiert|gibt es) nicht|zugriff verweigert|(?:interner )?serverfehler|wartungsarbeiten|sitzung ist abgelaufen|zu viele anfragen|konto (?:wurde )?gesperrt|die (?:angeforderte|gewünschte) (?:adresse|seite)"
    r"|page (?:introuvable|non trouvée)|adresse demandée n.existe|accès (?:refusé|interdit)|erreur (?:interne|du serveur|\d{3})|site en maintenance|session a expiré|trop de requêtes"
    r"|página no encontrada|dirección solicitada no existe|acceso denegado|error (?:interno|del servidor)|en mantenimiento|sesión ha (?:caducado|expirado)|demasiadas solicitudes"
    r"|página não (?:foi )?encontrada|endereço (?:pedido|solicitado) não existe|acesso negado|erro (?:interno|do servidor)|em manutenção|sessão expirou|muitos pedidos"
    r"|页面不存在|找不到(?:该|此|您)?.{0,6}页面|访问被拒绝|拒绝访问|错误代码|服务器(?:内部)?错误|系统维护|会话已过期|请求过于频繁|您访问的页面",
    re.IGNORECASE,
)
_SCRIPT = re.compile(
    r"(?:enable|activate|turn on|switch on|requires?|needs?|without|blocks?|disables?)\W+(?:\w+\W+){0,6}javascript\b|javascript\b\W+(?:\w+\W+){0,6}(?:disabled|enabled|required|needed|off|blocked)|(?:it seems to be|is) switched off|switch it on and reload"
    r"|(?:enable|allow|activate|turn on|blocks?) scripts\b|without scripts|scripts (?:are|is|seem to be) (?:disabled|blocked|required|switched off)|scripts enabled"
    r"|javascript\b.{0,40}(?:aktivieren|deaktiviert|einschalten|erforderlich)|(?:aktivieren|schalten)\b.{0,40}javascript"
    r"|(?:activer|activez|activé|désactivé)\b.{0,40}javascript|javascript\b.{0,40}(?:désactivé|requis|nécessaire)"
    r"|(?:active|activar|habilite|habilitar)\b.{0,40}javascript|javascript\b.{0,40}(?:desactivado|necesario)"
    r"|(?:ative|ativar|habilite)\b.{0,40}javascript|javascript\b.{0,40}(?:desativado|necessário)"
    r"|(?:启用|开启|打开|需要).{0,12}javascript|javascript.{0,12}(?:禁用|关闭|启用)|^loading(?:…|\.{2,3})?$",
    re.IGNORECASE,
)
_FILLER = re.compile(
    r"^(?:(?:tbd|todo|tba|xxx+|n/a|asdf\w*|qwert\w*|qwer|jkl|test|text|sample|dummy|foo|bar|lorem|blah?)\b[\s.,;:!]*){2,}$|^(?:tbd|todo|tba|xxx+)$"
    r"|dummy (?:copy|text)|sample text|placeholder text|demo post|replace this (?:paragraph|text)|(?:your )?content (?:will appear|goes) here|text goes here|add a short description|edit or delete it|until the editors deliver|coming soon$|this is (?:just )?a test"
    r"|blindtext|platzhaltertext|beispieltext|musterabsatz|wird (?:später|noch) ersetzt"
    r"|texte (?:de démonstration|de remplissage|d.exemple|factice)|faux texte|à remplacer avant"
    r"|texto de (?:ejemplo|relleno|muestra|prueba)|sustitúyalo|reemplace este"
    r"|texto de (?:exemplo|preenchimento|demonstração|teste)|substitua este"
    r"|示例文[本字]|占位文[本字]|样例文字|此处(?:将)?(?:显示|填写)",
    re.IGNORECASE,
)
# The vocabulary of the usual Latin filler.
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum "
    "porta vitae massa nisl justo risus mollis tellus cursus lectus augue ornare quam sodales fusce pretium donec vestibulum curabitur mauris pellentesque vivamus nunc morbi praesent integer aenean maecenas nullam phasellus suspendisse proin etiam quisque at ac eget turpis urna leo diam erat sem felis ligula libero odio orci ante arcu bibendum blandit condimentum congue dapibus dictum dignissim egestas eleifend elementum euismod facilisis faucibus fermentum feugiat fringilla gravida habitasse hac hendrerit iaculis imperdiet interdum lacinia lacus laoreet lobortis luctus malesuada mattis metus mi molestie nec neque nibh pharetra placerat platea posuere potenti pulvinar purus rhoncus rutrum sagittis sapien scelerisque sollicitudin tempus tincidunt tortor tristique ullamcorper ultrices ultricies varius vehicula vel venenatis viverra volutpat vulputate".split()
)
# Headers behind which a page lists other pages or comments.
_TRAILER = re.compile(
    r"^(?:more from\b|related\b|read next|you may also like|further reading|recommended|\d+ comments?$|comments$|leave a reply|join the discussion|mehr (?:von|aus)\b|weitere notizen\b|das könnte sie auch|weitere (?:artikel|beiträge)|\d+ kommentare?$|antwort schreiben|kommentare$"
    r"|à lire aussi|autres? notes?\b|plus de\b|\d+ commentaires?$|répondre|también le puede|más (?:de|notas)\b|otras notas\b|\d+ comentarios?$|responder|leia também|outras notas\b|mais (?:de|do|da|notas)\b|\d+ comentários?$|相关阅读|更多|\d+\s*条评论|发表回复|.{0,60}的更多文章)",
    re.IGNORECASE,
)
_FURNITURE = re.compile(r"cookie|©|\(c\) ?\d{4}|copyright|all rights|newsletter|subscribe|\s[|·•/]\s.*\s[|·•/]\s|partner.{0,30}(?:ger[äa]t|device|appareil|dispositivo)|^(?:skip to|zum inhalt|aller au contenu|saltar al|ir para o|back to top|nach oben|haut de page|volver arriba|voltar ao topo)\b", re.IGNORECASE)
# How bylines with a date begin.
_BYLINE = re.compile(r"^(?=.*\b(?:19|20)\d\d(?:\b|年))(?:by|von|par|por|written by|posted by|作者)[\s:：]+[^\W\d][^\d\n]{0,50}\d[^\n]{0,24}$", re.IGNORECASE)
# What a line of an article has at least, in characters; a character of Chinese, Japanese or Korean counts as three.
PROSE = 60
_WIDE = re.compile(r"[぀-ヿ㐀-鿿가-힯]")


def has_placeholder(text: str) -> bool:
    """Whether the text holds an unfilled placeholder that no sentence around it discusses."""
    if not any(c in text for c in "{[<%«@_") and "undefined" not in text and "null" not in text and "NaN" not in text and "None" not in text and "nil" not in text:
        return False
    for line in text.split("\n"):
        if _EMPTY_LINE.fullmatch(line):
            return True
        hits = [m for p in (_PLACEHOLDERS, _FIELD_ONLY) for m in p.finditer(line)]
        for m in hits:
            sentence = _sentence(line, m.start(), m.end())
            rest = _FIELD_ONLY.sub("", _PLACEHOLDERS.sub("", sentence))
            if not _DISCUSSES.search(rest) and not (_CODE.search(rest) and not m.group().startswith(("{{", "[Insert", "[YOUR"))):
                return True
    return False


def _sentence(line: str, start: int, end: int) -> str:
    lo = max(line.rfind(s, 0, start) for s in (". ", "! ", "? ", "。", "！", "？"))
    ends = [i for i in (line.find(s, end) for s in (". ", "! ", "? ", "。", "！", "？")) if i >= 0]
    return line[lo + 1 : min(ends, default=len(line)) + 1]


# Every message above holds one of these, in lower case; lines without any are not tried.
_STEMS = (
    "not found|not be found|cannot be|find|missing|not here|no longer|not exist|n't exist|nothing lives|been moved|limited|denied|permission|suspended|disabled|expired|timed out|sign in|log in|human|robot|unusual|captcha|too many|rate limit|server|gateway|unavailable|maintenance|upstream|try again|"
    "error|exception|traceback|trace|file \"|warning|rejected|nicht|existiert|verweigert|fehler|wartung|abgelaufen|anfragen|gesperrt|angeforderte|gewünschte|introuvable|trouvé|existe|refusé|interdit|erreur|expiré|requêtes|encontrada|denegado|mantenimiento|caducado|expirado|solicitudes|negado|erro|manutenção|expirou|pedidos|"
    "不存在|找不到|拒绝|错误|维护|过期|频繁|您访问|javascript|script|switched off|switch it|loading|tbd|todo|tba|xxx|n/a|asdf|qwer|jkl|test|text|sample|dummy|foo|bar|bla|placeholder|demo|replace|content|goes here|short description|delete it|deliver|coming soon|blindtext|platzhalter|beispiel|muster|ersetzt|texte|remplacer|texto|sustitúyalo|reemplace|substitua|"
    "示例|占位|样例|此处|lorem|ipsum|dolor|massa|elit|nulla"
).split("|")


@cache
def _stems() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for stem in _STEMS:
        a.add_word(stem, 1)
    a.make_automaton()
    return a


def evidence(line: str) -> str | None:
    """error, script or filler, if the line is a message of that kind."""
    s = line.strip()
    low = s.lower()
    if next(_stems().iter(low), None) is None and not (len(s) < 80 and re.search(r"(?<!\d)\d{3}(?!\d)", s)):
        return None
    if _is_latin(low):
        return "filler"
    return by_sentences(s, _message if len(s) <= ONE_SENTENCE else _stemmed_message)


def _stemmed_message(s: str) -> str | None:
    """_message, tried only on sentences that hold one of its stems."""
    return _message(s) if next(_stems().iter(s.lower()), None) is not None else None


# The share of a line's characters that sentences of one kind must fill, and the length up to which a line
# is taken for one sentence.
SENTENCE_SHARE, ONE_SENTENCE = 0.8, 160
_SENTENCE_END = re.compile(r"(?<=[.!?…])[\"'”’»)]*\s+|(?<=[。！？])\s*")


def by_sentences(line: str, kind_of: Callable[[str], T | None]) -> T | None:
    """The kind of a line: that of the line if it is short enough for one sentence, else the one whose sentences
    fill SENTENCE_SHARE of it."""
    if len(line) <= ONE_SENTENCE:
        return kind_of(line)
    chars: dict[T, int] = {}
    other, most, at = 0, (1 - SENTENCE_SHARE) * len(line), 0
    while at < len(line):
        end = _SENTENCE_END.search(line, at)
        to = end.start() if end and end.start() > at else len(line)
        kind = kind_of(line[at:to])
        if kind:
            chars[kind] = chars.get(kind, 0) + to - at
        else:
            other += to - at
            if other > most:  # no kind can fill its share any more
                return None
        at = max(end.end(), to) if end and to < len(line) else len(line)
    return max(chars, key=chars.__getitem__) if chars else None


def _is_latin(low: str) -> bool:
    words = re.findall(r"[^\W\d_]+", low)
    return len(words) >= 3 and sum(w in LATIN for w in words) >= 0.7 * len(words)


@lru_cache(100_000)
def _message(s: str) -> str | None:
    if _is_latin(s.lower()):
        return "filler"
    for kind, pattern in (("script", _SCRIPT), ("error", _ERROR), ("filler", _FILLER)):
        if pattern.search(s):
            return kind
    return None


def article_weight(line: str) -> int:
    """How much a line speaks for an article: 2 a line of prose or a byline, 1 a heading-like line of
    several words, 0 anything else. Two together make an article."""
    s = line.strip()
    if _BYLINE.match(s):
        return 2
    if _FURNITURE.search(s):
        return 0
    wide = len(_WIDE.findall(s))
    if len(s) + 2 * wide >= PROSE:
        return 2
    return int(not re.search(r"\S\s{2,}\S", s) and (len(s.split()) >= 3 or wide >= 6))


# Whole steps or values of a URI that name an empty value or the type of an object.
_URI_EMPTY = re.compile(r"(?:undefined|null|nan|none|nil|\(null\)|\[object(?: |%20)\w+\]|system\.object)", re.IGNORECASE)
_URI_STEP = re.compile(r"(?::[A-Za-z_]\w*|\[[A-Za-z_]\w*\]|__[A-Z][A-Z0-9_]*__|%[A-Z][A-Z0-9_]*%)")
_URI_ANY = re.compile(r"\{\{[^{}/]{1,60}\}\}|\$?\{[A-Za-z_][\w.]{0,60}\}|<%[^%/]{1,60}%>|\{%[^%/]{1,60}%\}|\[\[\w+\]\]|<[A-Za-z_]\w*>|\[object \w+\]|__[A-Z][A-Z0-9_]*__|%%[A-Z_]+%%")


def uri_residue(uri: str | None) -> bool:
    """Whether a URI was never filled in."""
    if not uri:
        return False
    tail = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", "", uri)
    for _ in range(2):
        if _URI_ANY.search(tail):
            return True
        path, _, query = re.split(r"#", tail, maxsplit=1)[0].partition("?")
        parts = [*path.split("/"), *(v for p in query.split("&") for v in p.split("=", 1)[1:])]
        if any(_URI_EMPTY.fullmatch(unquote(p)) or _URI_STEP.fullmatch(p) for p in parts):
            return True
        if "%" not in tail:
            return False
        tail = unquote(tail)
    return False


def uri_cases(rawdocs: DataFrame) -> DataFrame:
    """rawdoc_id of the captures whose source_uri was never filled in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.loc[[uri_residue(u) for u in b["source_uri"]], ["rawdoc_id"]]

    rows = rawdocs.select("rawdoc_id", "source_uri").where("rawdoc_id is not null and source_uri is not null")
    return rows.mapInPandas(run, "rawdoc_id string").distinct()


def site_name(host: Column) -> Column:
    """The site's own name as its host spells it, in the form of line keys; empty if too short."""
    name = F.regexp_replace(F.translate(F.element_at(F.split(host, r"\."), 1), "-", " "), r"\p{Nd}+", "0")
    return F.when(F.length(name) > 3, name).otherwise("")


def masked(line: Column, name: Column) -> Column:
    """Key of a line with the site's own name replaced."""
    return F.replace(line_key(line), name, F.lit("@"))


def page_keys(snapshots: DataFrame, *more: str) -> DataFrame:
    """(host, page, ...) of each capture; captures of one address have one page."""
    url = F.coalesce("page_url", "canonical_url")
    page = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "/+$", "")
    return snapshots.select(F.coalesce(host_key(url), F.lit("")).alias("host"), F.xxhash64(page).alias("page"), *more)


def page_lines(snapshots: DataFrame) -> DataFrame:
    """(host, name, page, line): the distinct non-blank lines of each text. Host, name and page are made
    once per capture, below the explode."""
    pages = page_keys(snapshots, "text").where("text is not null").select("host", site_name(F.col("host")).alias("name"), "page", "text")
    return pages.select("host", "name", "page", F.explode(F.array_distinct(F.split("text", "\n", -1))).alias("line")).where(F.trim("line") != "")


def line_counts(snapshots: DataFrame) -> DataFrame:
    """(host, key, pages): on how many pages of the host each normalised line stands. The host's name
    is masked, and the count is combined before its shuffle."""
    keyed = page_lines(snapshots).select("host", F.xxhash64(masked(F.col("line"), F.col("name"))).alias("key"), "page").distinct()
    return keyed.groupBy("host", "key").agg(F.count("*").alias("pages"))


def text_evidence(snapshots: DataFrame) -> DataFrame:
    """(rawdoc_id, version, host, placeholder, lines): captures with a placeholder or with evidence lines;
    the lines are structs of (no, kind, weight, line), weight being what the line adds to an article.
    Version is the fingerprint of host, text and titles: repeated rows are one, each other text is its own."""
    url = F.coalesce("page_url", "canonical_url")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r, v, h, t, own in zip(b["rawdoc_id"], b["version"], b["host"], b["text"], b["own"]):
                if has_placeholder(t):
                    out.append((r, v, h, True, []))
                    continue
                titles = set(own)
                rows, found = [], False
                for no, line in enumerate(t.split("\n")):
                    s = line.strip()
                    if not s:
                        continue
                    kind = evidence(s)
                    if kind is None and _TRAILER.search(s):
                        kind = "trailer"
                    found = found or kind in ("error", "script", "filler")
                    weight = 0 if kind else 2 if s in titles else article_weight(s)
                    if kind or weight:
                        rows.append({"no": no, "kind": kind, "weight": weight, "line": line})
                if found:
                    out.append((r, v, h, False, rows))
            yield pd.DataFrame(out, columns=["rawdoc_id", "version", "host", "placeholder", "lines"])

    own = F.transform(F.filter(F.array("title", "page_title"), lambda x: x.isNotNull()), lambda x: F.trim(x))
    rows = snapshots.select("rawdoc_id", F.coalesce(host_key(url), F.lit("")).alias("host"), "text", own.alias("own")).where("rawdoc_id is not null and text is not null")
    rows = rows.withColumn("version", F.xxhash64("host", "text", "own"))
    return rows.mapInPandas(run, "rawdoc_id string, version bigint, host string, placeholder boolean, lines array<struct<no int, kind string, weight int, line string>>").dropDuplicates(["rawdoc_id", "version"])


def text_cases(snapshots: DataFrame, min_pages: int = MIN_PAGES, min_hosts: int = MIN_HOSTS) -> DataFrame:
    """rawdoc_id of the captures whose text is residue: with a placeholder, or, once boilerplate is
    subtracted, without the title, a line of prose or two headings before the page's lists of other
    pages and comments."""
    found = materialise(text_evidence(snapshots), "evidence")
    counts = materialise(line_counts(snapshots), "line-counts")
    pages = page_keys(snapshots).distinct().groupBy("host").agg(F.count("*").alias("all"))
    by_host = counts.where(F.col("pages") >= min_pages).join(pages, "host").where(F.col("pages") >= F.col("all") * MIN_SHARE).select("host", "key", F.lit(True).alias("here"))
    everywhere = counts.groupBy("key").agg(F.count("*").alias("hosts")).where(F.col("hosts") >= min_hosts).select("key", F.lit(True).alias("there"))
    lines = found.where("not placeholder").select("rawdoc_id", "version", "host", F.explode("lines").alias("l"))
    trailer = lines.where("l.kind = 'trailer'").groupBy("rawdoc_id", "version").agg(F.min("l.no").alias("trailer"))
    weighed = lines.where("l.weight > 0").select("rawdoc_id", "version", "host", F.col("l.no").alias("no"), F.col("l.weight").alias("weight"), masked(F.col("l.line"), site_name(F.col("host"))).alias("masked")).withColumn("named", F.contains("masked", F.lit("@"))).withColumn("key", F.xxhash64("masked")).drop("masked")
    marked = salted_lookup(weighed, by_host, ["host", "key"], ["rawdoc_id"], how="left")
    # a short heading may stand on many sites by chance: there it is boilerplate only if it names the site
    marked = salted_lookup(marked, everywhere, ["key"], ["rawdoc_id"], how="left").join(trailer, ["rawdoc_id", "version"], "left")
    left = marked.where("here is null and (there is null or (weight = 1 and not named)) and (trailer is null or no < trailer)")
    articles = left.groupBy("rawdoc_id", "version").agg(F.sum("weight").alias("weight")).where("weight >= 2").select("rawdoc_id", "version")
    return found.where("placeholder").select("rawdoc_id").unionByName(found.where("not placeholder").select("rawdoc_id", "version").join(articles, ["rawdoc_id", "version"], "left_anti").select("rawdoc_id")).distinct()


def residue_cases(snapshots: DataFrame, rawdocs: DataFrame, min_pages: int = MIN_PAGES, min_hosts: int = MIN_HOSTS) -> DataFrame:
    """rawdoc_id of all captures to exclude.

    Null texts and null URIs are no evidence; a capture without a host is held against the lines of
    all captures without one. Repeated rows count once; of several texts of one capture any may make
    it a case. Empty tables give an empty result; other columns are not read."""
    return text_cases(snapshots, min_pages, min_hosts).unionByName(uri_cases(rawdocs)).distinct()


def without_residue(snapshots: DataFrame, rawdocs: DataFrame) -> DataFrame:
    """The snapshots that are kept."""
    return snapshots.join(residue_cases(snapshots, rawdocs), "rawdoc_id", "left_anti")
