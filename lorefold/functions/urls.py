"""URL identity: normalisation, hashes, hosts and the identities derived from them."""

from __future__ import annotations

import re
from urllib.parse import quote, unquote_to_bytes

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Query keys that only track visits, and the prefix of more of them.
TRACKING_KEYS = ("fbclid", "gclid", "igshid")
TRACKING_PREFIX = "utm_"
# URLs whose serialisation changes nothing but the query: lower-case host without port or credentials,
# plain path without dot segments, query of characters that form encoding leaves alone.
SIMPLE = r"^https?://[a-z0-9][a-z0-9.-]*/(?:[A-Za-z0-9_~!$&'()*+,;=:@%-]|[A-Za-z0-9_~-]\.|\.[A-Za-z0-9_~-]|/(?!\.))*(?:\?[A-Za-z0-9_.*=&-]*)?(?:#.*)?$"
_DEFAULT_PORT = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}
_URL = re.compile(r"^([A-Za-z][A-Za-z0-9+.-]*):[/\\]{2,}([^/\\?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$", re.DOTALL)


def _form(text: str) -> str:
    """One component of a query, decoded and encoded again as a form does."""
    raw = unquote_to_bytes(text.replace("+", " ")).decode("utf-8", "replace")
    return quote(raw, safe="*-._ ", encoding="utf-8", errors="replace").replace("~", "%7E").replace(" ", "+")


def _sort_key(text: str) -> bytes:
    return unquote_to_bytes(text.replace("+", " ")).decode("utf-8", "replace").encode("utf-16-be", "surrogatepass")


def normalize_url_py(url: str | None) -> str | None:
    """The URL without fragment and tracking keys, its query sorted by key. file: URLs come back as
    they are; None for what is no absolute URL."""
    if url is None:
        return None
    if url.startswith("file://"):
        return url
    m = _URL.match(re.sub(r"[\t\n\r]", "", url.strip("".join(map(chr, range(33))))))
    if not m:
        return None
    scheme, authority, path, query = m.group(1).lower(), m.group(2), m.group(3).replace("\\", "/"), m.group(4)
    credentials, at, host = authority.rpartition("@")
    host, colon, port = host.partition(":") if not host.startswith("[") else (host[: host.find("]") + 1], ":" if "]:" in host else "", host.rpartition("]:")[2] if "]:" in host else "")
    if not host or (port and not port.isdigit()):
        return None
    host = unquote_to_bytes(host).decode("utf-8", "replace").lower()
    if not host.isascii():
        try:
            host = host.encode("idna").decode()
        except UnicodeError:
            return None
    if re.search(r"[\s<>^|%#/?@\\]", host):
        return None
    port = str(int(port)) if port else ""
    where = host + (f":{port}" if port and port != _DEFAULT_PORT.get(scheme) else "")
    out: list[str] = []
    parts = path.split("/")[1:]
    for i, p in enumerate(parts):
        plain = p.lower().replace("%2e", ".")
        if plain == "..":
            out = out[:-1]
            if i == len(parts) - 1:
                out.append("")
        elif plain == ".":
            if i == len(parts) - 1:
                out.append("")
        else:
            out.append(quote(p, safe="!$%&'()*+,-./:;=@[]_~|^\\", encoding="utf-8").replace("^", "%5E"))
    pairs = []
    for piece in (query or "").split("&"):
        if piece:
            k, _, v = piece.partition("=")
            key = unquote_to_bytes(k.replace("+", " ")).decode("utf-8", "replace")
            if not (key.startswith(TRACKING_PREFIX) or key in TRACKING_KEYS):
                pairs.append((_sort_key(k), f"{_form(k)}={_form(v)}"))
    pairs.sort(key=lambda p: p[0])
    return f"{scheme}://{credentials + at if credentials else ''}{where}/{'/'.join(out)}" + ("?" + "&".join(p for _, p in pairs) if pairs else "")


@F.pandas_udf(StringType())
def _normalize_odd(urls: pd.Series) -> pd.Series:
    return urls.map(normalize_url_py, na_action="ignore")


def normalize_simple(url: Column) -> Column:
    """Normalisation of URLs that match SIMPLE, inside the JVM."""
    bare = F.regexp_extract(url, r"^([^#]*)", 1)
    base = F.regexp_extract(bare, r"^([^?]*)", 1)
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    pieces = F.filter(F.split(query, "&"), lambda p: p != "")
    pairs = F.transform(pieces, lambda p, i: F.struct(F.regexp_extract(p, "^([^=]*)", 1).alias("k"), i.alias("i"), F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))).alias("p")))
    kept = F.filter(pairs, lambda x: ~(F.startswith(x["k"], F.lit(TRACKING_PREFIX)) | x["k"].isin(*TRACKING_KEYS)))
    text = F.array_join(F.transform(F.array_sort(kept), lambda x: x["p"]), "&")
    return F.concat(base, F.when(text != "", F.concat(F.lit("?"), text)).otherwise(""))


def normalize_url(url: Column) -> Column:
    """URLs of the simple form stay in the JVM; only the others reach Python."""
    simple = url.rlike(SIMPLE)
    return F.when(F.startswith(url, F.lit("file://")), url).when(simple, normalize_simple(url)).otherwise(_normalize_odd(F.when(~simple & ~F.startswith(url, F.lit("file://")), url)))


def url_hash(normalized: Column) -> Column:
    return F.substring(F.sha2(normalized, 256), 1, 16)


def is_file_url(url: Column) -> Column:
    return F.startswith(url, F.lit("file://"))


def host_with_port(url: Column) -> Column:
    """Host of a URL with its port, the string itself if it has none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)", 1)
    return F.when(host != "", F.lower(host)).otherwise(url)


def hostname_title(url: Column) -> Column:
    """Host name as a title, else the first 80 characters, else Untitled."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.coalesce(F.nullif(host, F.lit("")), F.nullif(F.substring(url, 1, 80), F.lit("")), F.lit("Untitled"))


def origin(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))


def path_of(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def default_path_prefix(url: Column) -> Column:
    """The path up to its last slash."""
    return F.regexp_replace(path_of(url), "[^/]*$", "")


def unwrap_mirror(url: Column) -> Column:
    """The absolute URL a mirror carries, percent-encoded, as its path; null if there is none."""
    inner = F.try_url_decode(F.substring(path_of(url), 2, 1 << 20))
    return F.when(inner.rlike("^https?://"), inner)


def arxiv_id(url: Column) -> Column:
    """Identifier with version in an arXiv address, null if there is none."""
    return F.nullif(F.regexp_extract(url, r"^https?://(?:www\.)?arxiv\.org/(?:abs|html|pdf)/([0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?|[a-z-]+(?:\.[A-Z]{2})?/[0-9]{7}(?:v[0-9]+)?)", 1), F.lit(""))


def arxiv_fetch_url(url: Column) -> Column:
    """The HTML rendering of a paper named by any of its addresses."""
    return F.concat(F.lit("https://arxiv.org/html/"), arxiv_id(url))


def absolute_url(value: str, base: str) -> str:
    """Resolve a link against its page; data: URLs stay."""
    from urllib.parse import urljoin

    value = value.strip()
    if not value or value.startswith("data:"):
        return value
    try:
        return urljoin(base, value)
    except ValueError:
        return value
