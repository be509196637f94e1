"""Text normalisation shared by operators, as Catalyst expressions and as Python functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space as a Java/Python character class.
WHITE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

WORD = re.compile(r"[^\W_]+")
_DIGITS = re.compile(r"\d+")
_WHITE = re.compile(r"\s+")


def line_key(line: Column) -> Column:
    """Lower case, runs of digits as one digit, runs of white space as one space, trimmed."""
    x = F.regexp_replace(F.lower(line), r"\p{Nd}+", "0")
    x = F.regexp_replace(x, WHITE + "+", " ")
    return F.trim(x)


def line_key_py(line: str) -> str:
    """The same key in Python."""
    return _WHITE.sub(" ", _DIGITS.sub("0", line.lower())).strip()


def words_py(text: str) -> list[str]:
    """Maximal runs of letters or digits, in lower case."""
    return [w.lower() for w in WORD.findall(text)]


def host_key(url: Column) -> Column:
    """Host of a URL in lower case, without user, port and a leading www."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


# Characters that carry no text, by what becomes of them.
_TO_SPACE = "\u2028\u2029\u202f\u3000"
_DROPPED = "\u00ad\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2066\u2067\u2068\u2069\ufeff"


def sanitize(text: Column) -> Column:
    """Line and paragraph separators and odd spaces as a space; invisible characters removed."""
    return F.translate(text, _TO_SPACE + _DROPPED, " " * len(_TO_SPACE))


def normalize_inline(text: Column) -> Column:
    """Sanitised, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(sanitize(text), WHITE + "+", " "))


def normalize_block(text: Column) -> Column:
    """Sanitised, line ends as one new line, three and more of them as two, trimmed; spaces stay."""
    x = F.regexp_replace(sanitize(text), "\r\n", "\n")
    x = F.regexp_replace(x, "\n{3,}", "\n\n")
    return F.regexp_replace(x, f"^{WHITE}+|{WHITE}+$", "")


def normalize_markdown(text: Column) -> Column:
    """Blanks around new lines removed, runs of spaces and tabs as one space, trimmed."""
    x = F.regexp_replace(sanitize(text), "[ \t]*\n[ \t]*", "\n")
    return F.regexp_replace(F.regexp_replace(x, "[ \t]{2,}", " "), f"^{WHITE}+|{WHITE}+$", "")


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("int")


def round_half_up(x: Column, digits: int) -> Column:
    """Rounding with halves towards positive infinity."""
    f = 10.0**digits
    return F.floor(x * f + 0.5) / f


def json_string(text: Column) -> Column:
    """The text as a JSON string."""
    quoted = F.to_json(F.array(text))
    return F.substring(quoted, F.lit(2), F.length(quoted) - 2)


def slug(text: Column, index: Column) -> Column:
    """Anchor of a heading: lower case, ASCII letters, digits and Han characters, at most 64, with
    the heading's number."""
    base = F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9一-龥]+", "-")
    base = F.substring(F.regexp_replace(base, "^-+|-+$", ""), 1, 64)
    return F.concat(F.when(base == "", "section").otherwise(base), F.lit("-"), index.cast("string"))


def slugify_title_py(title: str) -> str:
    """File name of a title: compatibility decomposition, word characters, dots and hyphens, at most 80."""
    import unicodedata

    kept = re.sub(r"[^A-Za-z0-9_\s.-]", "", unicodedata.normalize("NFKD", title)).strip()
    return re.sub(r"-+", "-", re.sub(r"\s+", "-", kept))[:80] or "untitled"


def image_hash_py(text: str) -> str:
    """16 hexadecimal digits: two multiply-xor hashes of the UTF-16 code units, from two starting values.
    Products are rounded to double precision before they are cut to 32 bits, as the ids in use were."""
    raw = text.encode("utf-16-le", "surrogatepass")
    units = [raw[i] | raw[i + 1] << 8 for i in range(0, len(raw), 2)]
    out = ""
    for start in (0x811C9DC5, 0xCBF29CE4):
        h = start
        for c in units:
            x = (h ^ c) & 0xFFFFFFFF
            h = int(float(x - (1 << 32) if x >> 31 else x) * 0x01000193) & 0xFFFFFFFF
        out += f"{h:08x}"
    return out


def try_iso_date(text: Column) -> Column:
    """A date in one of the usual forms as ISO-8601 UTC with milliseconds, null if it is none; forms
    without a zone are read in the session's zone."""
    forms = ("yyyy-MM-dd'T'HH:mm:ss[.SSS][.SSSSSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSS]", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy")
    parsed = F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in forms])
    utc = F.to_utc_timestamp(parsed, F.expr("current_timezone()"))
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
