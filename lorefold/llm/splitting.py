"""Splitting oversized items at natural boundaries.

Method: recursive bisection. A text above the limit is cut at the strongest boundary near its
midpoint, each half that still exceeds limit - overlap is cut again, and at the end every piece but
the first gets the tail of the piece before in front of it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F



LIMIT, OVERLAP = 2000, 200

# Boundaries from strong to weak; each matches what ends before the cut.
_BOUNDARIES = [
    re.compile(r"\n[ \t]*\n\s*"),
    re.compile(r"\n\s*"),
    re.compile(r"[.!?…][\"'”’»)\]]*\s+|[。！？；]+[”’」』）]*\s*"),
    re.compile(r"[;:][\"'”’»)]*\s+|[：，、]+\s*"),
    re.compile(r",\s+|\s[–—-]\s"),
    re.compile(r"\s+"),
]


def cut_point(text: str, lo: int, hi: int) -> tuple[int, int]:
    """(position, strength): the cut of text[lo:hi]. For each class of boundary, from strong to
    weak, the one nearest the midpoint within the middle half counts; only if that half has none,
    the whole range is searched. Strength 6 is a hard cut at the midpoint, for text without any
    boundary, moved behind combining marks."""
    mid, reach = (lo + hi) // 2, max(1, (hi - lo) // 4)
    for first, last in ((mid - reach, min(hi, mid + reach)), (lo, hi)):
        for strength, pattern in enumerate(_BOUNDARIES):
            best = None
            for m in pattern.finditer(text, first, last):
                if lo < m.end() < hi and (best is None or abs(m.end() - mid) < abs(best - mid)):
                    best = m.end()
            if best is not None:
                return best, strength
    at = mid
    while at < hi - 1 and unicodedata.combining(text[at]):
        at += 1
    return at, len(_BOUNDARIES)


def bisect(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, strength of the cut at end) of the pieces before overlaps, in order. The pieces
    tile the text. A text of at most `limit` is one piece."""
    if len(text) <= limit:
        return [(0, len(text), -1)]
    body, out, stack = limit - overlap, [], [(0, len(text), -1)]
    while stack:
        lo, hi, strength = stack.pop()
        if hi - lo <= body:
            out.append((lo, hi, strength))
            continue
        at, s = cut_point(text, lo, hi)
        stack += [(at, hi, strength), (lo, at, s)]
    return out


def overlap_start(text: str, lo: int, start: int, overlap: int) -> int:
    """Where the repeated tail begins: at the earliest boundary of the strongest class available
    within the last `overlap` characters before start, at most `overlap` and at least one
    character back, and never before the start lo of the piece that is repeated."""
    first = max(lo, start - overlap)
    for pattern in _BOUNDARIES[1:]:
        for m in pattern.finditer(text, first, start):
            if first <= m.end() < start:
                return m.end()
    return first


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, str]]:
    """(start without overlap, start with overlap, end, piece)."""
    pieces = bisect(text, limit, overlap)
    out = []
    for i, (lo, hi, _) in enumerate(pieces):
        back = overlap_start(text, pieces[i - 1][0], lo, overlap) if i and overlap else lo
        out.append((lo, back, hi, text[back:hi]))
    return out


def split_items(df: DataFrame, keys: list[str], text: str, limit: int = LIMIT, overlap: int = OVERLAP, context: str | None = None) -> DataFrame:
    """Pieces of the rows whose text is longer than limit: keys, piece, start, body_start, end,
    text and, if a context column is named, context (the heading path without empty steps).

    Shorter texts are not returned: they need no cutting and stay where they are. Null and empty
    texts have no pieces. The text of a piece is text[start:end] in code points; start < body_start
    for all pieces but the first, by at most `overlap`. Ties between boundaries at equal distance
    go to the earlier one. Clashing names of the input cannot disturb, since only the named columns
    are read and renamed."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half the limit")
    names = [f"k{i}" for i in range(len(keys))]
    cols = [F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)]
    ctx = F.array_join(F.filter(F.transform(F.split(F.col(f"`{context}`"), ">"), lambda s: F.trim(s)), lambda s: s != ""), " > ") if context else F.lit(None).cast("string")
    big = df.where(F.length(F.col(f"`{text}`")) > limit).select(*cols, F.col(f"`{text}`").alias("t"), ctx.alias("c"))
    kinds = {c: k for c, k in big.dtypes}
    schema = ", ".join(f"{n} {kinds[n]}" for n in names) + ", piece int, start int, body_start int, end int, text string, context string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for row in b.itertuples(index=False):
                for i, (lo, back, hi, piece) in enumerate(split_text(row.t, limit, overlap)):
                    rows.append((*row[: len(names)], i, back, lo, hi, piece, row.c))
            yield pd.DataFrame(rows, columns=[*names, "piece", "start", "body_start", "end", "text", "context"])

    out = big.mapInPandas(run, schema)
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "piece", "start", "body_start", "end", "text", *(["context"] if context else []))


def oversized_chunks(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The holding row (chunk_id, heading_path, text) of each chunk whose text exceeds the limit. The
    row that holds is found on ids, times and fingerprints alone; texts are shuffled only for the
    few rows that are longer than the limit. Of equal times the greater fingerprint holds."""
    mark = F.xxhash64("heading_path", "text")
    slim = chunks.where("chunk_id is not null").select("chunk_id", "updated_at", mark.alias("mark"), F.length("text").alias("n"))
    held = slim.groupBy("chunk_id").agg(F.max_by(F.struct("mark", "n"), F.struct("updated_at", "mark")).alias("h")).where(F.col("h.n") > limit).select("chunk_id", F.col("h.mark").alias("mark"))
    long = chunks.where(F.length("text") > limit).select("chunk_id", "heading_path", "text", mark.alias("mark"))
    return long.join(held, ["chunk_id", "mark"]).dropDuplicates(["chunk_id"]).drop("mark")


def chunk_pieces(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the chunks that must be cut."""
    return split_items(oversized_chunks(chunks, limit), ["chunk_id"], "text", limit, overlap, "heading_path")


def section_pieces(sections: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the section contents that exceed the limit, repeats removed."""
    long = sections.where(F.length("content") > limit).select("doc_id", "section_index", "content").distinct()
    return split_items(long, ["doc_id", "section_index"], "content", limit, overlap)



