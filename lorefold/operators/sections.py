"""Operators on the ordered sections of documents: ids, statistics, paths, scopes and chunks.

A section row is (doc_id, idx, type, level, content); further columns ride along. A document is the unit
of order, so every window is partitioned by doc_id and none spans the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lorefold.functions.text import estimate_tokens, normalize_block
from lorefold.functions.urls import host_with_port

TARGET_CHARS = 1400
SUMMARY_LIMIT, SUMMARY_SIZE, SUMMARY_OVERLAP = 8000, 6000, 500
_UP_TO_HERE = (W.unboundedPreceding, W.currentRow)


def flat_sections(sections: DataFrame) -> DataFrame:
    """document_sections without repeats, in the form used here."""
    return sections.where("doc_id is not null and section_index is not null").select("doc_id", F.col("section_index").alias("idx"), "type", "level", "content").dropDuplicates(["doc_id", "idx"])


def canonical_text(kind: Column, level: Column, content: Column) -> Column:
    """The text a section's id is made from; lists, tables and figures without children have none."""
    text = F.coalesce(content, F.lit(""))
    return (
        F.when(kind == "heading", F.concat(F.lit("heading:"), F.coalesce(level, F.lit(0)).cast("string"), F.lit(":"), text))
        .when(kind.isin("paragraph", "blockquote", "code"), F.concat(kind, F.lit(":"), text))
        .when(kind == "figure", F.concat(F.lit("figure:"), text, F.lit(":")))
        .otherwise(F.concat(kind, F.lit(":")))
    )


def section_ids(sections: DataFrame) -> DataFrame:
    """sections with section_id: a hash of the canonical text, later equals numbered -1, -2, ..."""
    base = F.concat(F.lit("s-"), F.substring(F.sha2(canonical_text(F.col("type"), F.col("level"), F.col("content")), 256), 1, 10))
    n = F.row_number().over(W.partitionBy("doc_id", "_base").orderBy("idx")) - 1
    return sections.withColumn("_base", base).withColumn("_n", n).withColumn("section_id", F.when(F.col("_n") > 0, F.concat("_base", F.lit("-"), F.col("_n").cast("string"))).otherwise(F.col("_base"))).drop("_base", "_n")


def drop_adjacent_repeats(sections: DataFrame) -> DataFrame:
    """Without sections that equal the one before in type and non-empty content."""
    w = W.partitionBy("doc_id").orderBy("idx")
    same = (F.lag("type").over(w) == F.col("type")) & (F.lag("content").over(w) == F.col("content")) & (F.col("content") != "")
    return sections.withColumn("_same", F.coalesce(same, F.lit(False))).where("not _same").drop("_same")


def document_statistics(sections: DataFrame) -> DataFrame:
    """Counts of sections by type and of characters for each document, combined before the shuffle."""
    count = lambda kind: F.count_if(F.col("type") == kind).alias(f"{kind}s")
    return sections.groupBy("doc_id").agg(
        F.count("*").alias("sections"), count("heading"), count("paragraph"), count("blockquote"), count("list"), count("table"), count("figure"), count("code"),
        F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("chars"),
    )


def heading_paths(sections: DataFrame) -> DataFrame:
    """sections with path (headings from the outermost, skipped levels empty, null before the first)
    and run (number of headings so far). Headings without text end a run but leave the path."""
    w = W.partitionBy("doc_id").orderBy("idx").rowsBetween(*_UP_TO_HERE)
    text = F.when(F.col("type") == "heading", normalize_block(F.coalesce("content", F.lit(""))))
    marked = sections.withColumn("_h", F.nullif(text, F.lit(""))).withColumn("_l", F.when(F.col("_h").isNotNull(), F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce("level", F.lit(1))))))
    slots = []
    for level in range(1, 7):
        own = F.max(F.when(F.col("_l") == level, F.struct("idx", "_h"))).over(w)
        over = F.max(F.when(F.col("_l") < level, F.col("idx"))).over(w)
        marked = marked.withColumn(f"_own{level}", own).withColumn(f"_over{level}", over)
        slots.append(F.when(F.col(f"_own{level}.idx") > F.coalesce(F.col(f"_over{level}"), F.lit(-1)), F.col(f"_own{level}._h")).otherwise(""))
    last = F.max(F.when(F.col("_l").isNotNull(), F.struct("idx", "_l"))).over(w)
    run = F.count(F.when(F.col("type") == "heading", 1)).over(w)
    marked = marked.withColumn("_last", last).withColumn("run", run)
    path = F.when(F.col("_last").isNotNull(), F.array_join(F.slice(F.array(*slots), F.lit(1), F.col("_last._l")), " > "))
    return marked.withColumn("path", path).drop("_h", "_l", "_last", *[f"_own{i}" for i in range(1, 7)], *[f"_over{i}" for i in range(1, 7)])


def contextual_text(title: Column, url: Column, path: Column, body: Column) -> Column:
    """A section's text under its title, source and path; empty lines are left out."""
    lines = F.array(F.concat(F.lit("Title: "), F.coalesce(title, F.lit(""))), F.when(F.coalesce(url, F.lit("")) != "", F.concat(F.lit("Source: "), host_with_port(url))), F.when(F.coalesce(path, F.lit("")) != "", F.concat(F.lit("Section: "), path)), F.nullif(body, F.lit("")))
    return normalize_block(F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n"))


def fold_chunks(sections: DataFrame, titles: DataFrame, target: int = TARGET_CHARS) -> DataFrame:
    """Chunks (doc_id, chunk_index, heading_path, first_idx, parts, text, char_count, token_estimate,
    content_hash): sections of one run joined until `target` characters are reached; headings end
    a chunk. titles has (doc_id, title, url). Sections without a body are passed over."""
    pathed = heading_paths(sections).where(F.col("type") != "heading")
    body = normalize_block(F.coalesce("content", F.lit("")))
    parts = pathed.join(titles, "doc_id").withColumn("part", contextual_text(F.col("title"), F.col("url"), F.col("path"), F.col("content"))).where(body != "")
    runs = parts.groupBy("doc_id", "run").agg(F.sort_array(F.collect_list(F.struct("idx", "path", "part"))).alias("rows"))
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("size"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, row: Column) -> Column:
        size = acc["size"] + F.when(acc["size"] > 0, 2).otherwise(0) + F.length(row["part"])
        full = size >= target
        return F.struct((acc["chunk"] + full.cast("int")).alias("chunk"), F.when(full, 0).otherwise(size).alias("size"), F.concat(acc["out"], F.array(acc["chunk"])).alias("out"))

    numbered = runs.withColumn("nums", F.aggregate("rows", start, step)["out"])
    rows = numbered.select("doc_id", "run", F.explode(F.arrays_zip("rows", "nums")).alias("z")).select("doc_id", "run", F.col("z.nums").alias("chunk"), F.col("z.rows").alias("r"))
    grouped = rows.groupBy("doc_id", "run", "chunk").agg(F.sort_array(F.collect_list("r")).alias("r"))
    text = normalize_block(F.array_join(F.transform("r", lambda x: x["part"]), "\n\n"))
    made = grouped.select("doc_id", F.element_at("r", 1)["idx"].alias("first_idx"), F.element_at("r", 1)["path"].alias("heading_path"), F.size("r").alias("parts"), text.alias("text"))
    index = F.row_number().over(W.partitionBy("doc_id").orderBy("first_idx")) - 1
    return made.withColumn("chunk_index", index).withColumn("char_count", F.length("text")).withColumn("token_estimate", estimate_tokens(F.col("text"))).withColumn("content_hash", F.sha2("text", 256))


def heading_scopes(sections: DataFrame) -> DataFrame:
    """(doc_id, idx, end): for each heading the first later heading of its level or above, null if its
    scope runs to the end. A heading's level is 0 if null."""
    heads = sections.where(F.col("type") == "heading").select("doc_id", "idx", F.coalesce("level", F.lit(0)).alias("level"))
    per_doc = heads.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("idx", "level"))).alias("hs"))
    ends = F.transform("hs", lambda h, i: F.struct(h["idx"].alias("idx"), h["level"].alias("level"), F.array_min(F.transform(F.filter(F.slice("hs", i + 2, F.greatest(F.size("hs"), F.lit(1))), lambda g: g["level"] <= h["level"]), lambda g: g["idx"])).alias("end")))
    return per_doc.select("doc_id", F.explode(ends).alias("e")).select("doc_id", "e.idx", "e.level", "e.end")


def scope_texts(sections: DataFrame) -> DataFrame:
    """(doc_id, idx, sections, chars, text) of each heading's scope, the heading included."""
    scopes = heading_scopes(sections).select("doc_id", F.col("idx").alias("h"), "end")
    inside = scopes.join(sections, "doc_id").where("idx >= h and (end is null or idx < end)")
    rows = inside.groupBy("doc_id", "h").agg(F.count("*").alias("sections"), F.sort_array(F.collect_list(F.struct("idx", F.coalesce("content", F.lit("")).alias("c")))).alias("r"))
    text = F.array_join(F.filter(F.transform("r", lambda x: x["c"]), lambda c: c != ""), "\n\n")
    return rows.select("doc_id", F.col("h").alias("idx"), "sections", text.alias("text")).withColumn("chars", F.length("text"))


def heading_parents(sections: DataFrame) -> DataFrame:
    """(doc_id, idx, level, parent_idx): the nearest earlier heading of a smaller level."""
    heads = sections.where(F.col("type") == "heading").select("doc_id", "idx", F.coalesce("level", F.lit(1)).alias("level"))
    w = W.partitionBy("doc_id").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    before = [F.max(F.when(F.col("level") < level, F.col("idx"))).over(w) for level in range(2, 7)]
    parent = F.when(F.col("level") <= 1, F.lit(None).cast("int"))
    for level, col in zip(range(2, 7), before):
        parent = parent.when(F.col("level") == level, col)
    return heads.withColumn("parent_idx", parent.otherwise(before[-1]))


def cascade(sections: DataFrame) -> DataFrame:
    """(doc_id, idx, descendants, ancestors): what is checked or unchecked along with a heading."""
    heads = sections.where(F.col("type") == "heading").select("doc_id", "idx", F.coalesce("level", F.lit(1)).alias("level"))
    per_doc = heads.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("idx", "level"))).alias("hs"))

    def count(h: Column, i: Column) -> Column:
        later = F.slice("hs", i + 2, F.greatest(F.size("hs"), F.lit(1)))
        below = F.aggregate(later, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda a, g: F.struct((a["n"] + (a["go"] & (g["level"] > h["level"])).cast("int")).alias("n"), (a["go"] & (g["level"] > h["level"])).alias("go")))["n"]
        earlier = F.reverse(F.slice("hs", F.lit(1), i))
        above = F.aggregate(earlier, F.struct(F.lit(0).alias("n"), h["level"].alias("low")), lambda a, g: F.struct((a["n"] + (g["level"] < a["low"]).cast("int")).alias("n"), F.least(a["low"], g["level"]).alias("low")))["n"]
        return F.struct(h["idx"].alias("idx"), below.alias("descendants"), above.alias("ancestors"))

    return per_doc.select("doc_id", F.explode(F.transform("hs", count)).alias("x")).select("doc_id", "x.idx", "x.descendants", "x.ancestors")


def deepest_first(headings: DataFrame) -> DataFrame:
    """Order of work on headings: the deepest level first, document order within."""
    return headings.orderBy(F.col("level").desc_nulls_last(), "doc_id", "idx")


def summary_parts(texts: DataFrame, limit: int = SUMMARY_LIMIT, size: int = SUMMARY_SIZE, overlap: int = SUMMARY_OVERLAP) -> DataFrame:
    """(doc_id, idx, part, text): a scope over the limit in overlapping parts, others whole."""
    starts = F.when(F.length("text") > limit, F.sequence(F.lit(0), F.length("text") - 1, F.lit(size - overlap))).otherwise(F.array(F.lit(0)))
    rows = texts.select("doc_id", "idx", "text", F.posexplode(starts).alias("part", "at"))
    return rows.select("doc_id", "idx", "part", F.when(F.length("text") > limit, F.substring("text", F.col("at") + 1, F.lit(size))).otherwise(F.col("text")).alias("text"))


def correct_levels_py(headings: list[tuple[str, int | None]], entries: list[tuple[str, int]]) -> list[int | None]:
    """Levels of a book's headings after its table of contents: one pointer over the entries; a heading
    that equals, contains or lies in the entry there, or in the one behind it, takes its level."""
    def meets(a: str, b: str) -> bool:
        return bool(a) and bool(b) and (a == b or a in b or b in a)

    out, at = [], 0
    for title, level in headings:
        for ahead in (0, 1):
            if at + ahead < len(entries) and meets(title.strip(), entries[at + ahead][0].strip()):
                level = max(1, min(6, entries[at + ahead][1]))
                at += ahead + 1
                break
        out.append(level)
    return out
