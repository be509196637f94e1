"""Documents as Markdown, by higher-order functions over arrays of section structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorefold.functions.text import json_string

SECTION = "struct<section_id:string,type:string,level:int,content:string,items:array<struct<text:string,items:array<string>>>,rows:array<array<string>>,assets:array<struct<asset_id:string,path:string,source_url:string,alt:string,caption:string>>>"


def escape_link(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[\]])", r"\\$1")


def escape_cell(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\|", r"\\|"), "\r?\n", "<br>")


def _table_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, escape_cell), " | "), F.lit(" |"))


def table_lines(rows: Column, content: Column) -> Column:
    """Lines of a table: the first row is the header, short rows are filled up."""
    width = F.array_max(F.transform(rows, F.size))
    filled = F.transform(rows, lambda r: F.concat(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), F.array_repeat(F.lit(""), width - F.size(r))))
    lines = F.concat(F.array(_table_row(F.element_at(filled, 1)), _table_row(F.array_repeat(F.lit("---"), width))), F.transform(F.slice(filled, F.lit(2), F.greatest(F.size(filled), F.lit(1))), _table_row), F.array(F.lit("")))
    plain = F.filter(F.array(content, F.lit("")), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(F.coalesce(rows, F.array())) > 0, lines).otherwise(plain)


def section_lines(s: Column) -> Column:
    """Lines of one section, its anchor first."""
    text = F.coalesce(s["content"], F.lit(""))
    one = lambda *lines: F.array(*lines, F.lit(""))
    quote = F.when(text != "", F.concat(F.transform(F.split(text, "\r?\n", -1), lambda line: F.concat(F.lit("> "), line)), F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))
    items = F.concat(F.transform(F.coalesce(s["items"], F.array().cast("array<struct<text:string,items:array<string>>>")), lambda i: F.concat(F.lit("- "), F.coalesce(i["text"], F.lit("")))), F.array(F.lit("")))
    images = F.transform(
        F.filter(F.coalesce(s["assets"], F.array().cast("array<struct<asset_id:string,path:string,source_url:string,alt:string,caption:string>>")), lambda a: F.coalesce(F.nullif(a["path"], F.lit("")), F.nullif(a["source_url"], F.lit(""))).isNotNull()),
        lambda a: F.concat(F.lit("!["), escape_link(F.coalesce(F.nullif(a["alt"], F.lit("")), F.nullif(a["caption"], F.lit("")), F.lit(""))), F.lit("]("), F.coalesce(F.nullif(a["path"], F.lit("")), a["source_url"]), F.lit(")")),
    )
    figure = F.concat(images, F.when(text != "", F.array(text)).otherwise(F.array().cast("array<string>")), F.array(F.lit("")))
    kind = s["type"]
    body = (
        F.when(kind == "heading", one(F.concat(F.repeat(F.lit("#"), F.coalesce(s["level"], F.lit(2))), F.lit(" "), text)))
        .when(kind == "paragraph", one(text))
        .when(kind == "blockquote", quote)
        .when(kind == "list", items)
        .when(kind == "code", one(F.lit("```"), text, F.lit("```")))
        .when(kind == "figure", figure)
        .when(kind == "table", table_lines(s["rows"], s["content"]))
    )
    anchor = F.when(F.coalesce(s["section_id"], F.lit("")) != "", F.array(F.concat(F.lit("<!-- section_id:"), s["section_id"], F.lit(" -->")))).otherwise(F.array().cast("array<string>"))
    return F.when(body.isNull(), F.array().cast("array<string>")).otherwise(F.concat(anchor, body))


def markdown(title: Column, page_title: Column, url: Column, ingested_at: Column, language: Column, sections: Column) -> Column:
    """The whole document: front matter, title and sections."""
    field = lambda name, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{name}: "), json_string(value)))
    head = F.array(F.lit("---"), F.concat(F.lit("title: "), json_string(title)), field("page_title", page_title), field("url", url), F.concat(F.lit("ingested_at: "), json_string(ingested_at)), field("language", language), F.lit("---"), F.lit(""), F.concat(F.lit("# "), title), F.lit(""))
    lines = F.concat(F.filter(head, lambda x: x.isNotNull()), F.flatten(F.transform(sections, section_lines)))
    return F.concat(F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), "\n{4,}", "\n\n\n"), r"\s+$", ""), F.lit("\n"))


def render_sections(sections: DataFrame) -> DataFrame:
    """(doc_id, markdown) of flat section rows (doc_id, idx, section_id, type, level, content)."""
    empty = "cast(null as array<struct<text:string,items:array<string>>>)"
    s = F.struct("idx", "section_id", "type", "level", "content", F.expr(empty).alias("items"), F.expr("cast(null as array<array<string>>)").alias("rows"), F.expr("cast(null as array<struct<asset_id:string,path:string,source_url:string,alt:string,caption:string>>)").alias("assets"))
    grouped = sections.groupBy("doc_id").agg(F.sort_array(F.collect_list(s)).alias("s"))
    return grouped.select("doc_id", F.array_join(F.flatten(F.transform("s", section_lines)), "\n").alias("markdown"))


def annotations_markdown(annotations: DataFrame) -> DataFrame:
    """(doc_id, markdown): a document's annotations by type, types in order of first appearance."""
    by_type = annotations.groupBy("doc_id", "type").agg(F.min(F.struct("created_at", "annotation_id")).alias("first"), F.sort_array(F.collect_list(F.struct("created_at", "annotation_id", "text"))).alias("rows"))
    block = F.concat(F.lit("## "), F.col("type"), F.lit("\n\n"), F.array_join(F.transform("rows", lambda r: F.concat(F.lit("- "), F.coalesce(r["text"], F.lit("")))), "\n"))
    return by_type.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("first", block.alias("block")))).alias("b")).select("doc_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("markdown"))


def prompt_text(s: Column) -> Column:
    """A section for a prompt: code cut at 300 characters, tables at a header and 19 rows."""
    text = F.coalesce(s["content"], F.lit(""))
    row = lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | ")
    return (
        F.when(s["type"] == "code", F.when(F.length(text) > 300, F.concat(F.substring(text, 1, 300), F.lit("..."))).otherwise(text))
        .when(s["type"] == "table", F.array_join(F.transform(F.slice(s["rows"], 1, 20), row), "\n"))
        .when(s["type"] == "list", F.array_join(F.transform(s["items"], lambda i: F.concat(F.lit("- "), i["text"])), "\n"))
        .when(s["type"] == "figure", F.concat(F.lit("[Figure: "), F.coalesce(F.nullif(text, F.lit("")), F.lit("untitled")), F.lit("]")))
        .otherwise(text)
    )
