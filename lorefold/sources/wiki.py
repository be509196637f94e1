"""Wiki spaces as tables: pages reachable from roots, and trees of blocks as sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorefold.session import materialise


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(page, depth): pages reached from the roots by links (source, target), each at its least depth. One
    join per level over the pages not seen before, so cycles end."""
    seen = materialise(roots.select("page").distinct().withColumn("depth", F.lit(0)), "seen")
    frontier, depth = seen, 0
    while not frontier.isEmpty():
        depth += 1
        step = edges.join(frontier.select(F.col("page").alias("source")), "source").select(F.col("target").alias("page")).distinct()
        frontier = materialise(step.join(seen.select("page"), "page", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        seen = seen.unionByName(frontier)
    return seen


# Block types and the sections they become.
KINDS = {"text": "paragraph", "bullet": "list", "ordered": "list", "todo": "list", "code": "code", "quote": "blockquote", "image": "figure"}


def block_sections(blocks: DataFrame) -> DataFrame:
    """(page, idx, type, level, content) of blocks (page, path, type, text, done). path is the array of
    positions from the root, so that its order is the order of the page; heading1..heading9 carry their
    level, items are indented by their depth and checkboxes marked, adjacent items make one list."""
    depth = F.size("path") - 1
    kind = F.col("type")
    level = F.when(kind.startswith("heading"), F.least(F.regexp_extract(kind, r"(\d+)", 1).cast("int"), F.lit(6)))
    mapped = F.create_map(*[F.lit(x) for pair in sorted(KINDS.items()) for x in pair])
    section = F.when(level.isNotNull(), "heading").otherwise(F.element_at(mapped, kind))
    mark = F.when(kind == "todo", F.when(F.col("done"), "- [x] ").otherwise("- [ ] ")).when(kind == "ordered", "1. ").otherwise("- ")
    text = F.when(section == "list", F.concat(F.repeat(F.lit("  "), F.greatest(depth - 1, F.lit(0))), mark, F.col("text"))).otherwise(F.col("text"))
    rows = blocks.select("page", F.struct("path", section.alias("type"), level.alias("level"), text.alias("content")).alias("b")).where("b.type is not null and b.content is not null")
    ordered = rows.groupBy("page").agg(F.sort_array(F.collect_list("b")).alias("bs"))
    empty = F.array().cast("array<struct<type:string,level:int,content:string>>")

    def step(out, b):  # noqa: ANN001, ANN202
        joins = (F.size(out) > 0) & (b["type"] == "list") & (F.try_element_at(out, F.lit(-1))["type"] == "list")
        grown = F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(F.lit("list").alias("type"), F.lit(None).cast("int").alias("level"), F.concat_ws("\n", F.try_element_at(out, F.lit(-1))["content"], b["content"]).alias("content"))))
        return F.when(joins, grown).otherwise(F.concat(out, F.array(F.struct(b["type"].alias("type"), b["level"].alias("level"), b["content"].alias("content")))))

    return ordered.select("page", F.posexplode(F.aggregate("bs", empty, step)).alias("idx", "s")).select("page", "idx", "s.type", "s.level", "s.content")
