"""Deeply nested semi-structured records as related flat tables.

Method: single-pass tagged emission. A depth-first visitor walks each payload once, following a
declared tree of child arrays, and emits one row per record: table tag, primary key, parent key,
positions and the record's own fields as JSON. The rows are written once, partitioned by tag, and
each table is then read back from its partition with its own schema.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorefold.operators.latest import holding_rows
from lorefold.session import shared_path


@dataclass(frozen=True)
class Node:
    """A table fed by the array `field` of its parent's records."""

    tag: str
    field: str
    children: tuple[Node, ...] = ()


DOCUMENT = (
    Node("section", "sections", (Node("item", "items", (Node("subitem", "items"),)), Node("asset", "assets"))),
    Node("reference", "references", (Node("block", "blocks"),)),
)

# Schemas of the tables of a knowledge document.
SCHEMAS = {
    "section": "section_id string, type string, level int, content string, annotations string",
    "item": "text string",
    "subitem": "text string",
    "asset": "asset_id string, path string, source_url string, alt string, caption string",
    "reference": "ref_id string, label string, text string",
    "block": "text string",
}


def unwrap(value: object) -> object:
    """The value a JSON text stands for, through any number of such wrappings; other strings and
    values are returned as they are. Only objects, arrays, strings and null count as JSON text, so
    that a plain text made of digits stays a text."""
    while isinstance(value, str):
        text = value.strip()
        if not text or text[0] not in '[{"n' or (text[0] == "n" and text != "null"):
            return value
        try:
            value = json.loads(text)
        except (ValueError, RecursionError):
            return value
    return value


def elements(value: object) -> list[object]:
    """The entries of a child field: null and absent have none, a lone object is an array of one,
    a lone scalar is no record."""
    value = unwrap(value)
    if isinstance(value, list):
        return value
    return [value] if isinstance(value, dict) else []


def parse(payload: str | None) -> dict | None:
    """The object of a payload, None if it cannot be read or is no object."""
    if payload is None:
        return None
    value = unwrap(payload)
    return value if isinstance(value, dict) else None


def visit(root: dict, tree: tuple[Node, ...] = DOCUMENT) -> Iterator[tuple[str, tuple[int, ...], tuple[int, ...], object]]:
    """(tag, path, parent's path, record) in depth-first order; a path alternates the rank of the
    child table and the position in the array. Null entries are passed over but keep their place."""
    stack = [("", root, (), tree)]
    while stack:
        tag, record, path, nodes = stack.pop()
        if path:
            yield tag, path, path[:-2], record
        if not isinstance(record, dict):
            continue
        below = []
        for rank, node in enumerate(nodes):
            for pos, entry in enumerate(elements(record.get(node.field))):
                entry = unwrap(entry)
                if entry is not None:
                    below.append((node.tag, entry, (*path, rank, pos), node.children))
        stack += reversed(below)


def own_fields(record: object, children: tuple[str, ...]) -> str:
    """The record without its child arrays, as JSON; a plain value becomes {"text": value}."""
    if not isinstance(record, dict):
        record = {"text": record}
    return json.dumps({k: v for k, v in record.items() if k not in children}, ensure_ascii=False, separators=(",", ":"))


def _child_fields(tree: tuple[Node, ...]) -> dict[str, tuple[str, ...]]:
    out: dict[str, tuple[str, ...]] = {}
    for n in tree:
        out[n.tag] = tuple(c.field for c in n.children)
        out |= _child_fields(n.children)
    return out


def flatten(df: DataFrame, key: str, payload: str, tree: tuple[Node, ...] = DOCUMENT) -> DataFrame:
    """(root, tag, id, parent_id, place, record): one row per child record of each payload.

    id is the root key and the record's place, as in d7/section:2/item:0; parent_id is the id of
    the record around it, for the outermost ones the root key. place holds the positions only.
    Null keys and payloads, unreadable payloads and payloads that are no object have no records;
    unknown fields stay in `record`. Repeated rows give repeated records: pass holding rows. Columns
    other than key and payload are not read."""
    fields = _child_fields(tree)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, p in zip(b["k"], b["p"]):
                root = parse(p)
                if root is None:
                    continue
                names = {(): k}
                for tag, path, parent, record in visit(root, tree):
                    names[path] = f"{names[parent]}/{tag}:{path[-1]}"
                    out.append((k, tag, names[path], names[parent], list(path[1::2]), own_fields(record, fields[tag])))
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=["root", "tag", "id", "parent_id", "place", "record"])
                    out = []
            yield pd.DataFrame(out, columns=["root", "tag", "id", "parent_id", "place", "record"])

    rows = df.select(F.col(key).cast("string").alias("k"), F.col(payload).alias("p")).where("k is not null and p is not null")
    return rows.mapInPandas(run, "root string, tag string, id string, parent_id string, place array<int>, record string")


def document_tables(documents: DataFrame, path: str | None = None) -> dict[str, DataFrame]:
    """The flat tables of the holding row of each knowledge document, by tag. They are written once,
    one folder per tag, to `path` or a folder of their own in the shared one, and read back with their schemas."""
    held = holding_rows(documents, ["doc_id"], "written_at", ["payload"])
    spark = documents.sparkSession
    path = path or shared_path(spark, "records")
    write_tables(flatten(held, "doc_id", "payload"), path)
    return {tag: read_table(spark, path, tag) for tag in SCHEMAS}


def all_records(tables: dict[str, DataFrame]) -> DataFrame:
    """(tag, root, id, parent_id, place): the keys of all tables."""
    rows = [t.select(F.lit(tag).alias("tag"), "root", "id", "parent_id", "place") for tag, t in tables.items()]
    return reduce(DataFrame.unionByName, rows)


def record_places(records: DataFrame) -> DataFrame:
    """(doc_id, kind, section_index, pos, subpos) of document records; unused numbers are -1."""
    at = lambda i: F.coalesce(F.get("place", F.lit(i)), F.lit(-1))
    in_section = F.col("tag").isin("section", "item", "asset", "subitem")
    return records.select(
        F.col("root").alias("doc_id"),
        F.col("tag").alias("kind"),
        F.when(in_section, at(0)).otherwise(-1).alias("section_index"),
        F.when(in_section, at(1)).otherwise(at(0)).alias("pos"),
        F.when(in_section, at(2)).otherwise(at(1)).alias("subpos"),
    )


def write_tables(records: DataFrame, path: str) -> None:
    """Write the tagged rows once, one folder per tag."""
    records.write.mode("overwrite").partitionBy("tag").option("compression", "zstd").parquet(path)


def read_table(spark: SparkSession, path: str, tag: str, schema: str | None = None) -> DataFrame:
    """One flat table: keys, positions and the columns of its schema. Fields of another type than
    the schema's come back as null; an absent partition is an empty table."""
    rows = spark.read.schema("root string, id string, parent_id string, place array<int>, record string, tag string").parquet(path).where(F.col("tag") == tag)
    parsed = F.from_json("record", schema or SCHEMAS[tag])
    return rows.select("root", "id", "parent_id", "place", parsed.alias("_r")).select("root", "id", "parent_id", "place", "_r.*")
