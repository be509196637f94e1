"""The registry of queries over the reference's own operators and the general data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorefold.operators import nested
from lorefold.plans import content, details, extraction, library, saving
from lorefold.session import table as t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p7_found": lambda s, d: nested.record_places(nested.all_records(nested.document_tables(t(s, d, "knowledge_documents")))),
    "p7_records": lambda s, d: nested.all_records(nested.document_tables(t(s, d, "knowledge_documents"))).drop("place"),
}
QUERIES |= content.QUERIES | library.QUERIES | extraction.QUERIES | details.QUERIES | saving.QUERIES


def _unwrap(x: str) -> str:
    return f"case when json_type({x}) = 'VARCHAR' and json_valid({x} ->> '$') and json_type({x} ->> '$') in ('ARRAY', 'OBJECT', 'VARCHAR', 'NULL') then json({x} ->> '$') else {x} end"


def _entries(source: str, keys: str, field: str) -> str:
    """SQL for the child records of a column: (keys, i, e), nulls left out."""
    inner = f"select {keys}, {_unwrap(field)} u from {source}"
    lists = f"select {keys}, case json_type(u) when 'ARRAY' then json_extract(u, '$[*]') when 'OBJECT' then [u] else [] end l from ({inner})"
    rows = f"select {keys}, unnest(l) e0, generate_subscripts(l, 1) - 1 i from ({lists})"
    return f"(select * from (select {keys}, i, {_unwrap('e0')} e from ({rows})) where json_type(e) <> 'NULL')"


_PLACE = "cast({} as integer) section_index, cast({} as integer) pos, cast({} as integer) subpos"
_CHILD = lambda a, b, c: _PLACE.format(a, b, c)
ORACLE: dict[str, str] = {
    "p7_found": "with h as (select doc_id, arg_max(payload, written_at) p from knowledge_documents where doc_id is not null group by 1), v as (select doc_id, json(p) p0 from h where json_valid(p)), r as (select doc_id, " + _unwrap("p0") + " j from v),"
    " root as (select doc_id, json_extract(j, '$.sections') s, json_extract(j, '$.references') f from r where json_type(j) = 'OBJECT'),"
    " sec as (select doc_id, i si, e, json_extract(e, '$.items') it, json_extract(e, '$.assets') a from " + _entries("root", "doc_id", "s") + "), item as (select doc_id, si, i pi, e, case when json_type(e) = 'OBJECT' then json_extract(e, '$.items') end it from " + _entries("sec", "doc_id, si", "it") + "),"
    " ref as (select doc_id, i ri, json_extract(e, '$.blocks') b from " + _entries("root", "doc_id", "f") + ")"
    " select doc_id, 'section' kind, " + _CHILD("si", -1, -1) + " from sec union all select doc_id, 'item', " + _CHILD("si", "pi", -1) + " from item union all select doc_id, 'asset', " + _CHILD("si", "i", -1) + " from " + _entries("sec", "doc_id, si", "a")
    + " union all select doc_id, 'subitem', " + _CHILD("si", "pi", "i") + " from " + _entries("item", "doc_id, si, pi", "it") + " union all select doc_id, 'reference', " + _CHILD(-1, "ri", -1) + " from ref union all select doc_id, 'block', " + _CHILD(-1, "ri", "i") + " from " + _entries("ref", "doc_id, ri", "b"),
}
ORACLE["p7_records"] = (
    "select tag, root, concat(parent_id, '/', tag, ':', place) id, parent_id from (select kind tag, doc_id root, case when kind in ('section', 'reference') then doc_id when kind in ('item', 'asset') then concat(doc_id, '/section:', section_index)"
    " when kind = 'subitem' then concat(doc_id, '/section:', section_index, '/item:', pos) else concat(doc_id, '/reference:', pos) end parent_id, case when kind = 'section' then section_index when kind in ('subitem', 'block') then subpos else pos end place"
    f" from ({ORACLE['p7_found']}))"
)
ORACLE |= content.ORACLE | library.ORACLE | extraction.ORACLE | details.ORACLE | saving.ORACLE


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Ranked and packed citations for every evaluation question."""
    return library.QUERIES["context_pack"](spark, folder)
