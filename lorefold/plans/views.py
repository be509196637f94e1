"""Views that several queries share, once as DataFrames and once as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorefold.operators.latest import holding_rows
from lorefold.operators.sections import flat_sections
from lorefold.operators.store import first_by
from lorefold.session import table as t

ITEM_COLUMNS = ["source_type", "active_rawdoc_id", "active_doc_id", "normalized_url", "original_url", "canonical_url", "title", "page_title", "language", "state", "created_at", "updated_at", "parsed_at"]

ITEMS = "items as (select * exclude (rn) from (select *, row_number() over (partition by item_id order by updated_at desc) rn from knowledge_items where item_id is not null) where rn = 1)"
SECTIONS = "sections as (select distinct doc_id, section_index idx, type, level, content from document_sections where doc_id is not null and section_index is not null)"
ALIASES = (
    "aliases as (select item_id, 'normalized_url' alias_type, normalized_url alias_value, created_at from items where normalized_url is not null"
    " union all select item_id, 'original_url', original_url, created_at from items where original_url is not null"
    " union all select item_id, 'canonical_url', canonical_url, created_at from items where canonical_url is not null)"
)
CHUNKS = "held as (select * exclude (rn) from (select *, row_number() over (partition by chunk_id order by updated_at desc) rn from chunks where chunk_id is not null) where rn = 1)"
MEMBERS = "members as (select collection, member, order_index from (select l_orderkey collection, l_partkey member, l_linenumber order_index, row_number() over (partition by l_orderkey, l_partkey order by l_linenumber) rn from lineitem) where rn = 1)"
ANNOTATIONS = (
    "annotations as (select event_id annotation_id, user_id doc_id, case event_type when 'click' then 'highlight' when 'view' then 'note' when 'purchase' then 'summary' when 'signup' then 'tag' else 'bookmark' end as type,"
    " value > 180 orphaned, ts created_at from events)"
)
TRANSITIONS = (
    "transitions as (select user_id job, event_id // 5 item, ts, event_id, case event_type when 'click' then 'pending' when 'view' then 'fetching' when 'signup' then 'parsing' when 'purchase' then 'saved' else 'failed' end as state from events)"
)


def items(s: SparkSession, d: str) -> DataFrame:
    return holding_rows(t(s, d, "knowledge_items"), ["item_id"], "updated_at", ITEM_COLUMNS)


def sections(s: SparkSession, d: str) -> DataFrame:
    return flat_sections(t(s, d, "document_sections"))


def aliases(s: SparkSession, d: str) -> DataFrame:
    kinds = ["normalized_url", "original_url", "canonical_url"]
    rows = items(s, d).select("item_id", "created_at", F.explode(F.array(*[F.struct(F.lit(k).alias("alias_type"), F.col(k).alias("alias_value")) for k in kinds])).alias("a"))
    return rows.select("item_id", "a.alias_type", "a.alias_value", "created_at").where("alias_value is not null")


def titles(s: SparkSession, d: str) -> DataFrame:
    return items(s, d).where("active_doc_id is not null").select(F.col("active_doc_id").alias("doc_id"), "title", F.col("normalized_url").alias("url"))


def chunks(s: SparkSession, d: str) -> DataFrame:
    return holding_rows(t(s, d, "chunks"), ["chunk_id"], "updated_at", ["doc_id", "chunk_index", "heading_path", "text"])


def members(s: SparkSession, d: str) -> DataFrame:
    rows = t(s, d, "lineitem").select(F.col("l_orderkey").alias("collection"), F.col("l_partkey").alias("member"), F.col("l_linenumber").alias("order_index"))
    return first_by(rows, ["collection", "member"], ["order_index"])


def annotations(s: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "highlight").when(F.col("event_type") == "view", "note").when(F.col("event_type") == "purchase", "summary").when(F.col("event_type") == "signup", "tag").otherwise("bookmark")
    return t(s, d, "events").select(F.col("event_id").alias("annotation_id"), F.col("user_id").alias("doc_id"), kind.alias("type"), (F.col("value") > 180).alias("orphaned"), F.col("ts").alias("created_at"))


def transitions(s: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("event_type") == "click", "pending").when(F.col("event_type") == "view", "fetching").when(F.col("event_type") == "signup", "parsing").when(F.col("event_type") == "purchase", "saved").otherwise("failed")
    return t(s, d, "events").select(F.col("user_id").alias("job"), F.expr("event_id div 5").alias("item"), "ts", "event_id", state.alias("state"))
