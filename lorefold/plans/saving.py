"""Queries on saving, collections, jobs and what clients show."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorefold.functions.urls import normalize_url, url_hash
from lorefold.operators import saving as sv
from lorefold.operators import settings as se
from lorefold.operators import store
from lorefold.plans import views as v
from lorefold.session import table as t


def rows_of(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row): all rows of all tables as text, to compare what is left of them."""
    line = lambda df: F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in df.columns])
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("table_name"), line(df).alias("row")) for name, df in tables.items()])


ITEM = ("item_id", "active_rawdoc_id", "active_doc_id", "state", "created_at")


def _tables(s, d):  # noqa: ANN001, ANN202
    items = v.items(s, d)
    return {
        "items": items.select(*ITEM[:4], F.unix_micros("created_at").alias("created_at")),
        "documents": items.where("active_doc_id is not null").select(F.col("active_doc_id").alias("doc_id"), "item_id").distinct(),
        "chunks": v.chunks(s, d).select("chunk_id", "doc_id"),
        "rawdocs": t(s, d, "rawdocs").select("rawdoc_id", "item_id").distinct(),
        "aliases": v.aliases(s, d).groupBy("alias_type", "alias_value").agg(F.min("item_id").alias("item_id")).select(F.concat("alias_type", F.lit(":"), "alias_value").alias("alias_id"), "alias_type", "alias_value", "item_id", F.lit(0).alias("created_at")),
    }


def _again(s, d, mark):  # noqa: ANN001, ANN202
    """All items of web pages, taken a second time: new documents and captures, a chunk each."""
    items = v.items(s, d).where("source_type = 'url' and active_rawdoc_id is not null")
    new = lambda c: F.concat(F.col(c), F.lit(mark)).alias(c)
    saved = items.select("item_id", new("active_rawdoc_id"), F.concat(F.coalesce("active_doc_id", "active_rawdoc_id"), F.lit(mark)).alias("active_doc_id"), F.lit("parsed").alias("state"), F.lit(0).cast("bigint").alias("created_at"))
    docs = saved.select(F.col("active_doc_id").alias("doc_id"), "item_id")
    return saved, docs, docs.select(F.concat("doc_id", F.lit("#0")).alias("chunk_id"), "doc_id"), saved.select(F.col("active_rawdoc_id").alias("rawdoc_id"), "item_id")


def _save(s, d):  # noqa: ANN001, ANN202
    saved, docs, chunks, raws = _again(s, d, "~2")
    return rows_of(sv.save_captures(_tables(s, d), saved, docs, chunks, raws))


def _reparse(s, d):  # noqa: ANN001, ANN202
    saved, docs, chunks, _ = _again(s, d, "~3")
    held = _tables(s, d)
    saved = saved.join(held["items"].select("item_id", F.col("active_rawdoc_id").alias("_raw")), "item_id").withColumn("active_rawdoc_id", F.col("_raw")).select(*ITEM)
    held["annotations"] = held["documents"].select(F.concat("doc_id", F.lit("@1")).alias("annotation_id"), "doc_id", F.lit(False).alias("orphaned"))
    out = sv.save_reparsed(held, saved, docs, chunks)
    return rows_of(out | {"annotations": out["annotations"].select("annotation_id", "doc_id", "orphaned")})


def _collections(s, d):  # noqa: ANN001, ANN202
    urls = v.items(s, d).where("normalized_url is not null")
    page = F.regexp_extract("normalized_url", "^(https?://[^/?#]+)", 1)
    wanted = urls.select(F.col("title"), F.concat(page, F.lit("/")).alias("root_url"), F.unix_micros("updated_at").alias("updated_at")).where("root_url <> '/'")
    there = wanted.select("root_url").distinct().orderBy("root_url").limit(10)
    old = there.select(F.concat(F.lit("old:"), "root_url").alias("item_id"), F.lit("collection").alias("item_type"), url_hash(normalize_url(F.col("root_url"))).alias("identity_key"), F.lit("before").alias("title"), F.lit("active").alias("state"), F.lit(0).cast("bigint").alias("updated_at"))
    return sv.upsert_collections(old, wanted).select("item_id", "title", "updated_at")


def _repoint(s, d):  # noqa: ANN001, ANN202
    moved = t(s, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("old"), F.lit(1).cast("bigint").alias("new"))
    return sv.repoint_members(v.members(s, d).withColumn("member", F.col("member").cast("bigint")), moved).select("collection", "member", "order_index")


def _by_url(s, d):  # noqa: ANN001, ANN202
    urls = v.items(s, d).where("source_type = 'url' and canonical_url is not null").select(F.col("canonical_url").alias("url")).distinct()
    return sv.ids_of_urls(urls, v.aliases(s, d))


def _remove(s, d):  # noqa: ANN001, ANN202
    items = v.items(s, d)
    docs = items.where("active_doc_id is not null").select(F.col("active_doc_id").alias("doc_id"))
    return rows_of(store.remove_items(items.select("item_id", "state", "active_doc_id"), docs, v.chunks(s, d).select("chunk_id", "doc_id"), docs, items.where("source_type = 'epub'").select("item_id")))


def _purge(s, d):  # noqa: ANN001, ANN202
    items = v.items(s, d).select("item_id", "active_doc_id", "source_type")
    tables = {"items": items, "aliases": v.aliases(s, d).select("item_id", "alias_type"), "chunks": v.chunks(s, d).select("chunk_id", "doc_id"), "rawdocs": t(s, d, "rawdocs").select("rawdoc_id", "item_id").distinct()}
    return rows_of(store.purge_items(tables, items.where("source_type <> 'url'").select("item_id")))


def _annotated(s, d):  # noqa: ANN001, ANN202
    items = t(s, d, "customer").select(F.concat(F.lit("i"), F.col("c_custkey").cast("string")).alias("item_id"), F.col("c_custkey").alias("active_doc_id"), "c_name", "c_mktsegment")
    docs = items.select(F.col("active_doc_id").alias("doc_id"), F.col("c_name").alias("title"))
    kinds = items.select("item_id", F.explode(F.array(F.struct(F.lit("normalized_url").alias("alias_type"), F.concat(F.lit("https://x.example/"), "item_id").alias("alias_value")), F.struct(F.lit("original_url").alias("alias_type"), F.col("c_mktsegment").alias("alias_value")))).alias("a")).select("item_id", "a.*")
    return sv.annotated_items(v.annotations(s, d), items, docs, kinds)


QUERIES = {
    "save_capture": _save,
    "reparse": _reparse,
    "upsert_collections": _collections,
    "repoint_members": _repoint,
    "ids_by_url": _by_url,
    "remove_items": _remove,
    "purge_items": _purge,
    "clear_parsed": lambda s, d: rows_of({"items": store.clear_parsed(v.items(s, d).select("item_id", "state", "active_doc_id"))}),
    "annotated_items": _annotated,
    "collection_names": lambda s, d: sv.collection_names(t(s, d, "supplier").select(F.concat(F.lit(" "), F.col("s_name"), F.lit(" ")).alias("name")).unionByName(t(s, d, "part").select(F.col("p_name").alias("name"))), t(s, d, "part").select(F.col("p_name").alias("title"))),
    "create_jobs": lambda s, d: sv.create_jobs(t(s, d, "rawdocs").where("item_id is not null").groupBy(F.col("item_id").alias("job_id")).agg(F.lit("https://x.example/").alias("source_page_url"), F.lit("links").alias("mode"), F.lit(0).alias("created_at"), F.array_sort(F.collect_set("source_uri")).alias("urls")))[0].select("job_id", "state", "total"),
    "item_replay": lambda s, d: sv.replay_states(v.transitions(s, d), ["job", "item"], ["ts", "event_id"]),
    "annotation_mirror": lambda s, d: sv.annotation_mirror(v.annotations(s, d)).select("doc_id", "version", F.length("annotations").alias("chars")),
    "item_badges": lambda s, d: v.items(s, d).select("item_id", se.badge(store.presented_state(F.col("state"))).alias("badge")),
    "page_titles": lambda s, d: v.items(s, d).select("item_id", se.page_title_choice(F.col("title"), F.col("page_title"), F.col("normalized_url")).alias("chosen")),
    "error_status": lambda s, d: t(s, d, "rawdocs").select("rawdoc_id", "content_type").distinct().select("rawdoc_id", se.error_status(F.concat(F.lit("Expected "), F.upper(F.coalesce("content_type", F.lit(""))))).alias("status")),
    "content_sizes": lambda s, d: t(s, d, "rawdocs").select("rawdoc_id", "content_length").distinct().select("rawdoc_id", se.formatted_bytes(F.col("content_length") * 512).alias("size")),
    "summary_headings": lambda s, d: se.summary_headings(t(s, d, "document_sections"), t(s, d, "document_sections").where("section_id is not null and section_index < 3")),
    "parsed_impact": lambda s, d: se.parsed_impact(v.items(s, d), _tables(s, d)["documents"], v.chunks(s, d), v.items(s, d).select(F.col("item_id").alias("member"))),
}

_TABLES = (
    f"{v.ITEMS}, {v.CHUNKS}, ag as (select item_id, concat(active_rawdoc_id, '{{m}}') raw, concat(coalesce(active_doc_id, active_rawdoc_id), '{{m}}') doc from items where source_type = 'url' and active_rawdoc_id is not null),"
    " od as (select i.active_doc_id doc_id from items i join ag on ag.item_id = i.item_id where i.active_doc_id is not null), orw as (select i.active_rawdoc_id rawdoc_id from items i join ag on ag.item_id = i.item_id)"
)
_SAVED = (
    " select 'items' table_name, concat_ws('|', i.item_id, coalesce({raw}, '-'), coalesce(ag.doc, i.active_doc_id, '-'), case when ag.item_id is not null then 'parsed' else coalesce(state, '-') end, coalesce(cast(epoch_us(created_at) as varchar), '-')) as row from items i left join ag on ag.item_id = i.item_id"
    " union all select 'documents', concat_ws('|', active_doc_id, item_id) from (select distinct active_doc_id, item_id from items where active_doc_id is not null) where active_doc_id not in (select doc_id from od) union all select 'documents', concat_ws('|', doc, item_id) from ag"
    " union all select 'chunks', concat_ws('|', chunk_id, coalesce(doc_id, '-')) from held where doc_id is null or doc_id not in (select doc_id from od) union all select 'chunks', concat_ws('|', concat(doc, '#0'), doc) from ag"
)
_ROOTS = "r as (select title, regexp_extract(normalized_url, '^(https?://[^/?#]+)', 1) || '/' root_url, epoch_us(updated_at) updated_at from items where normalized_url is not null), w as (select * from r where root_url <> '/')"
ORACLE = {
    "save_capture": "with " + _TABLES.replace("{m}", "~2") + _SAVED.replace("{raw}", "ag.raw, i.active_rawdoc_id")
    + " union all select 'rawdocs', concat_ws('|', coalesce(rawdoc_id, '-'), coalesce(item_id, '-')) from (select distinct rawdoc_id, item_id from rawdocs) where rawdoc_id not in (select rawdoc_id from orw) union all select 'rawdocs', concat_ws('|', raw, item_id) from ag",
    "reparse": "with " + _TABLES.replace("{m}", "~3") + _SAVED.replace("{raw}", "i.active_rawdoc_id")
    + " union all select 'annotations', concat_ws('|', concat(i.active_doc_id, '@1'), coalesce(ag.doc, i.active_doc_id), 'false') from (select distinct active_doc_id, item_id from items where active_doc_id is not null) i left join ag on ag.item_id = i.item_id",
    "upsert_collections": f"with {v.ITEMS}, {_ROOTS}, x as (select root_url, regexp_replace(root_url, '/$', '') || '/' n, max(struct_pack(u := updated_at, t := title)) m from w group by 1), old as (select distinct root_url from w order by 1 limit 10)"
    " select case when o.root_url is not null then 'old:' || x.root_url else 'col:sha256:' || substr(sha256(n), 1, 16) end item_id, m.t title, m.u updated_at from x left join old o on o.root_url = x.root_url",
    "repoint_members": f"with {v.MEMBERS} select collection, cast(case when p_partkey is not null then 1 else member end as bigint) as member, min(order_index) order_index from members left join part on p_partkey = member and p_size = 1 group by 1, 2",
    "remove_items": f"with {v.ITEMS}, {v.CHUNKS}, gone as (select item_id, active_doc_id doc_id from items where source_type = 'epub' and active_doc_id is not null), dl as (select active_doc_id doc_id from items where active_doc_id is not null and active_doc_id not in (select doc_id from gone))"
    " select 'items' table_name, concat_ws('|', item_id, case when item_id in (select item_id from gone) then 'captured' else coalesce(state, '-') end, case when item_id in (select item_id from gone) then '-' else coalesce(active_doc_id, '-') end) as row from items"
    " union all select 'documents', doc_id from dl union all select 'chunks', concat_ws('|', chunk_id, coalesce(doc_id, '-')) from held where doc_id is null or doc_id not in (select doc_id from gone) union all select 'annotations', doc_id from dl",
    "purge_items": f"with {v.ITEMS}, {v.ALIASES}, {v.CHUNKS}, g as (select item_id, active_doc_id from items where source_type <> 'url') select 'items' table_name, concat_ws('|', item_id, coalesce(active_doc_id, '-'), coalesce(source_type, '-')) as row from items where item_id not in (select item_id from g)"
    " union all select 'aliases', concat_ws('|', item_id, alias_type) from aliases where item_id not in (select item_id from g)"
    " union all select 'chunks', concat_ws('|', chunk_id, coalesce(doc_id, '-')) from held where doc_id is null or doc_id not in (select active_doc_id from g where active_doc_id is not null)"
    " union all select 'rawdocs', concat_ws('|', coalesce(rawdoc_id, '-'), coalesce(item_id, '-')) from (select distinct rawdoc_id, item_id from rawdocs) where item_id is null or item_id not in (select item_id from g)",
    "clear_parsed": f"with {v.ITEMS} select 'items' table_name, concat_ws('|', item_id, 'captured', '-') as row from items",
    "annotated_items": f"with {v.ANNOTATIONS} select 'i' || c_custkey item_id, c_custkey doc_id, c_name title, 'https://x.example/i' || c_custkey url, count(*) annotations from annotations join customer on c_custkey = doc_id group by all",
    "collection_names": "select distinct trim(name) as name, trim(name) in (select trim(p_name) from part) taken from (select s_name as name from supplier union all select p_name from part) where trim(name) <> ''",
    "annotation_mirror": f"with {v.ANNOTATIONS} select doc_id, cast(count(*) as integer) as version, cast(2 + coalesce(sum(case when not orphaned then length('{{\"annotation_id\":,\"type\":\"\"}},') + length(cast(annotation_id as varchar)) + length(type) end), 1) - 1 as integer) chars from annotations group by 1",
    "item_badges": f"with {v.ITEMS} select item_id, case when state in ('parsed', 'stale', 'archived', 'active') then 'OK' else 'RAW' end badge from items",
    "page_titles": f"with {v.ITEMS} select item_id, case when page_title <> '' and page_title is distinct from title then page_title when normalized_url is not null and normalized_url is distinct from title then normalized_url else title end chosen from items",
    "error_status": "select rawdoc_id, cast(case when starts_with(upper(coalesce(content_type, '')), 'HTML') then 400 else 500 end as integer) status from (select distinct rawdoc_id, content_type from rawdocs)",
    "content_sizes": "select rawdoc_id, case when content_length * 512 % 1048576 = 0 then cast(content_length * 512 // 1048576 as varchar) || ' MiB' else cast(content_length * 512 as varchar) || ' bytes' end size from (select distinct rawdoc_id, content_length from rawdocs)",
    "summary_headings": "with h as (select distinct doc_id, section_id from document_sections where type = 'heading' and section_id is not null), w as (select distinct doc_id, section_id from document_sections where section_id is not null and section_index < 3) select w.doc_id, w.section_id, h.doc_id is not null as valid from w left join h on h.doc_id = w.doc_id and h.section_id = w.section_id",
    "parsed_impact": f"with {v.ITEMS}, {v.CHUNKS} select count(*) filter (where active_doc_id is not null) items, count(*) filter (where active_doc_id is not null and source_type = 'url') web_items, (select count(*) from (select distinct active_doc_id, item_id from items where active_doc_id is not null)) + (select count(*) from held) as rows, count(*) filter (where active_doc_id is not null) collection_refs from items",
}
