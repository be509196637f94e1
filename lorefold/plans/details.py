"""Queries on the smaller projections, states and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lorefold.functions import text as tx
from lorefold.functions import urls as u
from lorefold.operators import imports
from lorefold.operators import search as se
from lorefold.operators import sections as sec
from lorefold.operators import summaries as su
from lorefold.operators.latest import holding_rows
from lorefold.plans import views as v
from lorefold.session import table as t
from lorefold.sources import epub, files


def _urls(s, d):  # noqa: ANN001, ANN202
    return t(s, d, "rawdocs").where("source_uri is not null").select(F.col("source_uri").alias("url")).distinct()


def _kind(s, d):  # noqa: ANN001, ANN202
    """Annotations with the columns that their kind uses."""
    a = v.annotations(s, d)
    used = lambda *kinds: F.col("type").isin(*kinds)
    return a.select("annotation_id", "type", F.when(used("highlight", "note"), F.concat(F.lit("ref-"), F.col("annotation_id").cast("string"))).alias("text_ref"), F.when(used("note", "summary"), F.lit("text")).alias("note"), F.when(used("highlight"), F.lit("amber")).alias("color"), F.when(used("tag", "bookmark"), F.lit("label")).alias("label"))


def _jobs(s, d):  # noqa: ANN001, ANN202
    """(job, state, started, finished) of the transitions of each job's items."""
    rows = v.transitions(s, d)
    latest = rows.groupBy("job", "item").agg(F.max(F.struct("ts", "event_id", "state"))["state"].alias("state"))
    state = F.when(F.count_if(F.col("state").isin("pending", "fetching", "parsing", "saving")) > 0, "running").when(F.count_if(F.col("state") == "failed") == F.count("*"), "failed").otherwise("succeeded")
    return latest.groupBy("job").agg(state.alias("state"), F.count("*").alias("items"))


def _list_entries(s, d):  # noqa: ANN001, ANN202
    """The reader's list: items and collections in one, the last updated first; a date that cannot be read is 1970."""
    items = v.items(s, d).select(F.lit("document").alias("kind"), F.col("item_id").alias("id"), F.unix_micros("updated_at").alias("updated_us"))
    shelves = t(s, d, "orders").select(F.lit("collection").alias("kind"), F.col("o_orderkey").cast("string").alias("id"), F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', o_orderdate)").alias("updated_us"))
    return items.unionByName(shelves).select("kind", "id", F.coalesce("updated_us", F.lit(0)).alias("updated_us"))


def _children(s, d):  # noqa: ANN001, ANN202
    """(doc_id, idx, children): headings inside each heading's scope."""
    rows = v.sections(s, d)
    return sec.cascade(rows).select("doc_id", "idx", F.col("descendants").alias("children"))


QUERIES = {
    "annotation_kinds": _kind,
    "annotation_type_counts": lambda s, d: v.annotations(s, d).groupBy("type").agg(F.count("*").alias("n"), F.count_if("orphaned").alias("orphaned")),
    "annotations_of_documents": lambda s, d: v.annotations(s, d).where("not orphaned").select("doc_id", "annotation_id", F.row_number().over(W.partitionBy("doc_id").orderBy("created_at", "annotation_id")).alias("n")),
    "annotation_titles": lambda s, d: v.annotations(s, d).groupBy("doc_id").agg(F.count("*").alias("annotations")).join(t(s, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("title")), "doc_id", "left"),
    "batch_pending": lambda s, d: v.transitions(s, d).groupBy("job", "item").agg(F.max(F.struct("ts", "event_id", "state"))["state"].alias("state"), F.min("event_id").alias("created")).where("state = 'pending'").select("job", "item", "created"),
    "batch_jobs": _jobs,
    "chunk_estimates": lambda s, d: t(s, d, "chunks").where("text is not null").select("chunk_id", "text").distinct().select("chunk_id", F.length("text").alias("chars"), tx.estimate_tokens(F.col("text")).alias("tokens"), F.sha2("text", 256).alias("hash")),
    "heading_children": _children,
    "heading_order": lambda s, d: v.sections(s, d).where("type = 'heading'").select("doc_id", "idx", F.row_number().over(W.partitionBy("doc_id").orderBy(F.coalesce("level", F.lit(0)).desc(), "idx")).alias("rank")),
    "html_head": lambda s, d: holding_rows(t(s, d, "page_snapshots").where("html is not null"), ["rawdoc_id"], "captured_at", ["html"]).select("rawdoc_id", *[c.alias(k) for k, c in imports.head_metadata(F.col("html")).items()]),
    "html_accepted": lambda s, d: files.accept_snapshots(holding_rows(t(s, d, "page_snapshots"), ["rawdoc_id"], "captured_at", ["page_url", "html"])).select("rawdoc_id", "error_code"),
    "item_states": lambda s, d: v.items(s, d).groupBy("source_type", "state").agg(F.count("*").alias("n"), F.count("normalized_url").alias("with_url")),
    "item_tags": lambda s, d: t(s, d, "knowledge_items").select(F.explode("tags").alias("tag"), "item_id").distinct().groupBy("tag").agg(F.count("*").alias("items")),
    "language_codes": lambda s, d: t(s, d, "documents").select("lang").distinct().select("lang", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in sorted(epub.LANGUAGES.items()) for x in p]), F.lower(F.trim("lang"))), F.nullif(F.lower(F.trim("lang")), F.lit(""))).alias("code")),
    "latest_captures": lambda s, d: files.latest_capture(t(s, d, "rawdocs")).select("item_id", "rawdoc_id"),
    "library_list": _list_entries,
    "query_tokens": lambda s, d: t(s, d, "eval_items").select("eval_id", F.array_join(F.filter(F.split(F.trim("question"), r"\s+"), lambda x: x != ""), "|").alias("tokens"), F.array_join(se.trace_terms(F.col("question")), "|").alias("terms")),
    "snippets": lambda s, d: v.chunks(s, d).select("chunk_id", F.substring("text", 1, 300).alias("snippet")),
    "source_kinds": lambda s, d: _urls(s, d).select("url", u.is_file_url(F.col("url")).alias("is_file"), F.lower(F.regexp_extract("url", r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1)).alias("extension"), u.path_of(F.col("url")).alias("path")),
    "task_progress": lambda s, d: su.task_progress(v.transitions(s, d).groupBy("job", "item").agg(F.max(F.struct("ts", "event_id", "state"))["state"].alias("s")).select(F.when(F.col("s") == "saved", "completed").when(F.col("s") == "failed", "failed").when(F.col("s") == "pending", "pending").otherwise("skipped").alias("state"))),
    "url_below": lambda s, d: v.items(s, d).where("normalized_url is not null").select("normalized_url", u.origin(F.col("normalized_url")).alias("site")).where(se.url_matches(F.col("normalized_url"), F.col("site"))).groupBy("site").agg(F.count("*").alias("pages")),
    "url_schemes": lambda s, d: _urls(s, d).groupBy(F.lower(F.regexp_extract("url", "^([A-Za-z][A-Za-z0-9+.-]*):", 1)).alias("scheme")).agg(F.count("*").alias("urls")),
    "words_of_sections": lambda s, d: v.sections(s, d).where("content is not null").select("type", F.size(se.tokens(F.col("content"))).alias("n")).groupBy("type").agg(F.count("*").alias("sections"), F.sum("n").alias("words")),
}

_TOK = "regexp_extract_all(translate(lower(coalesce({x}, '')), '" + se.MARKED + "', '" + se.PLAIN + "'), '[\\p{{L}}\\p{{N}}]+')"
_LATEST = f"{v.TRANSITIONS}, latest as (select job, item, arg_max(state, (ts, event_id)) state, min(event_id) created from transitions group by 1, 2)"
_HEADS = f"{v.SECTIONS}, heads as (select doc_id, idx, coalesce(level, 1) lvl from sections where type = 'heading')"
_URL = "(select distinct source_uri url from rawdocs where source_uri is not null)"
_PATH = "case when regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' then '/' else regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) end"
_STOP = ", ".join(f"'{w}'" for w in se.STOP_WORDS)

ORACLE = {
    "annotation_kinds": f"with {v.ANNOTATIONS} select annotation_id, type, case when type in ('highlight', 'note') then 'ref-' || annotation_id end text_ref, case when type in ('note', 'summary') then 'text' end note, case when type = 'highlight' then 'amber' end color, case when type in ('tag', 'bookmark') then 'label' end as label from annotations",
    "annotation_type_counts": f"with {v.ANNOTATIONS} select type, count(*) n, count(*) filter (where orphaned) orphaned from annotations group by 1",
    "annotations_of_documents": f"with {v.ANNOTATIONS} select doc_id, annotation_id, cast(row_number() over (partition by doc_id order by created_at, annotation_id) as integer) n from annotations where not orphaned",
    "annotation_titles": f"with {v.ANNOTATIONS} select doc_id, count(*) annotations, any_value(c_name) title from annotations left join customer on c_custkey = doc_id group by 1",
    "batch_pending": f"with {_LATEST} select job, item, created from latest where state = 'pending'",
    "batch_jobs": f"with {_LATEST} select job, case when count(*) filter (where state in ('pending', 'fetching', 'parsing', 'saving')) > 0 then 'running' when count(*) filter (where state = 'failed') = count(*) then 'failed' else 'succeeded' end as state, count(*) items from latest group by 1",
    "chunk_estimates": "select distinct chunk_id, cast(length(text) as integer) chars, cast(greatest(1, ceil(length(text) / 4.0)) as integer) tokens, sha256(text) hash from chunks where text is not null",
    "heading_children": f"with {_HEADS}, e as (select h.doc_id, h.idx, min(g.idx) stop from heads h left join heads g on g.doc_id = h.doc_id and g.idx > h.idx and g.lvl <= h.lvl group by 1, 2) select e.doc_id, e.idx, cast(count(g.idx) as integer) children from e left join heads g on g.doc_id = e.doc_id and g.idx > e.idx and (e.stop is null or g.idx < e.stop) group by 1, 2",
    "heading_order": f"with {v.SECTIONS} select doc_id, idx, cast(row_number() over (partition by doc_id order by coalesce(level, 0) desc, idx) as integer) as rank from sections where type = 'heading'",
    "html_accepted": "select rawdoc_id, case when octet_length(encode(any_value(html))) > 10485760 then 'html_too_large' end error_code from page_snapshots group by 1",
    "item_states": f"with {v.ITEMS} select source_type, state, count(*) n, count(normalized_url) with_url from items group by 1, 2",
    "item_tags": "select tag, count(distinct item_id) items from (select unnest(tags) tag, item_id from knowledge_items) group by 1",
    "language_codes": "select lang, case lower(trim(lang)) " + " ".join(f"when '{a}' then '{b}'" for a, b in sorted(epub.LANGUAGES.items())) + " else nullif(lower(trim(lang)), '') end code from (select distinct lang from documents)",
    "latest_captures": "select item_id, rawdoc_id from (select item_id, rawdoc_id, row_number() over (partition by item_id order by created_at desc, rawdoc_id) rn from (select distinct item_id, rawdoc_id, created_at from rawdocs)) where rn = 1",
    "library_list": f"with {v.ITEMS} select 'document' kind, item_id id, coalesce(epoch_us(updated_at), 0) updated_us from items union all select 'collection', cast(o_orderkey as varchar), coalesce(epoch_us(o_orderdate), 0) from orders",
    "query_tokens": f"select eval_id, array_to_string(list_filter(regexp_split_to_array(trim(question), '\\s+'), lambda x: x <> ''), '|') tokens, (select coalesce(string_agg(w, '|' order by p), '') from (select w, min(p) p from (select unnest(ts) w, generate_subscripts(ts, 1) p from (select list_filter(list_transform(regexp_extract_all(question, '[A-Za-z][A-Za-z0-9_.-]*|[0-9]+'), lambda x: lower(x)), lambda x: x not in ({_STOP})) ts)) group by w)) terms from eval_items",
    "snippets": f"with {v.CHUNKS} select chunk_id, substr(text, 1, 300) snippet from held",
    "source_kinds": f"select url, starts_with(url, 'file://') is_file, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)(?:[?#].*)?$', 1)) extension, {_PATH.format(x='url')} as path from {_URL}",
    "task_progress": f"with {_LATEST} select count(*) filter (where state = 'pending') pending, count(*) filter (where state = 'saved') completed, count(*) filter (where state = 'failed') failed, count(*) filter (where state not in ('pending', 'saved', 'failed')) skipped, count(*) total from latest",
    "url_below": f"with {v.ITEMS}, x as (select normalized_url n, lower(regexp_extract(normalized_url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) site from items where normalized_url is not null) select site, count(*) pages from x where n = site or starts_with(n, site || '/') group by 1",
    "url_schemes": f"select lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) scheme, count(*) urls from {_URL} group by 1",
    "words_of_sections": f"with {v.SECTIONS} select type, count(*) sections, cast(sum(len({_TOK.format(x='content')})) as bigint) words from sections where content is not null group by 1",
}
