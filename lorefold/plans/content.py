"""Queries on addresses, sections, chunks and Markdown."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lorefold.functions import text as tx
from lorefold.functions import urls as u
from lorefold.operators import markdown as md
from lorefold.operators import sections as sec
from lorefold.operators import store
from lorefold.plans import views as v
from lorefold.session import table as t

_WS = tx.WHITE.replace("\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000", r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
_FROM, _TO = tx._TO_SPACE + tx._DROPPED, " " * len(tx._TO_SPACE)


def _sanitize_sql(x: str) -> str:
    return f"translate({x}, '{_FROM}', '{_TO}')"


def _block_sql(x: str) -> str:
    y = f"regexp_replace(regexp_replace({_sanitize_sql(x)}, E'\\r\\n', E'\\n', 'g'), '\\n{{3,}}', E'\\n\\n', 'g')"
    return f"regexp_replace({y}, '^{_WS}+|{_WS}+$', '', 'g')"


_NORM = (
    "case when url like 'file://%' then url else regexp_extract(url, '^([^?#]*)', 1) || coalesce('?' || nullif(array_to_string(list_transform(list_sort(list_filter(list_transform("
    "list_filter(string_split(regexp_extract(regexp_extract(url, '^([^#]*)', 1), '\\?(.*)$', 1), '&'), lambda p: p <> ''),"
    " lambda p, i: {'k': regexp_extract(p, '^([^=]*)', 1), 'i': i, 'p': case when contains(p, '=') then p else p || '=' end}),"
    " lambda x: not (starts_with(x.k, 'utm_') or x.k in ('fbclid', 'gclid', 'igshid')))), lambda x: x.p), '&'), ''), '') end"
)
_PATH = (
    "lv as (select *, case when type = 'heading' then nullif(" + _block_sql("coalesce(content, '')") + ", '') end h from sections),"
    " ll as (select *, case when h is not null then greatest(1, least(6, coalesce(level, 1))) end l from lv),"
    " slots as (select *, "
    + ", ".join(
        f"max(case when l = {i} then idx end) over w o{i}, arg_max(h, idx) filter (where l = {i}) over w t{i}, max(case when l < {i} then idx end) over w q{i}" for i in range(1, 7)
    )
    + ", arg_max(l, idx) filter (where l is not null) over w depth, count(case when type = 'heading' then 1 end) over w run from ll window w as (partition by doc_id order by idx rows between unbounded preceding and current row)),"
    " pathed as (select doc_id, idx, type, level, content, run, case when depth is not null then array_to_string(list_value("
    + ", ".join(f"case when o{i} > coalesce(q{i}, -1) then t{i} else '' end" for i in range(1, 7))
    + ")[1:depth], ' > ') end as path from slots)"
)
_HEADS = "heads as (select doc_id, idx, coalesce(level, {default}) lvl from sections where type = 'heading')"


def _url_rows(s, d):  # noqa: ANN001, ANN202
    return t(s, d, "knowledge_items").select(F.col("original_url").alias("url")).where("url is not null").distinct()


def _batch_rows(s, d):  # noqa: ANN001, ANN202
    """The items' addresses of each host as a batch: order by creation."""
    return v.items(s, d).where("original_url is not null").select("item_id", u.origin(F.col("original_url")).alias("job"), F.col("normalized_url").alias("url"), "created_at")


def _discover(s, d):  # noqa: ANN001, ANN202
    rows = _batch_rows(s, d)
    at = F.struct("created_at", "item_id")
    start = rows.where("url is not null").groupBy("job").agg(F.min_by(u.default_path_prefix(F.col("url")), at).alias("prefix"))
    unique = rows.groupBy("job", "url").agg(F.min(at).alias("first"))
    # the limit is applied in each map task before the shuffle, so that a large host sends few rows
    ranked = unique.withColumn("rank", F.row_number().over(W.partitionBy("job").orderBy("first"))).where("rank <= 50").join(start, "job", "left")
    return ranked.groupBy("job").agg(F.count("*").alias("discovered"), F.count_if(F.startswith(u.path_of(F.col("url")), F.col("prefix"))).alias("selected"))


def _dedupe_order(s, d):  # noqa: ANN001, ANN202
    unique = store.first_by(_batch_rows(s, d), ["job", "url"], ["created_at", "item_id"])
    return unique.select("job", "item_id", (F.row_number().over(W.partitionBy("job").orderBy("created_at", "item_id")) - 1).alias("order_index"))


QUERIES = {
    "url_normalize": lambda s, d: _url_rows(s, d).select("url", u.normalize_url(F.col("url")).alias("normalized")),
    "url_identity": lambda s, d: _url_rows(s, d).select("url", F.concat(F.lit("url:sha256:"), u.url_hash(u.normalize_url(F.col("url")))).alias("item_id")),
    "url_parts": lambda s, d: v.items(s, d).where("normalized_url is not null").select("item_id", u.host_with_port(F.col("normalized_url")).alias("host"), u.hostname_title(F.col("normalized_url")).alias("host_title"), u.default_path_prefix(F.col("normalized_url")).alias("prefix")),
    "url_alias_probe": lambda s, d: store.probe_urls(_url_rows(s, d).withColumn("normalized", u.normalize_url(F.col("url"))), v.aliases(s, d)),
    "batch_discover": _discover,
    "batch_dedupe_order": _dedupe_order,
    "section_ids": lambda s, d: sec.section_ids(v.sections(s, d)).select("doc_id", "idx", "section_id"),
    "sections_dedupe_adjacent": lambda s, d: sec.drop_adjacent_repeats(v.sections(s, d)).select("doc_id", "idx", "type"),
    "section_stats": lambda s, d: sec.document_statistics(v.sections(s, d)),
    "heading_path": lambda s, d: sec.heading_paths(v.sections(s, d)).select("doc_id", "idx", "path", "run"),
    "heading_parents": lambda s, d: sec.heading_parents(v.sections(s, d)),
    "heading_scopes": lambda s, d: sec.heading_scopes(v.sections(s, d)),
    "heading_cascade": lambda s, d: sec.cascade(v.sections(s, d)),
    "scope_text": lambda s, d: sec.scope_texts(v.sections(s, d)).select("doc_id", "idx", "sections", F.sha2("text", 256).alias("text_hash")),
    "summary_parts": lambda s, d: sec.summary_parts(t(s, d, "documents").select("doc_id", F.lit(0).alias("idx"), "text").where("text is not null")).select("doc_id", "part", F.length("text").alias("chars"), F.sha2("text", 256).alias("text_hash")),
    "chunk_fold": lambda s, d: sec.fold_chunks(v.sections(s, d), v.titles(s, d)).select("doc_id", "chunk_index", "heading_path", "parts", "char_count", "token_estimate", "content_hash"),
    "markdown_render": lambda s, d: md.render_sections(sec.section_ids(v.sections(s, d))).select("doc_id", F.sha2("markdown", 256).alias("markdown_hash")),
    "text_normalize": lambda s, d: v.sections(s, d).where("content is not null").select("doc_id", "idx", F.sha2(tx.normalize_inline(F.col("content")), 256).alias("inline_hash"), F.sha2(tx.normalize_block(F.col("content")), 256).alias("block_hash"), tx.estimate_tokens(F.col("content")).alias("tokens")),
    "heading_slugs": lambda s, d: v.sections(s, d).where("type = 'heading' and content is not null").select("doc_id", "idx", tx.slug(F.col("content"), F.col("idx")).alias("slug")),
}

_BATCH = f"with {v.ITEMS}, b as (select item_id, lower(regexp_extract(original_url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) job, normalized_url url, created_at from items where original_url is not null)"
_RAW_PATH = "regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_PATH_OF = "case when " + _RAW_PATH + " = '' then '/' else " + _RAW_PATH + " end"
_IDS = "ided as (select *, case when n > 0 then base || '-' || n else base end section_id from (select *, row_number() over (partition by doc_id, base order by idx) - 1 n from (select *, 's-' || substr(sha256(case when type = 'heading' then 'heading:' || coalesce(level, 0) || ':' || coalesce(content, '') when type in ('paragraph', 'blockquote', 'code') then type || ':' || coalesce(content, '') when type = 'figure' then 'figure:' || coalesce(content, '') || ':' else type || ':' end), 1, 10) base from sections)))"

ORACLE = {
    "url_normalize": f"select url, {_NORM} normalized from (select distinct original_url url from knowledge_items where original_url is not null)",
    "url_identity": f"select url, 'url:sha256:' || substr(sha256({_NORM}), 1, 16) item_id from (select distinct original_url url from knowledge_items where original_url is not null)",
    "url_parts": f"with {v.ITEMS} select item_id, lower(regexp_extract(normalized_url, '://([^/?#]+)', 1)) host, lower(regexp_extract(normalized_url, '://([^/?#:]+)', 1)) host_title, regexp_replace({_PATH_OF.format(x='normalized_url')}, '[^/]*$', '') as prefix from items where normalized_url is not null",
    "url_alias_probe": f"with {v.ITEMS}, {v.ALIASES}, q as (select url, {_NORM} n from (select distinct original_url url from knowledge_items where original_url is not null)),"
    " p as (select url, 1 priority, 'normalized_url' k, n val from q union all select url, 2, 'canonical_url', n from q union all select url, 3, 'canonical_url', url from q union all select url, 4, 'original_url', n from q union all select url, 5, 'original_url', url from q),"
    " r as (select url, item_id, priority, row_number() over (partition by url order by priority, item_id) rn from p join aliases a on a.alias_type = p.k and a.alias_value = p.val) select url, item_id, priority from r where rn = 1",
    "batch_discover": _BATCH + f", p as (select *, row_number() over (partition by job order by created_at, item_id) pos from b), f as (select *, first_value(regexp_replace({_PATH_OF.format(x='url')}, '[^/]*$', '') ignore nulls) over (partition by job order by pos rows between unbounded preceding and unbounded following) pre from p),"
    f" x as (select *, row_number() over (partition by job, url order by pos) rn from f), y as (select *, row_number() over (partition by job order by pos) rk from x where rn = 1) select job, count(*) discovered, count(*) filter (where starts_with({_PATH_OF.format(x='url')}, pre)) selected from y where rk <= 50 group by job",
    "batch_dedupe_order": _BATCH + ", x as (select *, row_number() over (partition by job, url order by created_at, item_id) rn from b) select job, item_id, cast(row_number() over (partition by job order by created_at, item_id) - 1 as integer) order_index from x where rn = 1",
    "section_ids": f"with {v.SECTIONS}, {_IDS} select doc_id, idx, section_id from ided",
    "sections_dedupe_adjacent": f"with {v.SECTIONS}, l as (select *, lag(type) over w pt, lag(content) over w pc from sections window w as (partition by doc_id order by idx)) select doc_id, idx, type from l where not coalesce(pt = type and pc = content and content <> '', false)",
    "section_stats": f"with {v.SECTIONS} select doc_id, count(*) sections, " + ", ".join(f"count(*) filter (where type = '{k}') {k}s" for k in ("heading", "paragraph", "blockquote", "list", "table", "figure", "code")) + ", coalesce(cast(sum(length(content)) as bigint), 0) chars from sections group by doc_id",
    "heading_path": f"with {v.SECTIONS}, {_PATH} select doc_id, idx, path, run from pathed",
    "heading_parents": f"with {v.SECTIONS}, " + _HEADS.format(default=1) + " select h.doc_id, h.idx, h.lvl as level, max(g.idx) parent_idx from heads h left join heads g on g.doc_id = h.doc_id and g.idx < h.idx and g.lvl < h.lvl group by 1, 2, 3",
    "heading_scopes": f"with {v.SECTIONS}, " + _HEADS.format(default=0) + ' select h.doc_id, h.idx, h.lvl as level, min(g.idx) "end" from heads h left join heads g on g.doc_id = h.doc_id and g.idx > h.idx and g.lvl <= h.lvl group by 1, 2, 3',
    "heading_cascade": f"with {v.SECTIONS}, " + _HEADS.format(default=1) + ", e as (select h.doc_id, h.idx, h.lvl, min(g.idx) stop from heads h left join heads g on g.doc_id = h.doc_id and g.idx > h.idx and g.lvl <= h.lvl group by 1, 2, 3),"
    " dn as (select e.doc_id, e.idx, cast(count(g.idx) as integer) descendants from e left join heads g on g.doc_id = e.doc_id and g.idx > e.idx and (e.stop is null or g.idx < e.stop) group by 1, 2),"
    " an as (select h.doc_id, h.idx, cast(count(g.idx) as integer) ancestors from heads h left join heads g on g.doc_id = h.doc_id and g.idx < h.idx and g.lvl < h.lvl and not exists (select 1 from heads m where m.doc_id = h.doc_id and m.idx > g.idx and m.idx < h.idx and m.lvl <= g.lvl) group by 1, 2)"
    " select dn.doc_id, dn.idx, descendants, ancestors from dn join an on an.doc_id = dn.doc_id and an.idx = dn.idx",
    "scope_text": f"with {v.SECTIONS}, " + _HEADS.format(default=0) + ", e as (select h.doc_id, h.idx, min(g.idx) stop from heads h left join heads g on g.doc_id = h.doc_id and g.idx > h.idx and g.lvl <= h.lvl group by 1, 2)"
    " select e.doc_id, e.idx, count(*) sections, sha256(coalesce(string_agg(nullif(s.content, ''), E'\\n\\n' order by s.idx), '')) text_hash from e join sections s on s.doc_id = e.doc_id and s.idx >= e.idx and (e.stop is null or s.idx < e.stop) group by 1, 2",
    "summary_parts": "with p as (select doc_id, text, case when length(text) > 8000 then range(0, length(text), 5500) else [0] end st from documents where text is not null), q as (select doc_id, text, unnest(st) a, generate_subscripts(st, 1) - 1 part from p),"
    " r as (select doc_id, cast(part as integer) part, case when length(text) > 8000 then substr(text, a + 1, 6000) else text end x from q) select doc_id, part, cast(length(x) as integer) chars, sha256(x) text_hash from r",
    "chunk_fold": f"with recursive {v.ITEMS}, {v.SECTIONS}, {_PATH},"
    " tt as (select active_doc_id doc_id, title, normalized_url url from items where active_doc_id is not null),"
    " parts as (select p.doc_id, run, idx, path, " + _block_sql("concat_ws(E'\\n', 'Title: ' || coalesce(title, ''), case when coalesce(url, '') <> '' then 'Source: ' || coalesce(lower(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)', 1), '')), url) end, case when coalesce(path, '') <> '' then 'Section: ' || path end, nullif(content, ''))") + " part,"
    " row_number() over (partition by p.doc_id, run order by idx) k from pathed p join tt on tt.doc_id = p.doc_id where type <> 'heading' and " + _block_sql("coalesce(content, '')") + " <> ''),"
    " f(doc_id, run, k, chunk, size) as (select doc_id, run, k, 0, length(part) from parts where k = 1"
    " union all select p.doc_id, p.run, p.k, case when f.size >= 1400 then f.chunk + 1 else f.chunk end, case when f.size >= 1400 then length(part) else f.size + 2 + length(part) end from f join parts p on p.doc_id = f.doc_id and p.run = f.run and p.k = f.k + 1),"
    " g as (select p.doc_id, p.run, f.chunk, min(p.idx) first_idx, arg_min(coalesce(p.path, chr(1)), p.idx) path, count(*) parts, " + _block_sql("string_agg(p.part, E'\\n\\n' order by p.idx)") + " txt from parts p join f on f.doc_id = p.doc_id and f.run = p.run and f.k = p.k group by 1, 2, 3)"
    " select doc_id, cast(row_number() over (partition by doc_id order by first_idx) - 1 as integer) chunk_index, nullif(path, chr(1)) heading_path, cast(parts as integer) parts, cast(length(txt) as integer) char_count, cast(greatest(1, ceil(length(txt) / 4.0)) as integer) token_estimate, sha256(txt) content_hash from g",
    "markdown_render": f"with {v.SECTIONS}, {_IDS}, l as (select doc_id, idx, '<!-- section_id:' || section_id || ' -->' || E'\\n' || case type when 'heading' then repeat('#', coalesce(level, 2)) || ' ' || coalesce(content, '') || E'\\n' when 'paragraph' then coalesce(content, '') || E'\\n'"
    " when 'blockquote' then case when coalesce(content, '') = '' then '' else regexp_replace('> ' || content, E'\\r?\\n', E'\\n> ', 'g') || E'\\n' end when 'list' then '' when 'code' then '```' || E'\\n' || coalesce(content, '') || E'\\n```\\n' when 'figure' then case when coalesce(content, '') = '' then '' else content || E'\\n' end else case when coalesce(content, '') = '' then null else content end end txt,"
    " '<!-- section_id:' || section_id || ' -->' anchor, type, content from ided)"
    " select doc_id, sha256(string_agg(case when type = 'blockquote' and coalesce(content, '') = '' then anchor else coalesce(txt, anchor) end, E'\\n' order by idx)) markdown_hash from l group by doc_id",
    "text_normalize": f"with {v.SECTIONS} select doc_id, idx, sha256(trim(regexp_replace({_sanitize_sql('content')}, '{_WS}+', ' ', 'g'))) inline_hash, sha256({_block_sql('content')}) block_hash, cast(greatest(1, ceil(length(content) / 4.0)) as integer) tokens from sections where content is not null",
    "heading_slugs": f"with {v.SECTIONS}, b as (select doc_id, idx, substr(regexp_replace(regexp_replace(lower(trim(content)), '[^a-z0-9一-龥]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 64) x from sections where type = 'heading' and content is not null) select doc_id, idx, case when x = '' then 'section' else x end || '-' || idx slug from b",
}
