"""Queries on retrieval, the store, collections, annotations, batches and imports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorefold.functions import urls as u
from lorefold.operators import library as lib
from lorefold.operators import search as se
from lorefold.operators import store
from lorefold.operators.index import SearchIndex
from lorefold.operators.latest import holding_rows
from lorefold.plans import views as v
from lorefold.session import files_mark, shared_folder
from lorefold.session import table as t

_TOKENS = "regexp_extract_all(translate(lower(coalesce({x}, '')), '" + se.MARKED + "', '" + se.PLAIN + "'), '[\\p{{L}}\\p{{N}}]+')"


def _docs(s, d):  # noqa: ANN001, ANN202
    return t(s, d, "documents").select("doc_id", "title", "text", "source")


def _postings(s, d):  # noqa: ANN001, ANN202
    return se.postings(_docs(s, d), "doc_id", "title", "text")


def _queries(s, d):  # noqa: ANN001, ANN202
    return t(s, d, "eval_items").select("eval_id", F.concat_ws(" ", "question", "answer").alias("query"), "passage")


def _index(s, d):  # noqa: ANN001, ANN202
    """The index of the documents, kept in the shared folder under what tells their files apart; built if it
    is not there."""
    docs = _docs(s, d)
    index = SearchIndex(s, f"{shared_folder(s).rstrip('/')}/index-{files_mark(docs)}")
    if not index.segments():
        index.add(docs, "doc_id", "title", "text")
    return index


def _scores(s, d):  # noqa: ANN001, ANN202
    return _index(s, d).scores(se.query_terms(_queries(s, d), "eval_id", "query"))


def _search(s, d, query):  # noqa: ANN001, ANN202
    return _index(s, d).scores(se.query_terms(s.range(1).select(F.lit(0).alias("query_id"), F.lit(query).alias("q")), "query_id", "q"))


def _hits(s, d, limit=10):  # noqa: ANN001, ANN202
    return se.top_hits(_scores(s, d), limit)


def _ranked(s, d):  # noqa: ANN001, ANN202
    docs = _docs(s, d).select(F.col("doc_id").alias("key"), F.coalesce("title", F.lit("Untitled")).alias("display_title"), F.col("source").alias("source_url"), "text")
    return _hits(s, d).join(docs, "key")


def _trace(s, d):  # noqa: ANN001, ANN202
    q = _queries(s, d).select(F.col("eval_id").alias("query_id"), "query")
    docs = _docs(s, d).select(F.col("doc_id").alias("key"), "title", "text", F.lit("").alias("heading"))
    rows = _hits(s, d).join(docs, "key").join(q, "query_id")
    return se.search_trace(rows, "query", "title", "heading", "text").select("query_id", "rank", "matched_terms", F.round("term_coverage", 6).alias("term_coverage"), "title_matches", "phrase_matched")


def _evaluate(s, d):  # noqa: ANN001, ANN202
    """A document is expected for an item if it holds the passage word for word."""
    docs = _docs(s, d).select(F.col("doc_id").alias("key"), se.tokens(F.col("text")).alias("ws"))
    items = _queries(s, d).select(F.col("eval_id").alias("query_id"), se.tokens(F.col("passage")).alias("pw")).where(F.size("pw") > 0)
    # hashes of openings only find candidates, before anything is shuffled
    openings = items.select("query_id", F.least(F.size("pw"), F.lit(8)).alias("n"), F.xxhash64(F.slice("pw", 1, 8)).alias("opening"))
    sizes = sorted(r["n"] for r in openings.select("n").distinct().collect())  # eight at most
    none = F.array().cast("array<bigint>")
    runs = lambda n: F.when(F.size("ws") >= n, F.transform(F.sequence(F.lit(1), F.size("ws") - n + 1), lambda i: F.xxhash64(F.slice("ws", i, n)))).otherwise(none)
    grams = F.flatten(F.array(none, *[runs(n) for n in sizes]))
    candidates = docs.select("key", F.explode(grams).alias("opening")).join(openings.select("query_id", "opening"), "opening").select("query_id", "key").distinct()
    line = lambda words: F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    lines = candidates.join(items.select("query_id", line("pw").alias("passage")), "query_id").join(docs.select("key", line("ws").alias("line")), "key")
    expected = lines.where(F.contains("line", F.col("passage"))).select("query_id", "key")
    return se.evaluate(_hits(s, d), expected)


def _new_generation(s, d):  # noqa: ANN001, ANN202
    old = t(s, d, "knowledge_items").where("state = 'captured'").select("item_id", "title", "state", "created_at", "updated_at")
    new = t(s, d, "knowledge_items").where("state = 'parsed'").select("item_id", "title", "state", "created_at", "updated_at")
    return old, new


def _upsert(s, d):  # noqa: ANN001, ANN202
    old, new = _new_generation(s, d)
    return store.upsert(store.first_by(old, ["item_id"], ["updated_at", "title"]), new, ["item_id"], keep=["created_at"], order="updated_at").select("item_id", "title", "state")


def _replace(s, d):  # noqa: ANN001, ANN202
    held = v.chunks(s, d).select("chunk_id", "doc_id", "chunk_index")
    rebuilt = held.where("chunk_index = 1").select(F.concat("doc_id", F.lit(":new")).alias("chunk_id"), "doc_id", (F.col("chunk_index") - 1).alias("chunk_index"))
    return store.replace_children(held, rebuilt, "doc_id")


def _latest(s, d):  # noqa: ANN001, ANN202
    return store.latest_states(v.transitions(s, d), "item", ["ts", "event_id"])


def _job_items(s, d):  # noqa: ANN001, ANN202
    rows = v.transitions(s, d)
    return store.latest_states(rows.withColumn("job_item", F.struct("job", "item")), "job_item", ["ts", "event_id"]).select("job_item.job", "job_item.item", "state", "attempts")


def _skip_existing(s, d):  # noqa: ANN001, ANN202
    wanted = t(s, d, "rawdocs").where("source_uri is not null").select(u.normalize_url(F.col("source_uri")).alias("url")).where("url is not null").distinct()
    have = v.items(s, d).where("state = 'parsed' and normalized_url is not null").select(F.col("normalized_url").alias("url")).distinct()
    return wanted.join(have.withColumn("there", F.lit(True)), "url", "left").groupBy(F.coalesce("there", F.lit(False)).alias("skipped")).agg(F.count("*").alias("urls"))


def _import_report(s, d):  # noqa: ANN001, ANN202
    rows = holding_rows(t(s, d, "rawdocs"), ["rawdoc_id"], "created_at", ["content_type", "content_length"])
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    state = F.when(kind == "", "failed").when(kind.contains("text/html") | kind.contains("application/xhtml+xml") | kind.contains("epub"), "imported").otherwise("skipped")
    return lib.import_report(rows.select(state.alias("state"), F.col("content_length").alias("bytes")))


def _scan(s, d):  # noqa: ANN001, ANN202
    names = ["knowledge_items", "rawdocs", "page_snapshots", "document_sections", "chunks", "knowledge_documents", "documents", "events"]
    return store.maintenance_scan({n: t(s, d, n) for n in names})


def _quality(s, d):  # noqa: ANN001, ANN202
    rows = v.sections(s, d).groupBy("doc_id").agg(F.count("*").alias("sections"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("chars"))
    score = lib.ingest_quality(F.col("chars") + 40 * F.col("sections"), F.col("chars"), F.col("sections"), F.lit(False), F.when(F.col("chars") < 120, 1).otherwise(0))
    return rows.select("doc_id", score.cast("int").alias("quality"))


def _members_of(s, d, condition):  # noqa: ANN001, ANN202
    chosen = t(s, d, "orders").where(condition).select(F.col("o_orderkey").alias("collection"))
    return v.members(s, d).join(chosen, "collection", "left_semi")


def _collections(s, d):  # noqa: ANN001, ANN202
    return t(s, d, "orders").select(F.col("o_orderkey").alias("collection"))


QUERIES = {
    "fts_corpus_stats": lambda s, d: se.corpus_statistics(_docs(s, d), "doc_id", "title", "text").select("n", F.round("avg_size", 6).alias("avg_size")),
    "fts_postings": lambda s, d: _postings(s, d).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf")),
    "bm25_batch": lambda s, d: _hits(s, d).select("query_id", "key", "rank", F.round("score", 6).alias("score")),
    "bm25_search": lambda s, d: se.top_hits(_search(s, d, "durable archive of the second edition"), 20).select("key", "rank", F.round("score", 6).alias("score")),
    "search_trace": _trace,
    "context_pack": lambda s, d: se.context_text(se.context_blocks(_ranked(s, d))).select("query_id", "citations", "used_chars", F.sha2("context", 256).alias("context_hash")),
    "retrieval_eval": lambda s, d: _evaluate(s, d).select("queries", *[F.round(c, 6).alias(c) for c in ("hit_at_1", "hit_at_3", "hit_at_5")]),
    "alias_pivot": lambda s, d: store.alias_pivot(v.aliases(s, d)).select("item_id", "normalized_url", "original_url", "canonical_url"),
    "item_list_recent": lambda s, d: v.items(s, d).withColumn("at", F.coalesce("parsed_at", "updated_at")).orderBy(F.col("at").desc(), "item_id").limit(50).select("item_id", "title", store.presented_state(F.col("state")).alias("state")),
    "item_status": lambda s, d: v.items(s, d).select("item_id", store.presented_state(F.col("state")).alias("state"), F.col("active_doc_id").isNotNull().alias("has_document"), F.col("active_rawdoc_id").isNotNull().alias("has_capture")),
    "item_view": lambda s, d: v.items(s, d).select("item_id", F.coalesce(F.nullif("page_title", F.lit("")), F.nullif("title", F.lit("")), u.hostname_title(F.col("normalized_url"))).alias("display_title"), F.coalesce("normalized_url", "canonical_url", "original_url", "item_id").alias("address")),
    "capture_reload": lambda s, d: v.items(s, d).select("item_id", F.col("active_rawdoc_id").alias("rawdoc_id")).join(t(s, d, "rawdocs").select("rawdoc_id", "source_uri").distinct(), "rawdoc_id").select("item_id", "rawdoc_id", "source_uri"),
    "collection_members": lambda s, d: lib.member_view(v.members(s, d), t(s, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"))),
    "collection_navigation": lambda s, d: lib.navigation(v.members(s, d)),
    "collection_counts": lambda s, d: lib.collection_counts(_collections(s, d), v.members(s, d)),
    "used_doc_ids": lambda s, d: lib.used_members(v.members(s, d)),
    "collections_by_doc": lambda s, d: lib.collections_of(v.members(s, d)),
    "standalone_items": lambda s, d: lib.standalone(t(s, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title")), _members_of(s, d, "o_orderstatus = 'F'")),
    "delete_plan": lambda s, d: lib.delete_plan(v.members(s, d).where("order_index = 7").select("member"), t(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("collection")), v.members(s, d), v.members(s, d).where("order_index = 6").select("member")),
    "annotation_rollup": lambda s, d: lib.annotation_rollup(v.annotations(s, d)),
    "annotation_types_map": lambda s, d: lib.annotation_types(v.annotations(s, d)),
    "annotation_top_types": lambda s, d: lib.top_types(v.annotations(s, d)),
    "annotation_timeline": lambda s, d: lib.timeline(v.annotations(s, d).where("not orphaned"), F.col("type") == "note").select("annotation_id", "doc_id", "rank"),
    "annotation_migrate": lambda s, d: lib.migrate_annotations(v.annotations(s, d), t(s, d, "customer").select(F.col("c_custkey").alias("old_doc"), (F.col("c_custkey") + 1_000_000).alias("new_doc"))).groupBy("doc_id").agg(F.count("*").alias("annotations")),
    "upsert_items": _upsert,
    "insert_missing": lambda s, d: (lambda g: store.insert_missing(store.first_by(g[0], ["item_id"], ["updated_at", "title"]).select("item_id", "state"), g[1].select("item_id", "state"), ["item_id"]))(_new_generation(s, d)),
    "replace_chunks": _replace,
    "batch_state_latest": _latest,
    "batch_counters": lambda s, d: store.job_counters(_job_items(s, d), "job"),
    "recover_stale": lambda s, d: store.recover_stale(_job_items(s, d)).select("job", "item", "state", "error_code"),
    "retry_failed": lambda s, d: store.retry_failed(_job_items(s, d)).groupBy("job", "state").agg(F.count("*").alias("items")),
    "pending_headings": lambda s, d: lib.pending_headings(t(s, d, "document_sections").where("type = 'heading'").select("section_id", F.lit("m").alias("model")).distinct(), t(s, d, "document_sections").where("type = 'heading' and level = 2").select("section_id", F.lit("m").alias("model"))).select("section_id"),
    "skip_existing": _skip_existing,
    "maintenance_scan": _scan,
    "import_report": _import_report,
    "library_overview": lambda s, d: lib.library_overview(v.items(s, d)),
    "ingest_quality": _quality,
}

_D = "docs as (select doc_id, list_concat(" + _TOKENS.format(x="title") + ", " + _TOKENS.format(x="text") + ") toks, title, text, source from documents)"
_POST = _D + ", post as (select doc_id, term, size, count(*) tf from (select doc_id, len(toks) size, unnest(toks) term from docs) group by 1, 2, 3), stats as (select count(*) n, avg(len(toks)) a from docs)"
_SCORES = (
    _POST + ", qt as (select eval_id query_id, term, count(*) w from (select eval_id, unnest(" + _TOKENS.format(x="concat_ws(' ', question, answer)") + ") term from eval_items) group by 1, 2),"
    " df as (select term, count(*) df from post group by 1),"
    " sc as (select q.query_id, p.doc_id \"key\", sum(q.w * greatest(ln((n - df + 0.5) / (df + 0.5)), case when ln((n - df + 0.5) / (df + 0.5)) > 0 then 0 else 1e-6 end) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / a))) score from qt q join df on df.term = q.term join post p on p.term = q.term, stats group by 1, 2),"
    " rk as (select *, row_number() over (partition by query_id order by round(score, 9) desc, \"key\") as rank from sc), hits as (select * from rk where rank <= 10)"
)
_STOP = ", ".join(f"'{w}'" for w in se.STOP_WORDS)
_JI = f"{v.TRANSITIONS}, latest as (select job, item, arg_max(state, (ts, event_id)) state, count(*) filter (where state = 'fetching') attempts from transitions group by 1, 2)"
_OLDNEW = (
    "old as (select * exclude (rn) from (select item_id, title, state, created_at, updated_at, row_number() over (partition by item_id order by updated_at, title) rn from knowledge_items where state = 'captured') where rn = 1),"
    " new as (select item_id, title, state, created_at, updated_at from knowledge_items where state = 'parsed')"
)

ORACLE = {
    "fts_corpus_stats": f"with {_D} select count(*) n, round(avg(len(toks)), 6) avg_size from docs",
    "fts_postings": f"with {_POST} select term, count(*) df, cast(sum(tf) as bigint) cf, max(tf) max_tf from post group by term",
    "bm25_batch": f'with {_SCORES} select query_id, "key", cast(rank as integer) rank, round(score, 6) score from hits',
    "bm25_search": f"with {_POST}, qt as (select term, count(*) w from (select unnest(" + _TOKENS.format(x="'durable archive of the second edition'") + ') term) group by 1), df as (select term, count(*) df from post group by 1), sc as (select p.doc_id "key", sum(q.w * greatest(ln((n - df + 0.5) / (df + 0.5)), case when ln((n - df + 0.5) / (df + 0.5)) > 0 then 0 else 1e-6 end) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / a))) score from qt q join df on df.term = q.term join post p on p.term = q.term, stats group by 1), rk as (select *, row_number() over (order by round(score, 9) desc, "key") as rank from sc) select "key", cast(rank as integer) rank, round(score, 6) score from rk where rank <= 20',
    "search_trace": f"with {_SCORES}, tr as (select h.query_id, h.rank, lower(coalesce(d.title, '')) ti, lower(coalesce(d.text, '')) te, list_distinct(list_filter(list_transform(regexp_extract_all(concat_ws(' ', e.question, e.answer), '[A-Za-z][A-Za-z0-9_.-]*|[0-9]+'), lambda x: lower(x)), lambda x: x not in ({_STOP}))) ts from hits h join docs d on d.doc_id = h.\"key\" join eval_items e on e.eval_id = h.query_id)"
    " select query_id, cast(rank as integer) rank, cast(len(list_filter(ts, lambda x: contains(ti, x) or contains(te, x))) as integer) matched_terms, round(case when len(ts) = 0 then 1.0 else len(list_filter(ts, lambda x: contains(ti, x) or contains(te, x))) / len(ts) end, 6) term_coverage, cast(len(list_filter(ts, lambda x: contains(ti, x))) as integer) title_matches, len(ts) > 0 and len(list_filter(ts, lambda x: contains(te, x))) = len(ts) phrase_matched from tr",
    "context_pack": f"with {_SCORES}, r as (select h.query_id, h.rank, coalesce(d.title, 'Untitled') ti, d.source so, case when length(d.text) > 800 then substr(d.text, 1, 800) || E'\\n[truncated]' else d.text end base from hits h join docs d on d.doc_id = h.\"key\"),"
    " p as (select *, '[' || rank || '] ' || ti || E'\\nSource: ' || coalesce(so, 'unknown') || E'\\n' pre from r), q as (select *, cast(sum(length(pre) + length(base)) over (partition by query_id order by rank) as bigint) used from p),"
    " z as (select *, used - length(pre) - length(base) bef, 6000 - (used - length(pre) - length(base)) - length(pre) room from q),"
    " k as (select *, case when length(base) <= room or room <= 12 then base else substr(base, 1, room - 12) || E'\\n[truncated]' end content from z where rank = 1 or (bef <= 6000 and (used <= 6000 or room > 12)))"
    " select query_id, count(*) citations, cast(length(string_agg(pre || content, E'\\n\\n' order by rank)) as integer) used_chars, sha256(string_agg(pre || content, E'\\n\\n' order by rank)) context_hash from k group by 1",
    "retrieval_eval": f"with {_SCORES}, ex as (select e.eval_id query_id, d.doc_id \"key\" from eval_items e join (select doc_id, ' ' || array_to_string({_TOKENS.format(x='text')}, ' ') || ' ' line from documents) d on contains(d.line, ' ' || array_to_string({_TOKENS.format(x='passage')}, ' ') || ' ')),"
    ' b as (select ex.query_id, min(h.rank) best from ex left join hits h on h.query_id = ex.query_id and h."key" = ex."key" group by 1) select count(*) queries, ' + ", ".join(f"round(coalesce(avg(case when best <= {k} then 1.0 else 0.0 end), 0), 6) hit_at_{k}" for k in (1, 3, 5)) + " from b",
    "alias_pivot": f"with {v.ITEMS} select item_id, normalized_url, original_url, canonical_url from items where coalesce(normalized_url, original_url, canonical_url) is not null",
    "item_list_recent": f"with {v.ITEMS} select item_id, title, case when state in ('parsed', 'stale', 'archived', 'active') then 'parsed' else 'captured' end as state from items order by coalesce(parsed_at, updated_at) desc, item_id limit 50",
    "item_status": f"with {v.ITEMS} select item_id, case when state in ('parsed', 'stale', 'archived', 'active') then 'parsed' else 'captured' end as state, active_doc_id is not null has_document, active_rawdoc_id is not null has_capture from items",
    "item_view": f"with {v.ITEMS} select item_id, coalesce(nullif(page_title, ''), nullif(title, ''), nullif(lower(regexp_extract(normalized_url, '://([^/?#:]+)', 1)), ''), nullif(substr(normalized_url, 1, 80), ''), 'Untitled') display_title, coalesce(normalized_url, canonical_url, original_url, item_id) address from items",
    "capture_reload": f"with {v.ITEMS} select item_id, r.rawdoc_id, r.source_uri from items join (select distinct rawdoc_id, source_uri from rawdocs) r on r.rawdoc_id = items.active_rawdoc_id",
    "collection_members": f"with {v.MEMBERS} select collection, member, order_index, coalesce(nullif(p_name, ''), 'Untitled') title from members left join part on p_partkey = member",
    "collection_navigation": f"with {v.MEMBERS} select collection, member, lag(member) over w as previous, lead(member) over w as next from members window w as (partition by collection order by order_index, member)",
    "collection_counts": f"with {v.MEMBERS} select o_orderkey collection, count(member) members from orders left join members on collection = o_orderkey group by 1",
    "used_doc_ids": "select distinct l_partkey member from lineitem",
    "collections_by_doc": f"with {v.MEMBERS} select member, count(*) collections, min(collection) first_collection from members group by 1",
    "standalone_items": "select p_partkey item_id, p_name title from part where p_partkey not in (select l_partkey from lineitem join orders on o_orderkey = l_orderkey where o_orderstatus = 'F')",
    "delete_plan": f"with {v.MEMBERS}, sc as (select o_orderkey collection from orders where o_orderpriority = '1-URGENT'), ins as (select m.* from members m join sc on sc.collection = m.collection), failed as (select distinct member from members where order_index = 6)"
    " select 'item' kind, cast(member as varchar) id from (select member from members where order_index = 7 union select member from ins) union all select 'collection', cast(collection as varchar) from sc where collection not in (select collection from ins join failed on failed.member = ins.member)",
    "annotation_rollup": f"with {v.ANNOTATIONS} select doc_id, count(*) annotations, count(*) filter (where orphaned) orphaned, arg_max(annotation_id, (created_at, annotation_id)) latest from annotations group by 1",
    "annotation_types_map": f"with {v.ANNOTATIONS} select doc_id, '{{' || string_agg('\"' || type || '\":' || n, ',' order by type) || '}}' types from (select doc_id, type, count(*) n from annotations group by 1, 2) group by 1",
    "annotation_top_types": f"with {v.ANNOTATIONS} select doc_id, string_agg(type || ' ' || n, ', ' order by rn) as label from (select *, row_number() over (partition by doc_id order by n desc, type) rn from (select doc_id, type, count(*) n from annotations group by 1, 2)) where rn <= 2 group by 1",
    "annotation_timeline": f"with {v.ANNOTATIONS} select annotation_id, doc_id, cast(row_number() over (partition by doc_id order by case when type = 'note' then 0 else 1 end, created_at desc, annotation_id) as integer) as rank from annotations where not orphaned",
    "annotation_migrate": f"with {v.ANNOTATIONS} select case when not orphaned and c_custkey is not null then c_custkey + 1000000 else doc_id end doc_id, count(*) annotations from annotations left join customer on c_custkey = doc_id group by 1",
    "upsert_items": f"with {_OLDNEW}, n as (select *, row_number() over (partition by item_id order by updated_at desc) rn from new) select coalesce(n.item_id, old.item_id) item_id, case when n.item_id is not null then n.title else old.title end title, case when n.item_id is not null then n.state else old.state end as state from old full join (select * from n where rn = 1) n on n.item_id = old.item_id",
    "insert_missing": f"with {_OLDNEW} select item_id, state from old union all select distinct item_id, state from new where item_id not in (select item_id from old)",
    "replace_chunks": f"with {v.CHUNKS}, nw as (select doc_id || ':new' chunk_id, doc_id, chunk_index - 1 chunk_index from held where chunk_index = 1) select chunk_id, doc_id, chunk_index from held where doc_id not in (select doc_id from nw) union all select * from nw",
    "batch_state_latest": f"with {v.TRANSITIONS} select item, arg_max(state, (ts, event_id)) as state, count(*) filter (where state = 'fetching') attempts, count(*) transitions from transitions group by item",
    "batch_counters": f"with {_JI} select job, count(*) items, count(*) filter (where state = 'saved') saved, count(*) filter (where state = 'skipped') skipped, count(*) filter (where state = 'failed') failed, count(*) filter (where state = 'cancelled') cancelled from latest group by job",
    "recover_stale": f"with {_JI} select job, item, case when state in ('fetching', 'parsing', 'saving') then 'failed' else state end as state, case when state in ('fetching', 'parsing', 'saving') then 'stale' end error_code from latest",
    "retry_failed": f"with {_JI} select job, case when state = 'failed' then 'pending' else state end as state, count(*) items from latest group by 1, 2",
    "pending_headings": "select distinct section_id from document_sections where type = 'heading' and section_id not in (select section_id from document_sections where type = 'heading' and level = 2 and section_id is not null)",
    "maintenance_scan": " union all ".join(f"select '{n}' table_name, count(*) as rows from {n}" for n in ("knowledge_items", "rawdocs", "page_snapshots", "document_sections", "chunks", "knowledge_documents", "documents", "events")),
    "import_report": "select case when coalesce(content_type, '') = '' then 'failed' when lower(content_type) like '%text/html%' or lower(content_type) like '%application/xhtml+xml%' or lower(content_type) like '%epub%' then 'imported' else 'skipped' end as state, count(*) items, coalesce(cast(sum(content_length) as bigint), 0) bytes from (select distinct on (rawdoc_id) * from rawdocs order by rawdoc_id) group by 1",
    "library_overview": f"with {v.ITEMS} select source_type, count(*) items, count(*) filter (where state = 'parsed') parsed, arg_max(item_id, (updated_at, item_id)) latest_item from items group by 1",
    "ingest_quality": f"with {v.SECTIONS}, r as (select doc_id, count(*) n, coalesce(cast(sum(length(content)) as bigint), 0) c from sections group by 1) select doc_id, cast(greatest(0, least(100, case when c + 40 * n >= 1000 then 30 when c + 40 * n >= 300 then 15 else 0 end + case when c >= 2500 then 30 when c >= 1000 then 20 when c >= 300 then 10 else 0 end + case when n >= 8 then 20 when n >= 3 then 12 when n >= 1 then 4 else 0 end + 10 - least(case when c < 120 then 5 else 0 end, 20))) as integer) quality from r",
}

