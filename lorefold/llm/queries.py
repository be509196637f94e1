"""Queries of the subpackage and the SQL of those that DuckDB can express over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorefold.llm import language, leakage, main_content, near_duplicates, packing, reading_level, repeated_lines, splitting, template_residue
from lorefold.session import table as t

Query = Callable[[SparkSession, str], DataFrame]


def _network(s: SparkSession, d: str) -> language.Network:
    return language.fit(t(s, d, "lang_samples"), t(s, d, "document_sections"), t(s, d, "knowledge_items"))


QUERIES: dict[str, Query] = {
    "p1_found": lambda s, d: template_residue.residue_cases(t(s, d, "page_snapshots"), t(s, d, "rawdocs")),
    "p1_kept": lambda s, d: template_residue.without_residue(t(s, d, "page_snapshots"), t(s, d, "rawdocs")).select("rawdoc_id", "page_url", "text"),
    "p2_found": lambda s, d: repeated_lines.repeated_places(t(s, d, "document_sections"), t(s, d, "knowledge_items")),
    "p2_sequences": lambda s, d: repeated_lines.site_sequences(t(s, d, "document_sections"), t(s, d, "knowledge_items")),
    "p2_clean": lambda s, d: repeated_lines.without_repeated_lines(t(s, d, "document_sections"), t(s, d, "knowledge_items")),
    "p3_found": lambda s, d: near_duplicates.similar_documents(t(s, d, "document_sections")).select("doc_id_a", "doc_id_b"),
    "p3_groups": lambda s, d: near_duplicates.near_duplicate_groups(t(s, d, "document_sections")),
    "p4_found": lambda s, d: main_content.main_content(t(s, d, "page_snapshots")),
    "p5_found": lambda s, d: splitting.chunk_pieces(t(s, d, "chunks")).select("chunk_id").distinct(),
    "p5_pieces": lambda s, d: splitting.chunk_pieces(t(s, d, "chunks")),
    "p5_sections": lambda s, d: splitting.section_pieces(t(s, d, "document_sections")),
    "p6_found": lambda s, d: language.mislabelled_sections(t(s, d, "document_sections"), t(s, d, "knowledge_items"), _network(s, d)),
    "p6_segments": lambda s, d: language.section_segments(t(s, d, "document_sections"), _network(s, d)),
    "p6_documents": lambda s, d: language.document_languages(t(s, d, "document_sections"), _network(s, d)),
    "p8_containers": lambda s, d: packing.pack(packing.token_lengths(t(s, d, "documents"))),
    "p9_found": lambda s, d: leakage.leaks(t(s, d, "documents"), t(s, d, "eval_items")).select("doc_id", "eval_id"),
    "p9_clean": lambda s, d: leakage.without_leaks(t(s, d, "documents"), t(s, d, "eval_items")),
    "p10_levels": lambda s, d: reading_level.reading_levels(t(s, d, "documents"), t(s, d, "reading_labels")),
}

_WHITE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_HELD = "(select * exclude (rn) from (select *, row_number() over (partition by {key} order by {at} desc) rn from {table} where {key} is not null) where rn = 1)"
_ITEMS = _HELD.format(key="item_id", at="updated_at", table="knowledge_items")
_LINES = (
    "select distinct doc_id, section_index, line_no, key from (select doc_id, section_index, line_no, trim(regexp_replace(regexp_replace(lower(line), '\\p{Nd}+', '0', 'g'), '" + _WHITE + "', ' ', 'g')) as key from"
    " (select doc_id, section_index, unnest(string_split(content, chr(10))) line, generate_subscripts(string_split(content, chr(10)), 1) - 1 line_no from document_sections where type in ('paragraph', 'blockquote') and content is not null)) where key <> ''"
)
_WORDS = "regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+')"

_PLACES = (
    f"sites as (select distinct active_doc_id doc_id, regexp_replace(regexp_extract(lower(trim(normalized_url)), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '^www\\.', '') site from {_ITEMS} where active_doc_id is not null and normalized_url is not null),"
    f" lines as ({_LINES}), placed as (select l.*, site from lines l join sites s on s.doc_id = l.doc_id), hot as (select site, key from placed group by 1, 2 having count(distinct doc_id) >= 6)"
    ", places as (select distinct p.doc_id, p.section_index, cast(p.line_no as integer) line_no from placed p join hot h on h.site = p.site and h.key = p.key)"
)

ORACLE: dict[str, str] = {
    "p2_found": f"with {_PLACES} select * from places",
    "p2_clean": f"with {_PLACES}, base as (select distinct doc_id, section_index, type, content from document_sections), ln as (select doc_id, section_index, unnest(string_split(content, chr(10))) line, generate_subscripts(string_split(content, chr(10)), 1) - 1 n from base where content is not null and type in ('paragraph', 'blockquote')),"
    " kept as (select l.doc_id, l.section_index, string_agg(case when p.line_no is null then line end, chr(10) order by n) c from ln l left join places p on p.doc_id = l.doc_id and p.section_index = l.section_index and p.line_no = n group by 1, 2)"
    " select b.doc_id, b.section_index, case when content is not null and type in ('paragraph', 'blockquote') then coalesce(c, '') else content end as content from base b left join kept k on k.doc_id = b.doc_id and k.section_index = b.section_index",
    "p3_found": "with parts as (select distinct doc_id, section_index, content from document_sections where content is not null), docs as (select doc_id, " + _WORDS.format(x="string_agg(content, chr(10) order by section_index)") + " w from parts group by 1),"
    " sh as (select distinct doc_id, s from (select doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) s from docs where len(w) >= 3)), n as (select doc_id, count(*) n from sh group by 1),"
    " c as (select a.doc_id x, b.doc_id y, count(*) k from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2) select x doc_id_a, y doc_id_b from c join n p on p.doc_id = x join n q on q.doc_id = y where k >= 0.6 * (p.n + q.n - k)",
    "p5_found": "select chunk_id from " + _HELD.format(key="chunk_id", at="updated_at", table="chunks") + " where length(text) > 2000",
    "p9_found": "with d as (select doc_id, " + _WORDS.format(x="text") + " w from documents where text is not null), e as (select eval_id, " + _WORDS.format(x="passage") + " w from eval_items), g as (select eval_id, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i : i + 12], ' '))) s from e where len(w) >= 13),"
    " h as (select doc_id, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i : i + 12], ' '))) s from d where len(w) >= 13) select distinct doc_id, eval_id from h join g on g.s = h.s",
}
