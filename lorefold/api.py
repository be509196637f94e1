"""What the service offers, as methods over a store: search, context, items, collections, maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorefold.operators import library, saving
from lorefold.operators import search as se
from lorefold.operators import store as st
from lorefold.operators.index import SearchIndex
from lorefold.operators.store import Store
from lorefold.session import materialise

INDEXED = ("title", "heading_path", "text")


class Knowledge:
    """A store with the tables items (item_id, state, title, page_title, normalized_url, source_type,
    active_doc_id, updated_at), chunks (chunk_id, doc_id, heading_path, text), documents (doc_id, title)
    and, where collections and annotations are used, members and annotations."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.store, self.index = spark, Store(spark, root), SearchIndex(spark, f"{root.rstrip('/')}/index")

    def _table(self, name: str) -> DataFrame:
        df = self.store.read(name)
        if df is None:
            raise LookupError(f"the store has no table {name}")
        return df

    def _hits(self, query: str, limit: int, source: str | None, url: str | None) -> DataFrame:
        items = self._table("items")
        if source:
            items = items.where(F.col("source_type") == source)
        if url:
            items = items.where(F.col("normalized_url") == url)
        rows = self._rows(items)
        terms = se.query_terms(self.spark.createDataFrame([(0, query)], "query_id int, q string"), "query_id", "q")
        if not self.index.segments():
            self.index.add(self._rows(self._table("items")), "key", *INDEXED)
        wanted = [r.term for r in terms.select("term").collect()]  # the words of one query
        scores = se.bm25(self.index.postings(wanted), self.index.statistics(), terms)
        if source or url:
            scores = scores.join(rows.select("key"), "key", "left_semi")
        return se.top_hits(scores, limit).join(rows, "key")

    def _rows(self, items: DataFrame) -> DataFrame:
        """Chunks with their items, as they are indexed and shown."""
        rows = self._table("chunks").join(items.select(F.col("active_doc_id").alias("doc_id"), "item_id", "title", "page_title", "normalized_url"), "doc_id")
        return rows.select(F.col("chunk_id").alias("key"), "doc_id", "item_id", "title", F.coalesce("page_title", "title").alias("display_title"), F.coalesce("normalized_url", "item_id").alias("source_url"), "heading_path", "text")

    def save(self, saved: DataFrame, documents: DataFrame, chunks: DataFrame, rawdocs: DataFrame | None = None, aliases: DataFrame | None = None) -> None:
        """Save captures, or reparsed documents if rawdocs is None: one commit of all tables, then the index of
        what came and went."""
        held = {n: self._table(n) for n in self.store.manifest()}
        before = self._rows(held["items"]).select("key", "item_id").join(saved.select("item_id"), "item_id", "left_semi").select("key")
        out = saving.save_captures(held, saved, documents, chunks, rawdocs, aliases) if rawdocs is not None or "annotations" not in held else saving.save_reparsed(held, saved, documents, chunks)
        self.store.commit(out)
        if self.index.segments():
            now = self._rows(self._table("items").join(saved.select("item_id"), "item_id", "left_semi"))
            self.index.add(now, "key", *INDEXED, gone=before)

    def _unindex(self, item_ids: DataFrame) -> DataFrame | None:
        """Keys of the items' chunks, kept before they are deleted."""
        if not self.index.segments():
            return None
        return materialise(self._rows(self._table("items")).join(item_ids, "item_id", "left_semi").select("key"), "gone")

    def _drop(self, keys: DataFrame | None) -> None:
        if keys is not None:
            self.index.add(self._rows(self._table("items")).limit(0), "key", *INDEXED, gone=keys)

    def search(self, query: str, limit: int = 20, source: str | None = None, url: str | None = None, trace: bool = False) -> DataFrame:
        """Ranked chunks with a snippet of 300 characters, with how they match if trace is set."""
        hits = self._hits(query, limit, source, url).withColumn("snippet", F.substring("text", 1, 300))
        if trace:
            hits = se.search_trace(hits.withColumn("_q", F.lit(query)), "_q", "title", "heading_path", "text").drop("_q")
        return hits.drop("query_id", "text").orderBy("rank")

    def context(self, query: str, max_chars: int = se.CONTEXT_CHARS, limit: int = se.CONTEXT_LIMIT) -> DataFrame:
        """One row: the packed context with its citations; no row if nothing is found."""
        return se.context_text(se.context_blocks(self._hits(query, limit, None, None), max_chars, limit)).drop("query_id")

    def items(self, source: str | None = None, limit: int = 50) -> DataFrame:
        """Items, the last updated first; between 1 and 500."""
        rows = self._table("items")
        if source:
            rows = rows.where(F.col("source_type") == source)
        return rows.withColumn("state", st.presented_state(F.col("state"))).orderBy(F.col("updated_at").desc(), "item_id").limit(max(1, min(limit or 50, 500)))

    def remove(self, item_ids: list[str]) -> None:
        """Take the parsed results of items away, their captures stay."""
        ids = self.spark.createDataFrame([(i,) for i in item_ids], "item_id string")
        empty = self.spark.createDataFrame([], "doc_id string")
        tables = {n: self.store.read(n) for n in ("documents", "chunks", "annotations")}
        gone = self._unindex(ids)
        out = st.remove_items(self._table("items"), *[tables[n] if tables[n] is not None else empty for n in ("documents", "chunks", "annotations")], ids)
        self.store.commit({n: df for n, df in out.items() if n == "items" or tables[n] is not None})
        self._drop(gone)

    def purge(self, item_ids: list[str]) -> None:
        """Delete items with all that hangs on them."""
        ids = self.spark.createDataFrame([(i,) for i in item_ids], "item_id string")
        gone = self._unindex(ids)
        self.store.commit(st.purge_items({n: self._table(n) for n in self.store.manifest()}, ids))
        self._drop(gone)

    def delete_urls(self, urls: list[str], purge: bool = False) -> None:
        """Remove, or purge, the items that addresses belong to."""
        found = saving.ids_of_urls(self.spark.createDataFrame([(u,) for u in urls], "url string"), self._table("aliases"))
        ids = [r.item_id for r in found.collect()]  # no more than the addresses given
        if ids:
            (self.purge if purge else self.remove)(ids)

    def navigation(self, collection: str, member: str) -> DataFrame:
        """Previous and next member of a collection; no row for an unknown member."""
        return library.navigation(self._table("members").where(F.col("collection") == collection)).where(F.col("member") == member)

    def scan(self) -> DataFrame:
        return st.maintenance_scan({n: self._table(n) for n in sorted(self.store.manifest())})
