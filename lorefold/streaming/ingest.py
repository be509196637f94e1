"""Incremental ingestion: captures that land in a folder are parsed and merged into the store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lorefold.functions.urls import normalize_url, url_hash
from lorefold.operators import extract
from lorefold.operators.latest import holding_rows
from lorefold.operators.store import Store, replace_children

CAPTURE = "rawdoc_id string, page_url string, page_title string, title string, html string, text string, selection_html string, captured_at timestamp"


def captures(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Snapshots as they land, as JSON lines with a stated schema. A file counts as new however old it is:
    the source would leave out those a week older than the newest it has seen."""
    return spark.readStream.schema(CAPTURE).option("maxFilesPerTrigger", files_per_trigger).option("maxFileAge", "36500d").json(folder)


def without_repeats(batch: DataFrame) -> DataFrame:
    """One row per capture of a batch, the latest; captures without an id are dropped. Repeats over
    batches are left to the merge, which they do not change: nothing is dropped for its age."""
    return holding_rows(batch, ["rawdoc_id"], "captured_at").select(*batch.columns)


def parse_batch(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, sections) of a batch of captures: the best candidate of each page."""
    url = normalize_url(F.col("page_url"))
    pages = batch.withColumn("normalized_url", url).where("normalized_url is not null")
    chosen = extract.select_candidates(extract.candidates(pages)).select(F.col("page_id").alias("rawdoc_id"), "method", F.col("title").alias("content_title"), "sections")
    joined = pages.select("rawdoc_id", "normalized_url", "page_title", "captured_at").join(chosen, "rawdoc_id")
    items = joined.select(F.concat(F.lit("url:sha256:"), url_hash(F.col("normalized_url"))).alias("item_id"), "normalized_url", "page_title", F.col("content_title").alias("title"), "method", F.col("rawdoc_id").alias("doc_id"), F.col("captured_at").alias("updated_at"), F.col("captured_at").alias("created_at"))
    sections = joined.select(F.concat(F.lit("url:sha256:"), url_hash(F.col("normalized_url"))).alias("item_id"), F.col("rawdoc_id").alias("doc_id"), F.col("captured_at").alias("updated_at"), F.posexplode("sections").alias("idx", "s")).select("item_id", "doc_id", "updated_at", "idx", "s.type", "s.level", "s.content")
    return items, sections


def latest_items(items: DataFrame) -> DataFrame:
    """One row per item: that of its latest capture, with the time of its first. Of captures of one time the
    greater doc_id holds, so the order in which they come makes no difference."""
    others = [c for c in items.columns if c not in ("item_id", "created_at")]
    rank = F.struct("updated_at", "doc_id", F.xxhash64(*others).alias("h"))
    best = items.groupBy("item_id").agg(F.max_by(F.struct(*others), rank).alias("_row"), F.min("created_at").alias("created_at"))
    return best.select(*[c if c in ("item_id", "created_at") else F.col("_row").getField(c).alias(c) for c in items.columns])


def merge_into(store: Store) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch. A capture older than the one an item holds leaves item and sections as they
    are. Merging a batch again gives the same tables, so a batch that is repeated after a failure does no
    harm."""

    def merge(batch: DataFrame, _batch_id: int) -> None:
        items, sections = parse_batch(without_repeats(batch))
        old = store.read("items")
        merged = latest_items(items if old is None else old.unionByName(items))
        held = merged.select("item_id", "doc_id", F.col("updated_at").alias("held_at"))
        current = sections.join(held, ["item_id", "doc_id"]).where("updated_at <=> held_at").drop("updated_at", "held_at")
        before = store.read("sections")
        store.commit({"items": merged, "sections": replace_children(before, current, "item_id") if before is not None else current})

    return merge


def ingest(spark: SparkSession, folder: str, root: str, checkpoint: str) -> StreamingQuery:
    """Run until all files in the folder are merged; call again for new ones."""
    return captures(spark, folder).writeStream.foreachBatch(merge_into(Store(spark, root))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_progress(transitions: DataFrame, window: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Counts of a stream of (ts, job, state) by job, state and window, for watching batch jobs."""
    return transitions.withWatermark("ts", delay).groupBy(F.window("ts", window), "job", "state").agg(F.count("*").alias("n"))
