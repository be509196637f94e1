"""Saving captures and reparsed documents, and keeping collections, as changes of several tables at once.

Each function takes the tables of the store and returns those that change, for one `Store.commit`.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorefold.functions.urls import normalize_url, url_hash
from lorefold.operators.library import migrate_annotations
from lorefold.operators.store import delete_where, probe_urls, replace_children, upsert, upsert_aliases

# States of a batch item and those that may follow each; of a job likewise.
ITEM_STEPS = {"pending": ("fetching", "skipped", "cancelled"), "fetching": ("parsing", "skipped", "failed", "cancelled"), "parsing": ("saving", "failed", "cancelled"), "saving": ("saved", "failed", "cancelled"), "failed": ("pending",)}
JOB_STEPS = {"queued": ("running", "cancelled"), "running": ("succeeded", "failed", "cancelled"), "failed": ("running",)}


def replaced_versions(items: DataFrame, saved: DataFrame) -> DataFrame:
    """(item_id, old_doc, new_doc, old_rawdoc): what the saved rows put out of use. A version that stays active, or
    was never there, is null."""
    new = saved.select("item_id", F.col("active_doc_id").alias("new_doc"), F.col("active_rawdoc_id").alias("new_rawdoc"))
    both = items.select("item_id", "active_doc_id", "active_rawdoc_id").join(new, "item_id")
    old_doc = F.when(F.col("active_doc_id") != F.col("new_doc"), F.col("active_doc_id"))
    old_rawdoc = F.when(F.col("active_rawdoc_id") != F.col("new_rawdoc"), F.col("active_rawdoc_id"))
    return both.select("item_id", old_doc.alias("old_doc"), "new_doc", old_rawdoc.alias("old_rawdoc"))


def save_captures(tables: Mapping[str, DataFrame], saved: DataFrame, documents: DataFrame, chunks: DataFrame, rawdocs: DataFrame | None = None, aliases: DataFrame | None = None) -> dict[str, DataFrame]:
    """Items, aliases, raw captures, documents and chunks after saving: rows of equal keys are overwritten
    (first times stay), chunks of saved documents are replaced, and versions that the saved
    ones replace are deleted. saved holds one row an item with the columns of tables["items"]; without
    rawdocs, as after parsing again, captures stay untouched."""
    gone = replaced_versions(tables["items"], saved)
    docs = gone.where("old_doc is not null").select(F.col("old_doc").alias("doc_id"))
    out = {
        "items": upsert(tables["items"], saved, ["item_id"], keep=["created_at"]),
        "documents": upsert(delete_where(tables["documents"], docs, ["doc_id"]), documents, ["doc_id"], keep=[c for c in ("created_at",) if c in documents.columns]),
        "chunks": replace_children(delete_where(tables["chunks"], docs, ["doc_id"]), chunks, "doc_id"),
    }
    if rawdocs is not None:
        raws = gone.where("old_rawdoc is not null").select(F.col("old_rawdoc").alias("rawdoc_id"))
        out["rawdocs"] = upsert(delete_where(tables["rawdocs"], raws, ["rawdoc_id"]), rawdocs, ["rawdoc_id"], keep=[c for c in ("content_ext", "created_at") if c in rawdocs.columns])
    if aliases is not None:
        out["aliases"] = upsert_aliases(tables["aliases"], aliases)
    return out


def save_reparsed(tables: Mapping[str, DataFrame], saved: DataFrame, documents: DataFrame, chunks: DataFrame) -> dict[str, DataFrame]:
    """save_captures without raw captures; the annotations of a replaced document that are not orphaned
    move to its successor."""
    out = save_captures(tables, saved, documents, chunks)
    if "annotations" in tables:
        moved = replaced_versions(tables["items"], saved).where("old_doc is not null and new_doc is not null").select("old_doc", "new_doc")
        out["annotations"] = migrate_annotations(tables["annotations"], moved)
    return out


def upsert_collections(items: DataFrame, wanted: DataFrame) -> DataFrame:
    """items (item_id, item_type, identity_key, title, state, updated_at) after saving collections (title, root_url,
    updated_at). One of an address that is there keeps its id and takes the title; another is
    new under col:sha256: and the hash of its address. Of several of one address the last one holds;
    those without an address are left out."""
    new = wanted.withColumn("identity_key", url_hash(normalize_url(F.col("root_url")))).where("identity_key is not null")
    last = new.groupBy("identity_key").agg(F.max(F.struct("updated_at", "title")).alias("w")).select("identity_key", "w.title", "w.updated_at")
    there = items.where("item_type = 'collection'").groupBy("identity_key").agg(F.min("item_id").alias("old_id"))
    rows = last.join(there, "identity_key", "left").select(F.coalesce("old_id", F.concat(F.lit("col:sha256:"), F.col("identity_key"))).alias("item_id"), F.lit("collection").alias("item_type"), "identity_key", "title", F.lit("active").alias("state"), "updated_at")
    kept = items.join(rows.select("item_id", F.col("title").alias("_title"), F.col("updated_at").alias("_at")), "item_id", "left")
    kept = kept.withColumn("title", F.coalesce("_title", "title")).withColumn("updated_at", F.coalesce("_at", "updated_at")).select(*items.columns)
    return kept.unionByName(rows.join(items.select("item_id"), "item_id", "left_anti").select(*items.columns))


def replace_members(members: DataFrame, new: DataFrame, collections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, collections) after the members of the collections in new are replaced; those become active."""
    live = new.select("collection").distinct().withColumn("_live", F.lit(True))
    state = F.when(F.col("_live"), "active").otherwise(F.col("state"))
    return replace_children(members, new, "collection"), collections.join(live, "collection", "left").withColumn("state", state).drop("_live")


def repoint_members(members: DataFrame, moved: DataFrame) -> DataFrame:
    """Memberships after items took another identity, as by a redirect. moved: (old, new). Where the new
    item is a member already, the membership that comes first stays."""
    pointed = members.join(moved.select(F.col("old").alias("member"), "new"), "member", "left").withColumn("member", F.coalesce("new", "member")).drop("new")
    others = [c for c in members.columns if c not in ("collection", "member")]
    best = pointed.groupBy("collection", "member").agg(F.min(F.struct(*others)).alias("_m"))
    return best.select(*[c if c in ("collection", "member") else F.col("_m").getField(c).alias(c) for c in members.columns])


def ids_of_urls(urls: DataFrame, aliases: DataFrame) -> DataFrame:
    """(item_id): the items that addresses (url) belong to, for removing or purging by address."""
    return probe_urls(urls.select("url", normalize_url(F.col("url")).alias("normalized")), aliases).select("item_id").distinct()


def collection_names(wanted: DataFrame, collections: DataFrame) -> DataFrame:
    """(name, taken): whether a collection of exactly that name, blanks trimmed, is there."""
    names = collections.select(F.trim("title").alias("_t")).where("_t <> ''").distinct()
    rows = wanted.select(F.trim("name").alias("name")).where("name <> ''").distinct()
    return rows.join(names, F.col("name") == F.col("_t"), "left").select("name", F.col("_t").isNotNull().alias("taken"))


def create_jobs(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs, items) of batch requests (job_id, source_page_url, mode, created_at, urls): a job waits with its
    count, its addresses are pending in their order. An address is one item of a job, however often
    it is named; those that cannot be normalised have none."""
    jobs = requests.select("job_id", "source_page_url", "mode", F.lit("queued").alias("state"), "created_at", F.posexplode_outer("urls").alias("at", "url")).withColumn("normalized_url", normalize_url(F.col("url")))
    items = jobs.where("normalized_url is not null").groupBy("job_id", "normalized_url").agg(F.min(F.struct("at", "url", "created_at")).alias("f"))
    items = items.select("job_id", F.col("f.at").alias("position"), "f.url", "normalized_url", F.lit("pending").alias("state"), F.lit(0).alias("attempts"), "f.created_at")
    counted = jobs.groupBy("job_id", "source_page_url", "mode", "state", "created_at").agg(F.count_distinct("normalized_url").alias("total"))
    return counted, items


def follows(before: Column, after: Column, steps: Mapping[str, tuple[str, ...]]) -> Column:
    """Whether a state may follow another; the first state of all may be any."""
    allowed = F.lit(False)
    for state, nexts in steps.items():
        allowed = allowed | ((before == state) & after.isin(*nexts))
    return before.isNull() | allowed


def replay_states(log: DataFrame, keys: list[str], order: list[str], steps: Mapping[str, tuple[str, ...]] = ITEM_STEPS) -> DataFrame:
    """(keys, state, attempts, refused): the state each log of one key ends in if steps that are not allowed are
    refused, how often work on it began, and how many steps were refused. A key's log is one row while
    it is replayed; it is as long as the item was tried often."""
    logs = log.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, "state"))).alias("log"))
    start = F.struct(F.lit(None).cast("string").alias("state"), F.lit(0).alias("attempts"), F.lit(0).alias("refused"))

    def step(acc: Column, x: Column) -> Column:
        ok = follows(acc["state"], x["state"], steps)
        return F.struct(
            F.when(ok, x["state"]).otherwise(acc["state"]).alias("state"),
            (acc["attempts"] + F.when(ok & (x["state"] == "fetching"), 1).otherwise(0)).alias("attempts"),
            (acc["refused"] + F.when(ok, 0).otherwise(1)).alias("refused"),
        )

    return logs.select(*keys, F.aggregate("log", start, step).alias("r")).select(*keys, "r.state", "r.attempts", "r.refused")


def annotation_mirror(annotations: DataFrame) -> DataFrame:
    """(doc_id, version, annotations): what a document's annotation file holds, as JSON in the order of
    creation; the version is the number of annotations ever written for it."""
    rows = F.array_sort(F.collect_list(F.struct("created_at", "annotation_id", "type", "orphaned")))
    kept = F.transform(F.filter("all", lambda a: ~a["orphaned"]), lambda a: F.struct(a["annotation_id"].alias("annotation_id"), a["type"].alias("type")))
    return annotations.groupBy("doc_id").agg(rows.alias("all")).select("doc_id", F.size("all").alias("version"), F.to_json(kept).alias("annotations"))


def annotated_items(annotations: DataFrame, items: DataFrame, documents: DataFrame, aliases: DataFrame) -> DataFrame:
    """(item_id, doc_id, title, url, annotations): annotations counted for each item with its document's title and its
    normalized address. Annotations are counted before they are joined, so aliases do not multiply them."""
    counts = annotations.groupBy("doc_id").agg(F.count("*").alias("annotations"))
    urls = aliases.where("alias_type = 'normalized_url'").groupBy("item_id").agg(F.max("alias_value").alias("url"))
    rows = counts.join(items.select("item_id", F.col("active_doc_id").alias("doc_id")), "doc_id")
    return rows.join(documents.select("doc_id", "title"), "doc_id", "left").join(urls, "item_id", "left").select("item_id", "doc_id", "title", "url", "annotations")
