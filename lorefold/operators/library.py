"""Collections, annotations, imports and library overviews as relational operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lorefold.operators.skew import salted_lookup


def member_view(members: DataFrame, items: DataFrame) -> DataFrame:
    """(collection, member, order_index, title): members with their items; an unknown item has the
    title Untitled. items is unique by item_id."""
    joined = salted_lookup(members.withColumnRenamed("member", "item_id"), items.select("item_id", "title"), ["item_id"], ["collection"], how="left")
    return joined.select("collection", F.col("item_id").alias("member"), "order_index", F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled")).alias("title"))


def navigation(members: DataFrame) -> DataFrame:
    """(collection, member, previous, next): neighbours in the order of the collection."""
    w = W.partitionBy("collection").orderBy("order_index", "member")
    return members.select("collection", "member", F.lag("member").over(w).alias("previous"), F.lead("member").over(w).alias("next"))


def collection_counts(collections: DataFrame, members: DataFrame) -> DataFrame:
    """(collection, members): collections without members count 0."""
    n = members.groupBy("collection").agg(F.count("*").alias("members"))
    return collections.join(n, "collection", "left").select("collection", F.coalesce("members", F.lit(0)).alias("members"))


def used_members(members: DataFrame) -> DataFrame:
    """Distinct members, by partial aggregation."""
    return members.select("member").distinct()


def collections_of(members: DataFrame) -> DataFrame:
    """(member, collections, first_collection): where each member is used."""
    return members.groupBy("member").agg(F.count("*").alias("collections"), F.min("collection").alias("first_collection"))


def standalone(items: DataFrame, members: DataFrame, key: str = "item_id") -> DataFrame:
    """Items that are in no collection."""
    return items.join(members.select(F.col("member").alias(key)).distinct(), key, "left_anti")


def delete_plan(selected: DataFrame, selected_collections: DataFrame, members: DataFrame, failed: DataFrame) -> DataFrame:
    """(kind, id): the items to delete, selected or in a selected collection, and the shells of those
    collections of which no member failed."""
    inside = members.join(selected_collections, "collection", "left_semi")
    ids = selected.select(F.col("member").alias("id")).union(inside.select(F.col("member").alias("id"))).distinct()
    broken = inside.join(failed.select("member"), "member", "left_semi").select("collection").distinct()
    shells = selected_collections.join(broken, "collection", "left_anti")
    row = lambda kind, key: (F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"))
    return ids.select(*row("item", "id")).union(shells.select(*row("collection", "collection")))


def annotation_rollup(annotations: DataFrame) -> DataFrame:
    """(doc_id, annotations, orphaned, latest): counted once each, combined before the shuffle."""
    return annotations.groupBy("doc_id").agg(F.count("*").alias("annotations"), F.count_if("orphaned").alias("orphaned"), F.max(F.struct("created_at", "annotation_id"))["annotation_id"].alias("latest"))


def annotation_types(annotations: DataFrame) -> DataFrame:
    """(doc_id, types): counts by type as a JSON object, types in alphabetical order."""
    by = annotations.groupBy("doc_id", "type").agg(F.count("*").alias("n"))
    entry = F.concat(F.lit('"'), F.col("type"), F.lit('":'), F.col("n").cast("string"))
    rows = by.groupBy("doc_id").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    return rows.select("doc_id", F.concat(F.lit("{"), F.array_join("e", ","), F.lit("}")).alias("types"))


def top_types(annotations: DataFrame, k: int = 2) -> DataFrame:
    """(doc_id, label): the k most frequent types with counts; ties go by name."""
    by = annotations.groupBy("doc_id", "type").agg(F.count("*").alias("n"))
    rows = by.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "type", "n"))).alias("e"))
    return rows.select("doc_id", F.array_join(F.transform(F.slice("e", 1, k), lambda x: F.concat(x["type"], F.lit(" "), x["n"].cast("string"))), ", ").alias("label"))


def timeline(annotations: DataFrame, current: Column) -> DataFrame:
    """annotations with rank in a document's list: those of the current place first, then the latest."""
    w = W.partitionBy("doc_id").orderBy(F.when(current, 0).otherwise(1), F.col("created_at").desc(), F.col("annotation_id"))
    return annotations.withColumn("rank", F.row_number().over(w))


def migrate_annotations(annotations: DataFrame, versions: DataFrame) -> DataFrame:
    """Non-orphaned annotations moved to the new version of their document; versions: (old_doc, new_doc)."""
    joined = annotations.join(versions.select(F.col("old_doc").alias("doc_id"), "new_doc"), "doc_id", "left")
    return joined.withColumn("doc_id", F.when(~F.col("orphaned") & F.col("new_doc").isNotNull(), F.col("new_doc")).otherwise(F.col("doc_id"))).drop("new_doc")


def pending_headings(headings: DataFrame, done: DataFrame) -> DataFrame:
    """Headings without a summary by the same model; both have (section_id, model)."""
    return headings.join(done.select("section_id", "model").distinct(), ["section_id", "model"], "left_anti")


def import_identity(content_hash: Column, canonical: Column, og_url: Column) -> Column:
    """Identity of an imported page: its address where it names one, else its content."""
    address = F.coalesce(F.when(canonical.rlike("^https?://"), canonical), F.when(og_url.rlike("^https?://"), og_url))
    return F.when(address.isNotNull(), F.concat(F.lit("url:sha256:"), F.substring(F.sha2(address, 256), 1, 16))).otherwise(F.concat(F.lit("singlefile_html:sha256:"), content_hash))


def error_code(message: Column) -> Column:
    """Class of an import error by what its message says."""
    return (
        F.when(message.contains("fetch"), "fetch_failed")
        .when(message.contains("parse_failed") | message.contains("pandoc"), "parse_failed")
        .when(message.contains("SQLITE") | message.contains("Path escapes"), "save_failed")
        .otherwise("import_failed")
    )


def import_report(rows: DataFrame) -> DataFrame:
    """(state, items, bytes): summary of an import run."""
    return rows.groupBy("state").agg(F.count("*").alias("items"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def library_overview(items: DataFrame) -> DataFrame:
    """(source_type, items, parsed, latest_item): per source, the item updated last named."""
    return items.groupBy("source_type").agg(F.count("*").alias("items"), F.count_if(F.col("state") == "parsed").alias("parsed"), F.max(F.struct("updated_at", "item_id"))["item_id"].alias("latest_item"))


def ingest_quality(markdown_chars: Column, text_chars: Column, sections: Column, fallback: Column, warnings: Column) -> Column:
    """0 to 100 from lengths, sections, the parser and its warnings."""
    score = (
        F.when(markdown_chars >= 1000, 30).when(markdown_chars >= 300, 15).otherwise(0)
        + F.when(text_chars >= 2500, 30).when(text_chars >= 1000, 20).when(text_chars >= 300, 10).otherwise(0)
        + F.when(sections >= 8, 20).when(sections >= 3, 12).when(sections >= 1, 4).otherwise(0)
        + F.when(fallback, 0).otherwise(10)
        - F.least(warnings * 5, F.lit(20))
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), score))
