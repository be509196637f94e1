"""The document store as versioned tables: snapshots, upserts, removals and states.

A table is a folder of immutable snapshots. Manifests are numbered; the one with the greatest number names
the snapshot of every table, and a change to several tables becomes visible when the next manifest is renamed
into place. None is ever overwritten, so readers always find a whole one, and a second writer that took the
same number is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ITEM_STATES = {"empty": "captured", "captured": "captured", "parsed": "parsed", "stale": "parsed", "archived": "parsed", "active": "parsed"}


class Store:
    """Snapshots under a root folder of any file system Spark can write."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):  # noqa: ANN202
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        """Numbers of the manifests, the last one last."""
        fs, p = self._fs(f"{self.root}/manifests")
        if not fs.exists(p):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(p)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def manifest(self, version: int | None = None) -> dict[str, str]:
        """Snapshots by table, of the last manifest or the one asked for."""
        numbers = self.versions()
        if not numbers:
            return {}
        fs, p = self._fs(f"{self.root}/manifests/{version or numbers[-1]:012}.json")
        size = fs.getFileStatus(p).getLen()
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readNBytes(size)).decode())
        finally:
            stream.close()

    def read(self, table: str) -> DataFrame | None:
        version = self.manifest().get(table)
        return self.spark.read.parquet(f"{self.root}/{table}/{version}") if version else None

    def commit(self, tables: Mapping[str, DataFrame]) -> None:
        """Write all new snapshots, then the next manifest. Until it stands readers see the old state, and
        a failed write leaves nothing but an unreferenced folder. If another writer has
        committed since this one read the tables, the commit is refused and changes nothing."""
        base = (self.versions() or [0])[-1]
        new = self.manifest(base) if base else {}
        for name, df in tables.items():
            version = f"v={uuid.uuid4().hex}"
            df.write.option("compression", "zstd").parquet(f"{self.root}/{name}/{version}")
            new[name] = version
        fs, final = self._fs(f"{self.root}/manifests/{base + 1:012}.json")
        _, temporary = self._fs(f"{self.root}/manifests/.{uuid.uuid4().hex}.tmp")
        out = fs.create(temporary, True)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(temporary, final):
            fs.delete(temporary, False)
            raise RuntimeError("another writer has committed; read the tables again and repeat the change")

    def vacuum(self, keep: int = 2) -> int:
        """Delete snapshots that none of the last `keep` manifests names, and older manifests; the number of folders
        removed. Readers of those manifests are left undisturbed."""
        numbers, removed = self.versions(), 0
        live = {(t, v) for n in numbers[-keep:] for t, v in self.manifest(n).items()}
        for table in {t for n in numbers for t in self.manifest(n)}:
            fs, p = self._fs(f"{self.root}/{table}")
            for status in fs.listStatus(p):
                if (table, status.getPath().getName()) not in live:
                    fs.delete(status.getPath(), True)
                    removed += 1
        for n in numbers[:-keep]:
            fs, p = self._fs(f"{self.root}/manifests/{n:012}.json")
            fs.delete(p, False)
        return removed


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] | None = None, order: str | None = None) -> DataFrame:
    """Rows of old overwritten by rows of new with the same key; the columns in keep stay as first
    written. Of several new rows of a key the one last in `order` holds. One shuffle on the key."""
    keep = keep or []
    columns = old.columns
    both = old.withColumn("_gen", F.lit(0)).unionByName(new.select(*columns).withColumn("_gen", F.lit(1)))
    others = [c for c in columns if c not in keys]
    rank = F.struct("_gen", *([order] if order else []), F.xxhash64(*others).alias("h"))
    kept = [F.min_by(F.col(c), rank).alias(c) if c in keep else F.max_by(F.struct(F.col(c).alias("v")), rank)["v"].alias(c) for c in others]
    return both.groupBy(*keys).agg(*kept).select(*columns)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and those rows of new whose key is not there; the first of equal keys in order of values."""
    others = [c for c in old.columns if c not in keys]
    fresh = new.select(*old.columns).join(old.select(*keys), keys, "left_anti")
    first = fresh.groupBy(*keys).agg(F.min(F.struct(*others)).alias("_f")).select(*[c if c in keys else F.col("_f").getField(c).alias(c) for c in old.columns]) if others else fresh.distinct()
    return old.unionByName(first)


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Delete-then-insert: all children of the parents in new are replaced by those of new."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def delete_where(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return table.join(keys.select(*on).distinct(), on, "left_anti").select(*table.columns)


def upsert_aliases(old: DataFrame, new: DataFrame) -> DataFrame:
    """Aliases are unique by type and value; the latest item owns a shared one, the first id and time stay."""
    return upsert(old, new, ["alias_type", "alias_value"], keep=["alias_id", "created_at"], order="created_at")


def probe_urls(urls: DataFrame, aliases: DataFrame, url: str = "url", normalized: str = "normalized") -> DataFrame:
    """(url, item_id, priority): the item an address belongs to, tried as normalized, canonical and
    original address in turn; addresses without an item are left out."""
    probe = lambda p, kind, value: F.struct(F.lit(p).alias("priority"), F.lit(kind).alias("alias_type"), F.col(value).alias("alias_value"))
    probes = F.array(probe(1, "normalized_url", normalized), probe(2, "canonical_url", normalized), probe(3, "canonical_url", url), probe(4, "original_url", normalized), probe(5, "original_url", url))
    rows = urls.select(url, normalized).distinct().select(F.col(url).alias("url"), F.explode(probes).alias("p"))
    hits = rows.select("url", "p.*").join(aliases.select("alias_type", "alias_value", "item_id"), ["alias_type", "alias_value"])
    best = hits.groupBy("url").agg(F.min(F.struct("priority", "item_id")).alias("b"))
    return best.select("url", "b.item_id", "b.priority")


def alias_pivot(aliases: DataFrame) -> DataFrame:
    """One row per item with a column per alias type; the last created alias of a type holds."""
    types = ["normalized_url", "original_url", "canonical_url", "root_url", "normalized_root_url"]
    pick = lambda kind: F.max(F.when(F.col("alias_type") == kind, F.struct("created_at", "alias_value")))["alias_value"].alias(kind)
    return aliases.groupBy("item_id").agg(*[pick(k) for k in types])


def presented_state(state: Column) -> Column:
    out = F.lit("captured")
    for stored, shown in ITEM_STATES.items():
        if shown == "parsed":
            out = F.when(state == stored, "parsed").otherwise(out)
    return out


def remove_items(items: DataFrame, documents: DataFrame, chunks: DataFrame, annotations: DataFrame, ids: DataFrame) -> dict[str, DataFrame]:
    """Take the parsed results of items away and leave the captures: items go back to captured, items
    without a document are left as they are."""
    gone = items.join(ids.select("item_id").distinct(), "item_id").where("active_doc_id is not null").select("item_id", F.col("active_doc_id").alias("doc_id"))
    marked = items.join(gone.select("item_id", F.lit(True).alias("_gone")), "item_id", "left")
    cleared = marked.withColumn("state", F.when(F.col("_gone"), "captured").otherwise(F.col("state"))).withColumn("active_doc_id", F.when(F.col("_gone"), None).otherwise(F.col("active_doc_id"))).select(*items.columns)
    return {"items": cleared, "documents": delete_where(documents, gone, ["doc_id"]), "chunks": delete_where(chunks, gone, ["doc_id"]), "annotations": delete_where(annotations, gone, ["doc_id"])}


def purge_items(tables: Mapping[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Delete items with all that hangs on them. Tables without item_id are cut by doc_id of the items."""
    docs = tables["items"].join(ids.select("item_id").distinct(), "item_id").where("active_doc_id is not null").select(F.col("active_doc_id").alias("doc_id"))
    out = {}
    for name, df in tables.items():
        if "item_id" in df.columns:
            df = delete_where(df, ids, ["item_id"])
        elif "doc_id" in df.columns:
            df = delete_where(df, docs, ["doc_id"])
        if "member_id" in df.columns:
            df = delete_where(df, ids.select(F.col("item_id").alias("member_id")), ["member_id"])
        out[name] = df
    return out


def clear_parsed(items: DataFrame) -> DataFrame:
    """Documents back to captured; collections keep their state."""
    is_doc = F.col("item_type") == "document" if "item_type" in items.columns else F.lit(True)
    out = items.withColumn("state", F.when(is_doc, "captured").otherwise(F.col("state")))
    return out.withColumn("active_doc_id", F.when(is_doc, F.lit(None).cast("string")).otherwise(F.col("active_doc_id"))) if "active_doc_id" in items.columns else out


def latest_states(transitions: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, state, attempts, updated) of a state log: the last state and how often work began."""
    last = F.max(F.struct(*order, "state"))
    return transitions.groupBy(key).agg(last["state"].alias("state"), F.count_if(F.col("state") == "fetching").alias("attempts"), F.count("*").alias("transitions"))


def job_counters(latest: DataFrame, job: str) -> DataFrame:
    """Counters of each job from the latest state of its items; a retried item counts once."""
    count = lambda s: F.count_if(F.col("state") == s).alias(s)
    return latest.groupBy(job).agg(F.count("*").alias("items"), count("saved"), count("skipped"), count("failed"), count("cancelled"))


def recover_stale(items: DataFrame) -> DataFrame:
    """After a crash: items in flight have failed with the code stale."""
    flying = F.col("state").isin("fetching", "parsing", "saving")
    return items.withColumn("error_code", F.when(flying, "stale").otherwise(F.lit(None).cast("string"))).withColumn("state", F.when(flying, "failed").otherwise(F.col("state")))


def retry_failed(items: DataFrame) -> DataFrame:
    failed = F.col("state") == "failed"
    return items.withColumn("state", F.when(failed, "pending").otherwise(F.col("state")))


def first_by(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Keep-first deduplication with a stated order."""
    w = W.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def maintenance_scan(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, rows) of every table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = row if out is None else out.unionByName(row)
    return out
