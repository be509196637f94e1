"""A kept inverted index: segments of postings, divided by the hash of the term and sorted by it.

Every change adds a segment: the postings of new or changed rows, their lengths, and the keys it takes out of
all segments before it. A segment counts once its lengths are written, which is done last, so a failed
write leaves nothing that is read. Queries read the buckets of their terms; statistics come from the lengths, never
from the texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorefold.operators import search

BUCKETS = 64


class SearchIndex:
    """Segments under a root folder of any file system Spark can write. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):  # noqa: ANN202
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def segments(self) -> list[str]:
        """Names of the complete segments, the first one first."""
        fs, p = self._fs(self.root)
        if not fs.exists(p):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(p))
        return [n for n in names if fs.exists(self._fs(f"{self.root}/{n}/sizes/_SUCCESS")[1])]

    def add(self, rows: DataFrame, key: str, *fields: str, gone: DataFrame | None = None) -> None:
        """Index rows, which replace those of equal keys; the keys of `gone` (one column named as key) leave
        the index. Null keys are not indexed."""
        have = self.segments()
        path = f"{self.root}/{len(have):06}-{uuid.uuid4().hex[:8]}"
        rows = rows.where(F.col(key).isNotNull())
        out = lambda df, name, *by: df.write.option("compression", "zstd").mode("overwrite").partitionBy(*by).parquet(f"{path}/{name}")
        bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")
        post = search.postings(rows, key, *fields).withColumn("bucket", bucket)
        out(post.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(8))).sortWithinPartitions("bucket", "term"), "postings", "bucket")
        if have:
            taken = rows.select(F.col(key).alias("key"))
            if gone is not None:
                taken = taken.unionByName(gone.select(F.col(key).alias("key")))
            out(taken.distinct(), "taken")
        tokens = F.flatten(F.array(*[search.tokens(F.col(f)) for f in fields]))
        out(rows.select(F.col(key).alias("key"), F.size(tokens).alias("size")), "sizes")

    def _standing(self, name: str) -> DataFrame:
        """Rows of all segments less those whose key a later segment takes out."""
        found, taken = None, None
        for s in reversed(self.segments()):
            rows = self.spark.read.parquet(f"{self.root}/{s}/sizes")
            if name == "postings":  # a segment that only takes out has none, and no schema of its own
                kind = dict(rows.dtypes)["key"]
                rows = self.spark.read.schema(f"key {kind}, term string, tf bigint, size int, bucket int").parquet(f"{self.root}/{s}/postings")
            if taken is not None:
                rows = rows.join(taken, "key", "left_anti")
            found = rows if found is None else found.unionByName(rows.select(*found.columns))
            fs, p = self._fs(f"{self.root}/{s}/taken")
            if fs.exists(p):
                more = self.spark.read.parquet(f"{self.root}/{s}/taken")
                taken = more if taken is None else taken.unionByName(more)
        if found is None:
            raise LookupError(f"no index at {self.root}")
        return found

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """(key, term, tf, size, bucket), of the given terms only if there are any."""
        rows = self._standing("postings")
        if terms is not None:
            buckets = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "term string").select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")).distinct().collect()]
            rows = rows.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
        return rows

    def statistics(self) -> DataFrame:
        """(n, avg_size): one row."""
        return self._standing("sizes").agg(F.count("*").alias("n"), F.avg("size").alias("avg_size"))

    def scores(self, terms: DataFrame) -> DataFrame:
        """Scores of (query_id, term, weight). The terms' buckets prune the postings as the query runs."""
        wanted = terms.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")).select("bucket", "term").distinct()
        return search.bm25(self.postings().join(wanted, ["bucket", "term"], "left_semi"), self.statistics(), terms)

    def compact(self, key_type: str = "string") -> None:
        """All segments written as one; the others are deleted behind it. Readers that began before keep to
        no segment of theirs, so compact when nothing reads."""
        old = self.segments()
        if len(old) < 2:
            return
        path = f"{self.root}/{len(old):06}-{uuid.uuid4().hex[:8]}"
        self._standing("postings").repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(8))).sortWithinPartitions("bucket", "term").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings")
        sizes = self._standing("sizes")
        # while both stand, the new segment takes out everything before it
        self.spark.read.parquet(*[f"{self.root}/{s}/sizes" for s in old]).select("key").distinct().write.parquet(f"{path}/taken")
        sizes.write.option("compression", "zstd").parquet(f"{path}/sizes")
        for s in old:
            fs, p = self._fs(f"{self.root}/{s}")
            fs.delete(p, True)
