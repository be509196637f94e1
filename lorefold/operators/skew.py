"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of one key that one task may hold.
ROWS_PER_TASK = 500_000


def salted_lookup(rows: DataFrame, lookup: DataFrame, keys: list[str], spread: list[str], how: str = "inner", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Join rows with a lookup by keys. Keys are counted first; one with more than rows_per_task rows is
    divided by the hash of the spread columns into as many parts as its count asks for, and the
    lookup's rows of that key, and of no other, are repeated for each part. The hot keys are
    broadcast: there are at most rows / rows_per_task of them. Null keys meet nothing; no row is dropped
    or capped."""
    hot = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > rows_per_task)
    hot = F.broadcast(hot.select(*keys, F.ceil(F.col("_n") / rows_per_task).cast("int").alias("_parts")))
    left = rows.join(hot, keys, "left").withColumn("_part", F.pmod(F.xxhash64(*spread), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    right = lookup.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return left.join(right, [*keys, "_part"], how).drop("_part")
