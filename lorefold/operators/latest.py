"""The row that holds for a key in a log of upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_hash(columns: list[str]) -> Column:
    """64-bit fingerprint of the given columns; maps are compared by their sorted entries."""
    return F.xxhash64(*[F.col(c) for c in columns])


def holding_rows(df: DataFrame, keys: list[str], order: str, columns: list[str] | None = None) -> DataFrame:
    """One row per key: the one with the greatest `order`. Nulls in `order` rank lowest; ties
    between different rows go to the greater fingerprint of the kept columns, then to the greater
    value, so that the result is the same in every run. Rows with a null key are dropped.
    max_by aggregates before the shuffle, so a key with very many rows costs one row per map task.
    An empty table gives an empty result.
    """
    kept = columns or [c for c in df.columns if c not in keys]
    plain = [c for c in kept if not dict(df.dtypes)[c].startswith("map")]
    df = df.where(F.expr(" and ".join(f"`{k}` is not null" for k in keys)))
    rank = F.struct(F.col(order).alias("o"), row_hash(plain).alias("h"))
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in kept]), rank).alias("_row"))
    return best.select(*keys, *[F.col("_row").getField(c).alias(c) for c in kept])
