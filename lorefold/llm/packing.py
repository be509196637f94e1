"""Filling fixed-capacity containers with items.

Method: shortest-pack-first over the histogram of lengths. Lengths are placed from the longest to the
shortest; all items of one length go, as many as fit at once, to the group of containers that is
filled least and still has room for one. What comes out is a list of packing patterns with their
counts, whose size depends on the capacity and not on the number of items. Patterns are then joined
back to items by their rank within their length.

Ranks are made without a global sort: items of one length are divided by a hash of their key, the
groups are counted, and the running sum of the counts is added to the rank within the group.
"""

from __future__ import annotations

import base64
import os
from bisect import insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lorefold.session import materialise

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the public byte-level BPE divides text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def encoding(path: str):  # noqa: ANN201
    """The tokenizer of a ranks file, once per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def token_lengths(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens) of each document; a null text has none. Repeated rows count once; of
    different texts with one id the longest is taken. Null ids are dropped."""
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(tokenizer)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["d"], "tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in b["t"]]})

    rows = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where("d is not null").mapInPandas(run, f"doc_id {kind}, tokens bigint")
    return rows.groupBy("doc_id").agg(F.max("tokens").alias("tokens"))


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(count, [(length, copies), ...]) of each pattern, lengths descending. Every item of the
    histogram is in exactly one container; lengths are between 1 and capacity."""
    groups: dict[int, list[list]] = {}  # room left -> groups [count, pattern]
    rooms: list[int] = []

    def put(room: int, group: list) -> None:
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append(group)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            if rooms and rooms[-1] >= length:
                room = rooms[-1]
                count, pattern = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop()
                used = min(count, left)
                if used < count:
                    put(room, [count - used, pattern])
                # one item per container, so that the least filled containers stay level
                grown = [*pattern[:-1], (length, pattern[-1][1] + 1)] if pattern[-1][0] == length else [*pattern, (length, 1)]
                put(room - length, [used, grown])
                left -= used
            else:
                copies = capacity // length
                # fresh containers: only as many as the remaining items of this length fill
                full, rest = divmod(left, copies)
                if full:
                    put(capacity - copies * length, [full, [(length, copies)]])
                if rest:
                    put(capacity - rest * length, [1, [(length, rest)]])
                left = 0
    return [(count, pattern) for room in sorted(groups) for count, pattern in groups[room]]


def slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> pd.DataFrame:
    """One row per place in a pattern: the items of `length` with ranks from first_rank on, `count`
    of them, go to the containers from first_container on, at `position`, behind `offset` tokens."""
    next_rank: dict[int, int] = {}
    rows, container = [], 0
    for count, pattern in patterns:
        position = offset = 0
        for length, copies in pattern:
            for _ in range(copies):
                rank = next_rank.get(length, 0)
                rows.append((length, rank, count, container, position, offset))
                next_rank[length] = rank + count
                position, offset = position + 1, offset + length
        container += count
    return pd.DataFrame(rows, columns=["length", "first_rank", "count", "first_container", "position", "offset"])


def ranked(items: DataFrame, group: str, key: list[str], salts: int) -> DataFrame:
    """items with rank, from 0, among the rows of their group in the order of (salt, key)."""
    salted = items.withColumn("_salt", F.pmod(F.xxhash64(*key), F.lit(salts)).cast("int"))
    counts = salted.groupBy(group, "_salt").agg(F.count("*").alias("_n"))
    before = W.partitionBy(group).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(group, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(W.partitionBy(group, "_salt").orderBy(*key)) - 1
    return salted.withColumn("_rank", within).join(starts, [group, "_salt"]).withColumn("rank", F.col("_start") + F.col("_rank")).drop("_salt", "_rank", "_start")


def pack(lengths: DataFrame, capacity: int = CAPACITY, doc_id: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """(doc_id, piece, from_token, tokens, container, position, offset), one row per item.

    A document within the capacity is one item; a longer one is divided into pieces of the capacity
    and a rest. Null and zero lengths take no room: such documents are spread over the containers in
    turn behind their items, at position -1 with offset null. The keys must be unique. Ties between
    equal lengths are broken by the hash of the key. Empty tables give an empty result."""
    spark = lengths.sparkSession
    n = F.coalesce(F.col(tokens), F.lit(0)).cast("bigint")
    base = lengths.select(F.col(doc_id).alias("doc_id"), n.alias("all"))
    pieces = F.when(F.col("all") > 0, F.sequence(F.lit(0), ((F.col("all") - 1) / capacity).cast("int"))).otherwise(F.array(F.lit(0)))
    items = base.select("doc_id", "all", F.explode(pieces).alias("piece")).select(
        "doc_id", "piece", (F.col("piece").cast("bigint") * capacity).alias("from_token"), F.least(F.col("all") - F.col("piece").cast("bigint") * capacity, F.lit(capacity)).cast("int").alias("tokens")
    )
    items = materialise(items, "items")
    histogram = {r.tokens: r.n for r in items.groupBy("tokens").agg(F.count("*").alias("n")).collect()}  # at most capacity + 1 rows
    empty = histogram.pop(0, 0)
    patterns = shortest_pack_first(histogram, capacity)
    table = slots(patterns)
    containers = max(1, sum(c for c, _ in patterns))
    by_length = {int(k): tuple(g[c].to_numpy() for c in ("first_rank", "first_container", "position", "offset")) for k, g in table.groupby("length")}
    shared = spark.sparkContext.broadcast(by_length)
    most = max([empty, *histogram.values()], default=0)
    order = ranked(items, "tokens", ["doc_id", "piece"], max(16, most // 250_000))
    kind = dict(items.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[["doc_id", "piece", "from_token", "tokens"]].copy()
            rank, length = b["rank"].to_numpy(), b["tokens"].to_numpy()
            container, position = np.empty(len(b), np.int64), np.full(len(b), -1, np.int32)
            offset = np.full(len(b), -1, np.int32)
            for value in np.unique(length):
                at = np.flatnonzero(length == value)
                if value == 0:
                    container[at] = rank[at] % containers
                    continue
                first, to, place, behind = shared.value[int(value)]
                i = np.searchsorted(first, rank[at], side="right") - 1
                container[at] = to[i] + rank[at] - first[i]
                position[at], offset[at] = place[i], behind[i]
            yield out.assign(container=container, position=position, offset=pd.array(offset, dtype="Int32")).assign(offset=lambda d: d["offset"].mask(d["position"] < 0))

    return order.mapInPandas(run, f"doc_id {kind}, piece int, from_token bigint, tokens int, container bigint, position int, offset int")


def utilisation(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(containers, tokens, fill): one row, fill being the share of the containers' room in use."""
    return packed.agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens")).select("containers", "tokens", (F.col("tokens") / (F.col("containers") * capacity)).alias("fill"))
