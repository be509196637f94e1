"""Near-duplicate records with small edits: an exact Jaccard join over sets of word shingles.

Method: a metric-space join with pivots, regions and windows. The Jaccard distance is a metric, and the
pivots are singleton sets {s}, one for each shingle s: a record x lies at distance 1 - 1/|x| from the
pivots it contains, which are its nearest, and at distance 1 from all others. The region of a pivot
is the set of records it is nearest to. Two records within the threshold share most shingles, so
they meet in the regions of many pivots; a record must be placed only into as many of its regions,
the least populated first, as the threshold leaves room for others to miss (its window), and of a
pair the smaller record needs the narrower window. Regions are joined on their own, divided again
where a pivot is populous, and the join is exact: a pair in a region is kept unless the triangle
inequality of set differences over folded parity sketches proves it too far apart, and what is left
is verified on the full sets.

Pivots drawn from the records themselves were given up: unrelated records are at distance 1 from each
other and the window d(x, p) <= d(x, nearest) + 2 * 0.4 then holds for every pivot unless a record
has a pivot within 0.2, so that every record would be copied into every region (README).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorefold.functions.text import WORD
from lorefold.operators.skew import salted_lookup
from lorefold.session import materialise

SHINGLE, SIMILARITY = 3, 0.6
LEAST_SLOTS, MOST_SLOTS, CHUNK = 1 << 21, 1 << 24, 1 << 13
# Bytes of placed records that one region should hold, and population from which a pivot is divided.
REGION_BYTES, POPULOUS = 48_000_000, 20_000
# Rows of ids up to which a side of a join may be broadcast.
BROADCAST_ROWS = 500_000
_EPS = 1e-9
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class WordHashes(dict):
    """64-bit hashes of lower-cased words, remembered while they are few."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.lower()) - (1 << 63)
        return h


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `size` words, from the hashes of the words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    w = words.view(np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h = (h ^ (h >> np.uint64(29))) * _M1 + (w[i : i + n] ^ (w[i : i + n] >> np.uint64(31))) * _M2
    h ^= h >> np.uint64(32)
    h *= _M3
    h ^= h >> np.uint64(29)
    return np.unique(h)


def document_texts(sections: DataFrame) -> DataFrame:
    """(doc_id, text): non-null contents in order of section_index, joined by a line break. Exact
    repeats count once; different contents of one place are kept in their own order."""
    rows = sections.where("doc_id is not null and content is not null").select("doc_id", F.struct("section_index", "content").alias("s"))
    parts = F.transform(F.sort_array("all"), lambda s: s["content"])
    return rows.groupBy("doc_id").agg(F.collect_set("s").alias("all")).select("doc_id", F.array_join(parts, "\n").alias("text"))


def word_table(texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(id, doc_id, words, copy): the hashes of each document's words and their fingerprint, written once so
    that ids are stable. Documents without a shingle are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for b in batches:
            rows = []
            for d, t in zip(b["doc_id"], b["text"]):
                w = np.fromiter(map(known.__getitem__, WORD.findall(t)), np.int64)
                if len(w) >= size:
                    rows.append((d, w, xxhash.xxh3_128_digest(w.tobytes())))
            yield pd.DataFrame(rows, columns=["doc_id", "words", "copy"])

    hashed = texts.mapInPandas(run, "doc_id string, words array<bigint>, copy binary")
    return materialise(hashed.select(F.monotonically_increasing_id().alias("id"), "doc_id", "words", "copy"), "words")


def copy_classes(words: DataFrame) -> DataFrame:
    """(rep, id): the members, the representative among them, of the classes of documents with one and
    the same sequence of words. Classes of one are left out."""
    classes = words.groupBy("copy").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1").select("copy", "rep")
    return materialise(salted_lookup(words.select("id", "copy"), classes, ["copy"], ["id"]).select("rep", "id"), "copies")


def slots_for(total: int) -> int:
    """Slots of the table of populations for so many shingles in all: a power of two, eight shingles a slot
    between the bounds."""
    return min(MOST_SLOTS, max(LEAST_SLOTS, 1 << math.ceil(math.log2(max(1, total / 8)))))


def without_background(q: np.ndarray) -> np.ndarray:
    """Levels of the populations less what a slot holds on the average by mere sharing, so that in a crowded
    table a pivot is populous only if it stands out. Level 0, one record in the whole slot, stays apart
    from all others."""
    background = np.exp2(np.median(q) / 8)
    if background < 16:  # a sparse table: populations are as counted
        return q
    level = np.arange(256)
    above = np.maximum(np.exp2(level / 8) - background, 2)
    # there are 256 levels; float terms of all slots would take hundreds of MB on the driver
    return np.where(level > 0, np.minimum(255, np.round(8 * np.log2(above))), 0).astype(np.uint8)[q]


def populations(words: DataFrame, size: int = SHINGLE, slots: int | None = None) -> tuple[np.ndarray, int, int]:
    """(levels of the populations of hashed pivots, records, shingles in all). The size of the table follows the
    data up to a bound; populations of pivots that share a slot are added up. It decides only the order in
    which regions are taken and which are divided, never which pairs are found."""
    if slots is None:
        slots = slots_for(words.agg(F.sum(F.size("words"))).first()[0] or 0)
    chunk = min(CHUNK, slots)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, docs, total = np.zeros(slots, np.int64), 0, 0
        for b in batches:
            sets = [shingles(w, size) for w in b["words"]]
            docs, total = docs + len(sets), total + sum(map(len, sets))
            if sets:
                table += np.bincount((np.concatenate(sets) & np.uint64(slots - 1)).astype(np.int64), minlength=slots)
        if total:
            parts = [zlib.compress(table[i : i + chunk].astype(np.uint32).tobytes(), 1) for i in range(0, slots, chunk)]
            yield pd.DataFrame({"chunk": range(len(parts)), "counts": parts, "docs": [docs] + [0] * (len(parts) - 1), "total": [total] + [0] * (len(parts) - 1)})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        s = np.zeros(chunk, np.int64)
        for c in pdf["counts"]:
            s += np.frombuffer(zlib.decompress(c), np.uint32)
        q = np.minimum(255, np.round(8 * np.log2(np.maximum(s, 1)))).astype(np.uint8)
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "counts": [zlib.compress(q.tobytes(), 1)], "docs": [pdf["docs"].sum()], "total": [pdf["total"].sum()]})

    schema = "chunk int, counts binary, docs bigint, total bigint"
    rows = words.select("words").mapInPandas(count, schema).groupBy("chunk").applyInPandas(add, schema).collect()
    out = np.zeros(slots, np.uint8)
    for r in rows:
        out[r.chunk * chunk : (r.chunk + 1) * chunk] = np.frombuffer(zlib.decompress(r.counts), np.uint8)
    return without_background(out), sum(r.docs for r in rows), sum(r.total for r in rows)


def sketch_bits(n: int) -> int:
    """Bits of the parity sketch of a set of n shingles: a power of two above 1.3 n, at least 64."""
    return max(64, 1 << math.ceil(math.log2(1.3 * max(n, 1))))


def parity_sketch(s: np.ndarray, bits: int) -> np.ndarray:
    """For each of `bits` classes of hashes, whether the set holds an odd number of them. Sketches of two
    sets differ in at most as many bits as the sets in elements, and folding halves keeps that."""
    odd = np.bincount(((s >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def fold(sketch: np.ndarray, to_bytes: int) -> np.ndarray:
    while len(sketch) > to_bytes:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def window(n: int, similarity: float) -> int:
    """How many regions a record of n shingles is placed in."""
    return n - math.ceil(similarity * n - _EPS) + 1


def narrow_window(n: np.ndarray, similarity: float) -> np.ndarray:
    """How many of them count where the record is the smaller one of a pair."""
    return n - np.ceil(2 * similarity / (1 + similarity) * n - _EPS).astype(np.int64) + 1


def placements(words: DataFrame, table: np.ndarray, regions: int, similarity: float, size: int) -> DataFrame:
    """(region, id, n, pivots, places, own, sketch): each record once in every region that holds some of
    its pivots, with these and their places in the record's order as packed arrays. A populous
    pivot is divided into shares: a record is owned in one share and visits the others."""
    shared = words.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = shared.value
        populous = int(8 * math.log2(POPULOUS))
        for b in batches:
            rows = []
            for rid, w in zip(b["id"], b["words"]):
                s = shingles(w, size)
                n = len(s)
                if not n:
                    continue
                bits = sketch_bits(n)
                sketch = parity_sketch(s, bits).tobytes()
                level = q[(s & np.uint64(len(q) - 1)).astype(np.int64)]
                order = np.argsort(level, kind="stable")[: window(n, similarity)]
                # a pivot counted once in all its slot is in no other record: nobody can be met there
                place = np.flatnonzero(level[order] > 0).astype(np.int32)
                order = order[place]
                if not len(order):
                    continue
                pivot, level = s[order], level[order]
                share = np.zeros(len(pivot), np.uint64)
                own = np.ones(len(pivot), bool)
                if level[-1] >= populous:
                    shares = np.where(level >= populous, np.ceil(np.exp2(level / 8) / POPULOUS), 1).astype(np.int64)
                    at = np.repeat(np.arange(len(pivot)), shares)
                    share = (np.arange(len(at)) - np.repeat(np.cumsum(shares) - shares, shares)).astype(np.uint64)
                    mine = (np.uint64(rid) * _M1 >> np.uint64(40)) % shares.astype(np.uint64)
                    own = share == mine[at]
                    pivot, place = pivot[at], place[at]
                key = pivot + share * _M2
                region = ((key >> np.uint64(33)) % np.uint64(regions)).astype(np.int64)
                by = np.argsort(region, kind="stable")
                cuts = np.flatnonzero(np.diff(region[by])) + 1
                for part in np.split(by, cuts):
                    rows.append((int(region[part[0]]), rid, n, (key[part] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), place[part].tobytes(), own[part].tobytes() if not own.all() else b"", sketch))
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    columns = ["region", "id", "n", "pivots", "places", "own", "sketch"]
    return words.select("id", "words").mapInPandas(run, "region int, id bigint, n int, pivots binary, places binary, own binary, sketch binary")


def join_region(pdf: pd.DataFrame, similarity: float, block: int = 2_000_000) -> pd.DataFrame:
    """Pairs (a, b) of record ids of one region that may be similar. Memory is bounded by the block of
    pairs looked at together; nothing is left out."""
    ids, n = pdf["id"].to_numpy(), pdf["n"].to_numpy().astype(np.int64)
    per = np.array([len(p) // 4 for p in pdf["pivots"]])
    pivot = np.frombuffer(b"".join(pdf["pivots"]), np.uint32)
    place = np.frombuffer(b"".join(pdf["places"]), np.int32).astype(np.int64)
    own = np.frombuffer(b"".join(o or b"\x01" * k for o, k in zip(pdf["own"], per)), bool)
    rec = np.repeat(np.arange(len(ids)), per)
    order = np.lexsort((n[rec], pivot))
    pivot, place, own, rec = pivot[order], place[order], own[order], rec[order]
    size = n[rec]
    starts = np.flatnonzero(np.r_[True, pivot[1:] != pivot[:-1]])
    group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(pivot)]))
    narrow = place < narrow_window(size, similarity)
    key = group * (int(size.max()) + 2) * 2 + size
    stride = (int(size.max()) + 2) * 2
    first = np.flatnonzero(narrow & own)
    most = np.minimum(np.floor(size[first] / similarity + _EPS).astype(np.int64), stride - 1)
    lo = np.searchsorted(key, group[first] * stride + size[first], side="left")
    hi = np.searchsorted(key, group[first] * stride + most, side="right")
    count = hi - lo
    bytes_of = np.array([len(s) for s in pdf["sketch"]])
    levels, folded = np.unique(bytes_of), {}
    for level in levels:
        near = np.flatnonzero((bytes_of == level) | (bytes_of == 2 * level))
        m = np.zeros((len(near), level), np.uint8)
        for r, i in enumerate(near):
            m[r] = fold(np.frombuffer(pdf["sketch"].iat[i], np.uint8), level)
        row = np.full(len(ids), -1, np.int64)
        row[near] = np.arange(len(near))
        folded[int(level)] = (row, m.view(np.uint64))
    overlap, apart = similarity / (1 + similarity), (1 - similarity) / (1 + similarity)
    found = [np.empty(0, np.int64)]
    ends = np.cumsum(count)
    at = 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + block, side="right")))
        # one record with more partners than a block is taken in several steps
        for step in range(0, max(1, int(count[at:to].max())) if to == at + 1 else 1, block):
            c = np.minimum(count[at:to] - step, block) if to == at + 1 else count[at:to]
            a = np.repeat(first[at:to], c)
            b = np.repeat(lo[at:to] + step, c) + np.arange(len(a)) - np.repeat(np.cumsum(c) - c, c)
            keep = rec[a] != rec[b]
            keep &= np.minimum(size[a] - place[a], size[b] - place[b]) >= np.ceil(overlap * (size[a] + size[b]) - _EPS)
            a, b = rec[a[keep]], rec[b[keep]]
            pairs = np.unique(np.minimum(a, b) * len(ids) + np.maximum(a, b))
            a, b = pairs // len(ids), pairs % len(ids)
            level = np.minimum(bytes_of[a], bytes_of[b])
            for width, (row, m) in folded.items():
                z = np.flatnonzero(level == width)
                if len(z):
                    far = np.bitwise_count(m[row[a[z]]] ^ m[row[b[z]]]).sum(axis=1)
                    found.append(pairs[z[far <= apart * (n[a[z]] + n[b[z]]) + _EPS]])
        at = to
    pairs = np.unique(np.concatenate(found))
    a, b = ids[pairs // len(ids)], ids[pairs % len(ids)]
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def similar_ids(words: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE, slots: int | None = None) -> DataFrame:
    """(a, b, similarity): all pairs of ids, a < b, whose sets of shingles reach the similarity."""
    table, docs, total = populations(words, size, slots)
    spark = words.sparkSession
    # a record is in about one region per pivot of its window; each placement carries its sketch
    volume = total * (1 - similarity) * 8 + min(docs * 120, total) * 60
    regions = max(spark.sparkContext.defaultParallelism, math.ceil(volume / REGION_BYTES))
    placed = placements(words, table, regions, similarity, size)
    # more partitions than regions, so that few regions share one by their hashes
    pairs = placed.repartition(4 * regions, "region").groupBy("region").applyInPandas(lambda pdf: join_region(pdf, similarity), "a bigint, b bigint")
    pairs = materialise(pairs.distinct(), "candidates")
    # merged: the planner takes the array of words for 8 bytes and would broadcast the table
    sets = words.select("id", "words")
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("words").alias("wa")).hint("merge"), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("words").alias("wb")).hint("merge"), "b")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for a, b, wa, wb in zip(x["a"], x["b"], x["wa"], x["wb"]):
                sa, sb = shingles(wa, size), shingles(wb, size)
                common = len(np.intersect1d(sa, sb, assume_unique=True))
                j = common / (len(sa) + len(sb) - common)
                if j >= similarity - _EPS:
                    out.append((a, b, j))
            yield pd.DataFrame(out, columns=["a", "b", "similarity"])

    return both.select("a", "b", "wa", "wb").mapInPandas(verify, "a bigint, b bigint, similarity double")


def similar_classes(sections: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, members, pairs): the documents, the classes of copies as (rep, id), and the pairs (a, b,
    similarity) between representatives. Copies never meet in a region."""
    words = word_table(document_texts(sections), size)
    members = copy_classes(words)
    again = members.where("id <> rep").select("id")
    # counted, as the planner goes by the bytes of compressed files
    if again.count() > BROADCAST_ROWS:
        again = again.hint("merge")
    single = words.join(again, "id", "left_anti")
    return words, members, materialise(similar_ids(single, similarity, size), "pairs")


def similar_documents(sections: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """(doc_id_a, doc_id_b, similarity): all pairs, doc_id_a < doc_id_b, at least that similar, copies
    written out.

    Documents with fewer words than a shingle have no set and no pair. Repeated rows count once; null
    ids and contents are not read, very long documents are taken whole. Copies are pairs of
    similarity 1; where they are many, near_duplicate_groups gives the same links without writing out
    pairs. Empty tables give an empty result; columns other than doc_id, section_index and content
    are not read."""
    words, members, pairs = similar_classes(sections, similarity, size)
    return expanded(words, members, pairs)


def expanded(words: DataFrame, members: DataFrame, pairs: DataFrame) -> DataFrame:
    """All pairs of documents from classes of copies and pairs of their representatives. A large class
    is divided by its members wherever it is joined."""
    others = members.where("id <> rep").select("rep", F.col("id").alias("_id"))
    sides = pairs
    for side in ("a", "b"):
        copies = salted_lookup(others, sides.withColumnRenamed(side, "rep"), ["rep"], ["_id"]).withColumn(side, F.col("_id")).select("a", "b", "similarity")
        sides = sides.unionByName(copies)
    within = salted_lookup(members.select("rep", F.col("id").alias("a")), members.select("rep", F.col("id").alias("b")), ["rep"], ["a"])
    within = within.where("a < b").select("a", "b", F.lit(1.0).alias("similarity"))
    name = words.select("id", "doc_id")
    named = sides.unionByName(within).join(name.select(F.col("id").alias("a"), F.col("doc_id").alias("da")).hint("merge"), "a").join(name.select(F.col("id").alias("b"), F.col("doc_id").alias("db")).hint("merge"), "b")
    return named.select(F.least("da", "db").alias("doc_id_a"), F.greatest("da", "db").alias("doc_id_b"), "similarity")


def connected_groups(pairs: DataFrame, a: str = "doc_id_a", b: str = "doc_id_b", max_rounds: int = 60) -> DataFrame:
    """(doc_id, group_id, links): the connected component of every document that has a pair, named by
    its smallest doc_id, and the document's number of pairs. Alternating large-star and small-star
    rounds over edges, each written to the shared folder; rounds grow with the logarithm of a
    component's length. A vertex with very many edges is divided wherever they are joined."""
    edges = materialise(pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    links = edges.select("u").unionAll(edges.select("v")).groupBy("u").agg(F.count("*").alias("links"))
    current, before = edges, None
    for _ in range(max_rounds):
        # large star: every greater neighbour is tied to the least vertex around u
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = salted_lookup(both, least, ["u"], ["v"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its lesser neighbours are tied to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_lookup(large, least, ["u"], ["v"])
        grown = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        current = materialise(grown, "star")
        state = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    root = current.groupBy("u").agg(F.min("v").alias("group_id"))
    return links.join(root.hint("merge"), "u", "left").select(F.col("u").alias("doc_id"), F.coalesce("group_id", "u").alias("group_id"), "links")


def near_duplicate_groups(sections: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """(doc_id, group_id, copies, links): every document with a near duplicate; its group, named by the
    least doc_id, the size of its class of copies and its number of links, copies included. Links
    between classes are counted by their sizes, never written out."""
    words, members, pairs = similar_classes(sections, similarity, size)
    sizes = members.groupBy("rep").agg(F.count("*").alias("n"))
    both = pairs.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    weighed = both.join(sizes.select(F.col("rep").alias("other"), "n").hint("merge"), "other", "left").groupBy("rep").agg(F.sum(F.coalesce("n", F.lit(1))).alias("outer"))
    classes = weighed.join(sizes, "rep", "full").select("rep", F.coalesce("n", F.lit(1)).alias("copies"), (F.coalesce("outer", F.lit(0)) + F.coalesce("n", F.lit(1)) - 1).alias("links"))
    roots = connected_groups(pairs, "a", "b").select(F.col("doc_id").alias("rep"), F.col("group_id").alias("root"))
    classes = classes.join(roots.hint("merge"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    rep_of = words.select("id", "doc_id").join(members.hint("merge"), "id", "left").select("doc_id", "id", F.coalesce("rep", "id").alias("rep"))
    rows = salted_lookup(rep_of, classes, ["rep"], ["id"])
    rows = materialise(rows.select("doc_id", "id", "root", "copies", "links"), "grouped")
    names = rows.groupBy("root").agg(F.min("doc_id").alias("group_id"))
    return salted_lookup(rows, names, ["root"], ["id"]).select("doc_id", "group_id", "copies", "links")
