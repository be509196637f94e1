"""Lines repeated across one site's documents.

Method: PrefixSpan over the sequences of line identifiers of each site's documents. A pattern is a
sequence of lines that occurs, in order, in at least `min_docs` different documents of a site. The
pattern tree is grown until no pattern is frequent: the projected database of a pattern holds what follows
its earliest match in each document, and its frequent extensions are the lines that stand there in enough
documents. The tree is grown over the cluster, a level at a time, for as long as a pattern's database is
larger than one task should hold; the databases that are smaller are grown to their ends in one pass,
many at a time.

Lines that always stand together, one right behind the other, are one symbol of the sequences: long texts
that a site holds in many copies would otherwise have as many frequent sequences as subsets of
their lines. The lines of a symbol have one support, so no frequent line is lost by it.

The places to delete are those of the lines of the frequent sequences found.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lorefold.functions.text import host_key, line_key
from lorefold.operators.latest import holding_rows
from lorefold.operators.skew import salted_lookup
from lorefold.session import materialise

TEXT_TYPES = ("paragraph", "blockquote")


def document_sites(items: DataFrame) -> DataFrame:
    """(doc_id, site) of the holding row of each item; documents without a URL have no row."""
    held = holding_rows(items, ["item_id"], "updated_at", ["active_doc_id", "normalized_url"])
    return held.select(F.col("active_doc_id").alias("doc_id"), host_key(F.col("normalized_url")).alias("site")).where("doc_id is not null and site is not null").distinct()


def section_lines(sections: DataFrame) -> DataFrame:
    """(doc_id, section_index, line_no, line): non-blank lines as 64-bit keys, repeats removed.
    Null contents and ids have no lines."""
    lines = (
        sections.where(F.col("type").isin(*TEXT_TYPES) & F.col("content").isNotNull() & F.col("doc_id").isNotNull() & F.col("section_index").isNotNull())
        .select("doc_id", "section_index", F.posexplode(F.split("content", "\n", -1)).alias("line_no", "_text"))
        .withColumn("_key", line_key(F.col("_text")))
        .where("_key <> ''")
    )
    return lines.select("doc_id", "section_index", "line_no", F.xxhash64("_key").alias("line")).distinct()


def site_lines(sections: DataFrame, items: DataFrame) -> DataFrame:
    """Lines with the site of their document. Only hashes are shuffled, never texts."""
    return section_lines(sections).join(document_sites(items), "doc_id")


def frequent_lines(lines: DataFrame, min_docs: int = 6) -> DataFrame:
    """Patterns of length one: (site, line, docs). The distinct step carries the document in its
    key, and the count is combined before its shuffle, so neither a large site nor a line that
    stands in all its documents meets in one task."""
    return lines.select("site", "line", "doc_id").distinct().groupBy("site", "line").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs)


def line_runs(database: DataFrame) -> DataFrame:
    """(site, line, head, place): for each line of the database (site, doc_id, pos, line) that continues
    another one, the first line of its run and its place there. Line b continues line a if it follows each
    a, and nothing else stands before a b. Runs are closed by pointer doubling, in as many rounds
    as the logarithm of the longest."""
    after = database.select("site", "doc_id", (F.col("pos") - 1).alias("pos"), F.col("line").alias("next"))
    pairs = database.join(after, ["site", "doc_id", "pos"]).groupBy("site", "line", "next").agg(F.count("*").alias("both"))
    counts = database.groupBy("site", "line").agg(F.count("*").alias("n"))
    follows = pairs.join(counts, ["site", "line"]).where("both = n").join(counts.select("site", F.col("line").alias("next"), F.col("n").alias("m")), ["site", "next"]).where("both = m and line <> next")
    jumps = materialise(follows.select("site", F.col("next").alias("line"), F.col("line").alias("head"), F.lit(1).alias("place")), "runs")
    while True:
        far = jumps.select("site", F.col("line").alias("head"), F.col("head").alias("_head"), F.col("place").alias("_place"))
        if jumps.join(far, ["site", "head"], "left_semi").isEmpty():
            return jumps
        joined = jumps.join(far, ["site", "head"], "left")
        jumps = materialise(joined.select("site", "line", F.coalesce("_head", "head").alias("head"), (F.col("place") + F.coalesce("_place", F.lit(0))).alias("place")), "runs")


def grow_locally(pdf: pd.DataFrame, min_docs: int) -> pd.DataFrame:
    """All frequent extensions of one pattern from its projected database, one row a document."""
    out: list[tuple[list[int], int]] = []
    stack = [(pdf["pattern"].iloc[0].tolist(), [r.tolist() for r in pdf["rest"]])]
    while stack:
        pattern, rests = stack.pop()
        counts = Counter(x for r in rests for x in set(r))
        for symbol, docs in counts.items():
            if docs >= min_docs:
                longer = [*pattern, symbol]
                out.append((longer, docs))
                stack.append((longer, [r[r.index(symbol) + 1 :] for r in rests if symbol in r]))
    return pd.DataFrame([(pdf["site"].iloc[0], p, n) for p, n in out], columns=["site", "pattern", "docs"])


def frequent_sequences(lines: DataFrame, min_docs: int = 6, local_lines: int = 200_000) -> DataFrame:
    """PrefixSpan: (site, pattern, docs) with pattern an array of line keys.

    The database is first reduced to frequent lines, and those that always stand together to their first
    one. A document that repeats a line is projected at its earliest match, as the algorithm demands,
    so that each document counts once per pattern. Lines of one place, which only different contents
    of that place can have, stand in the order of their keys. A pattern whose database has more than local_lines
    lines is grown by a further level over the cluster."""
    hot = frequent_lines(lines, min_docs)
    kept = salted_lookup(lines, hot.select("site", "line"), ["site", "line"], ["doc_id"])
    order = W.partitionBy("site", "doc_id").orderBy("section_index", "line_no", "line")
    database = materialise(kept.select("site", "doc_id", "line", F.row_number().over(order).alias("pos")), "sequences")
    runs = line_runs(database)
    heads = database.join(runs.select("site", "line"), ["site", "line"], "left_anti")
    sequences = heads.groupBy("site", "doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias("all"))
    rest_of = lambda seq, line: F.slice(seq, (F.array_position(seq, line) + 1).cast("int"), F.greatest(F.size(seq), F.lit(1)))
    first = sequences.select("site", "doc_id", "all", F.explode(F.array_distinct("all")).alias("line"))
    projected = materialise(first.select("site", "doc_id", F.array("line").alias("pattern"), rest_of(F.col("all"), F.col("line")).alias("rest")), "projected")
    found = projected.groupBy("site", "pattern").agg(F.count("*").alias("docs"))
    while True:
        projected = projected.where(F.size("rest") > 0)
        sizes = projected.groupBy("site", "pattern").agg(F.sum(F.size("rest")).alias("size"))
        small = projected.join(sizes.where(F.col("size") <= local_lines), ["site", "pattern"], "left_semi").select("site", "pattern", "rest")
        grown = small.groupBy("site", "pattern").applyInPandas(lambda pdf: grow_locally(pdf, min_docs), "site string, pattern array<bigint>, docs bigint")
        found = found.unionByName(grown)
        large = F.broadcast(sizes.where(F.col("size") > local_lines).select("site", "pattern"))
        next_level = projected.join(large, ["site", "pattern"]).select("site", "doc_id", "pattern", "rest", F.explode(F.array_distinct("rest")).alias("line"))
        grown = materialise(next_level.select("site", "doc_id", F.concat("pattern", F.array("line")).alias("pattern"), rest_of(F.col("rest"), F.col("line")).alias("rest")), "projected")
        if grown.isEmpty():
            break
        support = grown.groupBy("site", "pattern").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs)
        found = found.unionByName(support)
        projected = materialise(salted_lookup(grown, support.select("site", "pattern"), ["site", "pattern"], ["doc_id"]), "projected")
    # symbols back to their lines; most stand for themselves alone
    spelled = materialise(found, "patterns")
    if runs.isEmpty():
        return spelled
    tails = runs.groupBy("site", "head").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]).alias("tail"))
    steps = spelled.select("site", "pattern", "docs", F.posexplode("pattern").alias("step", "head")).join(tails, ["site", "head"], "left")
    run = F.concat(F.array("head"), F.coalesce("tail", F.array().cast("array<bigint>")))
    whole = steps.groupBy("site", "pattern", "docs").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("step", run.alias("run")))), lambda x: x["run"])).alias("whole"))
    return whole.select("site", F.col("whole").alias("pattern"), "docs")


def repeated_places(sections: DataFrame, items: DataFrame, min_docs: int = 6) -> DataFrame:
    """Places (doc_id, section_index, line_no) of the lines of frequent sequences.

    Nulls: sections without content and documents without a site have no places. Repeated rows count
    once. Ties cannot occur, since a line counts by documents. Empty tables give an empty result;
    further columns of the inputs are not read."""
    lines = materialise(site_lines(sections, items), "site-lines")  # read for each level, then looked up
    patterns = frequent_sequences(lines, min_docs)
    hot = patterns.select("site", F.explode("pattern").alias("line")).distinct()
    return salted_lookup(lines, hot, ["site", "line"], ["doc_id"]).select("doc_id", "section_index", "line_no").distinct()


def site_sequences(sections: DataFrame, items: DataFrame, min_docs: int = 6) -> DataFrame:
    """The frequent sequences of the sites' documents."""
    return frequent_sequences(materialise(site_lines(sections, items), "site-lines"), min_docs)


def without_repeated_lines(sections: DataFrame, items: DataFrame, min_docs: int = 6) -> DataFrame:
    """Every distinct (doc_id, section_index) with its content less the repeated lines. Contents of
    other types, nulls and documents without a site come back unchanged; a section of which
    nothing is left has an empty content."""
    places = repeated_places(sections, items, min_docs).groupBy("doc_id", "section_index").agg(F.collect_set("line_no").alias("_drop"))
    base = sections.select("doc_id", "section_index", "type", "content").distinct()
    joined = base.join(places, ["doc_id", "section_index"], "left")
    kept = F.filter(F.split("content", "\n", -1), lambda x, i: ~F.array_contains(F.col("_drop"), i))
    hit = F.col("_drop").isNotNull() & F.col("type").isin(*TEXT_TYPES) & F.col("content").isNotNull()
    return joined.select("doc_id", "section_index", F.when(hit, F.array_join(kept, "\n")).otherwise(F.col("content")).alias("content"))
