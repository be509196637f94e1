"""Retrieval: an inverted index with BM25 ranking, search traces and context packing.

Postings are rows (term, doc_key, tf, size). Batches of queries are joined with postings on the term, so a
thousand queries cost one pass; scores are summed before the shuffle. Terms that stand in a large
share of all chunks are spread over several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lorefold.operators.skew import salted_lookup
from lorefold.session import materialise

K1, B = 1.2, 0.75
SEARCH_LIMIT, SEARCH_MAX = 20, 50
CONTEXT_CHARS, CONTEXT_LIMIT, BLOCK_CHARS = 6000, 10, 800
TRUNCATED = "\n[truncated]"
# Letters with marks and their plain forms, for tokens that ignore marks.
MARKED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿāăąćĉċčďđēĕėęěĝğġģĥħĩīĭįĵķĺļľłńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
PLAIN = "aaaaaaceeeeiiiinoooooøuuuuyyaaaccccdđeeeeegggghħiiiijklllłnnnooorrrssssttuuuuuuwyzzz"
# Words left out of search traces.
STOP_WORDS = ("a", "an", "and", "are", "as", "for", "how", "in", "is", "of", "on", "or", "the", "to", "vs", "what", "when", "with")
assert len(MARKED) == len(PLAIN)


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower case, marks removed."""
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(text, F.lit(""))), MARKED, PLAIN), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def postings(chunks: DataFrame, key: str, *fields: str) -> DataFrame:
    """(key, term, tf, size): occurrences of each term over all fields, and the row's length in tokens.
    Rows without tokens have no postings. The row is split in place: nothing is shuffled but terms."""
    toks = F.flatten(F.array(*[tokens(F.col(f)) for f in fields]))
    rows = chunks.select(F.col(key).alias("key"), toks.alias("toks")).select("key", F.size("toks").alias("size"), F.explode("toks").alias("term"))
    return rows.groupBy("key", "term", "size").agg(F.count("*").alias("tf"))


def corpus_statistics(chunks: DataFrame, key: str, *fields: str) -> DataFrame:
    """(n, avg_size): one row; rows without tokens count."""
    toks = F.flatten(F.array(*[tokens(F.col(f)) for f in fields]))
    return chunks.agg(F.count(F.col(key)).alias("n"), F.avg(F.size(toks)).alias("avg_size"))


def document_frequencies(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"))


def query_terms(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """(query_id, term, weight): the query's tokens; a repeated token counts as often."""
    return queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("weight"))


def bm25(post: DataFrame, stats: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, key, score), higher is better. The inverse frequency is at least 1e-6. A query term
    that is in no row adds nothing; rows without any term are no hits."""
    wanted = terms.select("term").distinct()
    hit = materialise(post.join(wanted, "term", "left_semi").select("key", "term", "tf", "size"), "hits")  # counted, then scored
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    counts = df.withColumn("_one", F.lit(1)).join(F.broadcast(stats.select("n", "avg_size", F.lit(1).alias("_one"))), "_one")
    raw = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = terms.join(counts, "term").select("term", "query_id", (F.col("weight") * F.when(raw > 0, raw).otherwise(1e-6)).alias("w"), F.coalesce("avg_size", F.lit(1.0)).alias("average"))
    joined = salted_lookup(hit, weighted, ["term"], ["key"])
    part = F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("average")))
    return joined.groupBy("query_id", "key").agg(F.sum(part).alias("score"))


def top_hits(scores: DataFrame, limit: int = SEARCH_LIMIT) -> DataFrame:
    """scores with rank, the best `limit` of each query (between 1 and 50). Scores that agree to nine digits
    are ties, whatever the order they were summed in; ties go to the lesser key."""
    k = max(1, min(limit or SEARCH_LIMIT, SEARCH_MAX))
    w = W.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "key")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def phrase_hits(chunks: DataFrame, key: str, text: str, phrase: str) -> DataFrame:
    """Rows whose tokens hold the phrase's tokens in a row: what a quoted query with inner separators means."""
    rows = chunks.select(F.col(key).alias("key"), F.concat(F.lit(" "), F.array_join(tokens(F.col(text)), " "), F.lit(" ")).alias("line"))
    wanted = F.concat(F.lit(" "), F.array_join(tokens(F.lit(phrase)), " "), F.lit(" "))
    return rows.where(F.contains("line", wanted)).select("key")


def trace_terms(query: Column) -> Column:
    """Distinct lower-case words and numbers of a query without stop words."""
    found = F.regexp_extract_all(query, F.lit(r"[A-Za-z][A-Za-z0-9_.-]*|[0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, F.lower), lambda t: ~t.isin(*STOP_WORDS)))


def search_trace(hits: DataFrame, query: str, title: str, heading: str, text: str) -> DataFrame:
    """hits with matched_terms, term_coverage, title_matches, heading_matches and phrase_matched (all
    terms stand in the text). Coverage without terms is 1."""
    terms = trace_terms(F.col(query))
    within = lambda field: (lambda t: F.contains(F.lower(F.coalesce(F.col(field), F.lit(""))), t))
    matched = F.filter("_terms", lambda t: within(title)(t) | within(text)(t))
    return (
        hits.withColumn("_terms", terms)
        .withColumn("matched_terms", F.size(matched))
        .withColumn("term_coverage", F.when(F.size("_terms") == 0, 1.0).otherwise(F.size(matched) / F.size("_terms")))
        .withColumn("title_matches", F.size(F.filter("_terms", within(title))))
        .withColumn("heading_matches", F.size(F.filter("_terms", within(heading))))
        .withColumn("phrase_matched", (F.size("_terms") > 0) & F.forall("_terms", within(text)))
        .drop("_terms")
    )


def context_blocks(ranked: DataFrame, max_chars: int = CONTEXT_CHARS, limit: int = CONTEXT_LIMIT) -> DataFrame:
    """Citations packed under a budget of characters. ranked: (query_id, rank, display_title,
    source_url, text). A text over 800 characters is cut and marked; the block that crosses the budget
    is shortened if more than 12 characters remain for it, and nothing is packed behind it. The
    first block is always packed. One running sum per query decides; no loop."""
    full = F.col("text")
    base = F.when(F.length(full) > BLOCK_CHARS, F.concat(F.substring(full, 1, BLOCK_CHARS), F.lit(TRUNCATED))).otherwise(full)
    label = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("display_title"), F.lit("\nSource: "), F.coalesce("source_url", F.lit("unknown")), F.lit("\n"))
    w = W.partitionBy("query_id").orderBy("rank")
    rows = ranked.where(F.col("rank") <= limit).withColumn("base", base).withColumn("prefix", label)
    rows = rows.withColumn("used", F.sum(F.length("prefix") + F.length("base")).over(w))
    before = F.col("used") - F.length("prefix") - F.length("base")
    room = F.lit(max_chars) - before - F.length("prefix")
    take = (F.col("rank") == 1) | ((before <= max_chars) & ((F.col("used") <= max_chars) | (room > 12)))
    content = F.when((F.length("base") <= room) | (room <= 12), F.col("base")).otherwise(F.concat(F.substring("base", F.lit(1), room - 12), F.lit(TRUNCATED)))
    return rows.where(take).select("query_id", "rank", "display_title", "source_url", content.alias("content"), (F.length(full) > BLOCK_CHARS).alias("truncated"), "prefix")


def context_text(blocks: DataFrame) -> DataFrame:
    """(query_id, citations, context, used_chars): the rendered context of each query."""
    label = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("display_title"), F.lit("\nSource: "), F.coalesce("source_url", F.lit("unknown")), F.lit("\n"), F.col("content"))
    grouped = blocks.groupBy("query_id").agg(F.count("*").alias("citations"), F.sort_array(F.collect_list(F.struct("rank", label.alias("block")))).alias("b"))
    text = F.array_join(F.transform("b", lambda x: x["block"]), "\n\n")
    return grouped.select("query_id", "citations", text.alias("context")).withColumn("used_chars", F.length("context"))


def evaluate(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: queries, hit_at_1, hit_at_3, hit_at_5. hits: (query_id, key, rank); expected: (query_id,
    key). A query's rank is the best of its expected keys; a query without any is no hit."""
    best = expected.join(hits.select("query_id", "key", "rank"), ["query_id", "key"], "left").groupBy("query_id").agg(F.min("rank").alias("best"))
    at = lambda k: F.coalesce(F.avg(F.when(F.col("best") <= k, 1.0).otherwise(0.0)), F.lit(0.0)).alias(f"hit_at_{k}")
    return best.agg(F.count("*").alias("queries"), at(1), at(3), at(5))


def url_matches(result: Column, expected: Column) -> Column:
    """A result counts for an expected address if it equals it or lies below it."""
    return (result == expected) | F.startswith(result, F.concat(expected, F.lit("/")))
