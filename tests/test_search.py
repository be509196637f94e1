import sqlite3

from pyspark.sql import functions as F

from lorefold.operators import search as se
from lorefold.plans import library

DOCS = [(1, "Alpha", "the quick brown fox, the lazy dog"), (2, "Beta fox", "a fox's résumé and the dog"), (3, None, "nothing here"), (4, "Dog", "dog dog dog cat"), (5, "Empty", None)]
QUERIES = [(1, "fox dog"), (2, "resume"), (3, "dog dog zebra"), (4, "")]


def scores(spark):
    docs = spark.createDataFrame(DOCS, "id bigint, title string, text string")
    q = spark.createDataFrame(QUERIES, "qid bigint, q string")
    return se.bm25(se.postings(docs, "id", "title", "text"), se.corpus_statistics(docs, "id", "title", "text"), se.query_terms(q, "qid", "q"))


def test_bm25_equals_an_sqlite_index(spark):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(title, text)")
    db.executemany("insert into f(rowid, title, text) values (?, ?, ?)", [(i, t or "", x or "") for i, t, x in DOCS])
    got = {(r.query_id, r.key): r.score for r in scores(spark).collect()}
    want = {}
    for qid, q in QUERIES:
        match = " OR ".join(f'"{w}"' for w in q.split())
        if match:
            want |= {(qid, row): -rank for row, rank in db.execute("select rowid, rank from f where f match ?", (match,))}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_top_hits_and_evaluation(spark):
    top = se.top_hits(scores(spark), 1)
    assert {(r.query_id, r["rank"]) for r in top.collect()} == {(1, 1), (2, 1), (3, 1)}
    expected = spark.createDataFrame([(2, 2), (4, 1)], "query_id bigint, key bigint")
    row = se.evaluate(top, expected).first()
    assert (row.queries, row.hit_at_1) == (2, 0.5)


def loop(items, budget):
    used, out = 0, []
    for rank, title, url, text in items:
        if used > budget and out:
            break
        base = text if len(text) <= 800 else text[:800] + se.TRUNCATED
        prefix = f"[{rank}] {title}\nSource: {url or 'unknown'}\n"
        room = budget - used - len(prefix)
        content = base if len(base) <= room or room <= 12 else base[: room - 12] + se.TRUNCATED
        if out and len(prefix) + len(content) > budget - used and room <= 12:
            break
        out.append(content)
        used += len(prefix) + len(base)
    return out


def test_context_equals_a_loop(spark):
    items = [(i + 1, f"t{i}", None if i == 1 else "u", "x" * n) for i, n in enumerate([100, 900, 50, 700, 30])]
    df = spark.createDataFrame([(1, *x) for x in items], "query_id int, rank int, display_title string, source_url string, text string")
    for budget in (1, 120, 500, 1100, 6000):
        got = [r.content for r in se.context_blocks(df, budget).orderBy("rank").collect()]
        assert got == loop(items, budget), budget


def test_trace_and_phrases(spark):
    hits = spark.createDataFrame([("How is the fox-trot 2", "Fox", "", "The fox-trot, 2 steps")], "q string, title string, heading string, text string")
    r = se.search_trace(hits, "q", "title", "heading", "text").first()
    assert (r.matched_terms, r.term_coverage, r.title_matches, r.phrase_matched) == (2, 1.0, 0, True)
    docs = spark.createDataFrame(DOCS, "id bigint, title string, text string")
    assert [x.key for x in se.phrase_hits(docs, "id", "text", "lazy-dog").collect()] == [1]
    assert spark.range(1).select(se.trace_terms(F.lit("the of")).alias("t")).first().t == []


def test_expected_documents_hold_the_whole_passage(spark, tmp_path):
    words = [f"w{i}" for i in range(12)]
    passages = [(1, " ".join(words), "zebra"), (2, "short one", "okapi"), (3, "", "quagga")]
    docs = [(1, "zebra zebra", "zebra zebra " + " ".join(words[:9]), "s"), (2, None, "A " + ", ".join(words) + ". zebra", "s"), (3, None, "this short one is an okapi", "s"), (4, None, "short okapi okapi", "s"), (5, None, None, "s")]
    spark.createDataFrame(docs, "doc_id bigint, title string, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, "", q, p) for i, p, q in passages], "eval_id bigint, question string, answer string, passage string").write.parquet(f"{tmp_path}/eval_items.parquet")
    row = library.QUERIES["retrieval_eval"](spark, str(tmp_path)).first()
    assert (row.queries, row.hit_at_1, row.hit_at_3) == (2, 0.0, 1.0)
