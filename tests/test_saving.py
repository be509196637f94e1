import pytest
from pyspark.sql import functions as F

from lorefold.operators import saving as sv
from lorefold.operators import search as se
from lorefold.operators import settings as st
from lorefold.operators.index import SearchIndex
from lorefold.operators.store import Store

ITEM = "item_id string, active_rawdoc_id string, active_doc_id string, state string, created_at int"


def tables(spark):
    make = spark.createDataFrame
    return {
        "items": make([("a", "ra1", "da1", "parsed", 1), ("b", "rb1", None, "captured", 1)], ITEM),
        "documents": make([("da1", "a")], "doc_id string, item_id string"),
        "chunks": make([("da1#0", "da1"), ("x#0", "x")], "chunk_id string, doc_id string"),
        "rawdocs": make([("ra1", "a"), ("rb1", "b")], "rawdoc_id string, item_id string"),
        "annotations": make([("n1", "da1", False), ("n2", "da1", True)], "annotation_id string, doc_id string, orphaned boolean"),
    }


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_save_and_reparse(spark):
    make, held = spark.createDataFrame, tables(spark)
    saved = make([("a", "ra2", "da2", "parsed", 9), ("c", "rc1", "dc1", "parsed", 9)], ITEM)
    docs, chunks = make([("da2", "a"), ("dc1", "c")], held["documents"].schema), make([("da2#0", "da2"), ("dc1#0", "dc1")], held["chunks"].schema)
    out = sv.save_captures(held, saved, docs, chunks, make([("ra2", "a"), ("rc1", "c")], held["rawdocs"].schema))
    assert rows(out["items"]) == [("a", "ra2", "da2", "parsed", 1), ("b", "rb1", None, "captured", 1), ("c", "rc1", "dc1", "parsed", 9)]
    assert rows(out["documents"]) == [("da2", "a"), ("dc1", "c")]
    assert rows(out["chunks"]) == [("da2#0", "da2"), ("dc1#0", "dc1"), ("x#0", "x")]
    assert rows(out["rawdocs"]) == [("ra2", "a"), ("rb1", "b"), ("rc1", "c")]
    again = sv.save_captures(held | out, saved, docs, chunks, make([("ra2", "a"), ("rc1", "c")], held["rawdocs"].schema))
    assert all(rows(again[k]) == rows(out[k]) for k in out)  # saving the same again changes nothing
    parsed = sv.save_reparsed(held, make([("a", "ra1", "da2", "parsed", 9)], ITEM), make([("da2", "a")], held["documents"].schema), make([("da2#0", "da2")], held["chunks"].schema))
    assert "rawdocs" not in parsed
    assert rows(parsed["annotations"].select("annotation_id", "doc_id")) == [("n1", "da2"), ("n2", "da1")]


def test_collections_members_and_jobs(spark):
    make = spark.createDataFrame
    items = make([("old", "collection", None, "Before", "active", 1), ("doc", "document", None, "D", "parsed", 1)], "item_id string, item_type string, identity_key string, title string, state string, updated_at int")
    first = sv.upsert_collections(items, make([("One", "https://S.example/x/", 2), ("Two", "https://s.example/x/", 3), ("No", None, 4)], "title string, root_url string, updated_at int"))
    new = [r for r in first.collect() if r.item_id.startswith("col:sha256:")]
    assert first.count() == 3 and [(r.title, r.state) for r in new] == [("Two", "active")]
    second = sv.upsert_collections(first, make([("Three", "https://s.example/x/", 5)], "title string, root_url string, updated_at int"))
    assert {r.item_id: r.title for r in second.collect()}[new[0].item_id] == "Three" and second.count() == 3
    members = make([("c", "m1", 1), ("c", "m2", 2), ("e", "m1", 1)], "collection string, member string, order_index int")
    moved = sv.repoint_members(members, make([("m1", "m2")], "old string, new string"))
    assert rows(moved) == [("c", "m2", 1), ("e", "m2", 1)]
    left, states = sv.replace_members(members, make([("c", "m9", 1)], members.schema), make([("c", "draft"), ("e", "draft")], "collection string, state string"))
    assert rows(left) == [("c", "m9", 1), ("e", "m1", 1)] and rows(states) == [("c", "active"), ("e", "draft")]
    jobs, tasks = sv.create_jobs(make([("j", "p", "links", 1, ["https://a.example/1", "https://A.example/1#x", "no url", None]), ("k", "p", "links", 1, [])], "job_id string, source_page_url string, mode string, created_at int, urls array<string>"))
    assert {(r.job_id, r.total) for r in jobs.collect()} == {("j", 1), ("k", 0)} and tasks.select("position", "url").collect() == [(0, "https://a.example/1")]


def test_states_that_may_not_follow_are_refused(spark):
    log = [(1, "pending"), (2, "fetching"), (3, "saved"), (4, "parsing"), (5, "failed"), (6, "pending"), (7, "fetching")]
    df = spark.createDataFrame([("i", n, s) for n, s in log], "item string, n int, state string")
    assert rows(sv.replay_states(df, ["item"], ["n"])) == [("i", "fetching", 2, 1)]


def test_index_follows_changes(spark, tmp_path):
    docs = [(1, "Alpha", "the quick brown fox"), (2, "Beta fox", "a dog"), (3, None, "nothing here")]
    changed = [(2, "Beta", "a fox and a fox"), (4, "New", "dog days of the fox")]
    schema = "id bigint, title string, text string"
    index = SearchIndex(spark, f"file://{tmp_path}/index")
    assert index.segments() == []
    index.add(spark.createDataFrame(docs, schema), "id", "title", "text")
    index.add(spark.createDataFrame(changed, schema), "id", "title", "text", gone=spark.createDataFrame([(3,)], "id bigint"))
    now = spark.createDataFrame([docs[0], *changed], schema)
    terms = se.query_terms(spark.createDataFrame([(1, "fox dog"), (2, "nothing")], "qid bigint, q string"), "qid", "q")
    want = sorted((r.query_id, r.key, round(r.score, 9)) for r in se.bm25(se.postings(now, "id", "title", "text"), se.corpus_statistics(now, "id", "title", "text"), terms).collect())
    scored = lambda: sorted((r.query_id, r.key, round(r.score, 9)) for r in index.scores(terms).collect())
    assert scored() == want and len(want) == 3
    assert {r.key for r in index.postings(["dog"]).collect()} == {4}
    index.compact()
    assert len(index.segments()) == 1 and scored() == want


def test_store_refuses_a_second_writer_and_keeps_what_is_read(spark, tmp_path):
    one = Store(spark, f"file://{tmp_path}/store")
    one.commit({"t": spark.range(1)})
    read = one.read("t")
    one.commit({"t": spark.range(2)})
    assert one.vacuum() == 0 and read.count() == 1
    one.commit({"t": spark.range(3)})
    assert one.vacuum() == 1 and one.read("t").count() == 3

    class Late(Store):
        def versions(self):
            return super().versions()[:-1]  # as if another one had committed meanwhile

    with pytest.raises(RuntimeError, match="another writer"):
        Late(spark, one.root).commit({"t": spark.range(9)})
    assert one.read("t").count() == 3


def test_settings_and_projections(spark):
    s = st.Settings.of({"server_url": " http://h:1// ", "token": "x", "request_timeout_ms": "1", "saved_list_limit": "many", "input_mode": "odd"})
    assert (s.server_url, s.request_timeout_ms, s.saved_list_limit, s.input_mode, s.shown()["token"]) == ("http://h:1", 3000, 50, "browser_html", "********")
    assert st.Limits.of({"LOREFOLD_MAX_HTML_BYTES": "5"}).max_html_bytes == 5
    df = spark.createDataFrame([("0.1:dom", "Expected HTML, got pdf", 1 << 21, "T", "T", "Raw"), ("7", "boom", 5, "T", "P", None)], "v string, m string, n bigint, t string, meta string, raw string")
    got = df.select(st.parser_method(F.col("v")), st.error_status(F.col("m")), st.formatted_bytes(F.col("n")), st.page_title_choice(F.col("t"), F.col("meta"), F.col("raw"))).collect()
    assert list(map(tuple, got)) == [("dom", 400, "2 MiB", "Raw"), ("unknown", 500, "5 bytes", "P")]
