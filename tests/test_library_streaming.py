import json
import os
from datetime import datetime

from pyspark.sql import functions as F

from lorefold.operators import library as lib
from lorefold.operators.store import Store
from lorefold.streaming import ingest


def members(spark):
    return spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "c", 2), (2, "b", 0)], "collection int, member string, order_index int")


def test_collections(spark):
    m = members(spark)
    assert {(r.collection, r.member): (r.previous, r.next) for r in lib.navigation(m).collect()}[(1, "b")] == ("a", "c")
    counts = lib.collection_counts(spark.createDataFrame([(1,), (2,), (3,)], "collection int"), m)
    assert {r.collection: r.members for r in counts.collect()} == {1: 3, 2: 1, 3: 0}
    plan = lib.delete_plan(spark.createDataFrame([("z",)], "member string"), spark.createDataFrame([(1,), (2,)], "collection int"), m, spark.createDataFrame([("c",)], "member string"))
    assert {(r.kind, r.id) for r in plan.collect()} == {("item", x) for x in "abcz"} | {("collection", "2")}
    titles = spark.createDataFrame([("a", "A"), ("b", "")], "item_id string, title string")
    assert {r.member: r.title for r in lib.member_view(m, titles).where("collection = 1").collect()} == {"a": "A", "b": "Untitled", "c": "Untitled"}


def test_annotations(spark):
    t = [datetime(2024, 1, d) for d in (1, 2, 3)]
    df = spark.createDataFrame([(1, "d", "note", False, t[0]), (2, "d", "tag", True, t[1]), (3, "d", "note", False, t[2])], "annotation_id int, doc_id string, type string, orphaned boolean, created_at timestamp")
    assert lib.annotation_types(df).first().types == '{"note":2,"tag":1}'
    assert lib.top_types(df).first().label == "note 2, tag 1"
    assert {r.annotation_id: r["rank"] for r in lib.timeline(df, F.col("type") == "tag").collect()} == {2: 1, 3: 2, 1: 3}
    moved = lib.migrate_annotations(df, spark.createDataFrame([("d", "e")], "old_doc string, new_doc string"))
    assert {r.annotation_id: r.doc_id for r in moved.collect()} == {1: "e", 2: "d", 3: "e"}


def test_imports(spark):
    row = spark.createDataFrame([("h", None, "https://a.example/"), ("h", "x", None)], "hash string, canonical string, og string")
    got = [r[0] for r in row.select(lib.import_identity(F.col("hash"), F.col("canonical"), F.col("og"))).collect()]
    assert got[0].startswith("url:sha256:") and got[1] == "singlefile_html:sha256:h"
    codes = spark.createDataFrame([("fetch broke",), ("parse_failed: x",), ("Path escapes",), ("?",)], "m string").select(lib.error_code(F.col("m")).alias("c"))
    assert [r.c for r in codes.collect()] == ["fetch_failed", "parse_failed", "save_failed", "import_failed"]


def test_stream_into_store(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    page = lambda i, body: {"rawdoc_id": f"r{i}", "page_url": "https://h.example/p?utm_x=1" if i < 3 else "https://h.example/q", "title": "T", "html": f"<main><h1>T</h1><p>{body}</p></main>", "captured_at": f"2024-01-0{i}T00:00:00.000Z"}
    (landing / "1.json").write_text("\n".join(json.dumps(page(1, "first text " * 12)) for _ in range(2)))
    root, checkpoint = f"file://{tmp_path}/store", f"file://{tmp_path}/cp"
    ingest.ingest(spark, str(landing), root, checkpoint).awaitTermination()
    (landing / "2.json").write_text("\n".join(json.dumps(page(i, "second text " * 12)) for i in (2, 3)))
    ingest.ingest(spark, str(landing), root, checkpoint).awaitTermination()
    s = Store(spark, root)
    items = {r.normalized_url: (r.doc_id, r.created_at.day, r.updated_at.day) for r in s.read("items").collect()}
    assert items == {"https://h.example/p": ("r2", 1, 2), "https://h.example/q": ("r3", 3, 3)}
    assert {r.doc_id for r in s.read("sections").collect()} == {"r2", "r3"}


def test_stream_keeps_late_captures(spark, tmp_path):
    """Captures and files older than those of an earlier batch are merged; an older capture of an item does
    not take the place of a later one, nor does a repeat."""
    landing = tmp_path / "in"
    landing.mkdir()
    page = lambda i, at, url: json.dumps({"rawdoc_id": i, "page_url": f"https://h.example/{url}", "title": "T", "html": f"<main><h1>T</h1><p>{f'text of {i} ' * 20}</p></main>", "captured_at": f"{at}T00:00:00.000Z"})
    files = [[page("r1", "2025-06-01", "p")], [page("r2", "2024-06-01", "q"), page("r3", "2025-06-02", "s"), page("r4", "2024-05-01", "p")], [page("r5", "2022-04-01", "u"), page("r1", "2025-06-01", "p"), page("r2", "2024-06-01", "q")]]
    root, checkpoint = f"file://{tmp_path}/store", f"file://{tmp_path}/cp"
    for n, lines in enumerate(files):
        (landing / f"{n}.json").write_text("\n".join(lines))
        if n == 2:
            os.utime(landing / "2.json", (1e9, 1e9))
        ingest.ingest(spark, str(landing), root, checkpoint).awaitTermination()
    s = Store(spark, root)
    items = {r.normalized_url[-1]: (r.doc_id, str(r.created_at.date()), str(r.updated_at.date())) for r in s.read("items").collect()}
    assert items == {"p": ("r1", "2024-05-01", "2025-06-01"), "q": ("r2", "2024-06-01", "2024-06-01"), "s": ("r3", "2025-06-02", "2025-06-02"), "u": ("r5", "2022-04-01", "2022-04-01")}
    sections = s.read("sections").select("doc_id", "idx").collect()
    assert {r.doc_id for r in sections} == {"r1", "r2", "r3", "r5"} and len(sections) == len(set(sections))
