from datetime import datetime

from pyspark.sql import functions as F

from lorefold.api import Knowledge
from lorefold.operators import imports
from lorefold.operators.store import Store
from lorefold.sources import wiki
from test_sources import OPF, book

HEAD = """<head><meta content="Ann" name=author><meta property='og:url' content='https://h.example/p?utm_a=1'><title> A &amp; B </title><link href=/rel rel=canonical></head>"""


def test_head_metadata(spark):
    df = spark.createDataFrame([(HEAD,), ("<meta name='twitter:title' content='T'>",), (None,)], "h string")
    got = [tuple(r) for r in df.select(*[c.alias(k) for k, c in imports.head_metadata(F.col("h")).items()]).collect()]
    assert got == [("A & B", "/rel", "https://h.example/p?utm_a=1", "Ann"), ("T", None, None, None), (None, None, None, None)]


def test_importing_books_and_pages(spark):
    rows = [("/l/a/x.epub", book()), ("/l/a/metadata.opf", OPF.encode()), ("/l/b/y.epub", b"bad"), ("/l/b/metadata.opf", OPF.encode()), ("/l/c/z.epub", b""), ("/l/d/1.epub", b"1"), ("/l/d/2.epub", b"2"), ("/l/d/metadata.opf", b"")]
    tree = spark.createDataFrame(rows, "path string, content binary")
    none = spark.createDataFrame([], "item_id string, state string")
    books, report = imports.import_books(tree, none)
    assert {(r.path, r.state, r.error_code) for r in report.collect()} == {("/l/a/x.epub", "imported", None), ("/l/b/y.epub", "failed", "parse_failed"), ("/l/c", "skipped", "missing_opf"), ("/l/d", "failed", "multiple_epub_files")}
    done = books.select("item_id", F.lit("parsed").alias("state"))
    _, again = imports.import_books(tree, done)
    assert {r.state for r in again.where("path = '/l/a/x.epub'").collect()} == {"skipped"}
    _, dry = imports.import_books(tree, none, dry_run=True)
    assert {r.state for r in dry.where("path like '%epub'").collect()} == {"dry_run"}
    pages = spark.createDataFrame([("/p/1.html", HEAD + "<main><h1>A</h1><p>text of it</p></main>"), ("/p/2.html", "<p>no address</p>")], "path string, html string")
    documents, report = imports.import_pages(pages, none)
    assert {(r.path, r.state) for r in report.collect()} == {("/p/1.html", "imported"), ("/p/2.html", "imported")}
    assert {r.path: r.item_id.split(":")[0] for r in documents.collect()} == {"/p/1.html": "url", "/p/2.html": "singlefile_html"}


def test_importing_addresses(spark):
    urls = spark.createDataFrame([("https://a.example/x",), ("https://a.example/y",), ("https://a.example/z",)], "url string")
    fetched = spark.createDataFrame([("https://a.example/x", None, 200, "text/html", "h"), ("https://a.example/y", None, 500, "text/html", "h")], "url string, final_url string, status int, content_type string, html string")
    report = imports.import_urls(urls, fetched, spark.createDataFrame([], "item_id string, state string"))
    assert {(r.url[-1], r.state, r.error_code) for r in report.collect()} == {("x", "imported", None), ("y", "failed", "http_status"), ("z", "failed", "fetch_failed")}


def test_wiki(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("a", "c")], "source string, target string")
    got = {r.page: r.depth for r in wiki.reachable(edges, spark.createDataFrame([("a",)], "page string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 1}
    blocks = spark.createDataFrame([("p", [0], "heading2", "H", None), ("p", [1], "bullet", "one", None), ("p", [1, 0], "todo", "two", True), ("p", [2], "text", "t", None), ("p", [3], "divider", None, None), ("p", [10], "bullet", "last", None)], "page string, path array<int>, type string, text string, done boolean")
    rows = [(r.type, r.level, r.content) for r in wiki.block_sections(blocks).orderBy("idx").collect()]
    assert rows == [("heading", 2, "H"), ("list", None, "- one\n- [x] two"), ("paragraph", None, "t"), ("list", None, "- last")]


def test_api(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    t = datetime(2024, 1, 1)
    items = spark.createDataFrame([("i1", "parsed", "Intro", "Intro - Site", "https://h.example/1", "url", "d1", t), ("i2", "stale", "Other", None, None, "epub", "d2", t)], "item_id string, state string, title string, page_title string, normalized_url string, source_type string, active_doc_id string, updated_at timestamp")
    chunks = spark.createDataFrame([("c1", "d1", "Intro", "retrieval systems find things"), ("c2", "d2", None, "noise only")], "chunk_id string, doc_id string, heading_path string, text string")
    Store(spark, root).commit({"items": items, "chunks": chunks, "documents": chunks.select("doc_id").distinct()})
    k = Knowledge(spark, root)
    hit = k.search("retrieval systems", trace=True).collect()
    assert [(h.key, h.term_coverage, h.source_url) for h in hit] == [("c1", 1.0, "https://h.example/1")]
    assert k.search("noise", source="url").count() == 0
    assert k.context("retrieval").first().context.startswith("[1] Intro - Site\nSource: https://h.example/1\nretrieval")
    assert [r.state for r in k.items().collect()] == ["parsed", "parsed"]
    k.remove(["i1"])
    assert {r.item_id: r.state for r in k.store.read("items").collect()} == {"i1": "captured", "i2": "stale"} and k.search("retrieval").count() == 0
    k.purge(["i2"])
    assert {r.table_name: r.rows for r in k.scan().collect()} == {"items": 1, "chunks": 0, "documents": 0}
