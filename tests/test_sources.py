import io
import json
import zipfile

import pytest

from lorefold.operators import summaries as su
from lorefold.sources import epub, files

S = lambda t: {"t": "Str", "c": t}
P = lambda *xs: {"t": "Para", "c": list(xs)}


def test_blocks():
    image = {"t": "Image", "c": [[], [S("figure_1_1")], ["a.png", ""]]}
    attr = ["", [], []]
    cell = lambda t: [attr, {"t": "AlignDefault"}, 1, 1, [P(S(t))]]
    row = lambda *ts: [attr, [cell(t) for t in ts]]
    table = {"t": "Table", "c": [attr, [None, []], [], [attr, [row("Name", "Value")]], [[attr, 0, [], [row("Alpha", "One")]]], [attr, []]]}
    blocks = [{"t": "Header", "c": [2, [], [S("H")]]}, P(S("a"), {"t": "Space"}, S("b"), image), {"t": "BulletList", "c": [[P(S("x"))], [P(S("y"))]]}, {"t": "Div", "c": [[], [{"t": "Div", "c": [[], [table]]}]]}, {"t": "HorizontalRule"}, {"t": "CodeBlock", "c": [[], "code"]}]
    got = epub.blocks_to_sections(blocks)
    assert [s["type"] for s in got] == ["heading", "paragraph", "figure", "list", "table", "code"]
    assert got[1]["content"] == "a b" and got[2]["assets"][0]["alt"] is None and got[3]["items"] == ["x", "y"]
    assert got[4]["rows"] == [["Name", "Value"], ["Alpha", "One"]]
    assert epub.meta_values({"t": "MetaList", "c": [{"t": "MetaInlines", "c": [S("A")]}, {"t": "MetaString", "c": " B "}]}) == ["A", "B"]


OPF = """<package><metadata><dc:title>Book &amp; more</dc:title><dc:creator>Ann</dc:creator><dc:language>zho</dc:language><dc:date>2024-01-02</dc:date><dc:subject>Reference</dc:subject>
<dc:identifier opf:scheme="ISBN">123</dc:identifier><dc:identifier id="uuid_id" opf:scheme="uuid">u</dc:identifier><meta name="calibre:user_metadata:#pages" content="{&quot;#value#&quot;: 55}"/></metadata>
<manifest><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>"""
NCX = """<navMap><navPoint><navLabel><text>Two</text></navLabel><content src="b.xhtml"/><navPoint><navLabel><text>Deep</text></navLabel><content src="a.xhtml"/></navPoint></navPoint></navMap>"""


def book():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>')
        z.writestr("o/c.opf", OPF)
        z.writestr("o/toc.ncx", NCX)
        z.writestr("o/a.xhtml", "<html><body><h4>Deep</h4><p>first page</p></body></html>")
        z.writestr("o/b.xhtml", "<html><body><h3>Two</h3><p>second page</p></body></html>")
    return out.getvalue()


def test_books(spark):
    assert epub.parse_ncx(NCX) == [(2, "Deep", "a.xhtml"), (1, "Two", "b.xhtml")]
    meta = epub.parse_opf(OPF)
    assert (meta["language"], meta["identifiers"], meta["pages"], meta["title"]) == ("zh", {"isbn": "123", "uuid": "u"}, 55, "Book & more")
    df = spark.createDataFrame([("x.epub", book(), OPF), ("bad.epub", b"no zip", None), ("e.epub", b"", None)], "path string, content binary, opf string")
    got = {r.path: r for r in epub.books(df).collect()}
    good = got["x.epub"]
    assert [(s.type, s.content) for s in good.sections] == [("heading", "Two"), ("paragraph", "second page"), ("heading", "Deep"), ("paragraph", "first page")]
    assert (good.title, good.language, good.tags, good.chapters, good.error) == ("Book & more", "zh", ["Reference"], 2, None)
    assert got["bad.epub"].error.startswith("parse_failed") and got["e.epub"].error.startswith("unsupported_file_type")
    ast = json.dumps({"meta": {"title": {"t": "MetaString", "c": "Own"}}, "blocks": []})
    assert epub.book_document(b"x", ast=ast)["title"] == "Own"


def test_scans(spark, tmp_path):
    for p in ("a/book.epub", "a/metadata.opf", "a/Cover.JPG", "a/sub/metadata.opf", "b/x.epub", "c/metadata.opf", "d/p.HTML", "d/.git/q.html", "d/build/r.htm", "d/ok/s.htm"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x")
    listed = files.listing(spark, str(tmp_path))
    got = {r.folder.rsplit("/", 1)[-1]: (r.state, len(r.epubs), r.cover is not None) for r in files.scan_library(listed).collect()}
    assert got == {"a": ("candidate", 1, True), "b": ("missing_opf", 1, False), "c": ("missing_epub", 0, False)}
    assert sorted(r.path.rsplit("/", 1)[-1] for r in files.scan_pages(listed, str(tmp_path)).collect()) == ["p.HTML", "s.htm"]
    lines = spark.createDataFrame([(0, "# c"), (1, " u "), (2, ""), (3, "v"), (4, "u")], "line int, value string")
    assert {r.url: r.line for r in files.scan_urls(lines).collect()} == {"u": 1, "v": 3}


def test_sidebar_and_paths():
    got = files.parse_sidebar("* [A](a.md)\n  * <strong>Dir</strong>\n    * [B](b/c.md)\n* [C](c.md)", "https://h.example/")
    assert [(e["depth"], e["title"], e["parent"], e["folder"]) for e in got] == [(0, "A", None, ""), (1, "Dir", 0, "Dir"), (2, "B", 1, "Dir"), (0, "C", None, "")]
    assert files.safe_path("/r", "a/../b") == "/r/b"
    for bad in ("../x", "/abs", "C:\\x", "a/../../b"):
        with pytest.raises(ValueError, match="Path escapes"):
            files.safe_path("/r", bad)


def test_accepting(spark):
    rows = spark.createDataFrame([("https://a.example/x", "https://a.example/y#f", 200, "text/html", "h"), ("https://a.example/x", None, 404, "text/html", "h"), ("https://a.example/x", None, 200, "application/json", "h")], "url string, final_url string, status int, content_type string, html string")
    got = [(r.normalized_url, r.error_code) for r in files.accept_fetched(rows).collect()]
    assert got == [("https://a.example/y", None), ("https://a.example/x", "http_status"), ("https://a.example/x", "unsupported_content")]
    snaps = spark.createDataFrame([("no url", "h"), ("https://a.example/", "h" * 20)], "page_url string, html string")
    assert [r.error_code for r in files.accept_snapshots(snaps, max_bytes=10).collect()] == ["invalid_url", "html_too_large"]


def test_summaries(spark):
    calls = []

    def provider(text, tokens):
        calls.append((len(text), tokens))
        return text[:3]

    assert su.summarise("abc" * 3000, 1, provider) == "abc"
    assert [n for n, _ in calls] == [6000, 3500, 8] and calls[-1][1] == 400
    df = spark.createDataFrame([("d", 0, 2, "One. Two. Three"), ("d", 1, None, None)], "doc_id string, idx int, level int, text string")
    assert {r.idx: r.summary for r in su.summaries(df, "m").collect()} == {0: "One. Two", 1: ""}
