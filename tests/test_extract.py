import pytest

from lorefold.functions.dom import parse_html
from lorefold.operators import adapters as ad
from lorefold.operators import extract as ex

LONG = "Words about something that matter here, again and again, until the text is long enough. " * 3
PAGE = f"""<html lang=en><head><title>T - Site</title><meta name="author" content="Ann"></head><body><nav><p>menu</p></nav>
<main class="page header-height"><h1>T</h1><h2>Part</h2><p>{LONG}<p>See <a href="/x">the [link]</a>, <b>bold</b> and <code>c`d</code>.
<ul><li>one<ul><li>deep</li></ul><li>two</ul><pre>a
 b</pre><blockquote>quote</blockquote><figure><img data-src="i.png" alt="fig"><figcaption>cap</figcaption></figure>
<table><tr><th>A<th>B<tr><td>1<td>2</table><div class="ad">buy</div></main><div class="cookie banner">yes?</div></body></html>"""


def test_tree_closes_what_is_left_open():
    t = parse_html("<ul><li>a<li>b</ul><p>x<p>y<table><tr><td>1<td>2<tr><td>3</table><p/>")
    assert [n.text() for n in t.select("li")] == ["a", "b"]
    assert [n.text() for n in t.select("td")] == ["1", "2", "3"]
    assert len(t.select("tr")) == 2 and [n.text() for n in t.select("p")][:2] == ["x", "y"]


@pytest.mark.parametrize(
    ("selector", "n"),
    [("p", 3), ("div > p.a", 1), (".a", 2), ("#i", 1), ("[data-x]", 1), ("[data-x='Q' i]", 1), ("[class*='b']", 1), ("[class^='a']", 2), ("p:not(.a)", 2), ("div p, span", 3), ("span.a, #i", 2)],
)
def test_selectors(selector, n):
    t = parse_html("<div><p class=a>1</p><p>2</p></div><p id=i data-x=q>3</p><span class='a b'>4</span>")
    assert len(t.select(selector)) == n


def test_scope_selector():
    t = parse_html("<div><p>1</p><section><p>2</p></section></div>")
    assert [n.text() for n in t.first("div").select(":scope > p")] == ["1"]


def test_sections_of_a_page():
    got = {c["id"]: c for c in ex.page_candidates(PAGE, None, "https://h.example/d/", page_title="T - Site")}
    s = got["dom_fallback"]["sections"]
    assert [x["type"] for x in s] == ["heading", "paragraph", "paragraph", "list", "code", "blockquote", "figure", "table"]
    assert s[2]["content"] == "See [the \\[link\\]](https://h.example/x), **bold** and `c\\`d`."
    assert s[3]["items"] == ["onedeep", "two"] and s[4]["content"] == "a\n b"
    assert s[6]["assets"] == [{"source_url": "https://h.example/d/i.png", "alt": "fig", "caption": "cap"}]
    assert s[7]["rows"] == [["A", "B"], ["1", "2"]]
    assert got["dom_fallback"]["authors"] == ["Ann"]
    assert got["defuddle"]["score"] - got["dom_fallback"]["score"] == 40


def test_scores():
    m = {"text_length": 180, "sections_n": 3, "headings": 1, "images": 0, "tables": 0, "codes": 0, "link_density": 0.0}
    assert ex.score_py("selection", 120, m, 0) == 208
    assert ex.score_py("rendered_text_fallback", -15, {**m, "text_length": 80, "sections_n": 1, "headings": 0}, 2) == -56
    assert ex.score_py("dom_fallback", 0, {**m, "text_length": 0}, 0) == -100


def test_adapters():
    assert [m.adapter.id for m in ad.match_adapters("https://medium.com/@a/b")] == ["medium"]
    mirror = "https://freedium-mirror.cfd/https://medium.com/x"
    assert [(m.adapter.id, m.score) for m in ad.match_adapters(ad.canonical_url(mirror), mirror)] == [("freedium", 149.0), ("medium", 107.0)]
    assert ad.fetch_url("https://arxiv.org/abs/2401.00001v1") == "https://arxiv.org/html/2401.00001v1"
    assert [m.adapter.id for m in ad.match_adapters("https://any.example/docs/x")] == ["fern_docs"]
    with pytest.raises(ValueError, match="two adapters"):
        ad.checked([ad.ADAPTERS[0], ad.ADAPTERS[0]])


def test_structured_data_and_text_only():
    script = '<script type="application/ld+json">{"@graph":[{"@type":"ScholarlyArticle","headline":"H","author":[{"name":"A"},"B"],"keywords":["k",1],"abstract":"' + LONG.strip() + '"}]}</script>'
    got = {c["id"]: c for c in ex.page_candidates(script + "<div id=root></div>", "line one of the text\n" * 9, "https://h.example/")}
    assert got["schema_org"]["authors"] == ["A", "B"] and got["schema_org"]["tags"] == ["k", "1"] and got["schema_org"]["title"] == "H"
    assert got["rendered_text_fallback"]["warnings"] == [ex.TEXT_WARNING]


def test_comments():
    page = f"""<shreddit-post post-title="P" author="me"><div slot="text-body"><p>{LONG}</p></div></shreddit-post>
    <shreddit-comment thingid="t1" author="x" created="2024-01-02T00:00:00Z" permalink="/r/c/1" score="5" depth="1"><div slot="comment"><p>hello</p></div></shreddit-comment>
    <shreddit-comment thingid="t1"><div slot="comment"><p>again</p></div></shreddit-comment>"""
    got = [c for c in ex.page_candidates(page, None, "https://www.reddit.com/r/a/comments/1/") if c["method"] == "site_adapter"]
    assert got[0]["sections"][-1]["content"] == "> **x** · [2024-01-02](https://reddit.com/r/c/1) · 5 points\n>\n> hello"


def test_selection_in_spark(spark):
    rows = [("p", PAGE, "some text", "https://h.example/", "T", "T - Site", None), ("q", None, None, "https://h.example/q", None, None, None)]
    df = spark.createDataFrame(rows, "rawdoc_id string, html string, text string, page_url string, title string, page_title string, selection_html string")
    c = ex.candidates(df)
    best = {r.page_id: r.method for r in ex.select_candidates(c).collect()}
    assert best == {"p": "defuddle", "q": "dom_fallback"}
    assert {r.page_id for r in ex.previews(c).where("selected").collect()} == {"p", "q"}
    assert ex.candidates(df.limit(0)).count() == 0
