import pytest

from lorefold.llm import main_content, template_residue as tr

LONG = "A paragraph of an article, which says something, at some length, about a subject of its own. "
SNAP = "rawdoc_id string, page_url string, canonical_url string, title string, page_title string, html string, text string, host string"


@pytest.mark.parametrize("line", ["Dear {{ name }},", "By <%= post.author %>", "${site.email}", "#{doc.date} x", "[[TITLE]]", "%%NAME%%", "%CITY% · 4 min", "__AUTHOR__", "<<city>>", "«author»", "{first_name}", "[YOUR NAME]", "[Insert date here]", "[%page_date%]", "@Model.Body", "undefined", "x [object Object]", f"{LONG}Ask {{{{slug}}}} about it."])
def test_placeholders(line):
    assert tr.has_placeholder(f"Title\n{line}\nmore")


@pytest.mark.parametrize("line", ["The manual shows {{ name }} as an example of a variable and then replaces it.", "In the template language of X, writing ${id} prints the value.", "if a[0] > b: return x[1]", 'print(f"{name}")', "Il dit « bonjour » et «merci».", "undefined behaviour is a term", "100 % sure, 5% of it", "snake_case __init__ x", ""])
def test_no_placeholders(line):
    assert not tr.has_placeholder(line)


@pytest.mark.parametrize(("line", "kind"), [("HTTP 404", "error"), ("Page introuvable", "error"), ("Seite nicht gefunden", "error"), ("This account has been suspended.", "error"), ("Please turn on JavaScript in your browser.", "script"), ("请启用 JavaScript 后重新加载本页。", "script"), ("Lorem ipsum dolor sit amet nulla", "filler"), ("TBD TBD TBD", "filler"), (LONG, None), ("Stale scripts rarely notice", None), ("", None)])
def test_evidence(line, kind):
    assert tr.evidence(line) == kind


@pytest.mark.parametrize("uri", ["https://h/posts/{id}", "https://h/{{path}}/x", "https://h/x?ref=${id}", "https://h/a/:slug", "https://h/[id]/index.html", "https://h/p/<%25=id%25>", "https://h/[object%20Object]", "https://h/notes/%24%7Btitle%7D", "https://h/null/x", "https://h/x?id=undefined", "https://h/__SLUG__/view"])
def test_unfilled_uris(uri):
    assert tr.uri_residue(uri)


@pytest.mark.parametrize("uri", ["https://h/object-oriented/x", "https://h/null-safety/y", "https://h/sets/%7Ba%2Cb%7D-note", "https://h/time/12:the-queue", "https://h/dollar/$100/x", "https://h/search?filter=%7B%22lang%22%3A%22en%22%7D", "file:///shelf/x.epub", "", None, "%%%"])
def test_filled_uris(uri):
    assert not tr.uri_residue(uri)


def page(spark, rows):
    return spark.createDataFrame([(r, f"https://site-{h}.example/{r}?x=1", None, title, None, html, text, "noise") for r, h, title, html, text in rows], SNAP)


def test_repeats_of_a_residue_page_count_once(spark):
    """One line that may be a heading makes no article, however often its capture is stored; of several texts
    of a capture any may make it a case."""
    text = "Page not found\nHome about contact\n"
    rows = [("once", 1, None, None, text), ("twice", 2, None, None, text), ("twice", 2, None, None, text), ("texts", 3, None, None, text), ("texts", 3, None, None, text + LONG), ("article", 4, None, None, text + LONG)]
    raw = spark.createDataFrame([], "rawdoc_id string, source_uri string")
    assert sorted(r.rawdoc_id for r in tr.residue_cases(page(spark, rows), raw).collect()) == ["once", "texts", "twice"]


def test_residue_cases(spark):
    furniture = "Site 0 menu of pages and of many more things that stand here on every page of the site\n"
    rows = [(f"n{i}", 0, None, None, furniture + LONG.replace("subject", f"subject {chr(97 + i)}")) for i in range(6)]
    rows += [("error", 0, None, None, furniture + "HTTP 404\nMore from Site 0\n" + LONG), ("script", 0, "Title here", None, furniture + "Please turn on JavaScript.\nTitle here\n" + LONG), ("filler", 0, None, None, "Lorem ipsum dolor " * 9), ("quote", 0, None, None, LONG + '\nHTTP 404\n'), ("slot", 1, None, None, LONG + "\n{{name}}"), ("null", 0, None, None, None), ("empty", 0, None, None, ""), ("error", 0, None, None, furniture + "HTTP 404\nMore from Site 0\n" + LONG)]
    snaps = page(spark, rows)
    raw = spark.createDataFrame([("u1", "https://h/{id}"), ("u2", "https://h/x"), ("u3", None), ("u1", "https://h/{id}")], "rawdoc_id string, source_uri string")
    assert sorted(r.rawdoc_id for r in tr.residue_cases(snaps, raw).collect()) == ["error", "filler", "slot", "u1"]
    assert "null" in {r.rawdoc_id for r in tr.without_residue(snaps, raw).collect()}
    assert tr.residue_cases(snaps.limit(0), raw.limit(0)).count() == 0


HTML = f"""<html><head><title>T - S</title></head><body><div class="topbar menu"><a href=/>Home</a><a href=/a>About</a></div>
<div class=x9><h1>The title</h1><div class="by">By Ann · 3 May 2020</div><h2>Part one</h2><p>{LONG}<p>{LONG * 2}<p>Advertisement<p>Buy the best pen<h3>Part two</h3><p>Anzeige<h3>Part three</h3>
<ul><li>entry one<li>entry two</ul><table><tr><td>A</td><td>1</td></tr></table><pre>code_a()
code_b()</pre><div class="share">Share: Mail</div></div>
<div class=x7><p>3 comments<div class="com">Bob #1</div><p>{LONG}</div><div class=k2><a href=/i>Imprint</a></div></body></html>"""
TEXT = f"Home\nAbout\nThe title\nBy Ann · 3 May 2020\n\nPart one\n{LONG.strip()}\n{(LONG * 2).strip()}\nAdvertisement\nBuy the best pen\nPart two\nAnzeige\nPart three\n• entry one\n• entry two\nA\t1\ncode_a()\ncode_b()\nShare: Mail\n3 comments\nBob #1\n{LONG.strip()}\nImprint"


def test_main_lines():
    assert main_content.main_lines(HTML, TEXT, "The title") == [2, 5, 6, 7, 10, 12, 13, 14, 15, 16, 17]
    shell = '<html><body><div id="root"></div></body></html>'
    assert main_content.main_lines(shell, TEXT, "The title")[:4] == [2, 5, 6, 7]
    assert main_content.main_lines(shell, "HTTP 404", "The title") == []
    assert main_content.main_lines(None, TEXT, None)[:4] == [2, 5, 6, 7]
    assert main_content.main_lines(shell, "Home\nPlease turn on JavaScript.\nMore from Site\n" + LONG, None) == []
    assert main_content.main_lines("<div><p>HTTP 404<p>We could not find that page.</div>", "HTTP 404\nWe could not find that page.", None) == []
    assert main_content.main_lines("<b" * 50, "x", None) == []


def test_main_content_in_tables(spark):
    rows = [("a", 0, "The title", HTML, TEXT), ("a", 0, "The title", HTML, TEXT), ("b", 0, None, HTML, None), ("c", 0, None, None, ""), ("d", 0, None, "", LONG)]
    snaps = page(spark, rows)
    got = {(r.rawdoc_id, r.line_no) for r in main_content.main_content(snaps).collect()}
    assert got == {("a", n) for n in (2, 5, 6, 7, 10, 12, 13, 14, 15, 16, 17)} | {("d", 0)}
    assert main_content.main_content(snaps.limit(0)).count() == 0


def test_lines_that_recur_on_a_site_are_left_out(spark):
    body = "<html><body><div><h1>{t}</h1><p>{p}</p><p>{p} {t}.</p><p>Words of the Site house on each page</p></div></body></html>"
    rows = []
    for i in range(8):
        t, p = f"Head {chr(97 + i)}", LONG.replace("subject", f"subject {chr(97 + i)}").strip()
        rows.append((f"r{i}", 5, t, body.format(t=t, p=p), f"{t}\n{p}\n{p} {t}.\nWords of the Site house on each page"))
    got = {(r.rawdoc_id, r.line_no) for r in main_content.main_content(page(spark, rows)).collect()}
    assert got == {(f"r{i}", n) for i in range(8) for n in range(3)}


def test_captures_without_a_host_are_one_host(spark):
    furniture = "A long line of furniture that stands on all of these pages, whoever may have sent them to us"
    rows = [(f"n{i}", None, f"c{i}", None, None, None, f"{furniture}\n{LONG} {chr(97 + i)}", "x") for i in range(5)] + [("e", None, None, None, None, None, f"{furniture}\nHTTP 404", "x")]
    snaps = spark.createDataFrame(rows, SNAP)
    raw = spark.createDataFrame([], "rawdoc_id string, source_uri string")
    assert [r.rawdoc_id for r in tr.residue_cases(snaps, raw).collect()] == ["e"]


def test_messages_longer_than_a_sentence():
    refusal = "Access denied for your address. " * 12
    assert tr.evidence(refusal.strip()) == "error"
    assert tr.evidence("Please enable JavaScript to go on. " * 9) == "script"
    assert tr.evidence(("The index grows slowly and the reader waits for it. " * 8) + "Access denied.") is None
    notice = "We use cookies to measure how often this page is read and by whom. " * 6
    assert main_content.side_line(notice.strip()) == main_content.side_line(notice[:66])


def test_runs_of_lines_that_the_markup_does_not_hold():
    """A shell with some blocks of its own: the run of lines with the title is read by itself."""
    shell = "<html><body><nav><a href='/'>Home of the pages</a></nav><div id='app'></div><footer>Made by hand in the old town hall</footer></body></html>"
    prose = "The stale index grows slowly, and nobody in the reading room minds that it does so for years."
    text = "\n".join(["Home of the pages", "A slow index", prose, prose + " Again.", "Made by hand in the old town hall"])
    assert main_content.main_lines(shell, text, "A slow index") == [1, 2, 3]
