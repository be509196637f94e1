import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorefold.functions import text as tx
from lorefold.functions import urls as u

CASES = {
    "https://example.com/a?utm_source=x#top": "https://example.com/a",
    "https://example.com/a?b=2&a=1&fbclid=9": "https://example.com/a?a=1&b=2",
    "https://Example.com:443/a/../b?x=1 2": "https://example.com/b?x=1+2",
    "http://A.com:80": "http://a.com/",
    "https://e.com/p?q": "https://e.com/p?q=",
    "https://e.com/p?": "https://e.com/p",
    "https://e.com/p?b=%7B&a=1&a=0": "https://e.com/p?a=1&a=0&b=%7B",
    "file:///tmp/a b": "file:///tmp/a b",
    "not a url": None,
    "https://e.com/./x/%2e%2e/y": "https://e.com/y",
}


def test_normalize_urls_in_both_forms(spark):
    rows = spark.createDataFrame([(k,) for k in CASES] + [(None,)], "url string").select("url", u.normalize_url(F.col("url")).alias("n")).collect()
    assert {r.url: r.n for r in rows} == {**CASES, None: None}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("abcxyz_.-", min_size=1, max_size=6), st.text("0189az*", max_size=4)), max_size=6))
def test_normalizing_is_idempotent(pairs):
    url = "https://h.example/p?" + "&".join(f"{k}={v}" for k, v in pairs)
    once = u.normalize_url_py(url)
    assert u.normalize_url_py(once) == once


def test_simple_form_agrees_with_the_general_one(spark):
    urls = [f"https://h.example/{p}?{q}" for p in ("", "a/b", "x.html", "~u/") for q in ("", "b=1&a=2", "a&utm_x=1&c=", "k=v&k=u&igshid=1")]
    rows = spark.createDataFrame([(x,) for x in urls], "url string").select("url", u.normalize_simple(F.col("url")).alias("n")).collect()
    assert all(r.n == u.normalize_url_py(r.url) for r in rows)


def test_line_keys_agree_in_both_forms(spark):
    lines = ["  A\u00a0B\t12 ", "x\u20283\u202f4", "\u3000", "\u00c4\u00d6 \u0665", "", "a\u200bb 77"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, l string").select("i", tx.line_key(F.col("l")).alias("k")).collect()
    assert {r.i: r.k for r in rows} == {i: tx.line_key_py(x) for i, x in enumerate(lines)}


def test_text_forms(spark):
    row = spark.createDataFrame([("a\u200b\u2028b\u3000 c", "x \n\n\n\n y\r\nz ", -2.5)], "a string, b string, x double").select(
        tx.normalize_inline(F.col("a")).alias("inline"), tx.normalize_block(F.col("b")).alias("block"), tx.normalize_markdown(F.col("b")).alias("md"), tx.round_half_up(F.col("x"), 0).alias("r"), tx.json_string(F.lit('a"b')).alias("j")
    ).first()
    assert (row.inline, row.block, row.md, row.r, row.j) == ("a b c", "x \n\n y\nz", "x\n\n\n\ny\r\nz", -2.0, '"a\\"b"')
    assert tx.slugify_title_py("  Crème  brûlée! ") == "Creme-brulee"
    assert tx.slugify_title_py("???") == "untitled"
    assert len(tx.image_hash_py("abc")) == 16


@pytest.mark.parametrize(("url", "prefix"), [("https://h.example/a/b/c", "/a/b/"), ("https://h.example", "/")])
def test_path_prefix(spark, url, prefix):
    assert spark.range(1).select(u.default_path_prefix(F.lit(url)).alias("p")).first().p == prefix
