import random

from pyspark.sql import functions as F

from lorefold.operators import markdown as md
from lorefold.operators import sections as sec


def rows(spark, docs):
    return spark.createDataFrame([(d, i, *s) for d, ss in docs.items() for i, s in enumerate(ss)], "doc_id string, idx int, type string, level int, content string")


def stack_paths(ss):
    stack, out = [], []
    for kind, level, content in ss:
        if kind == "heading" and (content or "").strip():
            lv = max(1, min(6, level or 1))
            stack = (stack + [""] * 6)[: lv - 1] + [content.strip()]
        out.append(" > ".join(stack) if stack else None)
    return out


def random_docs(n, seed):
    r = random.Random(seed)
    return {f"d{i}": [(r.choice(["heading", "paragraph", "paragraph", "code"]), r.choice([None, 1, 2, 3, 5, 9]), r.choice(["", "a", "b c", None, "x" * r.randrange(900)])) for _ in range(r.randrange(1, 14))] for i in range(n)}


def test_heading_paths_equal_a_stack(spark):
    docs = random_docs(40, 1)
    got = {(r.doc_id, r.idx): r.path for r in sec.heading_paths(rows(spark, docs)).collect()}
    assert got == {(d, i): p for d, ss in docs.items() for i, p in enumerate(stack_paths(ss))}


def test_chunks_equal_a_loop(spark):
    docs = random_docs(30, 2)
    titles = spark.createDataFrame([(d, f"T {d}", "https://h.example:81/p") for d in docs], "doc_id string, title string, url string")
    got = {}
    for r in sec.fold_chunks(rows(spark, docs), titles).collect():
        got.setdefault(r.doc_id, {})[r.chunk_index] = (r.heading_path, r.text)
    for d, ss in docs.items():
        want, pending, path0 = [], [], None

        def flush():
            if pending:
                want.append((path0, "\n\n".join(pending)))
                pending.clear()

        for (kind, _, content), path in zip(ss, stack_paths(ss)):
            if kind == "heading":
                flush()
            elif (content or "").strip():
                if not pending:
                    path0 = path
                pending.append("\n".join(x for x in (f"Title: T {d}", "Source: h.example:81", f"Section: {path}" if path else "", content) if x).strip())
                if len("\n\n".join(pending)) >= sec.TARGET_CHARS:
                    flush()
        flush()
        assert [got.get(d, {})[i] for i in range(len(got.get(d, {})))] == want


def test_ids_and_adjacent_repeats(spark):
    df = rows(spark, {"d": [("paragraph", None, "a"), ("paragraph", None, "a"), ("code", None, "a"), ("paragraph", None, ""), ("paragraph", None, "")]})
    ids = [r.section_id for r in sec.section_ids(df).orderBy("idx").collect()]
    assert ids[1] == ids[0] + "-1" and ids[4] == ids[3] + "-1" and len(set(ids)) == 5
    assert [r.idx for r in sec.drop_adjacent_repeats(df).orderBy("idx").collect()] == [0, 2, 3, 4]


def test_scopes_parents_and_cascade(spark):
    ss = [("heading", 1, "A"), ("paragraph", None, "p"), ("heading", 3, "B"), ("heading", 2, "C"), ("paragraph", None, "q"), ("heading", 1, "D")]
    df = rows(spark, {"d": ss})
    assert {r.idx: r.end for r in sec.heading_scopes(df).collect()} == {0: 5, 2: 3, 3: 5, 5: None}
    assert {r.idx: r.parent_idx for r in sec.heading_parents(df).collect()} == {0: None, 2: 0, 3: 0, 5: None}
    assert {r.idx: (r.descendants, r.ancestors) for r in sec.cascade(df).collect()} == {0: (2, 0), 2: (0, 1), 3: (0, 1), 5: (0, 0)}
    assert {r.idx: r.text for r in sec.scope_texts(df).collect()}[3] == "C\n\nq"


def test_summary_parts_cover_the_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(13_000))
    parts = sec.summary_parts(spark.createDataFrame([("d", 0, text), ("e", 0, "short")], "doc_id string, idx int, text string")).orderBy("doc_id", "part").collect()
    assert [len(p.text) for p in parts if p.doc_id == "d"] == [6000, 6000, 2000]
    assert parts[0].text[5500:] == parts[1].text[:500] and parts[-1].text == "short"


def test_contents_levels():
    heads = [("one", 2), ("extra", 3), ("chapter two", 2), ("four", None)]
    assert sec.correct_levels_py(heads, [("one", 1), ("two", 2), ("three", 3), ("four", 9)]) == [1, 3, 2, 6]


def test_markdown_of_all_kinds(spark):
    s = [
        ("s-1", "heading", 2, "H", None, None, None), ("s-2", "paragraph", None, "p", None, None, None), ("s-3", "blockquote", None, "a\nb", None, None, None),
        ("s-4", "list", None, None, [("x", None), ("y", None)], None, None), ("s-5", "code", None, "c", None, None, None),
        ("s-6", "table", None, None, None, [["A|", "B"], ["1"]], None), ("s-7", "figure", None, "cap", None, None, [("i", None, "u.png", "al[t]", None)]), ("s-8", "blockquote", None, None, None, None, None),
    ]
    df = spark.createDataFrame([("t\"q", None, "u", "2024", "en", s)], f"title string, page string, url string, at string, lang string, s array<{md.SECTION}>")
    text = df.select(md.markdown(F.col("title"), F.col("page"), F.col("url"), F.col("at"), F.col("lang"), F.col("s")).alias("m")).first().m
    assert text.startswith('---\ntitle: "t\\"q"\nurl: "u"\ningested_at: "2024"\nlanguage: "en"\n---\n\n# t"q\n\n<!-- section_id:s-1 -->\n## H\n')
    assert "> a\n> b\n" in text and "- x\n- y\n" in text and "```\nc\n```" in text
    assert "| A\\| | B |\n| --- | --- |\n| 1 |  |" in text and "![al\\[t\\]](u.png)\ncap" in text
    assert text.endswith("<!-- section_id:s-8 -->\n")
