import random
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorefold.functions.text import line_key_py, words_py
from lorefold.llm import leakage, repeated_lines, splitting

AT = datetime(2024, 1, 1)
ITEM = "item_id string, active_doc_id string, normalized_url string, updated_at timestamp, line string"
SECTION = "doc_id string, section_index int, type string, content string, site string, line bigint"


def sections(spark, rows):
    return spark.createDataFrame([(*r, "noise", 0) for r in rows], SECTION)


def corpus(seed=1, docs=40):
    r = random.Random(seed)
    items, rows = [], []
    for d in range(docs):
        site = f"https://{'www.' if d % 2 else ''}S{d % 3}.example/p{d}" if d % 10 else None
        items.append((f"i{d}", f"d{d}", site, AT, "x"))
        for i in range(r.randrange(1, 5)):
            lines = [r.choice([f"Share  this {r.randrange(99)}", "By Ann", f"own {d} {'x' * i} text {chr(97 + d % 26)}", "", "   ", "FOOTER"]) for _ in range(r.randrange(1, 5))]
            rows.append((f"d{d}", i, r.choice(["paragraph", "paragraph", "blockquote", "heading"]), None if r.random() < 0.1 else "\n".join(lines)))
    return items, rows


def places(items, rows, least):
    site = {d: u.split("/")[2].lower().removeprefix("www.") for _, d, u, _, _ in items if u}
    docs, where = {}, {}
    for d, i, kind, content in rows:
        if d in site and kind in ("paragraph", "blockquote") and content is not None:
            for n, line in enumerate(content.split("\n")):
                if key := line_key_py(line):
                    docs.setdefault((site[d], key), set()).add(d)
                    where.setdefault((site[d], key), set()).add((d, i, n))
    return {p for k, ds in docs.items() if len(ds) >= least for p in where[k]}


def test_repeated_places_equal_brute_force(spark):
    items, rows = corpus()
    got = repeated_lines.repeated_places(sections(spark, rows + rows[:20]), spark.createDataFrame(items + items[:5], ITEM))
    assert {tuple(r) for r in got.collect()} == places(items, rows, 6)


def test_lines_of_empty_tables_and_cleaning(spark):
    items, rows = corpus()
    s, i = sections(spark, rows), spark.createDataFrame(items, ITEM)
    assert repeated_lines.repeated_places(s.limit(0), i).count() == 0
    assert repeated_lines.repeated_places(s, i.limit(0)).count() == 0
    drop = places(items, rows, 6)
    want = {(d, n): None if c is None else c if k == "heading" else "\n".join(x for j, x in enumerate(c.split("\n")) if (d, n, j) not in drop) for d, n, k, c in rows}
    assert {(r.doc_id, r.section_index): r.content for r in repeated_lines.without_repeated_lines(s, i).collect()} == want


def test_sequences_equal_brute_force(spark):
    items = [(f"i{d}", f"d{d}", f"https://s.example/{d}", AT, "x") for d in range(8)]
    seqs = ["abc", "abc", "acb", "ab", "bab", "abca", "c", "ab"]
    rows = [(f"d{d}", 0, "paragraph", "\n".join(s)) for d, s in enumerate(seqs)]
    lines = repeated_lines.site_lines(sections(spark, rows), spark.createDataFrame(items, ITEM))

    def holds(s, p):
        at = 0
        for c in p:
            at = s.find(c, at) + 1
            if not at:
                return False
        return True

    patterns = [a for a in "abc"] + [a + b for a in "abc" for b in "abc"] + [a + b + c for a in "abc" for b in "abc" for c in "abc"]
    want = sorted((len(p), n) for p in patterns if (n := sum(holds(s, p) for s in seqs)) >= 3)
    for local in (100, 3, 0):  # grown in one task, in part over the cluster, wholly over the cluster
        found = repeated_lines.frequent_sequences(lines, min_docs=3, local_lines=local).collect()
        assert sorted((len(r.pattern), r.docs) for r in found) == want


def test_long_copies_are_one_sequence(spark):
    """Forty lines that six documents share have 2^40 frequent subsequences; they are one symbol."""
    items = [(f"i{d}", f"d{d}", f"https://s.example/{d}", AT, "x") for d in range(7)]
    rows = [(f"d{d}", n, "paragraph", f"own {'x' * d}\nline {'y' * n}") for d in range(6) for n in range(40)]
    rows += [("d6", 0, "paragraph", "nothing of it")]
    found = repeated_lines.site_sequences(sections(spark, rows), spark.createDataFrame(items, ITEM)).collect()
    assert [(len(r.pattern), r.docs) for r in found] == [(40, 6)]
    assert repeated_lines.repeated_places(sections(spark, rows), spark.createDataFrame(items, ITEM)).count() == 240


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n,;。é\U0001f600", max_size=400), st.integers(20, 60), st.integers(0, 9))
def test_pieces(text, limit, overlap):
    pieces = splitting.split_text(text, limit, overlap)
    assert "".join(text[lo:hi] for lo, _, hi, _ in pieces) == text
    assert all(len(p) <= limit or len(pieces) == 1 for *_, p in pieces)
    for (lo0, _, hi0, _), (lo, back, _, piece) in zip(pieces, pieces[1:]):
        assert hi0 == lo and lo0 <= back < lo if overlap else back == lo
        assert lo - back <= overlap and piece.startswith(text[back:lo])


def test_cuts_are_natural_where_they_can_be():
    text = "One two three. " * 300
    assert all(text[hi - 2 : hi] == ". " for _, _, hi, _ in splitting.split_text(text)[:-1])
    paragraphs = ("word " * 60 + "\n\n") * 20
    assert all(paragraphs[:hi].endswith("\n\n") for _, _, hi, _ in splitting.split_text(paragraphs)[:-1])
    assert max(len(p) for *_, p in splitting.split_text("x" * 100_001)) <= 2000


def test_chunks_that_must_be_cut(spark):
    rows = [
        ("a", " > A >  > B", "x. " * 900, datetime(2024, 1, 1), 1), ("a", "A", "short", datetime(2024, 1, 2), 2), ("b", None, "y. " * 900, datetime(2024, 1, 2), 3), ("b", None, "y. " * 900, datetime(2024, 1, 2), 3),
        ("b", None, "old", datetime(2023, 1, 2), 3), ("c", None, None, datetime(2024, 1, 1), 4), ("d", "> D >", "\U0001f600" * 2001, datetime(2024, 1, 1), 5), ("e", None, "\U0001f600" * 2000, None, 5), ("f", None, "", None, 5),
    ]
    df = spark.createDataFrame(rows, "chunk_id string, heading_path string, text string, updated_at timestamp, piece int")
    got = splitting.chunk_pieces(df).collect()
    assert {r.chunk_id for r in got} == {"b", "d"} and {r.context for r in got} == {None, "D"}
    assert splitting.chunk_pieces(df.limit(0)).count() == 0
    s = sections(spark, [("d", 0, "paragraph", "z. " * 900), ("d", 0, "paragraph", "z. " * 900), ("d", 1, "paragraph", None)])
    assert {(r.doc_id, r.section_index, r.piece) for r in splitting.section_pieces(s).collect()} == {("d", 0, 0), ("d", 0, 1)}
    with pytest.raises(ValueError, match="overlap"):
        splitting.split_items(df, ["chunk_id"], "text", 100, 60)


words = st.lists(st.sampled_from("abc"), max_size=14)


@settings(max_examples=200, deadline=None)
@given(st.lists(words, max_size=4), words, st.integers(2, 5))
def test_matches_equal_brute_force(items, doc, least):
    passages = [(i, " ".join(w)) for i, w in enumerate(items)]
    spans, longest = leakage.build_matcher(passages, least).runs(doc, least)
    want, covered = {}, set()
    for i, w in enumerate(items):
        for a in range(len(doc)):
            for b in range(a + least, len(doc) + 1):
                run = doc[a:b]
                if any(w[k : k + len(run)] == run for k in range(len(w))):
                    want[i] = max(want.get(i, 0), len(run))
                    covered |= set(range(a, b))
    assert longest == want
    assert {k for a, b in spans for k in range(a, b)} == covered


def test_leaks_in_tables(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs = [(1, f"Start. {passage.upper()}, end of a longer text that goes on and on for a while with many other words in it"), (2, "one two three"), (3, None), (4, ""), (5, f"{passage[4:]}"), (1, f"Start. {passage.upper()}, end of a longer text that goes on and on for a while with many other words in it"), (6, passage.replace("seven", "7"))]
    d = spark.createDataFrame([(*x, "e") for x in docs], "doc_id bigint, text string, eval_id string")
    e = spark.createDataFrame([(7, passage, "t"), (8, "too short", "t"), (9, None, "t"), (10, passage, "t")], "eval_id bigint, passage string, text string")
    assert sorted((r.doc_id, r.eval_id, r.words) for r in leakage.leaks(d, e).collect()) == [(1, 7, 14), (1, 10, 14), (5, 7, 13), (5, 10, 13)]
    assert leakage.leaks(d.limit(0), e).count() == 0 and leakage.leaks(d, e.limit(0)).count() == 0
    clean = leakage.without_leaks(d, e).collect()
    assert len(clean) == len(docs)
    assert {r.doc_id: r.dropped for r in clean} == {1: False, 2: False, 3: False, 4: False, 5: True, 6: False}
    assert next(r.text for r in clean if r.doc_id == 1).startswith("Start. , end")
    with pytest.raises(ValueError, match="too many"):
        leakage.build_matcher([(1, passage)], 13, 5)


def test_item_sets_over_the_bound_are_cut(spark):
    e = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(20))) for i in range(9)], "eval_id bigint, passage string")
    d = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(15))) for i in range(9)], "doc_id bigint, text string")
    assert len(list(leakage.automata(e, max_item_words=150))) > 1
    parts = list(leakage.automata(e, max_item_words=150))
    assert sum(len(m.runs(words_py(r.text), 13)[1]) for m in parts for r in d.collect()) == 9


def test_leaks_of_several_automata_and_short_items(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    items = [(k, " ".join(r.choices(words, k=30))) for k in range(12)] + [(90, "only four words here")]
    docs = [(k, " ".join([*r.choices(words, k=20), *items[k % 12][1].split()[5:25], *r.choices(words, k=20), *("only four words here".split() if k % 5 == 0 else [])])) for k in range(24)]
    d, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "eval_id long, passage string")
    one = sorted(map(tuple, leakage.leaks(d, e).collect()))
    assert sorted(map(tuple, leakage.leaks(d, e, max_item_words=100).collect())) == one and len(one) == 24
    short = sorted(map(tuple, leakage.leaks(d, e, whole_short=True).collect()))
    assert short == sorted(one + [(k, 90, 4) for k in range(0, 24, 5)])
    assert sorted(map(tuple, leakage.without_leaks(d, e, max_item_words=100).collect()), key=str) == sorted(map(tuple, leakage.without_leaks(d, e).collect()), key=str)
