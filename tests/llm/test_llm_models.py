import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorefold.llm import language, near_duplicates as nd, packing, reading_level

R = random.Random(3)
VOCAB = {
    "en": "the and of with that from this which through between window garden river would should about paper light", "de": "der die und nicht mit auf eine zwischen fenster garten würde sollte über papier durch wird auch sehr",
    "fr": "le la les et dans une pour avec fenêtre jardin rivière serait devrait papier lumière très aussi cette", "es": "el los las para una con ventana jardín río sería debería papel luz muy también esta entre porque",
    "pt": "o os uma não com para janela jardim rio seria deveria papel luz muito também esta entre porque são", "zh": "的 了 在 是 我们 这个 可以 没有 因为 所以 花园 窗户 河流 应该 已经 时间 问题 工作",
}


def sentence(lang, r, n=12):
    ws = [r.choice(VOCAB[lang].split()) for _ in range(n)]
    return ("".join(ws) + "。") if lang == "zh" else " ".join(ws).capitalize() + "."


@pytest.fixture(scope="module")
def net():
    r = random.Random(1)
    rows = [(sentence(k, r), k) for k in VOCAB for _ in range(80)]
    return language.train([t for t, _ in rows], [k for _, k in rows], steps=500)


def test_languages_of_held_out_text(net):
    r = random.Random(2)
    texts = [(sentence(k, r, 20), k) for k in VOCAB for _ in range(20)]
    got = language.segment_batch(net, [t for t, _ in texts])
    assert np.mean([len(g) == 1 and g[0][2] == k for g, (_, k) in zip(got, texts)]) >= 0.95


def test_segments_of_mixed_text(net):
    r = random.Random(4)
    right = 0
    for _ in range(40):
        a, b = r.sample(list(VOCAB), 2)
        x, y = sentence(a, r, 20), sentence(b, r, 20)
        text = f"{x} {y}"
        segments = language.segment_batch(net, [text])[0]
        assert segments[0][0] == 0 and segments[-1][1] == len(text) and all(p[1] == q[0] for p, q in zip(segments, segments[1:]))
        assert all(0 < s[3] <= 1 for s in segments)
        right += [s[2] for s in segments] == [a, b] and abs(segments[0][1] - len(x)) <= 2
    assert right >= 36


def test_short_sentences_are_read(net):
    """A row of sentences too short to fill two blocks, and a sentence of 40 to 46 bytes wherever it begins,
    keep their own language beside another's."""
    r = random.Random(5)
    rows = alone = 0
    for i in range(48):
        a, b = r.sample([k for k in VOCAB if k != "zh"], 2)
        outer = sentence(b, r, 20)
        row = " ".join(s for s in (sentence(a, r, 3) for _ in range(6)) if len(s.encode()) < 32)
        one = next(s for s in (sentence(a, r, r.randint(5, 9)) for _ in range(10_000)) if 40 <= len(s.encode()) <= 46)
        for text in (row, one):
            before = f"{outer} {'x' * (i % 16)} {sentence(b, r, 20)} "
            found = [s for s in language.segment_batch(net, [f"{before}{text} {outer}"])[0] if s[2] == a and abs(s[0] - len(before)) <= 2 and abs(s[1] - len(before) - len(text)) <= 2]
            rows, alone = rows + (text is row and bool(found)), alone + (text is one and bool(found))
    assert rows >= 43 and alone >= 43


def test_features_do_not_depend_on_the_batch(net):
    texts = [sentence(k, R, n) for k in VOCAB for n in (1, 5, 40)]
    alone = [language.segment_batch(net, [t])[0] for t in texts]
    for a, b in zip(alone, language.segment_batch(net, texts)):
        assert [x[:3] for x in a] == [x[:3] for x in b]


@pytest.mark.parametrize(("label", "code"), [("en", "en"), ("EN", "en"), ("en_GB", "en"), ("pt-PT", "pt"), ("ger", "de"), ("Deutsch", "de"), ("Portuguese", "pt"), ("zho", "zh"), ("und", None), ("", None), (None, None), ("klingon", None)])
def test_labels(label, code):
    assert language.label_language(label) == code


def test_mislabelled_sections(spark, net):
    r = random.Random(5)
    en, de = sentence("en", r, 20), sentence("de", r, 20)
    s = spark.createDataFrame([("d1", 0, "paragraph", en, 1), ("d1", 0, "paragraph", en, 1), ("d1", 1, "paragraph", f"{en} {de}", 1), ("d1", 2, "heading", de, 1), ("d2", 0, "paragraph", en, 1), ("d3", 0, "blockquote", en, 1), ("d1", 3, "paragraph", None, 1), ("d1", 4, "paragraph", "", 1), ("d1", 5, "paragraph", "ok so", 1)], "doc_id string, section_index int, type string, content string, label int")
    i = spark.createDataFrame([("i1", "d1", "de_DE", 1), ("i1", "d1", "English", 2), ("i2", "d2", None, 1), ("i3", "d3", "Deutsch", 1)], "item_id string, active_doc_id string, language string, updated_at int")
    got = {tuple(x) for x in language.mislabelled_sections(s, i, net).collect()}
    assert got == {("d1", 1, "de"), ("d2", 0, "en"), ("d3", 0, "en")}
    docs = {x.doc_id: x.language for x in language.document_languages(s, net).collect()}
    assert docs == {"d1": "en", "d2": "en", "d3": "en"}
    assert language.mislabelled_sections(s.limit(0), i, net).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=12))
def test_packing_patterns_hold_every_item_once(histogram):
    patterns = packing.shortest_pack_first(histogram, 30)
    held = {}
    for count, pattern in patterns:
        assert count > 0 and sum(n * k for n, k in pattern) <= 30
        for n, k in pattern:
            held[n] = held.get(n, 0) + k * count
    assert held == histogram
    total = sum(n * k for n, k in histogram.items())
    assert sum(c for c, _ in patterns) <= max(2 * -(-total // 30), 1)


def test_containers(spark):
    lengths = [(i, n) for i, n in enumerate([0, 0, None, 5, 5, 5, 8, 10, 11, 25, 3, 3, 10] + [4] * 50)]
    df = spark.createDataFrame([(*x, "c") for x in lengths], "doc_id bigint, tokens bigint, container string")
    got = packing.pack(df, capacity=10).collect()
    by, pieces = {}, {}
    for r in got:
        if r.position >= 0:
            by.setdefault(r.container, []).append((r.position, r.offset, r.tokens))
        pieces.setdefault(r.doc_id, []).append((r.piece, r.from_token, r.tokens))
    for c in by.values():
        c.sort()
        assert [p for p, *_ in c] == list(range(len(c)))
        assert all(o == sum(n for *_, n in c[:i]) for i, (_, o, _) in enumerate(c)) and sum(n for *_, n in c) <= 10
    for d, n in lengths:
        ps = sorted(pieces[d])
        assert sum(p[2] for p in ps) == (n or 0) and (len(ps) == 1 or n > 10) and [p[1] for p in ps] == [10 * i for i in range(len(ps))]
    assert packing.pack(df.limit(0), capacity=10).count() == 0


def test_ranks_are_complete(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("g"))
    ranks = {}
    for r in packing.ranked(df, "g", ["doc_id"], 7).collect():
        ranks.setdefault(r.g, []).append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in ranks.values())


def test_token_lengths(spark):
    df = spark.createDataFrame([(1, "hello world"), (1, "hello world"), (2, None), (3, ""), (None, "x"), (4, "<|endoftext|>")], "doc_id bigint, text string")
    got = {r.doc_id: r.tokens for r in packing.token_lengths(df).collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] == 0 and got[4] > 1 and None not in got


def test_reading_levels(spark):
    r = random.Random(6)
    easy, hard = "cat dog sun big red run sit hat".split(), [f"{a}{b}ation" for a in "bcdfg" for b in "aeiou"]
    rows, labels = [], []
    for i in range(200):
        level = 1 + i % 5
        n = 4 + 5 * level
        rows.append((i, " ".join(" ".join(r.choice(hard if r.random() < level / 8 else easy) for _ in range(n)) + "." for _ in range(6)), "en"))
        if i % 2:
            labels += [(i, "a", level), (i, "b", level)]
    rows += [(900, None, "en"), (901, "  ", None), (902, "123 456.", "xx"), (900, None, "en"), (903, "猫坐在这里。狗跑了。", "zh")]
    d = spark.createDataFrame([(*x, 7) for x in rows], "doc_id bigint, text string, lang string, score int")
    lab = spark.createDataFrame(labels, "doc_id bigint, rater string, reading_level int")
    got = {x.doc_id: x for x in reading_level.reading_levels(d, lab, size=20).collect()}
    held = [abs(got[i].reading_level - (1 + i % 5)) for i in range(0, 200, 2)]
    assert np.mean(np.array(held) <= 1) > 0.95 and np.mean(held) < 0.6
    assert got[900].reading_level is None and got[901].score is None and got[902].words == 0 and got[903].words == 8
    assert reading_level.reading_levels(d.limit(0), lab.limit(0)).count() == 0


def sections(spark, docs):
    rows = [(d, i, c, 1) for d, parts in docs.items() for i, c in enumerate(parts)]
    return spark.createDataFrame(rows + rows[:7], "doc_id string, section_index int, content string, similarity int")


def brute(docs, similarity, size):
    from lorefold.functions.text import words_py

    sets = {}
    for d, parts in docs.items():
        w = words_py("\n".join(p for p in parts if p is not None))
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
    names = sorted(d for d in sets if sets[d])
    return {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])}


def edited_docs(n, r, length=60):
    docs = {}
    for i in range(n):
        if i and r.random() < 0.6:
            w = " ".join(p for p in docs[f"d{r.randrange(i)}"] if p).split()
            for _ in range(r.randrange(0, 7)):
                at = r.randrange(max(1, len(w)))
                w[at : at + r.choice([0, 1, 1])] = [f"w{r.randrange(40)}"]
        else:
            w = [f"w{r.randrange(40)}" for _ in range(r.randrange(1, length))]
        cut = r.randrange(len(w) + 1)
        docs[f"d{i}"] = [" ".join(w[:cut]), None, " ".join(w[cut:])]
    return docs


@pytest.mark.parametrize(("similarity", "size"), [(0.6, 3), (0.8, 5)])
def test_pairs_equal_brute_force(spark, similarity, size, monkeypatch):
    monkeypatch.setattr(nd, "LEAST_SLOTS", 1 << 6)  # far fewer slots than pivots
    monkeypatch.setattr(nd, "MOST_SLOTS", 1 << 6)
    docs = edited_docs(120, random.Random(8)) | {"e": [""], "n": [None], "s": ["one two"]}
    got = nd.similar_documents(sections(spark, docs), similarity, size).collect()
    assert len(got) == len({(r.doc_id_a, r.doc_id_b) for r in got})
    assert {(r.doc_id_a, r.doc_id_b) for r in got} == brute(docs, similarity, size)


def test_regions_with_populous_pivots_and_small_blocks():
    r = np.random.default_rng(0)
    sets = []
    for i in range(150):
        base = sets[r.integers(len(sets))].copy() if i and r.random() < 0.6 else r.integers(0, 1 << 62, r.integers(1, 60)).astype(np.uint64)
        base[r.integers(len(base))] = np.uint64(r.integers(0, 1 << 62))
        sets.append(np.unique(np.concatenate([base, np.arange(5, dtype=np.uint64)])))
    rows = []
    for i, s in enumerate(sets):
        n = len(s)
        chosen = s[: nd.window(n, 0.6)]
        rows.append((0, i, n, (chosen & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), np.arange(len(chosen), dtype=np.int32).tobytes(), b"", nd.parity_sketch(s, nd.sketch_bits(n)).tobytes()))
    import pandas as pd

    pdf = pd.DataFrame(rows, columns=["region", "id", "n", "pivots", "places", "own", "sketch"])
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if len(c := np.intersect1d(sets[i], sets[j])) >= 0.6 * (len(sets[i]) + len(sets[j]) - len(c))}
    for block in (1, 7, 10_000):
        got = {(a, b) for a, b in nd.join_region(pdf, 0.6, block).itertuples(index=False)}
        assert want <= got
        assert len(got) < 3 * len(want) + 50


def test_divided_pivots_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(nd, "LEAST_SLOTS", 1 << 13)
    monkeypatch.setattr(nd, "MOST_SLOTS", 1 << 13)
    monkeypatch.setattr(nd, "POPULOUS", 4)
    docs = edited_docs(60, random.Random(9), 30)
    words = nd.word_table(nd.document_texts(sections(spark, docs)))
    table, _, _ = nd.populations(words)
    placed = nd.placements(words, table, 3, 0.6, 3)
    assert placed.where("length(own) > 0").count() > 0
    pairs = placed.groupBy("region").applyInPandas(lambda pdf: nd.join_region(pdf, 0.6), "a bigint, b bigint").distinct()
    names = {r.id: r.doc_id for r in words.collect()}
    assert brute(docs, 0.6, 3) <= {tuple(sorted((names[r.a], names[r.b]))) for r in pairs.collect()}


def test_sketches_bound_differences():
    r = np.random.default_rng(1)
    for _ in range(200):
        a, b = (np.unique(r.integers(0, 400, r.integers(1, 200)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        x, y = nd.parity_sketch(a, nd.sketch_bits(len(a))), nd.parity_sketch(b, nd.sketch_bits(len(b)))
        m = min(len(x), len(y))
        assert np.bitwise_count(nd.fold(x, m) ^ nd.fold(y, m)).sum() <= len(np.setxor1d(a, b))


def test_groups(spark):
    chain = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(30)] + [("x", "y"), ("y", "z"), ("x", "z")]
    pairs = spark.createDataFrame(chain + chain[:3], "doc_id_a string, doc_id_b string")
    got = {r.doc_id: (r.group_id, r.links) for r in nd.connected_groups(pairs).collect()}
    assert {g for g, _ in got.values()} == {"n00", "x"} and len(got) == 34
    assert got["n00"] == ("n00", 1) and got["n05"] == ("n00", 2) and got["z"] == ("x", 2)
    assert nd.connected_groups(pairs.limit(0)).count() == 0


def test_copies_are_counted_without_their_pairs(spark):
    r = random.Random(11)
    docs = edited_docs(25, r, 40)
    docs |= {f"copy{i}": docs["d0"] for i in range(6)} | {f"same{i}": ["alpha beta gamma delta epsilon"] for i in range(4)}
    want = brute(docs, 0.6, 3)
    pairs = nd.similar_documents(sections(spark, docs)).collect()
    assert {(x.doc_id_a, x.doc_id_b) for x in pairs} == want and len(pairs) == len(want)
    parent = {d: d for d in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = {}
    for a, b in want:
        links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {x.doc_id: (x.group_id, x.links) for x in nd.near_duplicate_groups(sections(spark, docs)).collect()}
    assert got == {d: (find(d), n) for d, n in links.items()}


def test_pairs_of_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id string, section_index int, content string")
    assert nd.similar_documents(empty).count() == 0
    assert nd.near_duplicate_groups(empty).count() == 0


def test_a_crowded_table_does_not_multiply_placements():
    """Slots that all hold very many rare pivots: none stands out, so none is divided; a heavy one still does."""
    counts = np.random.default_rng(3).poisson(60_000, 1 << 12)
    counts[5] += 50_000
    q = np.minimum(255, np.round(8 * np.log2(counts))).astype(np.uint8)
    level = nd.without_background(q)
    populous = level >= int(8 * math.log2(nd.POPULOUS))
    assert populous[5] and populous.sum() == 1
    sparse = np.round(8 * np.log2(np.array([1, 1, 2, 3, 40_000]))).astype(np.uint8)
    assert (nd.without_background(sparse) == sparse).all() and nd.without_background(np.r_[q, np.uint8(0)])[-1] == 0


def test_large_classes_are_divided(spark, monkeypatch):
    """Copies, their links to another text and a hub of many edges, each with more rows than one task may hold."""
    from lorefold.operators import skew

    monkeypatch.setattr(skew.salted_lookup, "__defaults__", ("inner", 5))
    text = " ".join(f"w{i}" for i in range(40))
    docs = {f"d{k:02}": [text] for k in range(12)} | {"e1": [text + " more"], "e2": ["nothing at all like it"]}
    rows = sections(spark, docs)
    assert nd.similar_documents(rows).count() == 13 * 12 // 2
    got = {(r.group_id, r.links) for r in nd.near_duplicate_groups(rows).collect()}
    assert got == {("d00", 12)}
    hub = spark.createDataFrame([("m", f"x{k}") for k in range(30)], "doc_id_a string, doc_id_b string")
    assert {r.group_id for r in nd.connected_groups(hub).collect()} == {"m"}


def plan_of(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_that_grow_are_not_broadcast(spark, monkeypatch):
    """The planner takes a compressed file of words for far less than it holds: at the usual threshold it broadcast all of it."""
    docs = edited_docs(40, random.Random(12)) | {f"same{i}": ["alpha beta gamma delta epsilon"] for i in range(4)}
    words = nd.word_table(nd.document_texts(sections(spark, docs)))
    assert "Broadcast" not in plan_of(nd.similar_ids(words))
    found = nd.similar_documents(sections(spark, docs))
    plan = plan_of(found)
    assert "BroadcastHashJoin [a#" not in plan and "BroadcastHashJoin [b#" not in plan
    # copies beyond the bound are merged and left out all the same
    monkeypatch.setattr(nd, "BROADCAST_ROWS", 1)
    again = nd.similar_documents(sections(spark, docs))
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in found.collect()}
    assert {(r.doc_id_a, r.doc_id_b) for r in again.collect()} == brute(docs, 0.6, 3)


def test_levels_take_little_memory():
    import tracemalloc

    q = np.full(1 << 20, 160, np.uint8)
    tracemalloc.start()
    nd.without_background(q)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * len(q)
