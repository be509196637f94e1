import json

from hypothesis import given, settings
from hypothesis import strategies as st

from lorefold.operators import nested

DOC = {
    "doc_id": "d",
    "sections": [
        {"type": "list", "items": ["a", None, {"text": "b", "items": ["x", None, "y"]}, json.dumps({"text": "c", "items": ["z"]})], "assets": {"asset_id": "q"}},
        None,
        {"type": "paragraph", "items": None, "extra": [1]},
    ],
    "references": json.dumps([{"ref_id": "r", "blocks": ["one"]}]),
}
WANT = {
    ("section", 0, -1, -1), ("section", 2, -1, -1), ("item", 0, 0, -1), ("item", 0, 2, -1), ("item", 0, 3, -1), ("subitem", 0, 2, 0), ("subitem", 0, 2, 2), ("subitem", 0, 3, 0),
    ("asset", 0, 0, -1), ("reference", -1, 0, -1), ("block", -1, 0, 0),
}


def frame(spark, payloads):
    return spark.createDataFrame([(f"k{i}", p, "noise") for i, p in enumerate(payloads)], "doc_id string, payload string, path string")


def test_records_and_places(spark):
    twice = json.dumps(json.dumps(DOC))
    df = frame(spark, [json.dumps(DOC), twice, '{"sections": [', None, "[]", "3", "{}", '{"sections": []}'])
    got = {}
    for r in nested.record_places(nested.flatten(df, "doc_id", "payload")).collect():
        got.setdefault(r.doc_id, set()).add((r.kind, r.section_index, r.pos, r.subpos))
    assert got == {"k0": WANT, "k1": WANT}
    assert nested.flatten(df.limit(0), "doc_id", "payload").count() == 0


def test_parents_and_tables(spark, tmp_path):
    records = nested.flatten(frame(spark, [json.dumps(DOC)]), "doc_id", "payload").cache()
    ids = {r.id for r in records.collect()}
    assert all(r.parent_id in ids or r.parent_id == "k0" for r in records.collect()) and len(ids) == records.count()
    nested.write_tables(records, str(tmp_path / "t"))
    items = {r.id: r.text for r in nested.read_table(spark, str(tmp_path / "t"), "item").collect()}
    assert items == {"k0/section:0/item:0": "a", "k0/section:0/item:2": "b", "k0/section:0/item:3": "c"}
    assert nested.read_table(spark, str(tmp_path / "t"), "section").where("type = 'list'").first().parent_id == "k0"


def test_holding_payload(spark):
    rows = [("d", json.dumps(DOC), 1), ("d", '{"sections": [{}]}', 2), ("d", '{"sections": [{}]}', 2)]
    df = spark.createDataFrame(rows, "doc_id string, payload string, written_at int")
    assert nested.all_records(nested.document_tables(df)).count() == 1


texts = st.text("ab{[\"n1", max_size=4)
leaf = st.one_of(st.none(), texts, st.integers(0, 3))
entry = st.one_of(leaf, st.fixed_dictionaries({"text": texts}, optional={"items": st.one_of(leaf, st.lists(leaf, max_size=3)), "assets": st.lists(leaf, max_size=2)}))


@settings(max_examples=150, deadline=None)
@given(st.fixed_dictionaries({}, optional={"sections": st.one_of(leaf, entry, st.lists(entry, max_size=4)), "references": st.lists(entry, max_size=2)}))
def test_visitor_equals_a_recursion(doc):
    def walk(record, nodes):
        for n in nodes:
            for pos, e in enumerate(nested.elements(record.get(n.field)) if isinstance(record, dict) else []):
                e = nested.unwrap(e)
                if e is not None:
                    yield (n.tag, pos), e
                    yield from walk(e, n.children)

    got = [(tag, path[-1]) for tag, path, _, _ in nested.visit(doc)]
    assert got == [k for k, _ in walk(doc, nested.DOCUMENT)]
    paths = [p for _, p, _, _ in nested.visit(doc)]
    assert len(set(paths)) == len(paths) and paths == sorted(paths)
