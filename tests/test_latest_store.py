from datetime import datetime

from pyspark.sql import functions as F

from lorefold.operators import store
from lorefold.operators.latest import holding_rows
from lorefold.operators.skew import salted_lookup

T = [datetime(2024, 1, d) for d in range(1, 6)]


def test_holding_rows(spark):
    rows = [("a", T[0], "old"), ("a", T[2], "new"), ("a", T[2], "new"), ("b", None, "x"), (None, T[1], "y"), ("c", T[1], None)]
    df = spark.createDataFrame(rows, "k string, at timestamp, v string")
    got = {r.k: r.v for r in holding_rows(df, ["k"], "at").collect()}
    assert got == {"a": "new", "b": "x", "c": None}
    tie = spark.createDataFrame([("a", T[0], "x"), ("a", T[0], "y")], "k string, at timestamp, v string")
    assert len({holding_rows(tie.orderBy(F.rand(i)), ["k"], "at").first().v for i in range(3)}) == 1
    assert holding_rows(df.limit(0), ["k"], "at").count() == 0


def test_salted_lookup_equals_a_plain_join(spark):
    left = spark.range(300).select((F.col("id") % 3).alias("k"), "id")
    right = spark.createDataFrame([(0, "a"), (1, "b")], "k bigint, v string")
    for how, most in (("inner", 30), ("left", 30), ("left", 1000)):  # keys of 100 rows in four parts, or whole
        a = sorted(map(tuple, salted_lookup(left, right, ["k"], ["id"], how=how, rows_per_task=most).select("id", "v").collect()), key=str)
        b = sorted(map(tuple, left.join(right, "k", how).select("id", "v").collect()), key=str)
        assert a == b


def test_upsert_keeps_first_columns(spark):
    schema = "id string, v string, created_at timestamp"
    old = spark.createDataFrame([("a", "1", T[0]), ("b", "1", T[0])], schema)
    new = spark.createDataFrame([("a", "2", T[1]), ("a", "3", T[2]), ("c", None, T[1])], schema)
    got = {r.id: (r.v, r.created_at) for r in store.upsert(old, new, ["id"], keep=["created_at"], order="created_at").collect()}
    assert got == {"a": ("3", T[0]), "b": ("1", T[0]), "c": (None, T[1])}
    assert {r.id for r in store.insert_missing(old, new, ["id"]).collect()} == {"a", "b", "c"}
    assert sorted(r.v for r in store.replace_children(old, new.where("id = 'a'"), "id").collect()) == ["1", "2", "3"]


def test_states(spark):
    log = spark.createDataFrame([(1, 1, "pending"), (1, 2, "fetching"), (1, 3, "failed"), (1, 4, "pending"), (1, 5, "fetching"), (2, 1, "saved")], "item int, seq int, state string")
    got = {r.item: (r.state, r.attempts) for r in store.latest_states(log, "item", ["seq"]).collect()}
    assert got == {1: ("fetching", 2), 2: ("saved", 0)}
    recovered = store.recover_stale(spark.createDataFrame([(1, "fetching"), (2, "saved")], "item int, state string"))
    assert {(r.state, r.error_code) for r in recovered.collect()} == {("failed", "stale"), ("saved", None)}


def test_snapshots_and_manifest(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    assert s.read("items") is None
    s.commit({"items": spark.range(3), "docs": spark.range(1)})
    held = s.read("items")
    s.commit({"items": spark.range(5)})
    assert (s.read("items").count(), held.count(), s.read("docs").count()) == (5, 3, 1)
    assert s.vacuum(keep=1) == 1
    assert s.read("items").count() == 5


def test_probe_precedence(spark):
    aliases = spark.createDataFrame([("canonical_url", "u", "b"), ("normalized_url", "n", "a"), ("original_url", "x", "c")], "alias_type string, alias_value string, item_id string")
    urls = spark.createDataFrame([("u", "n"), ("x", "x"), ("none", "none")], "url string, normalized string")
    assert {(r.url, r.item_id, r.priority) for r in store.probe_urls(urls, aliases).collect()} == {("u", "a", 1), ("x", "c", 4)}


def test_remove_and_purge(spark):
    items = spark.createDataFrame([("i1", "parsed", "d1"), ("i2", "captured", None)], "item_id string, state string, active_doc_id string")
    docs = spark.createDataFrame([("d1",)], "doc_id string")
    ids = spark.createDataFrame([("i1",), ("i2",)], "item_id string")
    out = store.remove_items(items, docs, docs, docs, ids)
    assert {(r.item_id, r.state, r.active_doc_id) for r in out["items"].collect()} == {("i1", "captured", None), ("i2", "captured", None)}
    assert out["documents"].count() == 0
    left = store.purge_items({"items": items, "docs": docs}, ids.limit(1))
    assert left["items"].count() == 1
