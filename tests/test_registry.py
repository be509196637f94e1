import importlib.util
from pathlib import Path

import pytest

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def entry():
    spec = importlib.util.spec_from_file_location("__spark_entry__", Path(__file__).resolve().parents[1] / "__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_names(entry):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 60


@pytest.mark.skipif(not SF.exists(), reason="test tables are not here")
def test_flagship(spark, entry):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not SF.exists(), reason="test tables are not here")
def test_query_equals_its_sql(spark, entry):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for f in SF.iterdir():
        db.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    for name in ("url_normalize", "heading_path", "bm25_batch", "context_pack", "collection_navigation", "upsert_items", "batch_counters"):
        df = entry.queries()[name](spark, str(SF))
        cursor = db.execute(entry.oracle_sql()[name])
        columns = [c[0] for c in cursor.description]
        got = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
        assert got == sorted(map(str, cursor.fetchall())), name
