"""Registered queries against their SQL on the smallest tables; a few of each kind, to stay quick."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_every_sql_has_its_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("missing", ["lectern.llm.queries", "corpus_pipeline"])
def test_missing_parts_leave_the_rest(monkeypatch, missing):
    import importlib

    import __spark_entry__ as entry

    whole, found = set(entry.queries()), importlib.import_module

    def without(name, *more):
        if name == missing:
            raise ImportError(name)
        return found(name, *more)

    monkeypatch.setattr(importlib, "import_module", without)
    left = set(entry.queries())
    assert "search_batch" in left and "pipeline" not in left and set(entry.oracle_sql()) <= left
    assert not any(n.startswith("op1_") for n in left) if missing == "lectern.llm.queries" else left == whole - {"pipeline"}


@pytest.mark.parametrize("name", ["fingerprint", "tokenize", "match_phrase", "search_ranked", "search_batch", "search_batch_ops", "search_substring", "index_upsert", "index_upsert_postings", "ledger_put", "evict_lru", "ocr_enrich", "apply_annotation_changes", "regression_report", "index_stream", "recents_replay", "janitor_stream"])
def test_equals_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    db = duckdb.connect()
    for t in ("part", "lineitem", "orders", "events", "documents", "pages", "benchmark", "labels"):
        db.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got = entry.queries()[name](spark, SF)
    cursor = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, cursor.fetchall()))


def test_streams_equal_batch(spark):
    import __spark_entry__ as entry

    q = entry.queries()
    assert sorted(q["recents_stream"](spark, SF).collect()) == sorted(q["recents_replay"](spark, SF).collect())


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
