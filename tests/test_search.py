import sqlite3

import pytest
from pyspark.sql import functions as F

from lectern.functions import predicates as P
from lectern.functions.text import tokenize
from lectern.operators import index as I
from lectern.operators import search as Q

PAGES = "fp string, path string, page_index int, text string"


def indexed(spark, rows):
    return I.with_tokens(spark.createDataFrame(rows, PAGES))


def test_restrict_limit_and_null_layers(spark):
    pages = indexed(spark, [("doc-A", "/A", 0, "Lectern rocks"), ("doc-B", "/B", 0, "Lectern also rocks here"), ("doc-B", "/B", 1, None)])
    assert Q.search_ranked(pages, P.terms("lectern")).count() == 2
    assert [r["fp"] for r in Q.search_ranked(pages, P.terms("lectern"), fp="doc-B").collect()] == ["doc-B"]
    assert Q.search_ranked(pages, P.terms("  ")).count() == 0 and Q.search_ranked(pages, P.terms("lectern"), k=0).count() == 0
    many = indexed(spark, [(f"d{i}", f"/{i}", 0, "Lectern") for i in range(20)])
    assert Q.search_ranked(many, P.terms("lectern"), k=5).count() == 5


@pytest.mark.parametrize("query,units", [("the", "t"), ("the and", "tt"), ('"of the"', "p"), ("ga*", "x")])
def test_ranks_equal_fts5(spark, query, units):
    texts = [f"the cat {'and the ' * (i % 4)} game of the {'gamma ' * (i % 3)} hat {i}" for i in range(40)] + ["", "nothing at all", "and", "of the"]
    pages = indexed(spark, [(f"d{i:02d}", "/", 0, t) for i, t in enumerate(texts)])
    asked = {"t": lambda: P.terms("the"), "tt": lambda: P.terms("the and"), "p": lambda: [P.phrase("of the")], "x": lambda: [P.prefix("ga")]}[units]()
    got = {r["fp"]: r["rank"] for r in Q.search_ranked(pages, asked, 1000).collect()}
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table f using fts5(fp unindexed, text, tokenize = 'unicode61 remove_diacritics 2')")
    except sqlite3.OperationalError:
        pytest.skip("no fts5")
    db.executemany("insert into f values (?, ?)", [(f"d{i:02d}", t) for i, t in enumerate(texts)])
    want = dict(db.execute("select fp, bm25(f) from f where f match ?", (query,)))
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_batch_equals_single(spark):
    pages = indexed(spark, [(f"d{i}", "/", i % 3, f"the cat {'sat ' * (i % 5)}on mat {i}") for i in range(30)])
    posts = I.postings(pages)
    queries = spark.createDataFrame([(1, "cat sat", 5), (2, "the the", 3), (3, " ", 5), (4, "cat", 0), (5, "zebra", 5)], "query_id int, text string, max_results int")
    got = Q.search_batch(pages, posts, I.term_stats(posts), queries, tokenize(F.col("text"))).collect()
    assert {r["query_id"] for r in got} == {1, 2}
    single = Q.search_ranked(pages, P.terms("cat sat"), 5).collect()
    assert [(r["fp"], r["page_index"], round(r["rank"], 9)) for r in sorted((r for r in got if r["query_id"] == 1), key=lambda r: r["place"])] == [(r["fp"], r["page_index"], round(r["rank"], 9)) for r in single]


def test_substring_search(spark):
    pages = spark.createDataFrame([("d", "/", 0, "alpha"), ("d", "/", 1, "beta needle"), ("d", "/", 2, "Needle gamma needle"), ("d", "/", 3, None)], PAGES)
    got = Q.search_substring(pages, "needle").orderBy("page_index", "pos").collect()
    assert [(r["page_index"], r["pos"]) for r in got] == [(1, 5), (2, 0), (2, 13)]
    assert Q.search_substring(pages, "needle", 2).count() == 2 and Q.search_substring(pages, " ").count() == 0 and Q.search_substring(pages, "needle", 0).count() == 0
    redacted = {r["page_index"]: (r["text"], r["n_redacted"]) for r in Q.find_and_redact(pages, "needle").collect()}
    assert redacted[2] == ("██████ gamma ██████", 2) and redacted[3] == (None, 0)


def test_index_changes(spark):
    base = spark.createDataFrame([("A", "/A", 0, "old text"), ("A", "/A", 1, "more"), ("B", "/B", 0, "x")], PAGES)
    new = spark.createDataFrame([("A", "/A2", 0, "new")], PAGES)
    assert sorted((r["fp"], r["text"]) for r in I.upsert_pages(base, new).collect()) == [("A", "new"), ("B", "x")]
    gone = spark.createDataFrame([("B",), ("C",)], "fp string")
    assert {r["fp"] for r in I.remove(base, gone).collect()} == {"A"}
    reg = I.registry(base, F.expr("timestamp'2024-01-01 00:00:00'"))
    assert {r["fp"]: r["removed"] for r in I.removal_flags(reg, gone).collect()} == {"B": True, "C": False}
    docs = spark.createDataFrame([("A", "/A2"), ("D", "/D")], "fp string, path string")
    after = {r["fp"]: (r["path"], r["page_count"]) for r in I.upsert_registry(reg, docs, new, F.expr("timestamp'2024-01-02 00:00:00'")).collect()}
    assert after == {"A": ("/A2", 1), "B": ("/B", 1), "D": ("/D", 0)}
    assert [r["fp"] for r in I.list_indexed(reg.withColumn("last_indexed", F.when(F.col("fp") == "B", F.expr("timestamp'2024-01-03 00:00:00'")).otherwise(F.col("last_indexed")))).collect()] == ["B", "A"]
