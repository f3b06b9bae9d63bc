"""Search over a stored index equals search by scanning pages; its tables can be kept up to date."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.functions import predicates as P
from lectern.functions.text import highlight_units
from lectern.operators import index as I
from lectern.operators import lookup as K
from lectern.operators import search as Q
from lectern.sources.stored import write_index

PAGES = "fp string, path string, page_index int, text string"


def rows_of(seed, n=60):
    rng = random.Random(seed)
    words = "the cat of Café hat and game gamma sat on mat".split()
    out = []
    for i in range(n):
        text = None if i % 17 == 5 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 14)))
        out.append((f"d{i // 3:02d}", f"/p/{i // 3:02d}", i % 3, text))
    return out


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    pages = spark.createDataFrame(rows_of(1), PAGES)
    return I.with_tokens(pages), write_index(pages, str(tmp_path_factory.mktemp("index")), F.current_timestamp(), buckets=5)


def plain(rows):
    return [(r["fp"], r["path"], r["page_index"], round(r["rank"], 9)) for r in rows]


SINGLE = {
    "all": (P.terms("the cat"), {}), "repeated": (P.terms("cat cat"), {}), "any": (P.terms("gamma cafe"), {"any_unit": True}), "phrase": ([P.phrase("of the")], {}),
    "prefix": ([P.prefix("ga")], {}), "phrase with prefix": ([P.prefix("the ga")], {}), "document": (P.terms("the"), {"fp": "d03"}), "none": (P.terms("zebra"), {}), "two kinds": ([P.phrase("the cat"), *P.terms("mat")], {}),
}


@pytest.mark.parametrize("name", SINGLE)
def test_index_equals_scan(stored, name):
    pages, index = stored
    units, more = SINGLE[name]
    for k in (3, 1000):
        assert plain(K.search_index(index, units, k, **more).collect()) == plain(Q.search_ranked(pages, units, k, **more).collect())


def test_unwanted_units(stored):
    pages, index = stored
    got = {(r["fp"], r["page_index"]) for r in K.search_index(index, P.terms("the"), 1000, unwanted=P.terms("cat")).collect()}
    assert got == {(r["fp"], r["page_index"]) for r in pages.where(P.match_not(F.col("tokens"), P.terms("the"), P.terms("cat"))).collect()} and got
    assert K.search_index(index, [], 5).count() == 0 and K.search_index(index, P.terms("the"), 0).count() == 0


def test_batch_with_operators(spark, stored):
    pages, index = stored
    asked = [
        (1, "The cat", "all", None, None, 1000), (2, "gamma café", "any", None, None, 1000), (3, "of the", "phrase", None, None, 1000), (4, "the ga", "prefix", None, None, 1000), (5, "the", "all", "d03", None, 1000),
        (6, "cat hat", "near", None, None, 1000), (7, "the", "first", None, None, 1000), (8, "the", "all", None, "cat mat", 1000), (9, " ", "all", None, None, 5), (10, "cat", "all", None, None, 0), (11, "cat cat", None, None, None, 4), (12, "zebra", "any", None, None, 5),
    ]
    queries = spark.createDataFrame(asked, "query_id int, text string, op string, fp string, unwanted string, max_results int")
    found: dict = {}
    for r in K.search_index_batch(index, queries, near=2).orderBy("query_id", "place").collect():
        found.setdefault(r["query_id"], []).append(r)
    tokens = F.col("tokens")
    same = {1: (P.terms("the cat"), {}), 2: (P.terms("gamma cafe"), {"any_unit": True}), 3: ([P.phrase("of the")], {}), 4: ([P.prefix("the ga")], {}), 5: (P.terms("the"), {"fp": "d03"}), 11: (P.terms("cat cat"), {})}
    for q, (units, more) in same.items():
        assert plain(found[q]) == plain(Q.search_ranked(pages, units, 4 if q == 11 else 1000, **more).collect()), q
    tests = {6: P.match_near(tokens, "cat hat", 2), 7: P.match_first(tokens, "the"), 8: P.match_not(tokens, P.terms("the"), P.terms("cat mat"))}
    for q, test in tests.items():
        if q == 8:
            test = P.match_all(tokens, P.terms("the")) & ~P.match_any(tokens, P.terms("cat mat"))
        assert {(r["fp"], r["page_index"]) for r in found[q]} == {(r["fp"], r["page_index"]) for r in pages.where(test).collect()}, q
        assert [r["place"] for r in found[q]] == list(range(1, len(found[q]) + 1))
    assert not {9, 10, 12} & set(found)
    assert all("[" in r["snippet"] for rows in found.values() for r in rows)
    assert any("[of the]" in r["snippet"].lower() for r in found[3])


def test_lookup_reads_asked_buckets_only(stored):
    _, index = stored
    plan = K.search_index(index, P.terms("cat"))._jdf.queryExecution().toString()
    assert any("term_bucket" in x.split("]")[0] for x in plan.split("PartitionFilters: [")[1:])


def test_highlights_of_phrases_and_prefixes(spark):
    def shown(text, *units):
        array = F.array(*[F.struct(F.array(*[F.lit(w) for w in words]).alias("words"), F.lit(prefix).alias("prefix")) for words, prefix in units])
        return spark.range(1).select(highlight_units(F.lit(text), array, 8)).first()[0]

    assert shown("A house of the old town", (["of", "the"], False)) == "A house [of the] old town"
    assert shown("Café, cafés!", (["caf"], True)) == "[Café], [cafés]!"
    assert shown("a b a b a", (["a", "b", "a"], False)) == "[a b a b a]"
    assert shown(" ".join("xxxxxxxxxxxxyxxxxxxxxxxxxz"), (["y"], False), (["z"], False)).count("[") == 1
    assert shown("x the cat", (["the"], False), (["cat"], False)) == "x [the] [cat]"
    assert shown("nothing", (["the"], False)) == "nothing" and shown("", (["the"], False)) == ""


def test_postings_follow_changes(spark):
    rows = rows_of(2)
    base = I.with_tokens(spark.createDataFrame(rows, PAGES))
    again = [(f"d{i:02d}", "/n", 0, f"fresh café {i}") for i in (1, 4, 30)]
    new = I.with_tokens(spark.createDataFrame(again, PAGES))
    fps = spark.createDataFrame([("d01",), ("d04",), ("d07",), ("d30",)], "fp string")  # d07 has no pages left
    touched = [r["fp"] for r in fps.collect()]
    want = I.with_tokens(spark.createDataFrame([r for r in rows if r[0] not in touched] + again, PAGES))
    posts = I.postings(base, positions=True)
    after = I.upsert_postings(posts, new, fps)
    key = lambda df: sorted(map(str, df.select("term", "fp", "page_index", "dl", "tf", "positions").collect()))
    assert key(after) == key(I.postings(want, positions=True))
    gone = posts.join(fps, "fp", "left_semi")
    stats = I.updated_stats(I.term_stats(posts), gone, I.postings(new))
    assert sorted(map(tuple, stats.collect())) == sorted(map(tuple, I.term_stats(I.postings(want)).collect()))
    whole = I.updated_totals(I.totals(base), base.join(fps, "fp", "left_semi"), new)
    assert tuple(whole.first()) == tuple(I.totals(want).first())


def test_postings_are_not_repeated_for_each_query(spark, stored):
    """A page's postings are gathered by page; no row of a query and a page is shuffled to be summed."""
    queries = spark.createDataFrame([(i, "the cat", 5) for i in range(9)], "query_id long, text string, max_results int")
    scored = K.score_index(stored[1], queries)
    assert not re.search(r"Aggregate \[query_id#\d+L?, fp#", scored._jdf.queryExecution().optimizedPlan().toString())
    ranks = {(r["query_id"], r["fp"], r["page_index"]): round(r["rank"], 9) for r in scored.collect()}
    alone = {(r["fp"], r["page_index"]): round(r["rank"], 9) for r in Q.search_ranked(stored[0], P.terms("the cat"), 1000).collect()}
    assert ranks == {(i, *page): rank for i in range(9) for page, rank in alone.items()} and alone


@pytest.mark.parametrize("many", [K.MANY, 1])
def test_a_batch_over_pages_equals_the_index(spark, stored, tmp_path, monkeypatch, many):
    """Each operator, unwanted words and one document, pages without text; words too many to send; plain queries too."""
    monkeypatch.setattr(K, "MANY", many)
    pages, index = stored
    asked = [
        (1, "The cat", "all", None, None, 1000), (2, "gamma café", "any", None, None, 1000), (3, "of the", "phrase", None, None, 1000), (4, "the ga", "prefix", None, None, 1000), (5, "the", "all", "d03", None, 1000), (6, "cat hat", "near", None, None, 1000),
        (7, "the", "first", None, None, 1000), (8, "the", "all", None, "cat mat", 1000), (9, " ", "all", None, None, 5), (10, "ga", "prefix", None, None, 7), (11, "cat cat", None, None, None, 4), (12, "zebra", "any", None, None, 5), (13, "zebra the", "all", None, None, 5),
    ]
    queries = spark.createDataFrame(asked, "query_id int, text string, op string, fp string, unwanted string, max_results int")
    told = lambda df: sorted((r["query_id"], r["fp"], r["page_index"], r["k"], round(r["rank"], 9)) for r in df.collect())
    bare = pages.select("fp", "page_index", "text")
    for n, q in enumerate((queries, queries.select("query_id", "text", "max_results"))):
        want = told(K.score_index(index, q, near=2))
        assert told(K.score_pages(bare, q, str(tmp_path / str(n)), near=2)) == want and want
    assert K.score_pages(bare.limit(0), queries, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("name", ["bm25_score", "top_hits_per_query", "hits_with_document", "search_batch_ops"])
def test_a_batch_writes_no_index(spark, monkeypatch, name):
    """No posting is written or shuffled for a batch of queries that no index serves."""
    from lectern.plans import queries

    monkeypatch.setattr(queries, "stored_index", None)
    monkeypatch.setattr(queries, "write_index", None)
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not re.search(r"Exchange hashpartitioning\(fp#\d+, page_index", plan)
