"""The index as segments: changes, merges and searches over what is left, and what their plans read."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import predicates as P
from lectern.operators import index as I
from lectern.operators import lookup as K
from lectern.operators import search as Q
from lectern.sources.stored import StoredIndex, bucket_number, folders_for
from lectern.sources.tables import bucket_of

PAGES = "fp string, path string, page_index int, text string"


def at():
    return F.expr("timestamp'2024-01-01 00:00:00'")


def some_pages(seed, names):
    rng = random.Random(seed)
    words = "the cat of Café hat and game gamma sat on mat".split()
    return [(d, f"/p/{d}", i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for d in names for i in range(3)]


@pytest.fixture(scope="module")
def changed(spark, tmp_path_factory):
    """An index after upserts and removals, and the pages it should hold."""
    index = StoredIndex(spark, str(tmp_path_factory.mktemp("segments")))
    rows = {}
    for n, names in enumerate((range(20), range(15, 25), range(22, 30))):
        new = some_pages(n, [f"d{i:02d}" for i in names])
        df = spark.createDataFrame(new, PAGES)
        assert index.upsert(df, df, at(), f"change-{n}", buckets=8, doc_buckets=8)
        rows = {k: v for k, v in rows.items() if k not in {r[0] for r in new}}
        for r in new:
            rows.setdefault(r[0], []).append(r)
    index.remove(spark.createDataFrame([("d03",), ("d24",), ("never",)], "fp string"), "change-3")
    emptied = spark.createDataFrame([("d05", "/p/d05")], "fp string, path string")
    index.upsert(emptied, spark.createDataFrame([], PAGES), at(), "change-4")
    for d in ("d03", "d24", "d05"):
        rows.pop(d)
    return index, spark.createDataFrame([r for rs in rows.values() for r in rs], PAGES)


def ranks(rows):
    return [(r["fp"], r["path"], r["page_index"], round(r["rank"], 9)) for r in rows]


def same_as_scan(index, pages):
    tokens = I.with_tokens(pages)
    for units, more in ((P.terms("the cat"), {}), (P.terms("game cafe"), {"any_unit": True}), ([P.phrase("of the")], {}), ([P.prefix("ga")], {}), (P.terms("the"), {"fp": "d17"})):
        want = ranks(Q.search_ranked(tokens, units, 1000, **more).collect())
        assert ranks(K.search_index(index, units, 1000, **more).collect()) == want
        assert want
    queries = pages.sparkSession.createDataFrame([(1, "the hat", 1000), (2, "mat", 1000)], "query_id int, text string, max_results int")
    got = K.search_index_batch(index, queries).orderBy("query_id", "place").collect()
    assert ranks([r for r in got if r["query_id"] == 1]) == ranks(Q.search_ranked(tokens, P.terms("the hat"), 1000).collect())


def test_searches_after_changes(changed):
    same_as_scan(*changed)


def test_statistics_stay_exact(changed):
    index, pages = changed
    tokens = I.with_tokens(pages)
    assert sorted(map(tuple, index.terms().collect())) == sorted(map(tuple, I.term_stats(I.postings(tokens)).collect()))
    view, whole = index.now(), I.totals(tokens).first()
    assert (view.n_pages, view.n_tokens) == (whole["n_pages"], whole["n_tokens"]) and view.totals().first()["avgdl"] == pytest.approx(whole["avgdl"])
    want = {(r["fp"], r["path"], r["page_count"]) for r in I.registry(pages, at()).collect()} | {("d05", "/p/d05", 0)}
    assert {tuple(r) for r in index.registry().select("fp", "path", "page_count").collect()} == want
    assert sorted(map(str, index.pages().select("fp", "path", "page_index", "text").collect())) == sorted(map(str, pages.collect()))
    assert sorted(map(str, index.postings().collect())) == sorted(map(str, I.postings(tokens, positions=True).collect()))


def test_a_change_reads_its_documents_only(spark, changed):
    """No postings are read for a deletion, and documents in the folders of the named ones alone."""
    index, _ = changed
    view = index.now()
    plan = view.documents(view.segments[0], spark.createDataFrame([("d07",)], "fp string"))._jdf.queryExecution().toString()
    assert any("doc_bucket" in x.split("]")[0] for x in plan.split("PartitionFilters: [")[1:]) and "/postings" not in plan


def test_a_prefix_reads_the_folders_of_its_words(changed):
    index, _ = changed
    view = index.now()
    s = view.segments[1]
    plan = view.segment_postings(s, [], ["gam"])._jdf.queryExecution().toString()
    wanted = {bucket_number(t, s.buckets) for t in ("game", "gamma")}
    filters = [x.split("]")[0] for x in plan.split("PartitionFilters: [")[1:]]
    assert any("term_bucket" in x for x in filters) and len(wanted) <= 2
    assert {r["term_bucket"] for r in view.segment_postings(s, [], ["gam"]).select("term_bucket").distinct().collect()} == wanted
    assert "StringStartsWith(term,gam)" in view.read(s, "terms", "term string").where(F.col("term").startswith("gam"))._jdf.queryExecution().toString()


def test_merges(spark, changed, tmp_path):
    index, pages = changed
    before = len(index.now().segments)
    assert not index.merge("merge-none", fan=99) and index.merge("merge-0", everything=True) and not index.merge("merge-0", everything=True)
    assert before > 2 and len(index.now().segments) == 1 and index.published()[-1] == "merge-0"
    same_as_scan(index, pages)
    assert sorted(map(tuple, index.terms().collect())) == sorted(map(tuple, I.term_stats(I.postings(I.with_tokens(pages))).collect()))
    index.vacuum()
    again = spark.createDataFrame([("d01", "/n", 0, "fresh the cat")], PAGES)
    assert index.upsert(again, again, at(), "change-9") and not index.upsert(again, again, at(), "change-9")
    same_as_scan(index, pages.where("fp <> 'd01'").unionByName(again))


def test_sizes_classes_are_merged(spark, tmp_path):
    index = StoredIndex(spark, str(tmp_path))
    for n in range(3):
        df = spark.createDataFrame([(f"d{n}", "/p", 0, "one two")], PAGES)
        index.upsert(df, df, at(), f"c{n}")
        assert index.merge(f"m{n}", fan=3) == (n == 2)
    assert len(index.now().segments) == 1 and index.terms().where("df = 3").count() == 2


def test_an_unfinished_change_is_not_seen(spark, tmp_path):
    index = StoredIndex(spark, str(tmp_path / "i"))
    assert index.now().n_pages == 0 and K.search_index(index, P.terms("a")).collect() == [] and index.terms().count() == 0 and index.pages().count() == 0
    df = spark.createDataFrame([("a", "/a", 0, "one")], PAGES)
    index.upsert(df, df, at(), "c0")
    index._segment("c1", df.select("fp", "path"), df, at(), None, None)  # written, but not published
    assert index.now().n_pages == 1 and index.upsert(df, df, at(), "c1") and index.now().n_pages == 1


def test_blocks_are_pruned(spark, tmp_path):
    rng = random.Random(8)
    words = ["the", "and", *[f"w{i}" for i in range(50)]]
    rows = [(f"d{i}", "/p", 0, " ".join(rng.choices(words, weights=[20, 12, *[1] * 50], k=rng.randint(3, 60)))) for i in range(4000)]
    pages = spark.createDataFrame(rows, PAGES)
    index = StoredIndex(spark, str(tmp_path))
    index.upsert(pages.where("page_index = 0"), pages, at(), "c0")
    more = spark.createDataFrame([("x", "/p", 0, "the and " * 3), ("y", "/p", 0, "the")], PAGES)  # a segment in which the words are rare
    index.upsert(more, more, at(), "c1")
    tokens = I.with_tokens(pages.unionByName(more))
    for text, any_unit in (("the and", False), ("the and", True), ("the", False), ("the the and", False)):
        want = ranks(Q.search_ranked(tokens, P.terms(text), 10, any_unit=any_unit).collect())
        assert ranks(K.search_index(index, P.terms(text), 10, any_unit=any_unit, prune_from=0).collect()) == want
    view = index.now()
    search = K.PlainSearch(view, {"the": 1, "and": 1}, False)
    left, whole = search.pruned(10), view.blocks(view.segments[0], ["the", "and"]).select("block").distinct().count()
    assert left["c1"] is None and left["c0"].count() < 0.5 * whole and whole > 100


def test_folders():
    assert folders_for(0) == 1 and folders_for(5 << 20) == 5 and folders_for(1 << 30) == 16 and folders_for(1 << 40) == 4096


def test_bucket_number(spark):
    terms = ["a", "straße", "東京", "x" * 100, ""]
    df = spark.createDataFrame([(t,) for t in terms], "t string")
    assert [r[0] for r in df.select(bucket_of(F.col("t"), 13)).collect()] == [bucket_number(t, 13) for t in terms]


def test_near_takes_one_sweep(spark):
    """Tens of thousands of hits on a page, and the same result as comparing all of them."""
    rng = random.Random(4)
    for n, most in ((0, 1), (1, 1), (9, 2), (40, 0)):
        t = [rng.choice("abcde") for _ in range(n)]
        want = any({"a", "b", "c"} <= set(t[i : i + most + 2]) for i in range(n))
        assert spark.range(1).select(P.match_near(F.array(*[F.lit(x) for x in t]).cast("array<string>"), "a b c", most)).first()[0] == want
    page = spark.range(1).select(F.flatten(F.array_repeat(F.array(*[F.lit(x) for x in "aab"]), 20_000)).alias("t"))
    assert page.select(P.match_near(F.col("t"), "a b zz")).first()[0] is False and page.select(P.match_near(F.col("t"), "a b", 0)).first()[0] is True


def test_substrings_by_trigrams(spark, tmp_path):
    """As by a scan: any case, accents as they stand, letters with a partner outside ASCII, short needles, after changes too."""
    rows = [(f"d{i}", "/p", p, t) for i, (p, t) in enumerate([(0, "Some KEY here, key there"), (0, "ſtraße Straße"), (1, "Key"), (0, None), (0, ""), (0, "ke y"), (2, "Ÿ€y Été été"), (0, "x" * 5000 + "needle")])]
    pages = spark.createDataFrame(rows, PAGES)
    index = StoredIndex(spark, str(tmp_path), trigrams=True)
    index.upsert(pages, pages, at(), "c0")
    for needle in ("key", "STRASSE", "straße", "Été", "ke", "needle", "zzz", "a.b", " "):
        want = sorted(map(tuple, Q.search_substring(pages, needle, 10).collect()))
        got = K.substring_index(index, needle, 10).select("fp", "page_index", "pos", "snippet", "rank")
        assert sorted(map(tuple, got.collect())) == want, needle
    index.upsert(pages.where("fp = 'd0'"), pages.where("fp = 'd0'").withColumn("text", F.lit("new monkey")), at(), "c1")
    assert [r["fp"] for r in K.substring_index(index, "onkey").collect()] == ["d0"] and {r["fp"] for r in K.substring_index(index, "KEY").collect()} == {"d0", "d2"}
    assert index.merge("m", everything=True) and index.now().segments[0].trigrams and {r["fp"] for r in K.substring_index(index, "KEY").collect()} == {"d0", "d2"}


def test_queries_meet_postings_in_one_pass(spark, tmp_path, monkeypatch):
    """The rows of the index, without one; a term of several queries, one that no page has, pages without text; words too many to send."""
    from lectern.plans import queries

    rows = [*some_pages(5, "abc"), ("d", "/p", 0, None), ("e", "/p", 0, "")]
    pages = spark.createDataFrame(rows, PAGES)
    index = StoredIndex(spark, str(tmp_path))
    index.upsert(pages, pages, at(), "c0")
    asked = spark.createDataFrame([(1, "cat"), (2, "cat"), (2, "cafe"), (3, "unknown")], "query_id long, term string")
    columns = ["query_id", "term", "fp", "page_index", "dl", "tf"]
    want = sorted(map(tuple, index.now().postings_of(asked).select(*columns).collect()))
    for many in (K.MANY, 1):
        monkeypatch.setattr(K, "MANY", many)
        assert sorted(map(tuple, K.scan_postings(pages, asked).select(*columns).collect())) == want and want
    monkeypatch.setattr(queries, "stored_index", None)
    plan = queries.queries_x_postings(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "SortMergeJoin" not in plan


def test_index_of_trigrams_alone(spark, tmp_path, monkeypatch):
    """No postings are written, trigrams are rows of many pages; windows cut pages and a range of numbers ends inside a batch."""
    from lectern.sources import stored

    monkeypatch.setattr(stored, "RANGE", 3)
    monkeypatch.setattr(stored, "WINDOW", 5)
    rows = [(f"d{i % 4}", "/p", i, t) for i, t in enumerate(["Some KEY here, key there", "ſtraße Straße", None, "", "ab", "日本語 monkey 日本語", "x" * 40 + "needle", "KeyKey"])]
    pages = spark.createDataFrame(rows, PAGES)
    index = StoredIndex(spark, str(tmp_path), trigrams=True, words=False)
    index.upsert(pages, pages, at(), "c0")
    index.upsert(pages.where("fp = 'd0'"), pages.where("fp = 'd0'").withColumn("text", F.lit("new keys")), at(), "c1")
    now = [r if r[0] != "d0" else (*r[:3], "new keys") for r in rows]
    for _ in range(2):
        for needle in ("key", "STRASSE", "straße", "needle", "zzz", "monkey 日"):
            want = Q.search_substring(spark.createDataFrame(now, PAGES), needle, 10)
            assert sorted(map(tuple, K.substring_index(index, needle, 10).select(*want.columns).collect())) == sorted(map(tuple, want.collect())), needle
        assert {r["fp"]: r["page_count"] for r in index.registry().collect()} == {"d0": 2, "d1": 2, "d2": 1, "d3": 2}
        index.merge("m", everything=True)
    assert len(index.now().segments) == 1 and not list(tmp_path.glob("segments/*/postings")) and list(tmp_path.glob("segments/*/page_grams"))
    grams = stored.page_grams(spark.range(0, 400, 1, 1).selectExpr("id as number", "'some words' as text"))
    monkeypatch.undo()
    assert grams.count() > 8 and stored.page_grams(spark.range(0, 400, 1, 1).selectExpr("id as number", "'some words' as text")).count() == 8


def test_forward_index_shuffles_texts_once(spark):
    pages = spark.createDataFrame([("d", 0, "a b a"), ("d", 1, "b ..."), ("e", 0, "")], "fp string, page_index int, text string")
    counted = StoredIndex._counted(pages)
    assert counted._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {r["fp"]: (r["page_count"], r["n_tokens"], sorted(map(tuple, r["terms"]))) for r in counted.collect()}
    assert got == {"d": (2, 4, [("a", 1, 2), ("b", 2, 2)]), "e": (1, 0, [])}


def test_documents_are_counted_across_batches(spark):
    """A document's rows in several batches and parts, documents without pages, a path of the documents' table: one shuffle of texts."""
    rows = [(d, f"/p/{d}", i, " ".join(f"w{k % (i + 2)}" for k in range(i))) for d in "abc" for i in range(7)]
    pages = spark.createDataFrame([*rows, ("d", None, 0, "")], PAGES)
    docs = spark.createDataFrame([*((d, f"/q/{d}") for d in "abc"), ("d", None), ("e", "/q/e")], "fp string, path string")
    counted, name = StoredIndex._counted(pages, docs), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "2")
    try:
        got = {r["fp"]: (r["path"], r["page_count"], r["n_tokens"], sorted(map(tuple, r["terms"]))) for r in counted.collect()}
        posts = sorted(map(str, I.postings(I.with_tokens(pages), positions=True).collect()))
    finally:
        spark.conf.set(name, before)
    own = [r[3].split() for r in rows if r[0] == "a"]
    terms = [(w, sum(w in x for x in own), sum(x.count(w) for x in own)) for w in sorted({w for x in own for w in x})]
    assert got == {d: (f"/q/{d}", 7, 21, terms) for d in "abc"} | {"d": (None, 1, 0, []), "e": ("/q/e", 0, 0, [])}
    assert posts == sorted(map(str, I.postings(I.with_tokens(pages), positions=True).collect())) and len(posts) == 3 * sum(len(set(x)) for x in own)


def test_no_posting_is_shuffled(spark, tmp_path, monkeypatch):
    """Postings are written by the tasks that make them, a row for many pages; a document's words are not stored twice; shuffle files go."""
    pages = spark.createDataFrame([(f"d{i // 4}", "/p", i % 4, f"the w{i}") for i in range(400)], PAGES).repartition(3)
    index, plans, write = StoredIndex(spark, str(tmp_path)), {}, StoredIndex._write

    def noted(self, df, at, by=None):
        plans[at.split("/")[-1]] = df._jdf.queryExecution().executedPlan().toString()
        write(self, df, at, by)
        assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == before

    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    monkeypatch.setattr(StoredIndex, "_write", noted)
    index.upsert(pages, pages, at(), "c0")
    assert "MapInArrow" in plans["postings"] and "Exchange" not in plans["postings"]
    assert len(spark.read.parquet(f"{tmp_path}/segments/c0/postings").where("term = 'the'").collect()) < 40
    assert "terms" not in spark.read.parquet(f"{tmp_path}/segments/c0/documents").columns
    assert index.postings().count() == 800 and index.terms().where("term = 'the' and df = 400").count() == 1


def test_block_maxima_bound_contributions(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"d{i}", "/p", 0, " ".join(rng.choices(["the", "a", "b", "c"], k=rng.randint(0, 70)))) for i in range(1600)]
    pages = spark.createDataFrame(rows, PAGES)
    index = StoredIndex(spark, str(tmp_path))
    index.upsert(pages, pages, at(), "c0")
    view = index.now()
    posts = view.segment_postings(view.segments[0], ["the"])
    part = F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("dl") / view.avgdl))
    own = posts.groupBy("block").agg(F.max(part).alias("most"), F.count(F.lit(1)).alias("m"))
    both = own.join(view.blocks(view.segments[0], ["the"]), "block").collect()
    assert len(both) == own.count() > 90 and all(r["most"] <= r["best"] + 1e-12 and r["m"] == r["n"] for r in both)


def test_last_versions_in_a_batch(spark, monkeypatch):
    from lectern.streaming import streams

    rows = [("a", 1, "/x", "one"), ("a", 2, "/x", "two"), ("b", 1, "/y", "three"), ("c", 5, "/z", "v"), ("c", 5, "/z", "w")]
    df = spark.createDataFrame(rows, "fp string, ts int, path string, text string")
    for many in (10, 1):
        monkeypatch.setattr(streams, "MANY", many)
        assert sorted(map(tuple, streams.last_versions(df).collect())) == [rows[1], rows[2], rows[4]]
    single = streams.last_versions(df.where("fp = 'b'"))
    assert [tuple(r) for r in single.collect()] == [rows[2]] and "Exchange" not in single._jdf.queryExecution().executedPlan().toString()
