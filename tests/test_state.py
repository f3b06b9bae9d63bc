import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import annotations as A
from lectern.operators import enrich as E
from lectern.operators import ledger as L
from lectern.operators import recents as R
from lectern.operators import report as B

LEDGER = "key string, size long, last_access timestamp, doc_fp string"


def ledger(spark, rows):
    base = spark.createDataFrame([(k, s, t, d) for k, s, t, d in rows], "key string, size long, t long, doc_fp string")
    return base.select("key", "size", F.timestamp_seconds("t").alias("last_access"), "doc_fp")


def test_ledger_changes(spark):
    three = ledger(spark, [("a", 100, 1, "x"), ("b", 200, 2, "x"), ("c", 300, 3, "y")])
    assert L.total_size(three).first()[0] == 600 and L.total_size(L.clear(three)).first()[0] == 0
    assert {r["key"] for r in L.invalidate(three, spark.createDataFrame([("x",)], "doc_fp string")).collect()} == {"c"}
    counts = L.invalidated_counts(three, spark.createDataFrame([("x",), ("z",)], "doc_fp string")).collect()
    assert {r["doc_fp"]: r["removed"] for r in counts} == {"x": 2, "z": 0}
    put = {r["key"]: r["size"] for r in L.put(three, ledger(spark, [("a", 5, 9, "q"), ("a", 7, 8, "q"), ("d", 1, 1, "q")])).collect()}
    assert put == {"a": 5, "b": 200, "c": 300, "d": 1}
    reads = spark.createDataFrame([("a",), ("nope",)], "key string").withColumn("ts", F.timestamp_seconds(F.lit(50)))
    assert [r["key"] for r in L.touch(three, reads).orderBy(F.desc("last_access")).collect()] == ["a", "c", "b"]
    assert {r["key"] for r in L.remove(three, spark.createDataFrame([("a",), ("q",)], "key string")).collect()} == {"b", "c"}


def test_eviction_cases(spark):
    five = ledger(spark, [(f"k{i}", 100, i, "d") for i in range(5)])
    assert {r["key"] for r in L.evictions(five, 250).collect()} == {"k0", "k1", "k2"}
    assert L.evictions(five, 500).count() == 0 and L.evict_lru(five, 0).count() == 0
    assert L.janitor(five, hard=500).count() == 5 and L.janitor(five, hard=499).count() == 4
    assert L.evictions(five.limit(0), 10).count() == 0
    assert {r["key"] for r in L.evict_per_document(five, 1000, 30).collect()} == {"k2", "k3", "k4"}


@pytest.mark.parametrize("seed", range(3))
def test_eviction_random(spark, seed):
    rng = random.Random(seed)
    rows = [(f"k{i}", rng.randint(0, 50), rng.randint(0, 30), "d") for i in range(200)]
    target = rng.randint(0, 5000)
    total, gone = sum(r[1] for r in rows), set()
    for key, size, _, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        if total <= target:
            break
        gone.add(key)
        total -= size
    assert {r["key"] for r in L.evictions(ledger(spark, rows), target).collect()} == gone


@pytest.mark.parametrize("seed", range(2))
def test_one_time_for_most_entries_is_cut_by_keys(spark, seed):
    rng = random.Random(seed)
    rows = [(f"{rng.randint(0, 10**9):09d}-{i}", rng.randint(0, 50), 7 if rng.random() < 0.8 else rng.randint(0, 30), rng.choice("xxxxy")) for i in range(400)]
    df = ledger(spark, rows)
    for by in (None, "doc_fp"):
        want, seen = {}, {}
        for key, size, t, doc in sorted(rows, key=lambda r: (r[2], r[0])):
            want[key] = seen.get(by and doc, 0)
            seen[by and doc] = want[key] + size
        placed = L.sizes_before(df, ["last_access", "key"], ranges=20, by=by)
        assert {r["key"]: r["before"] for r in placed.collect()} == want
    kept, held = set(), {}
    for key, size, _, doc in sorted(rows, key=lambda r: (r[2], r[0]), reverse=True):
        held[doc] = held.get(doc, 0) + size
        if held[doc] <= 900:
            kept.add(key)
    assert {r["key"] for r in L.evict_per_document(df, 3000, 30).collect()} == kept


@pytest.mark.parametrize("seed", range(3))
def test_annotation_log_random(spark, seed):
    rng = random.Random(seed)
    log, want, rejects = [], {}, set()
    for seq in range(120):
        fp, op, key = rng.choice("AB"), rng.choice(["add", "add", "update", "remove", "removeAll"] if seq % 17 == 0 else ["add", "add", "update", "remove"]), rng.choice("pqrst")
        log.append((fp, seq, op, None if op == "removeAll" else key, float(seq)))
        live = want.setdefault(fp, [])
        if op == "add":
            live.append([seq, key, float(seq)])
        elif op == "removeAll":
            live.clear()
        elif not any(x[1] == key for x in live):
            rejects.add(seq)
        elif op == "update":
            for x in live:
                x[2] = float(seq) if x[1] == key else x[2]
        else:
            live[:] = [x for x in live if x[1] != key]
    result, rejected = A.apply_changes(spark.createDataFrame(log, "fp string, seq long, op string, id string, value double"))
    assert sorted((r["fp"], r["seq"], r["id"], r["value"]) for r in result.collect()) == sorted((fp, *x) for fp, xs in want.items() for x in xs)
    assert {r["seq"] for r in rejected.collect()} == rejects


def test_annotation_rules(spark):
    rows = [("Highlight", (0.0, 0.0, 1.0, 1.0), None, None), ("StickyNote", (0.0, 0.0, 1.0, 1.0), "note", None), ("Freehand", None, None, [(0.0, 0.0)]), ("Highlight", None, None, None), ("Odd", None, "x", None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "kind string, bounds struct<x:double,y:double,width:double,height:double>, text string, ink_points array<struct<x:double,y:double>>")
    assert [r["v"] for r in df.select(A.well_formed().alias("v")).collect()] == [True, True, True, False, False, False]


def replay(spark, steps):
    df = spark.createDataFrame([("w", i, op, p) for i, (op, p) in enumerate(steps)], "workspace string, seq long, op string, path string")
    return R.replay(df).first()["paths"]


def test_recents_cases(spark):
    assert replay(spark, [("add", "a"), ("add", "b"), ("add", "a")]) == ["a", "b"]
    assert replay(spark, [("add", f"p{i}") for i in range(25)]) == [f"p{i}" for i in range(24, 4, -1)]
    assert replay(spark, [("add", "doc.pdf"), ("add", "DOC.PDF")]) == ["doc.pdf"]
    assert len(replay(spark, [*[("add", f"p{i}") for i in range(21)], ("remove", "P20")])) == 19
    assert replay(spark, [("add", "C:\\a\\.\\b.pdf"), ("add", "/x"), ("remove", "c:/a/q/../b.pdf")]) == ["/x"] and replay(spark, [("add", "/a/../B"), ("add", "/b")]) == ["/B"]
    opens = spark.createDataFrame([("w", 1, "/a//b"), ("w", 2, "/x/../a/B"), ("w", 3, " ")], "workspace string, seq long, path string")
    assert [(r["place"], r["path"]) for r in R.recents(opens).collect()] == [(1, "/a/B")]
    assert replay(spark, [("add", "a"), ("remove", "zz"), ("add", None), ("add", " ")]) == ["a"] and replay(spark, [("add", "a"), ("clear", None)]) == []


@pytest.mark.parametrize("seed", range(3))
def test_recents_random(spark, seed):
    rng = random.Random(seed)
    steps = [(rng.choice(["add"] * 8 + ["remove", "clear"][: 1 + (seed > 0)]), rng.choice([f"p{i}" for i in range(30)] + [f"P{i}" for i in range(30)])) for _ in range(200)]
    assert replay(spark, steps) == R.replay_python(steps, [])


def test_recents_hold_no_whole_log(spark):
    rng = random.Random(5)
    steps = [(rng.choice(["a", "b", None]), i, rng.choice(["add"] * 30 + ["remove"] * 3 + ["clear"]), rng.choice([f"p{j}" for j in range(30)] + ["P1", " ", None])) for i in range(900)]
    steps += [("only", 0, "clear", None)]
    log = spark.createDataFrame(rng.sample(steps, len(steps)), "workspace string, seq long, op string, path string")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        out = R.replay(log)
        got = {r["workspace"]: r["paths"] for r in out.collect()}
    finally:
        spark.conf.set(name, before)
    assert got == {w: R.replay_python([(op, p) for x, _, op, p in steps if x == w], []) for w in ("a", "b", None, "only")}
    assert "collect_list" not in out._jdf.queryExecution().toString()


@pytest.mark.parametrize("k", [0, 1, 3, 20])
def test_recents_by_parts(spark, k):
    """One workspace with all steps is summarised by several tasks, in parts of any size, as the steps one by one."""
    rng = random.Random(k)
    steps = [(rng.choice(["add"] * 6 + ["remove"] * rng.choice([0, 5]) + ["clear"] * (rng.random() < 0.02)), rng.choice([f"p{j}" for j in range(9)] + ["P1", "P2", "P3", " ", None])) for _ in range(600)]
    log = spark.createDataFrame([("w", i // 2, op, p) for i, (op, p) in enumerate(steps)], "workspace string, seq int, op string, path string")
    inside = sorted(((i // 2, op, p) for i, (op, p) in enumerate(steps)), key=lambda s: (s[0], s[1], s[2] is not None, s[2] or ""))
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        for most in (2, 5, R.PART_PATHS):
            parts = R.summaries(log, k, most).withColumn("task", F.spark_partition_id()).collect()
            assert len({p["task"] for p in parts}) == 4 and all(len(p["touches"]) <= most and len(p["own"]) <= k for p in parts)
            assert R.replay(log, k, most).collect() == [("w", R.replay_python([(op, p) for _, op, p in inside], [], k))]
    finally:
        spark.conf.unset(name)
    full = spark.createDataFrame([("w", i, "add", f"p{i}") for i in range(200)], log.schema)
    assert all(p["gone"] and not p["touches"] for p in R.summaries(full, k).collect())


def test_enrich(spark):
    pages = spark.createDataFrame([("a", 0), ("b", 0)], "fp string, page_index int")
    asked = E.requests_for(pages, 2)
    cache = E.requests_for(spark.createDataFrame([("a", 0, "old")], "fp string, page_index int, layer string"), 2).select(*E.KEY, "layer")

    def run(batches):
        for b in batches:
            b["layer"] = "new"
            yield b

    codec = E.Codec("t", 2, run, "fp string, page_index int, engine_version int, zoom_bucket int, flags int, layer string")
    layers, new = E.enrich(asked, cache, codec)
    assert {r["fp"]: r["layer"] for r in layers.collect()} == {"a": "old", "b": "new"}
    assert [r["fp"] for r in new.collect()] == ["b"] and new.first()["flags"] == 0x100
    assert E.misses(E.requests_for(pages, 3), cache).count() == 2
    pairs = spark.createDataFrame([("en", "abcd", "abce"), ("en", "", None)], "lang string, expected string, recognised string")
    assert E.error_rate(pairs, "lang").first()["cer"] == 0.25


def test_report(spark):
    base = spark.createDataFrame([(n, 100.0, 100.0) for n in "abcd"], "name string, p50_ms double, p95_ms double")
    now = spark.createDataFrame([("a", 1.0, 115.0), ("b", 1.0, 115.1), ("c", 1.0, 80.0)], "name string, p50_ms double, p95_ms double")
    report = B.regression_report(base, now)
    assert {r["name"]: r["verdict"] for r in report.collect()} == {"a": "ok", "b": "REGRESS", "c": "ok", "d": "skip"}
    assert B.gate_failed(report).first()["failed"] and not B.gate_failed(report.where("name = 'a'")).first()["failed"]


def test_eviction_cuts_only_the_boundary(spark):
    """A time that holds most entries, whose keys agree in their first characters: exactly what a sort would evict."""
    import random

    from lectern.operators import ledger as L

    rng = random.Random(6)
    rows = [(f"common-prefix-{rng.randrange(10**6):06d}-{i}", rng.randrange(1, 100), 50 if i % 3 else rng.randrange(100), f"d{i % 7}") for i in range(3000)] + [("none", 5, None, "d")]
    df = spark.createDataFrame(rows, "key string, size long, t long, doc_fp string").select("key", "size", F.timestamp_seconds("t").alias("last_access"), "doc_fp")
    total = sum(r[1] for r in rows)
    for target in (total // 2, total - 6):
        want, left = set(), total
        for key, size, _, _ in sorted(rows, key=lambda r: (-1 if r[2] is None else r[2], r[0])):
            if left > target:
                want.add(key)
                left -= size
        left = L.evict_lru(df, target, few=200)
        assert {r["key"] for r in left.collect()} == {r[0] for r in rows} - want, target
    plan = left._jdf.queryExecution().toString()
    assert "Sort" not in plan and "Exchange" not in plan and "Join" not in plan
    assert L.evict_lru(df, total).count() == len(rows) and L.evict_lru(df.limit(0), 5).count() == 0


def test_percentiles_by_selection(spark):
    """As Spark's own, with a name that holds most rows, equal values, and nulls."""
    import random

    from lectern.operators import report as B

    rng = random.Random(2)
    rows = [("hot", rng.choice([1.0, 2.0, rng.random() * 1000])) for _ in range(4000)] + [("few", 3.0), ("two", 1.0), ("two", 2.0), ("same", 7.0)] + [("same", 7.0)] * 500 + [("gone", None), ("two", None)]
    df = spark.createDataFrame(rows, "name string, ms double")
    pick = F.percentile("ms", F.array(F.lit(0.5), F.lit(0.95)))
    want = {r["name"]: r["p"] for r in df.groupBy("name").agg(pick.alias("p")).collect() if r["p"]}
    for few in (100,):
        got = {r["name"]: [r["p50_ms"], r["p95_ms"]] for r in B.percentiles(df, exact=True, few=few).collect()}
        assert got.keys() == want.keys() and all(got[n] == pytest.approx(want[n]) for n in want)


def test_ledger_has_bloom_filters(spark, tmp_path):
    from lectern.sources import tables as T

    rows = spark.range(2000).selectExpr("cast(id as string) as key", "id as size", "timestamp_seconds(id) as last_access", "concat('d', id % 50) as doc_fp")
    T.write_ledger(rows, str(tmp_path / "l"))
    assert T.ledger_entries(spark, str(tmp_path / "l"), ["d7", "d9"]).count() == 80 and T.ledger_entries(spark, str(tmp_path / "l"), []).count() == 0


def test_offsets_of_ranges_reach_rows_without_a_join(spark):
    """The join of ranges to their offsets had a plan that failed on 1.2 million entries."""
    df = ledger(spark, [(f"k{i}", 10, i % 9, "xy"[i % 2]) for i in range(40)])
    left = L.evict_per_document(df, 1000, 10)
    assert "Join" not in left._jdf.queryExecution().optimizedPlan().toString()
    assert left.count() == 20


def test_eviction_reads_the_entries_few_times(spark):
    """A range is told by its times, so no pass repeats what earlier ones have cut."""
    rows = [(f"{i:05d}", 1 + i % 5, 10**6 if i % 3 else i * i, "d") for i in range(300)]
    total, gone, df = sum(r[1] for r in rows), set(), ledger(spark, rows)
    for key, size, _, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        if total <= 150:
            break
        gone.add(key)
        total -= size
    test = L.oldest(df, sum(r[1] for r in rows) - 150, few=5)
    assert {r["key"] for r in df.where(test).collect()} == gone
    assert "filter(" not in df.where(test)._jdf.queryExecution().optimizedPlan().toString()


def test_error_rate_in_bands(spark):
    """The band of the length's difference is enough, or a wider one, or all; nulls are empty."""
    pairs = spark.createDataFrame([("x", "abcdef", "abdf"), ("x", "abc", "cab"), ("x", "a" * 60, "b" * 60), ("x", None, "q"), ("x", "", None)], "lang string, expected string, recognised string")
    told = E.error_rate(pairs, "lang")
    assert told.first()["cer"] == (2 + 2 + 60 + 1) / 69 and "array(levenshtein(" in told._jdf.queryExecution().optimizedPlan().toString()
