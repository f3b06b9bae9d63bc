"""Joins and searches against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F


def shingles(text, n):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).split()]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    best: dict = {}
    for i, (d, _) in enumerate(rows):
        best.setdefault(find(i), []).append(d)
    return [(d, len(sets[i]), min(best[find(i)])) for i, (d, _) in enumerate(rows)]


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randint(0, 40))
    rows, passage = [], [word() for _ in range(30)]
    for _ in range(25):
        base = [word() for _ in range(rng.choice([1, 3, 4, 6, 8, 10, 12, 15, 18, 25, 40, 80, 150]))]
        if rng.random() < 0.4:
            base = base + passage  # a passage that many share
        for _ in range(rng.randint(1, 7)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randint(0, 1)] = [word()] if rng.random() < 0.6 else []
            rows.append(" ".join(w))
    rows += ["", None, " \n ", "one", "one", "Two words", "two WORDS"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed,n,percent,long_list", [(1, 4, 85, 50), (2, 4, 85, 3), (3, 5, 80, 4), (4, 2, 60, 6)])
def test_jaccard_components(spark, seed, n, percent, long_list):
    from lectern.llm.jaccard import linked_components

    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("key", F.lit("x"))
    got = [tuple(r) for r in linked_components(df, n, percent, long_list=long_list).collect()]
    assert sorted(got) == sorted(brute(rows, n, percent))


def test_jaccard_odd_tables(spark):
    from lectern.llm.jaccard import linked_components

    df = spark.createDataFrame([(7, "a b c d e f"), (7, "a b c d e f"), (None, "A B c d e f"), (3, "x"), (None, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in linked_components(df, 4, 85).collect())
    assert got == [(0, 0, None), (0, 3, 7), (3, 1, 3), (7, 3, 7), (7, 3, 7)]
    assert linked_components(df.limit(0), 4, 85).count() == 0


def test_subsets_decide_links():
    from lectern.llm.jaccard import overlap, shingle_set, subset_count, subset_keys

    rng = random.Random(8)
    for _ in range(300):
        n, m = rng.randint(6, 20), rng.randint(6, 20)
        pool = rng.sample(range(10**9), 40)
        shared = rng.randint(0, min(n, m))
        a = np.array(sorted(pool[:n]), np.uint64)
        b = np.array(sorted(pool[n - shared : n - shared + m]), np.uint64)
        common = len(set(a.tolist()) & set(b.tolist()))
        linked = 100 * common >= 85 * (n + m - common)
        keys = [{k for k, _ in subset_keys(s, 40, 85)} for s in (a, b)]
        assert len(keys[0]) == subset_count(n, 40, 85)
        if linked and not np.array_equal(a, b):
            assert keys[0] & keys[1] and common >= overlap(n, m, 85)
    assert len(shingle_set("A b\x0bC", 4)) == 1 and len(shingle_set(" ", 4)) == 1


def test_large_group_of_near_copies(spark):
    from lectern.llm.jaccard import linked_components

    rng = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(2):
            w[rng.randrange(120)] = f"x{i}-{rng.randint(0, 9)}"
        rows.append((i + 1, " ".join(w)))
    rows += [(1000 + i, " ".join([f"y{i}-{k}" for k in range(60)] + base[:60])) for i in range(80)]
    got = linked_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, long_list=20).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute(rows, 4, 85))


def test_group_of_copies_with_many_edits(spark):
    """Copies with none to many edits: chains of links, copies that link with nothing, all in the same long lists."""
    from lectern.llm.jaccard import linked_components

    rng = random.Random(16)
    base = [f"w{i}" for i in range(110)]
    rows = []
    for i in range(260):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9])):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 2)] = [f"x{rng.randint(0, 30)}"] * rng.randint(0, 2)
        rows.append((i + 1, " ".join(w)))
    rows += [(900, None), (901, rows[3][1]), (None, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in linked_components(df, 5, 80, long_list=5).collect()]
    want = brute([r for r in rows if r[0] is not None], 5, 80)
    assert sorted(r for r in got if r[0] is not None) == sorted(want) and len(got) == len(rows)


def test_neighbours(spark):
    from lectern.llm.neighbours import nearest

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    vectors = (centres[rng.integers(12, size=3000)] + 0.4 * rng.normal(size=(3000, 16))).astype(np.float32)
    vectors[2000:2400] = vectors[50]  # a third of a cell's rows and more are one vector
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(5000, None), (5050, []), (5100, [0.0] * 16), (5150, [float("nan")] + [1.0] * 15), (5200, [float("inf")] + [1.0] * 15), (5250, [1.0] * 3), (5300, [None] + [1.0] * 15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cell", F.lit(1)).withColumn("id", F.lit(2))
    got = nearest(df, F.col("vec_id") % 50 == 0, shard_rows=300, query_rows=16, centroids=8)
    found: dict = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == set(range(0, 3000, 50)) and all([x[0] for x in v] == [1, 2, 3, 4, 5] for v in found.values())
    data = vectors.astype(np.float64)
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    hits = 0
    for q, v in found.items():
        score = unit @ unit[q]
        score[q] = -9
        want = np.lexsort((np.arange(3000), -np.round(score, 12)))[:5]
        hits += len(set(want.tolist()) & {x[1] for x in v})
        assert all(abs(s - score[i]) < 1e-12 for _, i, s in v)
    assert hits / (5 * len(found)) >= 0.9
    assert [x[1] for x in found[50]] == [2000, 2001, 2002, 2003, 2004]


def test_cosines_of_huge_and_tiny_vectors():
    from lectern.llm.neighbours import centroids_for, cosines

    rng = np.random.default_rng(1)
    q, rows = rng.normal(size=8), rng.normal(size=(5, 8))
    plain = rows @ q / np.linalg.norm(rows, axis=1) / np.linalg.norm(q)
    for by in (1.0, 1e200, 1e-200, 3.7e150):
        assert np.allclose(cosines(q * by, rows * by), plain, rtol=1e-12)
    assert np.array_equal(cosines(q, rows), cosines(q * 2.0**500, rows * 2.0**-500))
    assert [centroids_for(n) for n in (0, 50_000, 10**12)] == [8, 24, 256]


def test_neighbours_repeated_ids_and_clashing_names(spark):
    from lectern.llm.neighbours import nearest

    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [1.0, 0.2]), (2, [0.0, 1.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, nearest(df, F.col("vec_id") % 50 == 0).collect()))
    assert [r[:3] for r in got] == [(0, 1, 1), (0, 2, 1), (0, 3, 2)]
    more = df
    for name in ("query_id", "rank", "score", "vec", "shard", "asks"):
        more = more.withColumn(name, F.lit("x"))
    assert sorted(map(tuple, nearest(more, F.col("vec_id") % 50 == 0).collect())) == got


def test_neighbours_few_rows(spark):
    from lectern.llm.neighbours import nearest

    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = [tuple(r)[:3] for r in nearest(df, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2)]
    assert nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert nearest(df.where("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_only_wanted_cells_are_multiplied():
    from lectern.llm.neighbours import best, products

    rng = np.random.default_rng(2)
    queries, rows, starts = rng.standard_normal((7, 5)), rng.standard_normal((30, 5)), np.array([0, 4, 20])
    wanted = rng.random((7, 3)) < 0.4
    got = products(queries, rows, starts, wanted)
    sizes = np.array([4, 16, 10])
    assert np.isfinite(got).sum() == (wanted * sizes).sum()
    place = np.repeat(np.arange(3), sizes)
    assert np.allclose(got[wanted[:, place]], (queries @ rows.T)[wanted[:, place]])
    found = best(np.arange(7), queries, np.arange(30), rows, 3, starts, wanted)
    assert all(wanted[q, place[i]] and q != i for q, i in zip(found["query_id"], found["id"], strict=True))


def test_ties_across_shards(spark):
    """Equal vectors that lie in different shards: the smaller ids come first, found twice alike."""
    from lectern.llm.neighbours import nearest

    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 6))
    rows = [(int(i), base[i % 40].tolist(), "z") for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell string").withColumn("shard", F.lit("q"))
    got = [tuple(r) for r in nearest(df, F.col("vec_id") % 50 == 0, shard_rows=16, query_rows=2, least=400).collect()]
    want = [(q, n + 1, i) for q in range(0, 400, 50) for n, i in enumerate([i for i in range(q % 40, 400, 40) if i != q][:5])]
    assert sorted(r[:3] for r in got) == want
    again = [tuple(r) for r in nearest(df, F.col("vec_id") % 50 == 0, shard_rows=16, query_rows=2, least=400).collect()]
    assert sorted(got) == sorted(again)
