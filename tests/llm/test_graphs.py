"""Flat graph, collocations and spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F


def brute_links(rows, threshold):
    """(id, n_links, component) of rows (id, vector, label) by comparing all pairs."""
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and lab is not None for _, v, lab in rows]
    linked = defaultdict(set)
    for i, (_, v, a) in enumerate(rows):
        for j in range(i):
            w, b = rows[j][1:]
            if ok[i] and ok[j] and a == b and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    linked[i].add(j)
                    linked[j].add(i)
    part = list(range(len(rows)))
    for i in range(len(rows)):
        todo = [i]
        while todo:
            for j in linked[todo.pop()]:
                if part[j] > part[i] or part[j] == j != i and part[i] < j:
                    part[j] = part[i]
                    todo.append(j)
    whole = defaultdict(list)
    for i, p in enumerate(part):
        if rows[i][0] is not None:
            whole[p].append(rows[i][0])
    return [(r[0], len(linked[i]), min(whole[part[i]], default=None)) for i, r in enumerate(rows)]


def clumps(seed, dim=16):
    rng = np.random.default_rng(seed)
    vectors = []
    for size, noise in [(60, 0.03), (40, 0.05), (5, 0.02), (2, 0.001)] + [(1, 0)] * 140:
        middle = rng.standard_normal(dim)
        vectors += [(middle + noise * np.linalg.norm(middle) * rng.standard_normal(dim) / 2).tolist() for _ in range(size)]
    vectors += [vectors[0]] * 30  # exact copies
    vectors += [[2.0 * x for x in vectors[1]], [-x for x in vectors[1]]]  # on one ray, and opposite
    labels = [rng.choice([1, 1, 2, 3]) for _ in vectors]
    rows = [(int(i), [float(x) for x in v], int(lab)) for i, (v, lab) in enumerate(zip(vectors, labels, strict=True))]
    rows += [(900, None, 1), (901, [0.0] * dim, 1), (902, [float("nan")] * dim, 1), (903, vectors[0], None), (904, vectors[0][:3], 1), (905, [], 1), (906, [None] * dim, 1)]
    rows += [(3, vectors[3], 1), (None, vectors[5], 1), (None, None, None)]
    order = rng.permutation(len(rows))
    return [rows[i] for i in order]


@pytest.mark.parametrize("seed,shard_rows", [(1, 8192), (2, 40)])
def test_flat_graph(spark, seed, shard_rows):
    """The second in shards and blocks, with a group of copies larger than a shard."""
    from lectern.llm.flatgraph import graph_links

    rows = clumps(seed)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    df = df.withColumn("grp", F.lit("x")).withColumn("node", F.lit(None).cast("int")).withColumn("id", F.lit(1)).withColumn("kept", F.lit("y"))
    found = graph_links(df, shard_rows=shard_rows, margin=1.0)
    got = [tuple(r) for r in found.rows.collect()]
    assert found.found_share == 1.0
    assert sorted(map(str, (r[:3] for r in got))) == sorted(map(str, brute_links(rows, 0.98)))
    assert all(r[3] == (r[0] == r[2]) for r in got)


def test_flat_graph_of_nothing(spark):
    from lectern.llm.flatgraph import graph_links

    schema = "vec_id long, embedding array<float>, label int"
    assert graph_links(spark.createDataFrame([], schema)).rows.collect() == []
    assert [tuple(r) for r in graph_links(spark.createDataFrame([(4, None, 1)], schema)).rows.collect()] == [(4, 0, 4, True)]


def test_graph_reaches_and_is_pruned():
    from lectern.llm.flatgraph import Shape, beam_search, build, robust_prune

    rng = np.random.default_rng(5)
    rows = rng.standard_normal((900, 8)).astype(np.float32)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    adjacency, starts = build(rows, Shape(degree=12, beam=32))
    padded = np.concatenate([rows, np.zeros((1, 8), np.float32)])
    ids, _ = beam_search(padded, adjacency, starts, rows, 32)
    assert adjacency.shape == (900, 12) and (ids[:, 0] == np.arange(900)).mean() > 0.99
    # a candidate that lies behind a nearer one goes
    line = np.array([[1, 0], [np.cos(0.1), np.sin(0.1)], [np.cos(0.2), np.sin(0.2)], [np.cos(0.3), -np.sin(0.3)], [0, 0]], np.float32)
    assert robust_prune(line, np.array([[1, 2, 3]]), (line[[1, 2, 3]] @ line[0])[None], 3, 1.2)[0].tolist() == [1, 3, 4]


def brute_phrases(rows, least):
    """Rows of the contract, for texts (lang, text)."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3, 4):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in cands.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cands.items()):
                continue
            score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), " ".join(p), counts[p[:k]], counts[p[k:]]))
        for r, (s, a, _, p, left, right) in enumerate(sorted(scored)[:2000], 1):
            out.append((lang, r, p, -a, left, right, n[lang], -s))
    return out


@pytest.mark.parametrize("head,bits", [(1 << 17, 1 << 20), (12, 1 << 12), (3, 64)])
def test_collocations(spark, head, bits):
    """With words and phrases beyond the heads, and a bit map in which rare words share bits."""
    from lectern.llm.collocations import collocations

    rng = random.Random(head)
    words = ["the", "of", "New", "york", "Straße", "東京", "a\x00b", "x y", "été", *[f"w{i}" for i in range(30)]]
    rows = []
    for _ in range(300):
        t = []
        for _ in range(rng.randint(0, 25)):
            t += rng.choice([["in", "the", "City", "of"], ["New", "York"], [rng.choice(words)], [rng.choice(words[:4])], ["run", "run", "run"]])
            if rng.random() < 0.2:
                t.append(rng.choice([". ", ",", "\n", "?", "\t", "  "]))
        rows.append((rng.choice(["en", "en", "en", "de", None, "und"]), " ".join(t)))
    rows += [("en", None), ("en", ""), ("fr", "..."), ("es", "solo")] + [rows[0]] * 5
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("word", F.lit("q")).withColumn("ids", F.lit(1)).withColumn("n", F.lit(2))
    got = [tuple(r) for r in collocations(df, least=4, head=head, bits=bits).collect()]
    assert sorted(got) == sorted(brute_phrases(rows, 4)) and len(got) > 50


def test_collocations_of_nothing(spark):
    from lectern.llm.collocations import collocations

    assert collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_tiles_and_hashes(spark):
    from lectern.llm.collocations import EDGE, Tiles, hash_longs

    rng = np.random.default_rng(1)
    pairs = [(rng.zipf(1.3, 400_000) % 6000, rng.zipf(1.3, 400_000) % 6000), (np.array([1 << 62, 5, 1 << 62]), np.array([7, 1 << 62, 7]))]
    tiles = Tiles()
    for left, right in pairs:
        tiles.add(left, right, most=1000)
    assert tiles.dense and all(x.shape == (EDGE * EDGE,) for x in tiles.dense.values())
    got = Counter()
    for left, right, n in tiles.rows():
        for x, y, c in zip(left.tolist(), right.tolist(), n.tolist(), strict=True):
            got[x, y] += c
    assert got == Counter(p for left, right in pairs for p in zip(left.tolist(), right.tolist(), strict=True))
    values = [(0, 1), (-5, 1 << 62), (1 << 40, -1)]
    want = [r[0] for r in spark.createDataFrame(values, "a long, b long").select(F.xxhash64("a", "b")).collect()]
    assert hash_longs(*np.array(values).T.copy()).tolist() == want


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def brute_variants(rows, one_in):
    counts = Counter()
    for doc_id, text in rows:
        for w in re.findall(r"[a-zÀ-ÿ]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % one_in == 0 else w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    best = {w: min(near[w], key=lambda v: (-words[v], v), default=None) for w in words}
    form = {w: b if b is not None and words[b] >= 5 * words[w] else None for w, b in best.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return [(w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()]


@pytest.mark.parametrize("most_words", [20_000, 4])
def test_spelling_variants(spark, most_words):
    from lectern.llm.variants import variants

    rng = random.Random(3)
    base = ["".join(rng.choice("abÀÿ÷c") for _ in range(rng.choice([6, 7, 8, 9]))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "abababab"]
    rows = []
    for i in range(150):
        t = []
        for _ in range(rng.randint(0, 120)):
            w = base[min(int(rng.expovariate(0.08)), len(base) - 1)]
            at = rng.randrange(len(w) + 1)
            w = rng.choice([w] * 12 + [w[:at] + w[at + 1 :], w[:at] + rng.choice("abc") + w[at:], w[:at] + "b" + w[at + 1 :]])
            t.append(w.upper() if w.isascii() and rng.random() < 0.1 else w)
        rows.append((i if i % 30 else None, rng.choice([" ", "-", "1"]).join(t)))
    long = "".join(rng.choice("ab") for _ in range(4001))
    rows += [(500, " ".join([long] * 30 + [long[1:]] * 6 + [long[:2000] + "ÿ" + long[2001:]] * 5)), (501, None), (502, ""), (503, "short")] + [rows[1]] * 4
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("x")).withColumn("n", F.lit(0)).withColumn("key", F.lit(0))
    got = [tuple(r) for r in variants(df, one_in=7, most_words=most_words).collect()]
    want = brute_variants(rows, 7)
    assert sorted(map(str, got)) == sorted(map(str, want)) and sum(r[1] is not None for r in want) > 20


def test_spelling_of_nothing(spark):
    from lectern.llm.variants import variants

    assert variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_pairs_of_an_acceptor():
    from lectern.llm.variants import Acceptor, near_pairs

    rng = random.Random(9)
    short = sorted({"".join(rng.choice("abc") for _ in range(5)) for _ in range(150)})
    long = sorted({"".join(rng.choice("abc") for _ in range(6)) for _ in range(300)})
    for at_end in (True, False):
        same, more = near_pairs(short, long, at_end)
        assert sorted(same) == [(i, j) for i in range(len(short)) for j in range(i + 1, len(short)) if one_edit(short[i], short[j])]
        assert sorted(more) == [(i, j) for i, a in enumerate(short) for j, b in enumerate(long) if one_edit(a, b) and (at_end or not b.startswith(a))]
    # states with equal right languages are one
    assert len(Acceptor(sorted(a + b for a in "abcdef" for b in ("xx", "xy", "yy"))).arcs) == 1 + 1 + 2 + 1 + 1 - 1
