"""Operators that work row by row: results on odd inputs and against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, word string"
ODD = [
    (1, "Call me now: +1 (415) 555-0100 or mail a.b@c.example.org, card 4111 1111 1111 1111.", "en", "s1", 1, 0.5, "x"),
    (2, None, None, None, None, None, None),
    (3, "", "en", "s1", 0, 0.5, "x"),
    (4, " \n\t ", "en", "s2", 4, 0.5, "x"),
    (5, "same same " * 30, "en", "s2", 1, 0.5, "x"),
    (5, "same same " * 30, "en", "s2", 1, 0.5, "x"),
    (None, "no id here", "fr", None, 1, None, None),
    (6, "x" * 200_000, "en", "s1", 1, 0.5, "x"),
    (7, "1" * 100_000 + " " + "+1 " * 20_000, "en", "s1", 1, 0.5, "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ODD, DOCS)


def model_path():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def test_pieces_equal_library(spark, docs):
    from lectern.llm.pieces import PieceCodec, piece_digests, piece_ids

    codec = PieceCodec(model_path())
    rng = random.Random(3)
    alphabet = [*" \t\nabcdeé▁日😀<0x>s/​�\x00", "  ", "the", "ing", "ﬁ", "́", "한국"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(2000)] + ["▁", "▁▁ ", "<s>", "<0x41>", "a" * 500]
    for t, (n, ids, decoded) in zip(texts, codec.digest(texts), strict=True):
        want = codec.library.encode(t)
        assert codec.encode(t) == want and codec.decode(want) == codec.library.decode(want)
        assert (n, ids) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest())
        assert decoded == hashlib.sha256(codec.library.decode(want).encode()).hexdigest()
    rows = piece_digests(docs, model_path()).collect()
    assert len(rows) == len(ODD) and {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3)} == {0}
    clashing = docs.withColumn("n_tokens", F.lit("x")).withColumn("id", F.lit("y")).withColumn("ids_sha256", F.lit("z"))
    assert sorted(map(str, piece_digests(clashing, model_path()).collect())) == sorted(map(str, rows))
    assert piece_digests(docs.limit(0), model_path()).count() == 0
    assert all(r["decoded"] == t for r, (_, t, *_) in zip(piece_ids(docs, model_path()).collect(), ODD, strict=True) if t)


def test_short_chunks_are_encoded_together(monkeypatch):
    """One table for all chunks of a length: equal to the agenda of each, with ties, bytes, single characters and long chunks."""
    from lectern.llm.pieces import TOGETHER_CHARS, PieceCodec

    codec = PieceCodec(model_path())
    rng = random.Random(9)
    alphabet = [*"aabeinorst.,é日😀\n\x00", "tion", "ation", "the", "ing"]
    chunks = ["▁" * rng.choice((1, 1, 1, 3)) + "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + ["▁", "▁\n", "▁" + "a" * 200, "▁日"]
    want = [codec.agenda(c) for c in chunks]
    assert codec.agendas(chunks) == want and codec.agendas([]) == []
    alone, agenda = [], codec.agenda
    monkeypatch.setattr(codec, "agenda", lambda c: alone.append(c) or agenda(c))
    list(codec.digest([c[1:].replace("▁", " ") for c in chunks]))
    assert alone and all(len(c) > TOGETHER_CHARS for c in alone)


def luhn(d):
    return sum(v - 9 if v > 9 else v for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    found = []
    for place, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                found.append((m.start(), place, f"{kind}:{m.start()}:{m.end()}"))
    return [x for _, _, x in sorted(found)]


def test_pii_equals_brute_force(spark, docs):
    from lectern.llm.pii import pii_digest

    rng = random.Random(5)
    bits = ["a@b.c", "a@b.c.d_e@f.gh", "😀", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (415) 555-0100", "+44 20 7946 0958 1234 5", "+1", "..", "--", "@", " ", "x", "7", "é", "+", "(", "0", "\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in pii_digest(df).collect():
        want = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[r["doc_id"]]
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(w.startswith(k) for w in want) for k in PATTERNS]
        assert set(want) <= set(r["spans"].split(",")) | {""}
    rows = pii_digest(docs).collect()
    assert len(rows) == len(ODD) and all(r["spans"] == "" for r in rows if r["doc_id"] in (2, 3, 4))
    assert pii_digest(docs.limit(0)).count() == 0


def test_pii_added_kinds_and_redaction(spark):
    from lectern.llm.pii import pii_digest, redact

    texts = {1: "IBAN GB82 WEST 1234 5698 7654 32 of my bank account", 2: "IBAN GB83 WEST 1234 5698 7654 32", 3: "his social security number: 123-45-6789", 4: "order 123-45-6789 example", 5: "login password=abcdef123456 now"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii_digest(df).collect()}
    assert "iban:5:32" in got[1] and "iban" not in got[2] and "ssn:28:39" in got[3] and "ssn" not in got[4] and "secret:6:27" in got[5]
    clean = {r["doc_id"]: r["text"] for r in redact(df.withColumn("pii", F.lit(1)).drop("pii")).collect()}
    assert clean[3] == "his social security number: [SSN]" and clean[4] == texts[4]


def test_pii_long_secrets(spark):
    from lectern.llm.pii import redact

    secret = "aB3" * 300
    d = spark.createDataFrame([(1, f"login token={secret} end")], "doc_id long, text string")
    left = str(redact(d).collect())
    assert "aB3" not in left and "end" in left


def test_quality_equals_brute_force(spark, docs):
    from lectern.llm.quality import quality

    rng = random.Random(9)
    texts = [t for _, t, *_ in ODD] + [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(150)] + ["\n".join(rng.choice(["a b", " ", "c", ""]) for _ in range(12)) for _ in range(30)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in quality(df).collect():
        t = texts[r["doc_id"]] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        seen: dict = {}
        for w in windows:
            seen[w] = seen.get(w, 0) + 1
        inside = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(lines) - len(set(lines)), len(inside))
        assert r["base_failed"] == (len(words) < 20 or 100 * len(inside) > 30 * len(words)) and not (r["base_failed"] and r["kept"])
    assert quality(docs.limit(0)).count() == 0 and quality(docs).count() == len(ODD)


def test_quality_learns_from_votes(spark):
    from lectern.llm.quality import quality

    rng = random.Random(2)
    words = "the of and to a in is that it for was on with as house tree river mountain small green walks sings".split()
    good = [" ".join(rng.choice(words) + ("." if k % 9 == 8 else "") for k in range(120)) for _ in range(80)]
    bad = [" ".join(rng.choice(words) + rng.choice(["***", "###", "$$$"]) for _ in range(120)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    kept = {r["doc_id"]: r["kept"] for r in quality(df).collect()}
    assert all(kept[i] for i in range(80)) and not any(kept[i] for i in range(80, 100))


def test_quality_equals_plain_expectation_maximisation(spark):
    from lectern.llm.quality import ANCHOR, START, learn_accuracies

    rng = random.Random(8)
    names = ["a", "b", "c", "d"]
    table = {}
    for _ in range(400):
        good = rng.random() < 0.7
        votes = tuple(rng.choice([0, 0, 1 if rng.random() < (0.9 if good else 0.3) else -1, 1 if good else -1]) for _ in names)
        table[votes] = table.get(votes, 0) + 1
    df = spark.createDataFrame([(*v, n) for v, n in table.items()], "v_a int, v_b int, v_c int, v_d int, n long")
    got = learn_accuracies(df, names, rounds=12).first()
    share, chance = 0.8, [[list(p) for p in zip(*START)] for _ in names]  # chance[rule][0 good vote, 1 bad vote] = (given good, given bad)
    for _ in range(12):
        weight = {}
        for v, n in table.items():
            g, b = share, 1 - share
            for k, x in enumerate(v):
                if x:
                    g, b = g * chance[k][0 if x == 1 else 1][0], b * chance[k][0 if x == 1 else 1][1]
            weight[v] = n * g / (g + b)
        total, good = sum(table.values()), sum(weight.values())
        anchor, new = ANCHOR * total + 1, []
        for k in range(len(names)):
            said = [[sum(weight[v] for v in table if v[k] == s), sum(table[v] - weight[v] for v in table if v[k] == s)] for s in (1, -1)]
            new.append([[(said[s][c] + anchor * START[c][s]) / (said[0][c] + said[1][c] + anchor) for c in (0, 1)] for s in (0, 1)])
        share, chance = (good + 8) / (total + 10), new
    assert abs(got["good"] - share) < 1e-9
    flat = [tuple(pair) for rule in chance for pair in rule]
    assert all(abs(x["g"] - g) < 1e-9 and abs(x["b"] - b) < 1e-9 for x, (g, b) in zip(got["chance"], flat, strict=True))


def test_mixing_cuts_at_the_budget(spark):
    """Brute force on one source: rows in order of their keys, whole epochs first, then up to the budget."""
    from lectern.llm.mixing import mix

    rng = random.Random(14)
    rows = [(rng.choice([1, 2, None, 7]), " ".join(["w"] * rng.randint(0, 9)) + f" {i}", "s") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x")).withColumn("taken", F.lit("x"))
    order = df.select(F.xxhash64(F.lit(42), F.col("doc_id"), F.xxhash64("text")).alias("key"), "text").collect()
    size = {r["text"]: len(r["text"].split()) for r in order}
    rest, want = int(1.5 * sum(size.values())) - sum(size.values()), {}
    for r in sorted(order, key=lambda r: r["key"]):
        take = min(rest, size[r["text"]])
        want[r["text"]], rest = size[r["text"]] + take, rest - take
    for per_range in (5, 1000):
        got = mix(df, per_range=per_range).collect()
        assert sorted((r["doc_id"] or 0, r["size"], r["taken"]) for r in got) == sorted((d or 0, size[t], want[t]) for d, t, _ in rows)


def test_mixing(spark, docs):
    from lectern.llm.mixing import mix

    rng = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 40))), rng.choice(["a", "b", "c", "d", None, "é"])) for i in range(600)] + [(1000 + i, "w " * 200, "big") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(df, per_range=50).collect()
    assert len(got) == len(rows) and sorted(got) == sorted(mix(df, per_range=50).collect())
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    names = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in names if x not in capped) for s in names if s not in capped}
        over = {s for s in share if share[s] > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    want = {s: 2.0 * sizes[s] if s in capped else share[s] for s in names}
    taken: dict = {}
    for r in got:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 2 * r["size"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in names)
    assert mix(docs).count() == len(ODD) and mix(docs.limit(0)).count() == 0
    assert all(r["taken"] == 0 for r in mix(docs.where("doc_id in (2, 3, 4)")).collect())


@pytest.fixture(scope="module")
def licences(spark):
    """(documents, a model trained with them): trained once."""
    from lectern.llm.licences import train

    plain = [(100 + i, f"An ordinary paragraph about rivers and trees number {i}.\nIt was public and free for all under the bridge of version {i}.") for i in range(30)]
    marked = [(1, "Released under the MIT License.\nText"), (2, "x\nLicensed under the Apache License, Version 2.0. And then a long story follows about mit und ohne Licht."), (3, "Licensed under CC BY-NC 4.0."), (4, "All rights reserved."), (5, None), (6, ""), (7, "Wir gehen mit dem Hund und mit der Katze."), (8, "Released under the MIT License.\nThis work is licensed under the GNU General Public License, version 3.")]
    df = spark.createDataFrame(marked + plain, "doc_id long, text string").withColumn("family", F.lit("clash")).withColumn("place", F.lit(1))
    return df, train(df)


def test_licences(licences):
    from lectern.llm.licences import UNKNOWN, licence_digest

    df, model = licences
    plain = [(100 + i, None) for i in range(30)]
    got = {r["doc_id"]: r["families"] for r in licence_digest(df, model).collect()}
    assert [got[i] for i in (1, 2, 3, 4, 5, 6, 7, 8)] == ["mit", "apache", "cc-by-nc", "proprietary", "", "", "", "gpl,mit"]
    assert all(got[i] in ("", UNKNOWN) for i, _ in plain) and sum(got[i] != "" for i, _ in plain) <= 1
    assert licence_digest(df.limit(0), model).count() == 0


def test_licences_equal_brute_force(spark, licences):
    """Every paragraph scored by all its n-grams, in Python, and compared with all templates of its family."""
    import math

    from lectern.llm.licences import NOT_LICENCES, UNKNOWN, WORDINGS, scan, train

    _, model = licences

    def tokens(t):
        return [w for w in re.split(r"[^a-z0-9à-ÿ.+]+|[.](?![0-9])", t.lower()) if w]

    def grams(w, n):
        return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}

    rng = random.Random(3)
    texts = [f"{t}\n\n  {rng.choice(NOT_LICENCES)}" for ts in WORDINGS.values() for t in ts] + [" ".join(rng.sample(t.split(), len(t.split()))) for ts in WORDINGS.values() for t in ts]
    texts += ["a plain line\n" * 40 + "Licensed under the MIT license" + "\nanother plain line" * 40, "word " * 5000 + "released under CC0 1.0", None, "", "\n", "mit mit mit"]
    df = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)] + [(None, texts[0])], "doc_id long, text string")
    none = model.classes.index("none")
    want = []
    for d, t in [(i // 2, t) for i, t in enumerate(texts)] + [(None, texts[0])]:
        for place, par in enumerate((t or "").split("\n") if t is not None else []):
            w = tokens(par)
            found = [model.weights[g] for g in set().union(*(grams(w, n) for n in (1, 2, 3))) if g in model.weights]
            if not found:
                continue
            raw = [b + sum(x[k] for x in found) for k, b in enumerate(model.bias)]
            top = max(range(none), key=lambda k: raw[k])
            chance = 1 / (1 + math.exp(-((raw[top] - raw[none]) * model.slope + model.shift)))
            if chance >= 0.5:
                shares = [0.0]
                for template in WORDINGS[model.classes[top]]:
                    n = 3 if len(tokens(template)) >= 3 else 2
                    shares.append(len(grams(tokens(template), n) & grams(w, n)) / len(grams(tokens(template), n)))
                want.append((d, place, model.classes[top] if max(shares) >= 0.6 else UNKNOWN, round(chance, 6)))
    got = [(r["doc_id"], r["place"], r["family"], round(r["chance"], 6)) for r in scan(df, model).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) > 40
    assert {r[2] for r in want} > {"mit", UNKNOWN}
    empty = train(df.limit(0))
    assert scan(df, empty).count() > 0 and scan(df.limit(0), empty).count() == 0
    # without words that decide, no paragraph is left out before it is scored
    from lectern.llm.licences import LicenceModel

    bare = LicenceModel(model.classes, model.weights, [0.0] * len(model.bias), model.slope, model.shift)
    assert bare.anchors(0.5) is None or model.shift < 0
    assert scan(df, bare).count() >= len(want)


def test_licences_score_each_row(spark, licences):
    from lectern.llm.licences import licence_digest, scan

    mit, gpl, weak = "Released under the MIT License.", "Text\nLicensed under the GNU General Public License version 2", "a licensed electrician should do this work"
    texts = [mit, gpl, weak, weak, mit, None]
    one_each = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _, model = licences
    want = sorted((r["families"], round(r["chance"], 9), r["n_licences"]) for r in licence_digest(one_each, model).collect())
    for ids in ([1] * 6, [None] * 6, [1, 1, 2, 2, None, None]):
        df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
        got = licence_digest(df, model).collect()
        assert sorted((r["families"], round(r["chance"], 9), r["n_licences"]) for r in got) == want
        assert sorted(map(str, ids)) == sorted(str(r["doc_id"]) for r in got)
        assert scan(df, model).count() == sum(n for _, _, n in want)


def test_codecs_go_with_their_query(spark):
    """A Python worker that goes on with other work keeps no codec, and so no memo, of a query before."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from lectern.llm.pieces import piece_digests

    docs = spark.range(64).selectExpr("id as doc_id", "concat('word', id, ' and more') as text").repartition(4)
    assert piece_digests(docs, public_tokenizers.path("piece_bpe_32k.model")).where("n_tokens > 0").count() == 64

    def held(batches):
        import gc

        import pyarrow as pa

        for _ in batches:
            pass
        yield pa.RecordBatch.from_pydict({"n": [sum(type(x).__name__ == "PieceCodec" for x in gc.get_objects())]})

    assert docs.select("doc_id").mapInArrow(held, "n long").agg({"n": "max"}).first()[0] == 0
