"""Trained operators: held-out accuracy on small made texts, and odd inputs."""

import math
import random

import numpy as np
import pytest

WORDS = {"en": "the and of house running walked light brother", "de": "der und nicht häuser gegangen licht bruder schön", "fr": "le et pas maison marché lumière frère élève"}
SLURS = ["stupid", "moron", "scumbag"]


def sentence(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(240):
        lang = ("en", "de", "fr")[i % 3]
        toxic = i % 5 == 0
        text = sentence(rng, lang, 20) + (f" {rng.choice(SLURS)}! " if toxic else " ") + sentence(rng, lang, 5)
        rows.append((i, text, lang, "s", len(text), 9.0))
        if i % 2 == 0 or toxic:
            labels.append((i, 1, int(toxic)))
    rows += [(900, None, "en", "s", 0, 9.0), (901, "", None, None, None, None), (902, "1234 --- !!!", "en", "s", 0, 9.0), (903, "ok " * 60_000, "en", "s", 0, 9.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, corpus):
    from lectern.llm.toxicity import toxicity_digest

    docs, labels = corpus
    got = {r["doc_id"]: r for r in toxicity_digest(docs, labels).collect()}
    assert len(got) == 244 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    held = [i for i in range(240) if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == (i % 5 == 0) for i in held]) > 0.95
    assert all(got[i]["predicted"] == 0 for i in (900, 901, 902, 903))
    assert toxicity_digest(docs.limit(0), labels).count() == 0
    assert {r["predicted"] for r in toxicity_digest(docs, labels.limit(0)).collect()} == {0}


def test_identity_terms_raise_no_alarm():
    from lectern.llm.toxicity import train

    rng = random.Random(2)
    texts, labels = [], []
    for i in range(300):
        base = sentence(rng, "en", 10)
        # in training, one group is mentioned mostly in toxic texts
        texts += [f"{base} muslims {rng.choice(SLURS)}", f"{base} christians came", base]
        labels += [1, 0, 0]
    fair, plain = train(texts, labels), train(texts, labels, penalty=0.0)
    neutral = "muslims met for dinner"
    assert fair.score([neutral])[0] < 0.3 and fair.score([neutral])[0] < plain.score([neutral])[0]
    assert fair.score(["what a moron"])[0] > 0.3


def test_swaps_alone_bring_scores_of_twins_together():
    from lectern.llm.toxicity import train

    rng = random.Random(12)
    texts, labels = [], []
    for i in range(200):
        base = sentence(rng, "en", 8)
        texts += [f"{base} muslims. {base}", f"{base} christians came", base, f"{sentence(rng, 'fr', 8)} juifs", sentence(rng, "fr", 9)]
        labels += [1, 0, 0, 1, 0]
    apart = []
    for penalty in (0.0, 1.0):
        model = train(texts, labels, penalty=penalty)
        a, b, c, d = model.score(["muslims met for dinner", "christians met for dinner", "les juifs marché", "les athées marché"])
        apart.append(abs(a - b) + abs(c - d))
    assert apart[1] < 0.5 * apart[0]


def test_scores_equal_plain_ones_and_read_whole_tokens():
    """Brute force: the mean weight of a word's features, the largest of a text's words, one after the other."""
    from lectern.llm.toxicity import DIMS, LENGTHS, RUN, train
    from lectern.llm.wordfeats import long_word_features, word_features

    rng = random.Random(5)
    texts = [sentence(rng, "en", 12) + (f" {rng.choice(SLURS)}" if i % 2 else "") for i in range(120)]
    model = train(texts, [i % 2 for i in range(120)])
    for text in ["the light moron", "walked of", "Brother; and", "", None]:
        best = model.floor
        for token in (text or "").split():
            f = word_features(["".join(c for c in token.lower() if c.isalpha())], DIMS, LENGTHS)[1]
            best = max(best, float(np.mean([model.weights[k] for k in f])))
        assert abs(model.score([text])[0] - 1 / (1 + math.exp(-(model.scale * best + model.bias)))) < 1e-6
    # a word far inside a run of letters without blanks is read, with and without other signs
    hidden = "q" * 5000
    plain = model.score([hidden, "x1" + hidden])
    assert all(s > p for s, p in zip(model.score([hidden + "moron" + hidden, "x1" + hidden + "moron" + hidden]), plain, strict=True)) and RUN == 64
    # features of long words, made in parts, are those made at once
    for word in ("a", "ab", "moron", "ünïcode" * 9):
        at_once = sorted(word_features([word], DIMS, LENGTHS)[1].tolist())
        assert sorted(int(x) for f in long_word_features(word, DIMS, LENGTHS, size=7) for x in f) == at_once


def test_clashing_names_and_repeated_rows(spark, corpus):
    from pyspark.sql import functions as F

    from lectern.llm.language import language_digest
    from lectern.llm.pseudo import pseudo_likelihood
    from lectern.llm.toxicity import toxicity_digest

    docs, labels = corpus
    docs = docs.where("doc_id < 60 or doc_id > 898")
    docs = docs.unionByName(docs.where("doc_id < 3"))
    more = docs
    for name in ("predicted", "held_out", "lang_pred", "n_words", "log_prob", "row", "word", "l_id"):
        more = more.withColumn(name, F.lit("x"))
    for f in (lambda d: toxicity_digest(d, labels), language_digest):
        plain, odd = (sorted(map(str, f(d).collect())) for d in (docs, more))
        assert plain == odd and len(plain) == docs.count()
    assert pseudo_likelihood(more).count() == docs.count()


def test_toxicity_sees_lookalikes():
    from lectern.llm.toxicity import train

    rng = random.Random(3)
    texts = [sentence(rng, "en", 12) + (" moron" if i % 2 else "") for i in range(200)]
    model = train(texts, [i % 2 for i in range(200)])
    assert all(s > 0.3 for s in model.score(["you m0ron", "a m.o.r.o.n", "(Moron)!"]))


def test_language(spark, corpus):
    from lectern.llm.language import fit, label_words, language_digest

    docs, _ = corpus
    got = {r["doc_id"]: r for r in language_digest(docs).collect()}
    held = [i for i in range(240) if got[i]["held_out"]]
    assert np.mean([got[i]["lang_pred"] == ("en", "de", "fr")[i % 3] for i in held]) > 0.95
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and len(got) == 244
    assert language_digest(docs.limit(0)).count() == 0
    model = fit(docs)
    rng = random.Random(4)
    mixed = spark.createDataFrame([(1, f"{sentence(rng, 'en', 10)} {sentence(rng, 'de', 10)}"), (2, None)], "doc_id long, text string")
    runs = {r["doc_id"]: r["runs"] for r in label_words(mixed, model).collect()}
    assert [(x["lang"]) for x in runs[1]] == ["en", "de"] and abs(runs[1][1]["first"] - 10) <= 1 and runs[2] == []


def test_language_reads_whole_tokens():
    from lectern.llm.language import bare, train

    rng = random.Random(7)
    texts, langs = zip(*[(sentence(rng, lang, 30), lang) for lang in ("en", "de", "fr") for _ in range(40)], strict=True)
    model = train(list(texts), list(langs))
    middle = "häusergegangennichtschönlichtbruder" * 40
    assert bare("«" + middle + "»") == middle
    assert model.label(["the" + middle + "the"])[0][0] == "de"
    alone, again = model.label([middle, "und " + middle])
    assert alone[0] == "de" and again[0] == "de" and middle not in model.place and model.label([middle])[0] == alone


def test_forward_backward_equals_plain():
    from lectern.llm.language import forward_backward

    rng = np.random.default_rng(1)
    lengths = np.array([1, 63, 64, 65, 200, 0, 3, 129])
    e, t, s = rng.normal(size=(lengths.sum(), 4)) * 2, rng.normal(size=(4, 4)), rng.normal(size=4)
    got, at = forward_backward(e, lengths, t, s), 0
    for n in lengths:
        if not n:
            continue
        x, trans = np.exp(e[at : at + n]), np.exp(t)
        a, b = np.zeros((n, 4)), np.ones((n, 4))
        a[0] = np.exp(s) * x[0] / (np.exp(s) * x[0]).sum()
        for k in range(1, n):
            a[k] = (a[k - 1] @ trans) * x[k]
            a[k] /= a[k].sum()
        for k in range(n - 2, -1, -1):
            b[k] = trans @ (x[k + 1] * b[k + 1])
            b[k] /= b[k].sum()
        want = a * b / (a * b).sum(axis=1, keepdims=True)
        assert np.allclose(want, got[at : at + n], atol=1e-4)
        at += n


def test_pseudo_likelihood(spark, corpus):
    from lectern.llm.pseudo import WindowNet, count_vocabulary, pseudo_likelihood, score, train

    docs, _ = corpus
    rows = {r["doc_id"]: r for r in pseudo_likelihood(docs).collect()}
    assert len(rows) == 244 and rows[900]["n_words"] == 0 and rows[900]["mean_log_prob"] is None and rows[903]["n_words"] == 60_000
    assert all(r["log_prob"] <= 0 for r in rows.values())
    assert pseudo_likelihood(docs.limit(0)).count() == 0
    vocabulary = count_vocabulary(docs)
    trained = train(docs, vocabulary, rounds=3)
    total = lambda net: sum(r["log_prob"] for r in score(docs, vocabulary, net).collect())
    assert total(trained) > total(WindowNet(vocabulary.size, weight=vocabulary.weight)) > total(WindowNet(vocabulary.size))
    # the probabilities of all classes in one place sum to 1
    ids = np.array([0, 1, 2, 3])
    each = [np.exp(trained.log_probs(np.array([0, k, 2, 3]), np.array([4]))[1]) for k in range(vocabulary.size)]
    assert math.isclose(sum(each), 1.0, rel_tol=1e-4) and len(ids) == 4


def test_log_probs_equal_a_plain_loop():
    from lectern.llm.pseudo import SIDE, WindowNet

    rng = np.random.default_rng(2)
    for classes in (1, 5, 7, 256):
        net = WindowNet(classes, weight=rng.integers(0, 50, classes).astype(float))
        for v in net.views[3:6]:
            v += rng.normal(size=v.shape).astype(np.float32)
        lengths = np.array([3, 0, 1, 9])
        ids = rng.integers(0, classes, lengths.sum())
        emb, w1, b1, wg, bg, wm, bm = (v.astype(np.float64) for v in net.views)
        want, at = [], 0
        for n in lengths:
            for i in range(n):
                near = [ids[at + i + k] if 0 <= i + k < n else classes for k in range(-SIDE, SIDE + 1) if k]
                h = np.tanh(np.concatenate([emb[c] for c in near]) @ w1 + b1)
                group, member = divmod(ids[at + i], net.inner)
                z, y = h @ wg + bg, h @ wm[group] + bm[group]
                want.append(z[group] - np.log(np.exp(z).sum()) + y[member] - np.log(np.exp(y).sum()))
            at += n
        assert np.allclose(net.log_probs(ids, lengths), want, atol=1e-4)
        # gradients by differences
        if classes == 7:
            grad, order = net.split(np.zeros_like(net.flat)), np.argsort(ids, kind="stable")
            net.pick(net.contexts(ids, lengths)[order], ids[order], None, grad)
            for part, where in ((0, (2, 3)), (1, (5, 4)), (3, (1, 1)), (5, (0, 2, 1)), (6, (1, 0))):
                loss = []
                for step in (1e-2, -1e-2):
                    net.views[part][where] += step
                    loss.append(-net.log_probs(ids, lengths).sum())
                    net.views[part][where] -= step
                assert abs((loss[0] - loss[1]) / 2e-2 - grad[part][where]) < 2e-2


def test_blocks_keep_rows_and_count_words(spark):
    from collections import Counter

    from lectern.llm.pseudo import block_words, blocks

    rows = [(k % 3 or None, t) for k, t in enumerate(["a b a", None, "", "c " * 50, "b\x0bc", "x" * 400] * 5)]
    made = blocks(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))
    assert sorted(map(str, ((r["id"], r["text"]) for r in made.collect()))) == sorted(map(str, rows))
    counted = Counter()
    for r in block_words(made).collect():
        counted[bytes(r["word"]).decode()] += r["n"]
    assert counted == Counter(w for _, t in rows for w in (t or "").split())


def test_pseudo_likelihood_trains_on_every_document(spark):
    from lectern.llm.pseudo import WindowNet, count_vocabulary, train

    for doc_id in range(3):
        docs = spark.createDataFrame([(doc_id, "the old house by the old river " * 20)], "doc_id long, text string")
        vocabulary = count_vocabulary(docs)
        assert not np.array_equal(train(docs, vocabulary, rounds=1).flat, WindowNet(vocabulary.size, weight=vocabulary.weight).flat)
    docs = spark.createDataFrame([(k, f"word{k} the house " * 9) for k in range(40)], "doc_id long, text string").repartition(1)
    vocabulary = count_vocabulary(docs)
    # each document changes the weights
    whole = train(docs, vocabulary, rounds=1).flat
    assert all(not np.array_equal(whole, train(docs.where(f"doc_id != {k}"), vocabulary, rounds=1).flat) for k in (0, 7, 23))


def test_pseudo_likelihood_uses_counts_inside_classes(spark):
    from lectern.llm.pseudo import WindowNet, count_vocabulary, score

    texts = ["a b c d", "a a a b b c", "a", "zzz a", None]
    docs = spark.createDataFrame([(k % 2, t) for k, t in enumerate(texts)], "doc_id long, text string")
    counted = docs.where("text not like '%zzz%'")
    n = {"a": 5, "b": 3, "c": 2, "d": 1, "zzz": 1}
    for frequent in (0, 1):
        v = count_vocabulary(counted, frequent=frequent, buckets=1)
        net = WindowNet(v.size)  # uniform over classes
        total = 11 - 5 * frequent
        inside = {w: 0.0 if frequent and w == "a" else math.log(n[w] / total) for w in n}
        want = [sum(inside[w] - math.log(v.size) for w in (t or "").split()) for t in texts]
        got = sorted(r["log_prob"] for r in score(docs, v, net).collect())
        assert np.allclose(got, sorted(want), atol=1e-5)


def test_counts_cover_all_words(spark, corpus):
    from lectern.llm.pseudo import count_vocabulary

    docs, _ = corpus
    v = count_vocabulary(docs, frequent=5, buckets=4)
    words = {w for r in docs.collect() for w in (r["text"] or "").split()}
    assert len(v.frequent) == 5 and sum(v.types) == len(words) - 5


def test_tokens_without_letters_are_read_whole():
    from lectern.llm.toxicity import RUN, _parts

    assert _parts("1488/88") == ["1488", "88"] and _parts("123-456") == ["123", "456"] and _parts("--") == []
    assert "".join(_parts("7" * RUN + "/1")).endswith("1")


def test_an_id_of_many_rows_gives_few_training_rows(spark):
    from lectern.llm.language import training_rows

    many = [(1, "en", f"text {i % 400}") for i in range(900)] + [(i, "en", f"other {i}") for i in range(2, 40)] + [(5, None, "x"), (6, "de", None), (None, "de", "y")]
    rows = training_rows(spark.createDataFrame(many, "doc_id long, lang string, text string"), per_language=50)
    assert len(rows) == 50 and len({r["text"] for r in rows}) == 50


def test_embedding_gradient_is_the_sum_over_places():
    """Each class's gradient is the sum over all places of the context that hold it; classes that are nowhere have none."""
    import numpy as np

    from lectern.llm.pseudo import WindowNet

    rng = np.random.default_rng(5)
    net, ids = WindowNet(30), np.sort(rng.integers(0, 12, 500))
    net.flat[:] = rng.normal(0, 0.3, len(net.flat))
    ctx = rng.integers(0, 12, (500, 4)).astype(np.int32)
    grad = net.split(np.zeros_like(net.flat))
    net.pick(ctx, ids, None, grad)
    step, want = 1e-2, np.zeros(31)
    assert not grad[0][12:].any() and grad[0][:12].any()
    for c in range(12):  # the loss's change when one class's embedding moves
        loss = []
        for sign in (1, -1):
            moved = WindowNet(30, net.flat)
            moved.views[0][c] += np.float32(sign * step)
            out = np.empty(500, np.float32)
            moved.pick(ctx, ids, out, None)
            loss.append(-out.astype(np.float64).sum())
        want[c] = (loss[0] - loss[1]) / (2 * step)
    assert np.allclose(grad[0][:12].sum(axis=1), want[:12], rtol=0.02, atol=0.1)


def test_words_are_numbered_where_they_lie():
    """Distinct words, their numbers and the words of each text are those of a plain split, also in parts of a batch."""
    import zlib

    import pyarrow as pa

    from lectern.llm.pseudo import Vocabulary, _slices, coded

    texts = [" a  b\x0bc\t", None, "", " ", "\x1cq\x85  \u00e9\u00a0x\n", "a " * 30, "\u2003z a", "b"]
    split = [(t or "").encode().split() for t in texts]
    vocabulary = Vocabulary([b"a", b"\xc3\xa9\xc2\xa0x"], [9, 1], [3] * 7, [5] * 7)
    for chars in (1, 20, 10_000):
        parts = list(_slices(pa.chunked_array([pa.array(["x", *texts]).slice(1)]), chars))
        assert sum(map(len, parts)) == len(texts)
        made = [coded(p) for p in parts]
        assert [n for _, _, lengths in made for n in lengths] == [len(w) for w in split]
        assert [words[int(k)].as_py() for words, at, _ in made for k in at] == [w for ws in split for w in ws]
        classes = [int(c) for words, at, _ in made for c in vocabulary.classes(words)[at]]
        place = {w: k for k, w in enumerate(vocabulary.frequent)}
        assert classes == [place.get(w, 2 + zlib.crc32(w) % 7) for ws in split for w in ws]


def test_a_memo_computes_a_bounded_number_of_words_at_once():
    from lectern.llm.wordfeats import WordMemo

    asked = []
    memo = WordMemo(lambda words: asked.append(len(words)) or [len(w) for w in words], limit=40, step=16)
    for k in range(3):
        words = {"x" * (i + 1) for i in range(10 * k, 50 + 10 * k)}
        found = memo.lookup(words)
        assert all(found[w] == len(w) for w in words)
    assert max(asked) <= 16 and sum(asked) >= 70
