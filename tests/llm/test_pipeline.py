"""The pipeline stage by stage."""

import random

import pytest

from tests.llm.test_pairs import brute


def test_pipeline(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as C

    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(60):
        text = " ".join(rng.choice(words) for _ in range(60)) + (" moron" if i % 6 == 0 else "")
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(i % 6 == 0)))
    rows += [(100, rows[1][1] + " tail", "en", "s1", 1), (101, rows[1][1], "en", "s1", 1), (102, None, "en", None, None), (103, "", "en", "s1", 0), (None, "no id at all", "en", "s1", 1), (None, rows[3][1], "en", "s1", 1), (None, "two without an id " * 9, "en", "s1", 1), (None, "two without an id " * 9 + "x", "en", "s1", 1), (None, None, None, "s1", 1), (104, rows[2][1] + "\nmail me: a@b.example.com", "en", "s2", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = docs.selectExpr("*", "1 as score", "'x' as toxicity", "2 as place", "3 as times")
    for name, stage in C.STAGES[:-1]:
        before, docs = docs, C.cut(stage(spark, docs, str(tmp_path)))
        assert docs.columns == before.columns, name
        ids = sorted(r["doc_id"] for r in docs.select("doc_id").collect() if r["doc_id"] is not None)
        if name == "toxicity":
            assert not any(i in ids for i in range(0, 60, 6)) and sum(i < 60 for i in ids) == 50
        if name == "near_duplicates":
            told = [(r["doc_id"], r["text"]) for r in before.where("doc_id is not null").collect()]
            assert ids == sorted({d for d, _, least in brute(told, 5, 80) if d == least})
            assert 1 in ids and 100 not in ids and 101 not in ids and len(ids) == len(set(ids))
            bare = [r["text"] for r in docs.where("doc_id is null").collect()]
            assert 3 in ids and len(bare) == 3 and None in bare and "no id at all" in bare
        if name == "pii":
            texts = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert not any("@" in (t or "") for t in texts.values())
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(C.run(spark, str(tmp_path)).columns)
    assert C.run(spark, str(tmp_path)).count() > 0
    assert C.pii(spark, docs.drop("n_chars"), "").columns == [c for c in docs.columns if c != "n_chars"]
    empty = docs.limit(0)
    for name, stage in C.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name


def test_documents_that_share_an_id(spark):
    """An id that other texts repeat loses none of them; copies and near copies go, whatever their ids."""
    import corpus_pipeline as C

    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abc"]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (2, texts[1] + " more"), (1, None), (3, ""), (None, texts[2]), (4, texts[2] + " more"), (7, "x " * 200_000)]
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(((r["doc_id"], r["text"]) for r in C.near_duplicates(spark, docs, "").collect()), key=str)
    assert kept == sorted([(1, texts[0]), (1, texts[1]), (1, None), (3, ""), (4, texts[2] + " more"), (7, "x " * 200_000)], key=str)
    mixed = {(r["doc_id"], r["text"]) for r in C.mixing(spark, docs, "").collect()}
    assert {(1, texts[0]), (1, texts[1])} <= mixed and (1, None) not in mixed
