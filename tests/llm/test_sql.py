"""Registered queries of the training-data operators against their SQL, and their columns."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", ["op4_ngram_jaccard", "op9_pii", "op11_flat_graph", "op12_collocations", "op13_spelling_variants"])
def test_equals_sql(spark, name):
    import duckdb

    from lectern.llm.queries import ORACLE_SQL, QUERIES

    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    cursor = db.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, cursor.fetchall()))


COLUMNS = {
    "op1_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op3_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op7_source_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op8_nearest": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
}


@pytest.mark.parametrize("name", COLUMNS)
def test_contract_columns(spark, name):
    from lectern.llm.queries import QUERIES

    df = QUERIES[name](spark, SF)
    assert COLUMNS[name].items() <= dict(df.dtypes).items()
    assert df.count() > 0


def test_pii_equals_sql_on_account_numbers_and_long_secrets(spark, tmp_path):
    import duckdb

    from lectern.llm.queries import ORACLE_SQL, QUERIES

    good = ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "FR14 2004 1010 0505 0001 3M02 606", "NO9386011117947"]
    bad = ["DE89370400440532013001", "GB82 WEST 1234 5698 7654 33", "XX00 0000"]
    texts = [f"bank {n}, {n}_{n} a{n} {n}b ({n})" for n in good + bad] + ["isbn order " + good[0], "_" + good[1] + "_", good[0] + " " + good[2] + "-" + good[3]]
    texts += ["password: " + "aB3/" * 300 + " api_key='" + "k" * 200 + "' xtoken=" + "t" * 9, "pwd = " + "z" * 7, "", None, "naïve é " + good[0] + " ip 10.0.0.1 a@b.co"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    cursor = db.execute(ORACLE_SQL["op9_pii"])
    columns = [d[0] for d in cursor.description]
    got = QUERIES["op9_pii"](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, cursor.fetchall()))
    spans = {r["doc_id"]: r["spans"] for r in got}
    assert all(spans[i].count("iban") == 4 for i in range(len(good))) and not any("iban" in spans[len(good) + i] for i in range(len(bad)))
    assert any(int(s.split(":")[2]) - int(s.split(":")[1]) > 1200 for t in spans.values() for s in t.split(",") if s.startswith("secret"))
