import datetime
import gzip
import io
import os
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from lectern.functions.scalars import HEAD_BYTES as S_HEAD
from lectern.operators import annotations as A
from lectern.operators import index as I
from lectern.operators import recents as R
from lectern.sources import files as Files
from lectern.sources import tables as T
from lectern.sources.stored import StoredIndex
from lectern.streaming import streams as S


def test_files(spark, tmp_path):
    for name, body in {"a.pdf": b"no header", "b.bin": b"%PDF-1.7", "c.txt": b"one\ftwo", "d.txt": b"zzz"}.items():
        (tmp_path / name).write_bytes(body)
    files = Files.with_fingerprint(Files.scan_files(spark, str(tmp_path)))
    fine, rejects = Files.classify_format(files)
    assert {os.path.basename(r["path"]): r["kind"] for r in fine.collect()} == {"a.pdf": "Pdf", "b.bin": "Pdf"}
    assert rejects.count() == 2 and files.select("fp").distinct().count() == 4
    pages = Files.scan_page_layers(files.where("path like '%.txt'")).collect()
    assert sorted((r["page_index"], r["text"]) for r in pages) == [(0, "one"), (0, "zzz"), (1, "two")]
    with pytest.raises(Exception):
        Files.scan_files(spark, str(tmp_path / "none")).count()
    assert spark.range(1).select(Files.classify(F.lit("  "), F.lit(b"%PDF-")).alias("k")).first()["k"] is None


def test_heads_of_files(spark, tmp_path):
    """Three sparse gigabytes are fingerprinted by their head; the plan reads no content."""
    long = tmp_path / "deep" / "long.pdf"
    long.parent.mkdir()
    with open(long, "wb") as f:
        f.write(b"%PDF-" + b"x" * 100_000)
        f.truncate(3 << 30)
    for name, body in {"empty.bin": b"", "short of bytes %41 é#?.bin": b"ab%c", "edge.bin": b"e" * S_HEAD, "over.bin": b"e" * (S_HEAD + 1)}.items():
        (tmp_path / name).write_bytes(body)
    heads = Files.scan_heads(spark, str(tmp_path))
    rows = {os.path.basename(r["path"]): (r["length"], bytes(r["content"])) for r in heads.collect()}
    assert rows["long.pdf"] == (3 << 30, b"%PDF-" + b"x" * (S_HEAD - 5))
    assert rows["edge.bin"] == (S_HEAD, b"e" * S_HEAD) and rows["over.bin"] == (S_HEAD + 1, b"e" * S_HEAD) and len(rows) == 4
    fp = lambda files: {(r["path"], r["fp"]) for r in Files.with_fingerprint(files).select("path", "fp").collect()}
    assert fp(heads.where("path not like '%long%'")) == fp(Files.scan_files(spark, str(tmp_path), "*.bin"))
    assert {r["kind"] for r in Files.classify_format(Files.scan_heads(spark, str(tmp_path), "*.pdf"))[0].collect()} == {"Pdf"}
    scan = [line for line in heads._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).splitlines() if "ReadSchema" in line]
    assert scan and all("content" not in line for line in scan)
    with pytest.raises(Exception):
        Files.scan_heads(spark, str(tmp_path / "none")).count()


def test_heads_come_whole_from_short_reads():
    class Slow(io.BytesIO):
        def read(self, n=-1):
            return super().read(min(n, 3))

    assert Files._first(Slow(b"0123456789"), 7) == b"0123456" and Files._first(Slow(b"01"), 7) == b"01"


def test_annotation_sidecars(spark, tmp_path):
    """Order comes from seq, not from the rows' order; all kinds of nulls and planes of Unicode survive; damage stays in its document."""
    when = datetime.datetime(2020, 2, 29, 23, 59, 58)
    rows = [(f"doc {d}", seq, f"{d}-{seq}", seq % 3, kind, color, box, text, ink, when if seq % 2 else None)
            for d in "xy" for seq, (kind, color, box, text, ink) in enumerate([("Box", None, (-1.5, 0.25, 1e-9, 1e9), "𝔘 \"quoted\" \\ \n", None), ("Line", "#12ab9F", None, "", [(k / 8, -k) for k in range(40)]), ("Empty", "", (0.0, 0.0, 0.0, 0.0), None, [])])]
    rows = [(*r[:8], None if r[8] is None else [tuple(map(float, p)) for p in r[8]], r[9]) for r in rows]
    df = spark.createDataFrame(rows[::-1], f"fp string, seq long, {A.SCHEMA}")
    out = str(tmp_path / "a")
    T.write_annotations(df, out)
    assert "null" not in "".join(p.read_text() for p in pathlib.Path(out).rglob("part-*"))
    bad = pathlib.Path(out) / "fp=doc z"
    bad.mkdir()
    (bad / "part-0.json").write_text('{"Version": 1, "Annotations": [\n')
    back, quarantine = T.read_annotations(spark, out)
    assert sorted(map(str, back.select(*df.columns).collect())) == sorted(map(str, df.collect()))
    assert [r["fp"] for r in quarantine.collect()] == ["doc z"]
    assert A.on_page(back, 2).count() == 2 and [r["id"] for r in A.in_order(back, "doc y").collect()] == ["y-0", "y-1", "y-2"]


def test_annotation_files_do_not_follow_documents(spark, tmp_path):
    """Many documents in few files; names of all kinds; a line that breaks off is told by its name; folders of single documents are read."""
    names = [f"doc {k}" for k in range(300)] + ['a/b=c', 'quo"te\\', "50% +x", "é"]
    df = spark.createDataFrame([(n, 0, f"id-{n}", 1, "Box") for n in names], "fp string, seq long, id string, page_index int, kind string")
    df = df.selectExpr("*", "cast(null as string) as color_hex", "cast(null as struct<x:double,y:double,width:double,height:double>) as bounds", "cast(null as string) as text", "cast(null as array<struct<x:double,y:double>>) as ink_points", "cast(null as timestamp) as created_at")
    out = str(tmp_path / "a")
    T.write_annotations(df, out)
    assert len(list(pathlib.Path(out).rglob("part-*.json"))) < 50
    (pathlib.Path(out) / "part-torn.json").write_text('{"fp":"torn \\"1\\"","Version":1,"Annot')
    df.limit(0).unionByName(df.where("fp in ('a/b=c', '50% +x')").withColumn("fp", F.concat("fp", F.lit("!")))).select("fp", F.lit(1).alias("Version"), F.array(F.struct("id", "page_index")).alias("Annotations")).write.mode("append").partitionBy("fp").json(out)
    back, quarantine = T.read_annotations(spark, out)
    assert sorted((r["fp"], r["id"]) for r in back.collect()) == sorted([(n, f"id-{n}") for n in names] + [(f"{n}!", f"id-{n}") for n in ("a/b=c", "50% +x")])
    assert [r["fp"] for r in quarantine.collect()] == ['torn "1"']


def test_layers(spark, tmp_path):
    """Runs that overlap, characters of all planes, repeated text that packs well, and a file that breaks off in its middle."""
    overlapping = [(t, i / 3, -2.0, 50.0, 9.75) for i, t in enumerate(["e\u0301", "𐍈", "", "\t", "דג"])]
    rows = [("k", 0, overlapping), ("k", 3, [("lorem " * 4000, 0.0, 0.0, 0.0, 0.0)] * 2), ("m", 0, []), (None, 0, overlapping)]
    df = spark.createDataFrame(rows, "fp string, page_index int, runs array<struct<text:string,x:double,y:double,w:double,h:double>>")
    out = tmp_path / "l"
    T.write_layers(df.coalesce(1), str(out))
    whole = next(out.glob("part-*")).read_bytes()
    assert len(whole) < 2000
    (out / "part-cut.json.gz").write_bytes(whole[: len(whole) // 2])
    with gzip.open(out / "part-odd.json.gz", "wt") as f:
        f.write('[]\n{"fp": "q", "page_index": "first"}\n{"fp"\n')
    got = {(r["fp"], r["page_index"]): [tuple(x) for x in r["runs"]] for r in T.read_layers(spark, str(out)).where("page_index is not null").collect()}
    assert got == {(fp, page): runs for fp, page, runs in rows if fp is not None}


def test_postings_pruned(spark, tmp_path):
    posts = spark.createDataFrame([(t, "d", 0, 3, 1) for t in "abcdefgh"], "term string, fp string, page_index int, dl int, tf int")
    T.write_postings(posts, str(tmp_path / "p"))
    found = T.read_postings(spark, str(tmp_path / "p"), ["a", "c"])
    assert {r["term"] for r in found.collect()} == {"a", "c"} and T.read_postings(spark, str(tmp_path / "p")).count() == 8
    assert "PartitionFilters: [term_bucket" in found._jdf.queryExecution().toString()


def test_baseline(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"scan": {"P50_ms": 12.5, "P95_ms": 80}, "merge": {"P50_ms": 3}}')
    assert T.read_baseline(spark, str(tmp_path / "b.json")).orderBy("name").collect() == [("merge", 3.0, None), ("scan", 12.5, 80.0)]
    (tmp_path / "e.json").write_text("{}")
    with pytest.raises(ValueError):
        T.read_baseline(spark, str(tmp_path / "e.json"))


def test_index_stream_quarantine(spark, tmp_path):
    schema = "fp string, path string, text string, ts timestamp"
    docs = spark.createDataFrame([("A", "/A", "one\ntwo", None), (None, "/x", "lost", None), ("B", "/B", None, None)], schema)
    docs.write.parquet(str(tmp_path / "in"))
    store = StoredIndex(spark, str(tmp_path / "i"))
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    S.index_stream(source, store, str(tmp_path / "c"), str(tmp_path / "q"), availableNow=True).awaitTermination()
    assert sorted(r["text"] for r in store.pages().collect()) == ["one", "two"]
    assert spark.read.parquet(str(tmp_path / "q")).count() == 2


def test_streamed_index_equals_batch(spark, tmp_path):
    schema = "fp string, path string, text string, ts timestamp"
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store = StoredIndex(spark, str(tmp_path / "i"))
    for rows in ([("A", "/A", "one two\ntwo", None), ("B", "/B", "two three", None)], [("A", "/A", "four two", None), ("C", "/C", "", None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        S.index_stream(source, store, str(tmp_path / "c"), availableNow=True).awaitTermination()
    pages = spark.createDataFrame([("A", "/A", 0, "four two"), ("B", "/B", 0, "two three"), ("C", "/C", 0, "")], "fp string, path string, page_index int, text string")
    want = I.postings(I.with_tokens(pages), positions=True)
    assert sorted(map(str, store.postings().collect())) == sorted(map(str, want.collect()))


def test_janitor_stream(spark, tmp_path):
    folder = str(tmp_path / "s")
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema("key string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    spark.createDataFrame([("a", 40)], "key string, t long").select("key", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    S.janitor_stream(source, spark, str(tmp_path / "none"), str(tmp_path / "c0"), hard=250, availableNow=True).awaitTermination()
    assert S.latest_state(spark, str(tmp_path / "none")) is None  # no ledger, nothing to do
    rows = spark.createDataFrame([(k, 100, i, "d") for i, k in enumerate("abcd")], "key string, size long, t long, doc_fp string")
    rows.select("key", "size", F.timestamp_seconds("t").alias("last_access"), "doc_fp").write.parquet(f"{folder}/state=-1")
    for t in (50, 60, 70):
        spark.createDataFrame([("a", t), ("nope", t)], "key string, t long").select("key", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    S.janitor_stream(source, spark, folder, str(tmp_path / "c1"), hard=300, soft_percent=67, availableNow=True).awaitTermination()
    # 400 are over 300: the oldest go until 201 are left; 'a' was read last
    last = spark.read.parquet(S.latest_state(spark, folder))
    assert {r["key"]: r["last_access"].timestamp() for r in last.collect()}["a"] == 70 and {r["key"] for r in last.collect()} == {"a", "d"}
    assert len(list((tmp_path / "s").glob("state=*"))) == 2


def test_recents_stream_in_order(spark, tmp_path):
    """Steps come in any order; their times decide, and what the watermark has passed is only a list."""
    rng = random.Random(3)
    steps = [("w" if i % 3 else None, i, rng.choice(["add"] * 9 + ["remove"] * 3 + ["clear"]), rng.choice([f"p{j}" for j in range(28)] + ["P1", "P2", " ", None])) for i in range(600)]
    near = sorted(steps, key=lambda s: s[1] + rng.random() * 40)  # out of order by up to 40 seconds
    schema = "workspace string, seq long, op string, path string"
    (tmp_path / "in").mkdir()
    rows = lambda part: spark.createDataFrame(part, schema).withColumn("ts", F.expr("timestamp_seconds(seq div 2)"))
    got = {}

    def keep(batch, number):
        got.update({r["workspace"]: r["paths"] for r in batch.collect()})

    name, store = S.STATE_STORE
    before = spark.conf.get(name)
    spark.conf.set(name, store)
    try:
        # the last part comes too late and has no effect
        for part in [*(near[i : i + 150] for i in range(0, 600, 150)), [("w", 1, "clear", None), ("w", 2, "add", "late")]]:
            rows(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            source = spark.readStream.schema(schema + ", ts timestamp").parquet(str(tmp_path / "in"))
            S.recents_stream(source, time="ts", delay="25 seconds").writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    assert got == {w: R.replay_python([(op, p) for x, _, op, p in steps if x == w], []) for w in ("w", None)}
    waiting = spark.read.format("statestore").option("stateVarName", "waiting").load(str(tmp_path / "c"))
    assert 0 < waiting.count() < 200


def test_postings_tasks_follow_their_size(spark, tmp_path):
    """Few postings of a term are one file; how many tasks write a bucket is not fixed."""
    posts = spark.range(40).selectExpr("'a' AS term", "concat('d', id) AS fp", "0 AS page_index", "3 AS dl", "1 AS tf")
    T.write_postings(posts, str(tmp_path / "p"))
    assert len(list((tmp_path / "p").rglob("part-*.parquet"))) == 1
