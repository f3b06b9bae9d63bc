import datetime
import hashlib
import itertools

from pyspark.sql import functions as F

from lectern.functions import predicates as P
from lectern.functions import scalars as S
from lectern.functions import text as X


def one(spark, column, schema="x int", row=(1,)):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]


def test_tokens_fold_latin_only(spark):
    assert one(spark, X.tokenize(F.lit("Café résumé naïve, İstanbul ŁØß foo-bar_baz ёй 42"))) == ["cafe", "resume", "naive", "istanbul", "łøß", "foo", "bar", "baz", "ёй", "42"]
    assert X.literal_tokens("Café-Ё 1") == ["cafe", "ё", "1"]
    assert one(spark, X.tokenize(F.lit(""))) == []


def test_fingerprint(spark):
    content = b"x" * 70000
    want = hashlib.sha256(content[:65536] + b"|70000|5").hexdigest()
    assert one(spark, S.fingerprint(F.col("c"), F.length("c"), F.lit(5)), "c binary", (bytearray(content),)) == want
    assert one(spark, S.fingerprint(F.col("c"), F.length("c"), F.lit(6)), "c binary", (bytearray(content),)) != want


def test_fingerprint_query_of_long_texts(spark, tmp_path):
    from lectern.plans.queries import fingerprint

    texts = ["", "short", "x" * 65535, "x" * 65536, "x" * 65537, "x" * 65536 + "yz", "ä" * 40000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["fp"] for r in fingerprint(spark, str(tmp_path)).collect()}
    for k, t in enumerate(texts):
        b = t.encode()
        assert got[k] == hashlib.sha256(b[:65536] + f"|{len(b)}|{638396640000000000 + k}".encode()).hexdigest()


def test_cache_keys_and_flags(spark):
    assert one(spark, S.cache_key(F.lit("abc123"), F.lit(5), F.lit(2), F.lit(100), F.lit(1))) == "abc123_5_2_100_1.bin"
    assert one(spark, S.render_flags(F.lit(True), F.lit(1))) == 3
    assert one(spark, S.render_flags(F.lit(False), F.lit(2))) == 4
    zooms = {1.0: 100, 1.1: 100, 1.13: 125, 0.5: 50, 2.0: 200, 0.1: 0, 1.125: 100}
    assert {z: one(spark, S.zoom_bucket(F.lit(z))) for z in zooms} == zooms


def test_geometry(spark):
    for turns, want in {0: (595, 842), 2: (595, 842), 4: (595, 842), 1: (842, 595), 3: (842, 595), -1: (842, 595)}.items():
        w, h = S.rotate_size(F.lit(595), F.lit(842), F.lit(turns))
        assert (one(spark, w), one(spark, h)) == want
    assert one(spark, S.aspect_ratio(F.lit(5.0), F.lit(0))) == 0
    assert one(spark, S.pixel_size(F.lit(0.1), F.lit(1.0))) == 1
    assert one(spark, S.pixel_size(F.lit(7200.0), F.lit(1.0), F.lit(4000))) == 4000


def test_dates_and_ticks(spark):
    utc = datetime.datetime(2024, 2, 29)
    assert one(spark, S.parse_pdf_date(F.lit("D:20240229235900+02'00'")).cast("timestamp_ntz")) == utc
    for bad in ("D:20241301", "D:2024", "garbage!", "D:2024ab01"):
        assert one(spark, S.parse_pdf_date(F.lit(bad))) is None
    assert one(spark, S.ts_to_ticks(F.expr("timestamp'2024-01-01 00:00:00'"))) == 638396640000000000
    assert one(spark, S.ts_to_ticks(S.ticks_to_ts(F.lit(638396640000000019)))) == 638396640000000010


def test_metadata_and_paths(spark):
    m = one(spark, S.normalize_metadata(F.lit(" a "), F.lit(" \t"), F.lit(None).cast("string")))
    assert (m["title"], m["author"], m["subject"], m["custom"]) == (" a ", None, None, {})
    assert one(spark, S.path_key(F.lit("C:\\Docs\\.\\A.PDF"))) == "c:/docs/a.pdf"
    assert one(spark, S.path_key(F.lit("  "))) is None
    paths = {"/a/b/../c": "/a/c", "/../a": "/a", "a/../../b": "../b", "http://h/x/../Y/": "http://h/Y/", "/": "/", "/a/..": "/", "./a//b/": "a/b/", "..": "..", "\\\\srv\\x": "/srv/x", "a/.": "a", "a/..": "."}
    got = {p: one(spark, S.normal_path(F.lit(p))) for p in paths}
    assert got == paths


def test_paths_in_normal_form_stay(spark):
    """Every string of up to five characters: what is normal comes back as it is, the rest becomes normal."""
    every = ["".join(x) for n in range(1, 6) for x in itertools.product("a./\\:", repeat=n)]
    table = spark.createDataFrame([(p,) for p in every], "p string").repartition(4)
    rows = table.select("p", S.normal_path(F.col("p")).alias("once")).select("p", "once", S.normal_path(F.col("once")).alias("twice")).collect()
    assert all(r.once == r.twice for r in rows if "//" not in r.once)
    for r in rows:
        inner = r.p.split("/")[1:-1]
        if "\\" not in r.p and "" not in inner and not {".", ".."} & set(r.p.split("/")) and not r.p.startswith("//"):
            assert r.once == r.p


def test_occurrences(spark):
    count = lambda t, n: one(spark, X.occurrence_count(F.lit(t), n))
    assert count("foo bar foo baz foo qux", "foo") == 3
    assert count("The Quick Brown Fox", "FOX") == 1
    assert count("aaaa", "aa") == 2 and count("hello", "zzz") == 0 and count("1.2.3", ".") == 2
    assert one(spark, X.occurrence_starts(F.lit("x a.b A.B"), "a.b")) == [2, 6]
    assert one(spark, X.occurrence_starts(F.lit("nothing"), "zz")) == []
    text = "a" * 50 + "needle" + "b" * 50
    snippet = one(spark, X.substring_snippet(F.lit(text), F.lit(50), 6))
    assert snippet == "..." + "a" * 30 + "needle" + "b" * 30 + "..."
    assert one(spark, X.substring_snippet(F.lit("\n hit \r\n"), F.lit(2), 3)) == "hit"


def test_highlight(spark):
    text = " ".join(f"w{i}" for i in range(60)) + " PDFium, " + " ".join(f"v{i}" for i in range(60))
    got = one(spark, X.highlight_snippet(F.lit(text), ["pdfium"]))
    assert "[PDFium]," in got and got.startswith(" … ") and got.endswith(" … ")
    assert len(got.replace("…", "").split()) == 32
    assert one(spark, X.highlight_snippet(F.lit("Здесь живёт PDFium."), ["PDFium"])) == "Здесь живёт [PDFium]."
    assert one(spark, X.highlight_snippet(F.lit("no match here"), ["zz"])) == "no match here"


def test_predicates(spark):
    tokens = F.array(*[F.lit(t) for t in "the cat of the hat and the bat".split()])
    yes = lambda c: one(spark, c)
    assert yes(P.match_all(tokens, P.terms("The bat"))) and not yes(P.match_all(tokens, P.terms("the dog")))
    assert yes(P.match_any(tokens, [*P.terms("dog"), P.phrase("of the")])) and not yes(P.match_any(tokens, P.terms("dog")))
    assert yes(P.match_not(tokens, P.terms("the"), P.terms("dog"))) and not yes(P.match_not(tokens, P.terms("the"), P.terms("cat")))
    assert yes(P.match_phrase(tokens, "of the hat")) and not yes(P.match_phrase(tokens, "the of")) and not yes(P.match_phrase(F.array(F.lit("of")), "of the"))
    assert yes(P.match_prefix(tokens, "ba")) and not yes(P.match_prefix(tokens, "zz"))
    assert yes(P.match_first(tokens, "the")) and not yes(P.match_first(tokens, "cat"))
    assert yes(P.match_near(tokens, "cat bat", 5)) and not yes(P.match_near(tokens, "cat bat", 4))
    assert one(spark, P.Unit(("the",)).count(tokens)) == 3 and one(spark, P.phrase("a a").count(F.array(*[F.lit("a")] * 3))) == 2


def test_form_values(spark):
    old, new = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"))
    assert one(spark, S.merge_form_values(old, new)) == {"a": "1", "b": "3"}
    assert one(spark, X.dehyphenate(F.lit("hy-\nphen a-\n1"))) == "hyphen a-\n1"
