"""Tables of the library: how they are written and read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.annotations import SCHEMA as ANNOTATION

SIDECAR = f"Version int, Annotations array<struct<{', '.join(x.replace(' ', ':', 1) for x in ('id string', 'page_index int', 'kind string', 'color_hex string'))}, bounds:struct<x:double,y:double,width:double,height:double>, text:string, ink_points:array<struct<x:double,y:double>>, created_at:timestamp>>, _corrupt string"
LAYER = "fp string, page_index int, runs array<struct<text:string,x:double,y:double,w:double,h:double>>, _corrupt string"
assert ANNOTATION.startswith("id string")


def write_annotations(annotations: DataFrame, folder: str) -> None:
    """One JSON line per document: {fp, Version, Annotations in order}; nulls are left out; the job's commit makes it whole or not at all.
    A task writes its documents to one file, so files do not grow in number with documents. A document's annotations are one
    line, so one document's must fit in a task."""
    fields = [c for c in ("id", "page_index", "kind", "color_hex", "bounds", "text", "ink_points", "created_at")]
    each = F.struct("seq", F.struct(*fields).alias("a"))
    docs = annotations.groupBy("fp").agg(F.transform(F.array_sort(F.collect_list(each)), lambda e: e["a"]).alias("Annotations"))
    docs.select("fp", F.lit(1).alias("Version"), "Annotations").write.mode("overwrite").json(folder)


def read_annotations(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(annotations (fp, seq, ...), quarantine (fp, line)): a damaged line gives no annotations and no error.

    A file may also be one document's own, in a folder ``fp=<name>``."""
    source = spark.read.schema(f"{SIDECAR}, fp string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    raw = source.option("recursiveFileLookup", "true").json(folder).withColumn("fp", F.coalesce("fp", _named_folder(F.col("_metadata.file_path"))))
    fine = raw.where("_corrupt is null").select("fp", F.posexplode("Annotations").alias("seq", "a")).select("fp", "seq", "a.*")
    told = F.get_json_object(F.concat(F.regexp_extract("_corrupt", r'^\{"fp":"(?:[^"\\]|\\.)*"', 0), F.lit("}")), "$.fp")  # the line may break off behind it
    return fine, raw.where("_corrupt is not null and coalesce(Version, 0) >= 0").select(F.coalesce("fp", told).alias("fp"), F.col("_corrupt").alias("line"))


def _named_folder(path: Column) -> Column:
    """The name in the path's folder ``fp=<name>``, if there is one; names are escaped in folders, and folders in paths."""
    name = F.nullif(F.regexp_extract(path, "/fp=([^/]+)/[^/]*$", 1), F.lit(""))
    for _ in range(2):
        name = F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)
    return F.nullif(name, F.lit("__HIVE_DEFAULT_PARTITION__"))


def write_layers(layers: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """Text layers (fp, page_index, runs) as gzip JSON."""
    layers.select("fp", "page_index", "runs").write.mode(mode).option("compression", "gzip").json(folder)


def read_layers(spark: SparkSession, folder: str) -> DataFrame:
    """Layers that can be read; damaged files and lines count as not there."""
    source = spark.read.schema(LAYER).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("ignoreCorruptFiles", "true")
    return source.json(folder).where("_corrupt is null and fp is not null").drop("_corrupt")


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_postings(posts: DataFrame, folder: str, buckets: int = 16) -> None:
    """Postings by bucket of the term, so that a lookup reads one folder. Buckets are split over tasks by their size (Spark's
    rebalancing), as frequent terms make some much larger than others; so a task's rows don't grow with the table."""
    rows = posts.withColumn("term_bucket", bucket_of(F.col("term"), buckets)).hint("rebalance", "term_bucket")
    rows.sortWithinPartitions("term_bucket", "term").write.mode("overwrite").partitionBy("term_bucket").parquet(folder)


def read_postings(spark: SparkSession, folder: str, terms: list[str] | None = None, buckets: int = 16) -> DataFrame:
    """Postings, of the named terms only if any are named: their buckets' folders alone are listed and read."""
    posts = spark.read.parquet(folder)
    if terms is None:
        return posts.drop("term_bucket")
    wanted = sorted({r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(bucket_of(F.col("t"), buckets)).collect()})
    return posts.where(F.col("term_bucket").isin(wanted) & F.col("term").isin(terms)).drop("term_bucket")


def write_ledger(ledger: DataFrame, folder: str) -> None:
    """Sorted by access inside ranges of it, so that row groups' statistics find the oldest ones; Bloom filters of the
    row groups find entries by key and by document."""
    writer = ledger.repartitionByRange("last_access", "key").sortWithinPartitions("last_access", "key").write.mode("overwrite")
    for name in ("key", "doc_fp"):
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
    writer.option("parquet.bloom.filter.adaptive.enabled", "true").parquet(folder)


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def ledger_entries(spark: SparkSession, folder: str, doc_fps: list[str]) -> DataFrame:
    """Entries of a few documents: row groups without them are not read."""
    test = F.lit(False)
    for fp in doc_fps:  # equality by equality, which is what Bloom filters answer
        test = test | (F.col("doc_fp") == fp)
    return read_ledger(spark, folder).where(test)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(name, p50_ms, p95_ms) of a JSON object by benchmark; an empty one is an error."""
    text = spark.read.option("wholetext", "true").text(path)
    rows = baseline_rows(text.select(F.from_json("value", "map<string,struct<P50_ms:double,P95_ms:double>>").alias("m")))
    if rows.limit(1).count() == 0:
        raise ValueError(f"no baseline in {path}")
    return rows


def baseline_rows(maps: DataFrame) -> DataFrame:
    return maps.select(F.explode("m").alias("name", "v")).select("name", F.col("v.P50_ms").alias("p50_ms"), F.col("v.P95_ms").alias("p95_ms"))


def write_recents(lists: DataFrame, folder: str) -> None:
    lists.select("workspace", "paths").write.mode("overwrite").parquet(folder)
