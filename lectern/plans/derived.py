"""The library's tables, derived from the given ones: in Spark, and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.index import page_layers, with_tokens


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def micros(name: str):
    """Microseconds since 1970 of a timestamp without a zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {name})")


def doc_fp():
    return F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))


def doc_path():
    return F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """(fp, path) of the documents that have pages."""
    return table(spark, sf, "documents").where("text is not null").select(doc_fp().alias("fp"), doc_path().alias("path")).distinct()


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """Each line of a document is a page."""
    docs = table(spark, sf, "documents")
    return page_layers(docs, doc_fp(), F.col("text"), doc_path())


def token_pages(spark: SparkSession, sf: str) -> DataFrame:
    return with_tokens(pages(spark, sf))


def query_table(spark: SparkSession, sf: str, k: int = 10) -> DataFrame:
    """Each benchmark item asks for its first two words."""
    words = F.slice(F.split("text", r"\s+"), 1, 2)
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(words, " ").alias("text"), F.lit(k).alias("max_results"))


def entries(spark: SparkSession, sf: str) -> DataFrame:
    """One cache entry per event."""
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").cast("string").alias("key"), F.round(F.col("value") * 100).cast("long").alias("size"), F.col("ts").alias("last_access"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("doc_fp"))


def keyed_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Events as writes to a user's entry of their type."""
    e = table(spark, sf, "events")
    return e.select(F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("key"), F.round(F.col("value") * 100).cast("long").alias("size"), F.col("ts").alias("last_access"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("doc_fp"))


#: The month of the events is cut here into what was before and what comes new.
MIDDLE = "2024-01-16 00:00:00"


def annotation_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as changes: seq = event_id, id = k of the properties, op by event type."""
    e = table(spark, sf, "events")
    types = F.when(F.col("event_type") == "error", "removeAll").when(F.col("event_type") == "click", "update").when(F.col("event_type") == "purchase", "remove").otherwise("add")
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("fp"), F.col("event_id").alias("seq"), types.alias("op"), F.get_json_object("props", "$.k").alias("id"), F.col("value").alias("value"))


def recents_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as steps of a user's recent list; odd events write the path in upper case."""
    e = table(spark, sf, "events")
    way = F.when(F.col("event_id") % 5 == 0, "/doc/./x/../").otherwise("/doc/")  # the same path, written in another way
    path = F.concat(way, F.get_json_object("props", "$.k"), F.lit(".pdf"))
    op = F.when(F.col("event_type") == "purchase", "remove").when((F.col("event_type") == "error") & (F.col("value") > 20), "clear").otherwise("add")
    return e.select(F.col("user_id").alias("workspace"), F.col("event_id").alias("seq"), op.alias("op"), F.when(F.col("event_id") % 2 == 1, F.upper(path)).otherwise(path).alias("path"))


PAGES_SQL = """pages AS (
  SELECT fp, path, i - 1 AS page_index, lines[i] AS text FROM (
    SELECT fp, path, lines, unnest(range(1, len(lines) + 1)) AS i FROM (
      SELECT 'doc-' || doc_id AS fp, '/' || source || '/' || doc_id AS path, string_split(text, chr(10)) AS lines
      FROM documents WHERE text IS NOT NULL)))"""
TOKENS_SQL = PAGES_SQL + r""", toks AS (
  SELECT fp, path, page_index, text, tokens, len(tokens) AS dl FROM (
    SELECT *, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') AS tokens FROM pages))"""
POSTS_SQL = TOKENS_SQL + """, posts AS (
  SELECT term, fp, page_index, dl, count(*) AS tf FROM (SELECT fp, page_index, dl, unnest(tokens) AS term FROM toks) GROUP BY ALL)"""
QUERY_SQL = r"""asked AS (
  SELECT query_id, term, n_terms, 10 AS k, count(*) AS times FROM (
    SELECT query_id, unnest(t) AS term, len(list_distinct(t)) AS n_terms FROM (
      SELECT item_id AS query_id, regexp_extract_all(lower(strip_accents(array_to_string(list_slice(regexp_split_to_array(text, '\s+'), 1, 2), ' '))), '[\p{L}\p{N}]+') AS t FROM benchmark)) GROUP BY ALL)"""
SCORED_SQL = POSTS_SQL + ", " + QUERY_SQL + """, whole AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM toks),
 stats AS (SELECT term, count(*) AS df FROM posts GROUP BY term),
 weighted AS (SELECT a.*, greatest(ln((w.n - s.df + 0.5) / (s.df + 0.5)), 1e-6) * a.times AS idf, w.avgdl FROM asked a JOIN stats s USING (term), whole w),
 scored AS (SELECT query_id, fp, page_index, k, -sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS rank
   FROM posts JOIN weighted USING (term) GROUP BY query_id, fp, page_index, k, n_terms HAVING count(*) = n_terms)"""
ENTRIES_SQL = "entries AS (SELECT CAST(event_id AS VARCHAR) AS key, CAST(round(value * 100) AS BIGINT) AS size, ts AS last_access, 'u' || user_id AS doc_fp FROM events)"
KEYED_SQL = """keyed AS (SELECT user_id || '-' || event_type AS key, CAST(round(value * 100) AS BIGINT) AS size, ts AS last_access, 'u' || user_id AS doc_fp FROM events)"""
RECENTS_SQL = """log AS (SELECT user_id AS workspace, event_id AS seq,
   CASE WHEN event_type = 'purchase' THEN 'remove' WHEN event_type = 'error' AND value > 20 THEN 'clear' ELSE 'add' END AS op,
   CASE WHEN event_id % 2 = 1 THEN upper('/doc/' || (props::JSON->>'k') || '.pdf') ELSE '/doc/' || (props::JSON->>'k') || '.pdf' END AS path FROM events)"""
CHANGES_SQL = """log AS (SELECT 'u' || user_id AS fp, event_id AS seq,
   CASE event_type WHEN 'error' THEN 'removeAll' WHEN 'click' THEN 'update' WHEN 'purchase' THEN 'remove' ELSE 'add' END AS op,
   props::JSON->>'k' AS id, value FROM events)"""
SPOTS_SQL = "spots AS (SELECT fp, page_index, dl, tokens[i] AS term, i AS pos FROM (SELECT fp, page_index, dl, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM toks))"
#: The queries' words as tokens, each with an operator by its number.
OPS_SQL = r"""asked AS (SELECT query_id, op, single, against, CASE WHEN op = 'near' THEN list_distinct(t) ELSE t END AS t FROM (
   SELECT query_id, op, CASE WHEN query_id % 12 = 1 THEN 'doc-1' END AS single, CASE WHEN query_id % 12 = 0 THEN 'the' END AS against, regexp_extract_all(lower(strip_accents(CASE op WHEN 'prefix' THEN concat_ws(' ', w[1], substr(w[2], 1, 2)) WHEN 'first' THEN w[1] ELSE concat_ws(' ', w[1], w[2]) END)), '[\p{L}\p{N}]+') AS t
   FROM (SELECT item_id AS query_id, ['all', 'any', 'phrase', 'prefix', 'near', 'first'][item_id % 6 + 1] AS op, regexp_split_to_array(text, '\s+') AS w FROM benchmark)) WHERE len(t) > 0)"""
