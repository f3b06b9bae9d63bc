"""Ranked and literal search, one query or many at once.

Ranks are BM25 (k1 = 1.2, b = 0.75), lower is better; the inverse document frequency is floored at
1e-6, and statistics cover all pages whatever the query is restricted to. Ties go by document
and page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.predicates import Unit, match_all, match_any, real_query
from lectern.functions.text import any_case, occurrence_starts, substring_snippet

#: Fixed values of the ranking function.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6


def idf(n_pages: Column, df: Column) -> Column:
    return F.greatest(F.log((n_pages - df + 0.5) / (df + 0.5)), F.lit(IDF_FLOOR))


def weight(idf_value: Column, tf: Column, dl: Column, avgdl: Column) -> Column:
    """One unit's share of a page's rank, before its sign is turned."""
    return idf_value * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def search_ranked(pages: DataFrame, units: list[Unit], k: int = 100, fp: str | None = None, any_unit: bool = False) -> DataFrame:
    """(fp, path, page_index, rank) of the k best pages (with tokens and dl) that match the units."""
    if not units or k <= 0:
        return pages.select("fp", "path", "page_index", F.lit(0.0).alias("rank")).limit(0)
    counts = [u.count(F.col("tokens")) for u in units]
    stats = pages.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.count(F.when(c > 0, 1)).alias(f"df{i}") for i, c in enumerate(counts)])).scalar()
    matched = pages.where((match_any if any_unit else match_all)(F.col("tokens"), units))
    if fp is not None:
        matched = matched.where(F.col("fp") == fp)
    counted = matched.select("fp", "path", "page_index", "dl", *[c.alias(f"tf{i}") for i, c in enumerate(counts)], stats.alias("s"))
    rank = F.lit(0.0)
    for i in range(len(units)):
        rank = rank - weight(idf(F.col("s.n"), F.col(f"s.df{i}")), F.col(f"tf{i}"), F.col("dl"), F.col("s.avgdl"))
    return counted.select("fp", "path", "page_index", rank.alias("rank")).orderBy("rank", "fp", "page_index").limit(k)


def query_terms(queries: DataFrame, tokens: Column) -> DataFrame:
    """(query_id, term, times, n_terms, k) of a table (query_id, text, max_results), one row per distinct term."""
    asked = queries.where(real_query(F.col("text"), F.col("max_results"))).select("query_id", "max_results", tokens.alias("t"))
    each = asked.select("query_id", F.col("max_results").alias("k"), F.size(F.array_distinct("t")).alias("n_terms"), F.explode("t").alias("term"))
    return each.groupBy("query_id", "term", "n_terms", "k").agg(F.count(F.lit(1)).alias("times"))


def score_batch(posts: DataFrame, stats: DataFrame, asked: DataFrame, n_pages: Column, avgdl: Column) -> DataFrame:
    """(query_id, fp, page_index, k, rank) of every page that has all terms of a query.

    ``stats`` (term, df) joins to the queries' terms before these meet the postings, so only
    asked terms travel; which side is broadcast is left to the sizes that Spark sees.
    """
    weighted = asked.join(stats.select("term", "df"), "term").withColumn("idf", idf(n_pages, F.col("df")) * F.col("times"))
    hits = posts.join(weighted, "term")
    part = weight(F.col("idf"), F.col("tf"), F.col("dl"), avgdl)
    found = hits.groupBy("query_id", "fp", "page_index", "n_terms", "k").agg((-F.sum(part)).alias("rank"), F.count(F.lit(1)).alias("met"))
    return found.where("met = n_terms").select("query_id", "fp", "page_index", "k", "rank")


def top_hits(scored: DataFrame) -> DataFrame:
    """The k best hits of each query, numbered from 1 in ``place``."""
    order = Window.partitionBy("query_id").orderBy("rank", "fp", "page_index")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.col("k"))


def search_batch(pages: DataFrame, posts: DataFrame, stats: DataFrame, queries: DataFrame, tokens: Column) -> DataFrame:
    """(query_id, place, fp, page_index, rank) of a whole table of queries in one pass."""
    whole = pages.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))).scalar()
    scored = score_batch(posts, stats, query_terms(queries, tokens), whole["n"], whole["avgdl"])
    return top_hits(scored).select("query_id", "place", "fp", "page_index", "rank")


def with_document(hits: DataFrame, reg: DataFrame) -> DataFrame:
    """Paths of hits: joined after the top k, so that few rows travel."""
    return hits.join(reg.select("fp", "path"), "fp")


def search_substring(pages: DataFrame, needle: str, k: int = 100) -> DataFrame:
    """(fp, page_index, pos, snippet, rank) of the first k occurrences in each document, by page and place."""
    if not needle.strip() or k <= 0:
        return pages.select("fp", "page_index", F.lit(0).alias("pos"), F.lit("").alias("snippet"), F.lit(1.0).alias("rank")).limit(0)
    found = pages.where(F.col("text").rlike(any_case(needle))).select("fp", "page_index", "text", F.explode(occurrence_starts(F.col("text"), needle)).alias("pos"))
    order = Window.partitionBy("fp").orderBy("page_index", "pos")
    first = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return first.select("fp", "page_index", "pos", substring_snippet(F.col("text"), F.col("pos"), len(needle)).alias("snippet"), F.lit(1.0).alias("rank"))


def find_and_redact(pages: DataFrame, needle: str, mark: str = "█") -> DataFrame:
    """Pages with the needle's occurrences replaced, and how many there were."""
    pattern = any_case(needle)
    n = F.size(F.split("text", pattern, -1)) - 1
    return pages.withColumn("n_redacted", F.coalesce(n, F.lit(0)).cast("long")).withColumn("text", F.regexp_replace("text", pattern, mark * len(needle)))
