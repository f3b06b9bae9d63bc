"""Mixing sources to target weights, in DataFrame functions only.

Sources in code-point order (null last) weigh 5, 2, 1, repeating. Together they are to give
``share`` times all words; a source gives at most ``most`` times its own words, and what is cut
off there is shared again by weight among the others. Within a source, documents get
hash-random keys; keys are cut into ranges of some ``per_range`` documents, so that each
(source, range) is small whatever the source's size, ranges are sorted on their own, and prefix
sums of ranges and of rows inside a range give each document's place. Whole epochs are taken
first; in the last one the documents up to the budget are taken, and of the one across the cut
the words up to it, so that a source gives its target to the word.

Defined cases: null text has size 0 and takes 0; a null source is a source of its own; a source
without words has target 0; repeated rows are documents of their own (equal keys are ordered by
size, equal rows are interchangeable); an empty table gives an empty result; extra columns are
ignored. Rows without an id, or that repeat one, are told apart by their text; only rows that are equal
in both lie next to each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import cut, words_of

#: Weights of sources in order, repeating (fixed by the contract).
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) of a table (source, size)."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row per source by now; utf-8 bytes sort as code points
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (place % len(WEIGHTS) + 1).cast("int"))
    per = cut(per.withColumn("weight", weight).withColumn("top", F.col("source_size") * F.lit(float(most))))
    level, full = None, F.lit(False)
    while True:  # each turn caps one more source at least, or ends
        row = per.agg(
            F.sum("source_size").alias("words"), F.sum(F.when(full, F.col("top")).otherwise(0.0)).alias("given"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weights"), F.count(F.when(full, 1)).alias("n")
        ).first()
        if not row["words"] or not row["weights"]:
            level = float("inf") if row["words"] else 0.0
            break
        new = max(0.0, share * row["words"] - row["given"]) / row["weights"]
        if level is not None and new <= level:
            break
        level = new
        full = F.col("weight") * F.lit(level) >= F.col("top")
        if per.filter(full).count() == row["n"]:
            break
    return per.select("source", "source_size", F.least(F.col("weight") * F.lit(level), F.col("top")).alias("target"))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, seed: int = 42, per_range: int = 2_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, taken) of every row.

    ``taken`` is the number of words the mix takes of the document, repeats counted.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size"), F.xxhash64(text_col).alias("content"))
    slim = cut(slim)
    per = source_targets(slim, share, most)
    rows = slim.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
    per = cut(per.join(rows, per["source"].eqNullSafe(rows["source"])).select(per["source"], "source_size", "target", F.ceil(F.col("rows") / per_range).alias("ranges")))
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("content"))  # a repeated or null id is no hot range
    keyed = slim.join(per, slim["source"].eqNullSafe(per["source"])).select("doc_id", slim["source"], "size", "source_size", "target", "ranges", key.alias("key"))
    # keys are uniform over the 64-bit range: the upper bits name the range, in key order
    keyed = keyed.withColumn("range", F.floor((F.shiftright("key", 32) + F.lit(2**31)) * F.col("ranges") / F.lit(2**32)).cast("long"))
    sums = keyed.groupBy("source", "range").agg(F.sum("size").alias("in_range"))
    before = F.coalesce(F.sum("in_range").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(F.col("source").alias("o_source"), F.col("range").alias("o_range"), before.alias("offset"))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("source", "range").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = keyed.withColumn("inside", inside).join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("range") == F.col("o_range")))
    start = F.col("offset") + F.col("inside")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.floor(F.col("target") - epochs * F.col("source_size")).cast("long")
    taken = epochs * F.col("size") + F.least(F.greatest(rest - start, F.lit(0)), F.col("size"))
    return placed.select(F.col("doc_id").alias(id_col), F.col("source"), "size", "source_size", "target", taken.alias("taken"))
