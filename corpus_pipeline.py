"""A training-data pipeline over ``documents``: each stage applies one operator of ``lectern.llm``.

toxicity (1): documents scored at 0.3 or more go. near duplicates (4): of each component of linked
documents (five-word shingles, Jaccard 0.8) the one with the smallest id stays. pii (9): personal
data is replaced by its kind. mixing (7): documents are kept or repeated as the mix takes them (one
that the cut runs through stays whole). pieces (5): what is left is encoded and decoded.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again for the next. All but the last return the columns of ``docs``, extra ones included. Documents
are told apart by id and text together: rows that repeat an id with other texts are documents of
their own, rows that repeat both are copies, of which near duplicates keep one. Rows without a
doc_id take part (a document with an id stays rather than one without); those without words are
linked with nothing and stay. Of equally small ids in a component one text stays, always the same. Texts of
any length are read whole; an empty table passes through all stages empty. A table without
``n_chars`` gets none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import WORD, cut, table
from lectern.llm.jaccard import linked_components
from lectern.llm.mixing import mix
from lectern.llm.pieces import piece_digests
from lectern.llm.pii import redact
from lectern.llm.toxicity import fit, score_toxicity


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    name = _free(docs, "toxicity")
    return score_toxicity(docs, model, keep=tuple(docs.columns), out_col=name).where(F.col(name) < 0.3).select(*docs.columns)


def _named(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the column ``name``: a number of the document, made from its id and its text."""
    return docs.withColumn(name, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ident, first, place = _free(docs, "ident"), _free(docs, "first_id"), _free(docs, "place")
    wordless = F.col("doc_id").isNull() & ~F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(WORD)
    told = _named(docs.where(~wordless), ident)
    found = linked_components(told, words=5, percent=80, id_col=ident).groupBy(ident).agg(F.min("component_id").alias("part"))
    # the smallest id of each component stays, one without an id only where there is no other
    ids = told.groupBy(ident).agg(F.min(F.col("doc_id").cast("long")).alias("least"))
    order = F.struct(F.col("least").isNull(), "least", F.col(ident))
    stay = found.join(ids, ident).groupBy("part").agg(F.min_by(ident, order).alias(first)).select(first)
    kept = told.join(stay, F.col(ident) == F.col(first), "left_semi")
    # rows that repeat an id and its text are copies of one document
    order = Window.partitionBy(ident).orderBy(F.xxhash64(*docs.columns))
    kept = kept.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1)
    return kept.select(*docs.columns).unionByName(docs.where(wordless))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ident, mixed, times, turn = _free(docs, "ident"), _free(docs, "mixed_id"), _free(docs, "times"), _free(docs, "turn")
    told = _named(docs, ident)
    taken = mix(told, id_col=ident).where("taken > 0").groupBy(F.col(ident).alias(mixed)).agg(F.max(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias(times))
    both = told.join(taken, F.col(ident) == F.col(mixed))
    return both.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("pii", pii), ("mixing", mixing), ("pieces", pieces)]

#: SQL can't express the trained classifier or the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
