"""Annotations: change logs, rules by kind, and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "id string, page_index int, kind string, color_hex string, bounds struct<x:double,y:double,width:double,height:double>, text string, ink_points array<struct<x:double,y:double>>, created_at timestamp"


def well_formed() -> Column:
    """Highlights have bounds alone, sticky notes bounds and text, freehand strokes points alone."""
    box, words, ink = F.col("bounds").isNotNull(), F.col("text").isNotNull(), F.col("ink_points").isNotNull()
    return F.coalesce(
        F.when(F.col("kind") == "Highlight", box & ~words & ~ink).when(F.col("kind") == "StickyNote", box & words & ~ink).when(F.col("kind") == "Freehand", ink & ~box & ~words).otherwise(F.lit(False)), F.lit(False)
    )


def apply_changes(log: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(annotations (fp, seq, id, value), rejects) after a log (fp, seq, op, id, value).

    Adds after the last removeAll and without a later remove of their id are live, in the order of
    the adds; each has the value of its latest later update. An update or remove of an id that is
    not live then is rejected. Repeated adds of an id are separate annotations that share later
    changes. ``seq`` is unique in a document.
    """
    doc = Window.partitionBy("fp").orderBy("seq")
    one = Window.partitionBy("fp", "id").orderBy("seq")
    before, after = one.rowsBetween(Window.unboundedPreceding, -1), one.rowsBetween(1, Window.unboundedFollowing)
    upto = doc.rowsBetween(Window.unboundedPreceding, -1)
    cleared = F.max(F.when(F.col("op") == "removeAll", F.col("seq"))).over(doc.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    marked = log.withColumns({"_cleared": cleared, "_clear_before": F.max(F.when(F.col("op") == "removeAll", F.col("seq"))).over(upto)})
    never = F.lit(-(2**62))
    marked = marked.withColumns(
        {
            "_added": F.max(F.when(F.col("op") == "add", F.col("seq"))).over(before),
            "_gone": F.max(F.when(F.col("op") == "remove", F.col("seq"))).over(before),
            "_removed_later": F.max(F.when(F.col("op") == "remove", F.col("seq"))).over(after),
            "_updated": F.max(F.when(F.col("op") == "update", F.struct("seq", value))).over(after),
        }
    )
    live = marked.where((F.col("op") == "add") & (F.col("seq") > F.coalesce("_cleared", never)) & F.col("_removed_later").isNull())
    result = live.select("fp", "seq", "id", F.coalesce(F.col(f"_updated.{value}"), F.col(value)).alias(value))
    had = F.coalesce(F.col("_added"), never) > F.greatest(F.coalesce("_gone", never), F.coalesce("_clear_before", never))
    rejects = marked.where(F.col("op").isin("update", "remove") & ~had).select("fp", "seq", "op", "id")
    return result, rejects


def by_path(files: DataFrame, annotations: DataFrame) -> DataFrame:
    """Annotations of files (path, fp)."""
    return files.select("path", "fp").join(annotations, "fp")


def on_page(annotations: DataFrame, page: int) -> DataFrame:
    return annotations.where(F.col("page_index") == page)


def in_order(annotations: DataFrame, fp: str) -> DataFrame:
    return annotations.where(F.col("fp") == fp).orderBy("seq")
