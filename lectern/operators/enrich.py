"""Cache-aside recognition: serve what the cache has, recognise only what is missing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.functions.scalars import OCR_FLAGS, OCR_ZOOM
from lectern.functions.text import let

KEY = ("fp", "page_index", "engine_version", "zoom_bucket", "flags")


@dataclass(frozen=True)
class Codec:
    """A caller's function from batches of rows to batches of rows. A new ``version`` invalidates what
    older ones have cached."""

    name: str
    version: int
    run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
    schema: StructType | str


REGISTRY: dict[str, Codec] = {}


def register(kind: str, codec: Codec) -> None:
    REGISTRY[kind] = codec


def requests_for(pages: DataFrame, version: int) -> DataFrame:
    """Recognition requests of pages: their key has its own zoom and flags, so it never meets a rendered page's."""
    return pages.withColumns({"engine_version": F.lit(version), "zoom_bucket": F.lit(OCR_ZOOM), "flags": F.lit(OCR_FLAGS)})


def hits(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Cached rows that are asked for."""
    return cache.join(requests.select(*KEY).distinct(), list(KEY), "left_semi")


def misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests without a cached row."""
    return requests.join(cache.select(*KEY).distinct(), list(KEY), "left_anti")


def enrich(requests: DataFrame, cache: DataFrame, codec: Codec) -> tuple[DataFrame, DataFrame]:
    """(all layers asked for, the newly recognised ones, which are to be appended to the cache)."""
    new = misses(requests, cache).mapInPandas(codec.run, codec.schema)
    return hits(requests, cache).unionByName(new.select(*cache.columns)), new


def extract(files: DataFrame, kind_col: str = "kind") -> DataFrame:
    """Page layers of files by the codec registered for their kind; kinds without a codec give none."""
    parts = [files.where(F.col(kind_col) == kind).mapInPandas(c.run, c.schema) for kind, c in sorted(REGISTRY.items())]
    if not parts:
        raise ValueError("no extractor is registered")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def error_rate(pairs: DataFrame, by: str) -> DataFrame:
    """Character error rate of (by, expected, recognised): edits per expected character."""
    left, right = F.coalesce("expected", F.lit("")), F.coalesce("recognised", F.lit(""))
    # the difference in length is the least number of edits; a band of that width is tried before wider ones, and at last all
    least = F.abs(F.length(left) - F.length(right))
    within = lambda most: let(F.call_function("levenshtein", left, right, most), lambda n: F.when(n >= 0, n))
    edits = F.coalesce(within(least), within(2 * least + 16), F.levenshtein(left, right))
    return pairs.groupBy(by).agg((F.sum(edits) / F.greatest(F.sum(F.length(left)), F.lit(1))).alias("cer"), F.count(F.lit(1)).alias("pages"))
