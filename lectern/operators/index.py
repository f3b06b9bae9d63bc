"""Pages, postings and statistics of a corpus, and changes to its index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import tokenize

#: Tokens that a task holds as numbers at once, if no page alone has more.
CHUNK = 1 << 19


def page_layers(docs: DataFrame, fp: Column, text: Column, path: Column, sep: str = "\n") -> DataFrame:
    """One row per page of text documents: (fp, path, page_index, text). Null texts have no pages."""
    return docs.where(text.isNotNull()).select(fp.alias("fp"), path.alias("path"), F.posexplode(F.split(text, sep, -1)).alias("page_index", "text"))


def with_tokens(pages: DataFrame) -> DataFrame:
    """Pages with their tokens and length; null layers are dropped, empty ones stay."""
    return pages.where(F.col("text").isNotNull()).withColumn("tokens", tokenize(F.col("text"))).withColumn("dl", F.size("tokens"))


def slices(batch: pa.RecordBatch, name: str = "tokens") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of a batch of about ``CHUNK`` tokens, with each row's number of them."""
    sizes = pc.fill_null(pc.list_value_length(batch[name]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // CHUNK
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
    for s, e in zip(edges[:-1], edges[1:], strict=True):
        if e > s:
            yield batch.slice(s, e - s), sizes[s:e]


def _met(b: pa.RecordBatch, sizes: np.ndarray, asked: tuple[pa.Array, list[pa.Array]] | None, positions: bool) -> tuple[np.ndarray, np.ndarray, pa.Array, dict[str, pa.Array]]:
    """(each posting's row, in order; its word's number; the words; tf and positions of each) of a part's pages; of the asked words and
    beginnings of words only, if any are given."""
    coded = b["tokens"].flatten().dictionary_encode()
    row, code, words = np.repeat(np.arange(b.num_rows), sizes), coded.indices.to_numpy(), coded.dictionary
    at = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes) if positions else None
    if asked is not None:
        there = pc.is_in(words, asked[0])
        for starts in asked[1]:  # of one length each
            there = pc.or_(there, pc.is_in(pc.utf8_slice_codeunits(words, 0, pc.utf8_length(starts[0]).as_py()), starts))
        picked = np.flatnonzero(there.to_numpy(zero_copy_only=False)[code])
        row, code, at = row[picked], code[picked], at[picked] if positions else None
    n = len(code)
    key = row * len(words) + code
    order = np.argsort(key, kind="stable")
    key = key[order]
    edges = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), n) if n else np.zeros(1, np.int64)
    first = order[edges[:-1]]
    out = {"tf": pa.array(np.diff(edges).astype(np.int32))}
    if positions:
        out["positions"] = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(at[order].astype(np.int32)))
    return row[first], code[first], words, out


def postings(pages: DataFrame, positions: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(term, fp, page_index, dl, tf[, positions]) of pages with tokens, and the columns ``keep`` of the page.

    No shuffle: a page's tokens lie in one row. A part of a batch is numbered and sorted at once."""
    names = ["fp", "page_index", "dl", *keep]
    slim = pages.select(*names, "tokens")
    fields = [slim.schema[n] for n in names]
    more = [T.StructField("positions", T.ArrayType(T.IntegerType()))] if positions else []
    schema = T.StructType([T.StructField("term", T.StringType()), *fields[:3], T.StructField("tf", T.IntegerType()), *more, *fields[3:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, sizes in slices(batch):
                row, code, words, out = _met(b, sizes, None, positions)
                out |= {c: b[c].take(pa.array(row)) for c in names} | {"term": words.take(pa.array(code))}
                yield pa.RecordBatch.from_arrays([out[f.name] for f in schema], [f.name for f in schema])

    return slim.mapInArrow(run, schema)


def posting_lists(pages: DataFrame, span: int) -> DataFrame:
    """(term, part, places, sizes, tfs, positions) of pages (number, size, tokens): a word's pages in a part of a batch, in one row for each
    ``part`` of ``span`` numbers. No shuffle."""
    slim = pages.select("number", "size", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, sizes in slices(batch):
                row, code, words, out = _met(b, sizes, None, True)
                order = np.argsort(code, kind="stable")
                word, row = code[order], row[order]
                part, place = np.divmod(b["number"].to_numpy()[row], span)
                cuts = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (part[1:] != part[:-1]))) if len(row) else np.zeros(0, np.int64)
                edges, order = pa.array(np.append(cuts, len(row)).astype(np.int32)), pa.array(order)
                listed = lambda values: pa.ListArray.from_arrays(edges, values)  # noqa: B023, E731
                values = [words.take(pa.array(word[cuts])), pa.array(part[cuts]), listed(pa.array(place.astype(np.int16))), listed(b["size"].take(pa.array(row))), listed(out["tf"].take(order)), listed(out["positions"].take(order))]
                yield pa.RecordBatch.from_arrays(values, ["term", "part", "places", "sizes", "tfs", "positions"])

    return slim.mapInArrow(run, "term string, part long, places array<smallint>, sizes array<smallint>, tfs array<int>, positions array<array<int>>")


def page_entries(pages: DataFrame, words: list[str] | None = None, starts: list[str] = (), positions: bool = False) -> DataFrame:
    """(fp, page_index, dl, entries (term, tf[, positions])) of pages with tokens: the postings of a page in its row, of the given words and
    of those that begin as ``starts`` say only, if words are given. No shuffle, and all pages stay."""
    slim = pages.select("fp", "page_index", "dl", "tokens")
    kinds = "term:string,tf:int" + (",positions:array<int>" if positions else "")
    lengths: dict[int, list[str]] = {}
    for s in starts:
        lengths.setdefault(len(s), []).append(s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = None if words is None else (pa.array(words, pa.string()), [pa.array(x, pa.string()) for x in lengths.values()])
        for batch in batches:
            for b, sizes in slices(batch):
                row, code, found, out = _met(b, sizes, asked, positions)
                out = {"term": found.take(pa.array(code))} | out
                edges = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
                entries = pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays(list(out.values()), list(out)))
                yield pa.RecordBatch.from_arrays([b["fp"], b["page_index"], b["dl"], entries], ["fp", "page_index", "dl", "entries"])

    return slim.mapInArrow(run, f"fp string, page_index int, dl int, entries array<struct<{kinds}>>")


def forward_index(rows: DataFrame) -> DataFrame:
    """(fp, path, named, page_count, n_tokens, terms (term, df, cf)) of rows (fp, path, named, tokens); a row without tokens is no page.

    A document's rows come together once, and its words are counted where they are. What is held of the
    document that the next batch goes on with is its vocabulary."""
    schema = "fp string, path string, named boolean, page_count long, n_tokens long, terms array<struct<term:string,df:bigint,cf:bigint>>"

    def made(fp, path, named, page_count, n_tokens, edges, term, df, cf) -> pa.RecordBatch:
        terms = pa.ListArray.from_arrays(pa.array(np.asarray(edges, np.int32)), pa.StructArray.from_arrays([term, pa.array(df, pa.int64()), pa.array(cf, pa.int64())], ["term", "df", "cf"]))
        values = [pa.array(fp, pa.string()), pa.array(path, pa.string()), pa.array(named, pa.bool_()), pa.array(page_count, pa.int64()), pa.array(n_tokens, pa.int64()), terms]
        return pa.RecordBatch.from_arrays(values, ["fp", "path", "named", "page_count", "n_tokens", "terms"])

    def counted(b: pa.RecordBatch, sizes: np.ndarray) -> pa.RecordBatch:
        """The part's documents, each a run of rows."""
        docs = b["fp"].dictionary_encode()
        doc, n_docs = docs.indices.to_numpy().astype(np.int64), len(docs.dictionary)
        coded = b["tokens"].flatten().dictionary_encode()
        n_terms, code = max(1, len(coded.dictionary)), coded.indices.to_numpy()
        row = np.repeat(np.arange(b.num_rows), sizes)
        pair, often = np.unique(row * n_terms + code, return_counts=True)
        key, place = np.unique(doc[pair // n_terms] * n_terms + pair % n_terms, return_inverse=True)
        df, cf = np.bincount(place, minlength=len(key)), np.bincount(place, often, len(key)).astype(np.int64)
        page = b["tokens"].is_valid().to_numpy(zero_copy_only=False)
        named, paths = b["named"].to_numpy(zero_copy_only=False).astype(bool), [None] * n_docs
        for k in np.flatnonzero(named):
            paths[doc[k]] = b["path"][int(k)].as_py()
        total = lambda w: np.bincount(doc, w, n_docs).astype(np.int64)
        return made(docs.dictionary, paths, total(named) > 0, total(page), total(sizes), np.searchsorted(key, np.arange(n_docs + 1) * n_terms), coded.dictionary.take(pa.array(key % n_terms)), df, cf)

    def joined(a: pa.RecordBatch, b: pa.RecordBatch) -> pa.RecordBatch:
        """Two parts of one document."""
        both = pa.concat_arrays([a["terms"].flatten(), b["terms"].flatten()])
        coded = both.field("term").dictionary_encode()
        code, n = coded.indices.to_numpy(), len(coded.dictionary)
        total = lambda name: np.bincount(code, both.field(name).to_numpy(), n).astype(np.int64)
        x, y = ({c: r[c][0].as_py() for c in ("fp", "path", "named", "page_count", "n_tokens")} for r in (a, b))
        source = x if x["named"] else y
        return made([x["fp"]], [source["path"]], [x["named"] or y["named"]], [x["page_count"] + y["page_count"]], [x["n_tokens"] + y["n_tokens"]], [0, n], coded.dictionary, total("df"), total("cf"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for b, sizes in slices(batch):
                part = counted(b, sizes)
                if held is not None and held["fp"][0] == part["fp"][0]:
                    held, part = joined(held, part.slice(0, 1)), part.slice(1)
                if part.num_rows:
                    if held is not None:
                        yield held
                    if part.num_rows > 1:
                        yield part.slice(0, part.num_rows - 1)
                    held = part.slice(part.num_rows - 1)
        if held is not None:
            yield held

    return rows.select("fp", "path", "named", "tokens").mapInArrow(run, schema)


def totals(pages: DataFrame) -> DataFrame:
    """One row: number of pages, tokens, and mean length, over all pages, empty ones included."""
    return pages.agg(F.count(F.lit(1)).alias("n_pages"), F.coalesce(F.sum("dl"), F.lit(0)).alias("n_tokens"), F.avg("dl").alias("avgdl"))


def term_stats(posts: DataFrame) -> DataFrame:
    """(term, df, cf): pages with the term, and its occurrences."""
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def corpus_stats(pages: DataFrame) -> DataFrame:
    """(term, df, cf, n_pages, avgdl) of pages (text) in one pass: each token counts for cf, each distinct token of a page
    for df, and each page gives one row of its own. No positions, and partial sums before the shuffle."""
    row = lambda kind, term, df, cf: F.struct(F.lit(kind).alias("kind"), term.alias("term"), df.cast("long").alias("df"), cf.cast("long").alias("cf"))
    one, zero, none = F.lit(1), F.lit(0), F.lit(None).cast("string")
    tokens = F.col("tokens")
    rows = F.concat(F.array(row(0, none, one, F.size(tokens))), F.transform(tokens, lambda t: row(1, t, zero, one)), F.transform(F.array_distinct(tokens), lambda t: row(1, t, one, zero)))
    counts = with_tokens(pages).select(F.inline(rows)).groupBy("term").agg(F.max("kind").alias("kind"), F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    # told apart by a sum, not by the key: so both readings share one shuffle
    whole = counts.where("kind = 0").select(F.struct(F.col("df").alias("n_pages"), (F.col("cf") / F.col("df")).alias("avgdl"))).scalar()
    return counts.where("kind = 1").select("term", "df", "cf", whole["n_pages"].alias("n_pages"), whole["avgdl"].alias("avgdl"))


def updated_stats(stats: DataFrame, gone: DataFrame, new: DataFrame) -> DataFrame:
    """(term, df, cf) after the postings ``gone`` are replaced by ``new``: only touched documents' postings are counted."""
    parts = [stats.select("term", "df", "cf")]
    for posts, sign in ((gone, -1), (new, 1)):
        parts.append(posts.groupBy("term").agg((sign * F.count(F.lit(1))).alias("df"), (sign * F.sum("tf")).alias("cf")))
    both = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    return both.where("df > 0")


def updated_totals(whole: DataFrame, gone: DataFrame, new: DataFrame) -> DataFrame:
    """The totals after the pages ``gone`` (with dl) are replaced by ``new``."""
    parts = whole.select("n_pages", "n_tokens")
    for pages, sign in ((gone, -1), (new, 1)):
        parts = parts.unionByName(pages.agg((sign * F.count(F.lit(1))).alias("n_pages"), (sign * F.coalesce(F.sum("dl"), F.lit(0))).alias("n_tokens")))
    summed = parts.agg(F.sum("n_pages").alias("n_pages"), F.sum("n_tokens").alias("n_tokens"))
    return summed.withColumn("avgdl", F.when(F.col("n_pages") > 0, F.col("n_tokens") / F.col("n_pages")))


def registry(pages: DataFrame, indexed_at: Column) -> DataFrame:
    """(fp, path, page_count, last_indexed) of the documents that have pages."""
    return pages.groupBy("fp", "path").agg(F.count(F.lit(1)).alias("page_count")).withColumn("last_indexed", indexed_at)


def list_indexed(reg: DataFrame) -> DataFrame:
    return reg.orderBy(F.desc("last_indexed"), "fp")


def upsert_postings(base: DataFrame, new_pages: DataFrame, fps: DataFrame) -> DataFrame:
    """Postings after the documents ``fps`` are indexed again with ``new_pages`` (with tokens); none left, none kept."""
    new = postings(new_pages, "positions" in base.columns)
    return base.join(fps.select("fp").distinct(), "fp", "left_anti").unionByName(new.select(*base.columns))


def upsert_pages(base: DataFrame, new: DataFrame, fps: DataFrame | None = None) -> DataFrame:
    """All pages of each document in ``new`` (or named in ``fps``: it may have none left) replace its old ones."""
    touched = (new.select("fp") if fps is None else fps.select("fp")).distinct()
    return base.join(touched, "fp", "left_anti").unionByName(new.select(*base.columns))


def upsert_registry(reg: DataFrame, docs: DataFrame, new_pages: DataFrame, indexed_at: Column) -> DataFrame:
    """Registry after (fp, path) ``docs`` are indexed with ``new_pages``; no pages gives a count of 0."""
    counted = docs.select("fp", "path").distinct().join(new_pages.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "fp", "left")
    rows = counted.select("fp", "path", F.coalesce("n", F.lit(0)).cast("long").alias("page_count"), indexed_at.alias("last_indexed"))
    return reg.join(rows.select("fp"), "fp", "left_anti").unionByName(rows)


def remove(table: DataFrame, fps: DataFrame) -> DataFrame:
    return table.join(fps.select("fp").distinct(), "fp", "left_anti")


def removal_flags(reg: DataFrame, fps: DataFrame) -> DataFrame:
    """(fp, removed): whether each named document was there."""
    return fps.select("fp").distinct().join(reg.select("fp", F.lit(True).alias("removed")), "fp", "left").select("fp", F.coalesce("removed", F.lit(False)).alias("removed"))


def stale_fingerprints(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, fp) of files whose path now has another fingerprint."""
    return old.alias("o").join(new.alias("n"), "path").where(F.col("o.fp") != F.col("n.fp")).select("path", F.col("o.fp").alias("fp")).distinct()
