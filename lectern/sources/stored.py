"""The search index as tables in a folder: immutable segments, what was deleted in them, and a list of what counts.

A segment is written once and never changed. It holds
  pages      by bucket of the document: fp, path, page_index, text, dl, cell, and a number; pages of one cell lie together
  documents  by bucket of the document: the registry
  postings   by bucket of the term, sorted by term in each task: the numbers of the pages that hold it, many in a row, with the
             class of their length, tf, positions
  terms      df and cf, in ranges of the term, so that statistics of row groups cut a prefix to a range
  blocks     of frequent terms: the largest contribution to a rank in each block of pages
  page_grams if trigrams are asked for: by bucket of three characters, the numbers of the pages that hold them, many in a row
An index of trigrams alone (``words=False``) has no postings, terms and blocks.
Only pages are shuffled to write a segment: each task writes the postings of its pages to the folders, and shuffle files go with the step
that made them.

A change (an upsert or a removal) finds the documents it touches in the buckets of their names, notes
per segment which of them are deleted there and what their pages had added to the statistics, and writes
what is new as a segment of its own. So a change costs what it touches: postings of others are
neither read nor written. Then a numbered file in ``published`` lists segments and changes
that count from now on, by a rename to a name that was not there; readers take the highest number and
never see half a change, and a change that is published already is skipped. Segments of similar
size are merged by ``merge``. One writer at a time.

Blocks are ``BLOCK_PAGES`` numbers in a row: pages of similar length and repetitiveness (a cell), as such pages give similar
contributions. Folders' numbers follow the amount of text; those of postings end at ``TERM_FOLDERS``, as each task writes to all of them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import tokenize
from lectern.operators.index import forward_index, posting_lists, with_tokens
from lectern.operators.search import B, K1
from lectern.sources.tables import bucket_of

PAGES = "fp string, path string, page_index int, text string, dl int, cell int, number long, doc_bucket int"
DOCUMENTS = "fp string, path string, page_count long, n_tokens long, last_indexed timestamp, doc_bucket int"
LISTS = "term string, part long, places array<smallint>, sizes array<smallint>, tfs array<int>, positions array<array<int>>, term_bucket int"
POSTINGS = "term string, fp string, page_index int, dl int, tf int, positions array<int>, block long, term_bucket int"
TERMS = "term string, df long, cf long"
#: ``places`` of pages in a range of ``RANGE`` numbers, the ``part``-th one.
TRIGRAMS = "gram string, part long, places array<smallint>, gram_bucket int"
RANGE = 1 << 15
#: Characters of pages whose trigrams are held at once; a longer page takes several turns.
WINDOW = 1 << 21
BLOCKS = "term string, block long, n long, best double, term_bucket int"
#: Pages of a block, and pages a term must have to get block maxima.
BLOCK_PAGES, FREQUENT = 16, 1024
#: Classes of a page's length from each power of two to the next.
SIZES = 4
#: Folders of postings at most; tokens whose postings one task writes; frequent terms up to which they go to all tasks.
TERM_FOLDERS, TASK_TOKENS, SENT = 16, 1 << 23, 500_000
#: How Parquet packs the tables: differences of values that stand in order, also where a dictionary would do.
PACKED = {"compression": "zstd", "parquet.writer.version": "v2"} | {f"parquet.enable.dictionary#{c}": "false" for c in ("term", "places.list.element", "sizes.list.element", "block")}
#: Segments of one size class that are merged into one, and the ratio between size classes.
FAN = 4


def bucket_number(term: str, buckets: int) -> int:
    """What ``bucket_of`` gives for one value."""
    h = xxhash.xxh64_intdigest(term.encode(), 42)
    return (h - (h >> 63 << 64)) % buckets


def folders_for(chars: int) -> int:
    """Folders for so much text: one a million characters up to 16, then one for every 64 million."""
    return int(min(4096, max(1, min(16, chars >> 20), chars >> 26)))


#: Characters outside ASCII that match an ASCII letter in another case (fixed by Unicode), and those letters.
OTHER_CASE = ("\u212a\u017f\u0130\u0131", "ksii")


def page_grams(pages: DataFrame) -> DataFrame:
    """(gram, part, places) of pages (number, text): the three-character strings of the texts in lower case, each with the numbers of
    pages that hold it. A row has those of one window of one task, so a page that goes through several windows may stand in several rows."""
    slim = pages.select("number", F.lower(F.translate("text", *OTHER_CASE)).alias("low")).where(F.length("low") > 2)

    def told(number: np.ndarray, page: np.ndarray, points: np.ndarray) -> pa.RecordBatch | None:
        """Of consecutive characters, with the place of each one's page in ``number``."""
        at = np.flatnonzero(page[:-2] == page[2:])
        if not len(at):
            return None
        there = np.zeros(0x110000, bool)
        there[points] = True
        chars = np.flatnonzero(there)
        code = np.zeros(len(there), np.int32)
        code[chars] = np.arange(len(chars))
        code = code[points]
        gram = (code[at].astype(np.int64) * len(chars) + code[at + 1]) * len(chars) + code[at + 2]
        first = int(page[at[0]])
        n = int(page[at[-1]]) - first + 1
        names = None
        if len(chars) ** 3 * n >= 1 << 63:
            names, gram = np.unique(gram, return_inverse=True)
        gram, at = np.divmod(np.unique(gram * n + (page[at] - first)), n)
        part, place = np.divmod(number[at + first], RANGE)
        edges = np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]) | (part[1:] != part[:-1])])
        gram = gram[edges] if names is None else names[gram[edges]]
        spelt = np.stack([gram // len(chars) ** 2, gram // len(chars) % len(chars), gram % len(chars)], axis=1)
        text = chars[spelt].astype("<u4").tobytes().decode("utf-32-le")
        places = pa.ListArray.from_arrays(pa.array(np.r_[edges, len(place)].astype(np.int32)), pa.array(place.astype(np.int16)))
        return pa.RecordBatch.from_arrays([pa.array([text[i : i + 3] for i in range(0, len(text), 3)], pa.string()), pa.array(part[edges]), places], ["gram", "part", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number, pages = b["number"].to_numpy(), np.repeat(np.arange(b.num_rows, dtype=np.int32), pc.utf8_length(b["low"]).to_numpy())
            points = np.frombuffer("".join(b["low"].to_pylist()).encode("utf-32-le"), "<u4")
            for start in range(0, len(points), WINDOW):
                window = slice(start, start + WINDOW + 2)
                if (out := told(number, pages[window], points[window])) is not None:
                    yield out

    return slim.mapInArrow(run, "gram string, part long, places array<smallint>")


def block_maxima(lists: DataFrame, avgdl: float) -> DataFrame:
    """(term, block, n, best, term_bucket) of rows of postings; a block that two rows share stands in both. A page's contribution is largest
    at the least length of its class, which bounds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = np.repeat(np.arange(b.num_rows), pc.list_value_length(b["places"]).to_numpy())
            if not len(row):
                continue
            tf, least = b["tfs"].flatten().to_numpy(), np.maximum(0, 2.0 ** (b["sizes"].flatten().to_numpy() / SIZES) - 1)
            block = (b["part"].to_numpy()[row] * RANGE + b["places"].flatten().to_numpy()) // BLOCK_PAGES
            cuts = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (block[1:] != block[:-1])))
            best = np.maximum.reduceat(tf * (K1 + 1) / (tf + K1 * (1 - B + B * least / (avgdl or 1.0))), cuts)
            of = pa.array(row[cuts])
            yield pa.RecordBatch.from_arrays([b["term"].take(of), pa.array(block[cuts]), pa.array(np.diff(np.append(cuts, len(row)))), pa.array(best), b["term_bucket"].take(of)], ["term", "block", "n", "best", "term_bucket"])

    return lists.select("term", "part", "places", "sizes", "tfs", "term_bucket").mapInArrow(run, BLOCKS)


def grams_of(needle: str) -> list[str]:
    """Three-character strings of ASCII that every page with the needle, in any case, must hold."""
    low = needle.lower()
    return list(dict.fromkeys(g for g in (low[i : i + 3] for i in range(len(low) - 2)) if g.isascii())) if len(low) == len(needle) else []


@dataclass
class Segment:
    name: str
    pages: int
    tokens: int
    buckets: int
    doc_buckets: int
    avgdl: float  # when it was written: block maxima hold for it
    trigrams: bool = False
    words: bool = True
    deleted_in: list[str] = field(default_factory=list)


class Snapshot:
    """The index as one published list has it."""

    def __init__(self, spark: SparkSession, folder: str, segments: list[Segment]):
        self.spark, self.folder, self.segments = spark, folder, segments
        self.n_pages, self.n_tokens = sum(s.pages for s in segments), sum(s.tokens for s in segments)
        self.avgdl = self.n_tokens / self.n_pages if self.n_pages else None

    def read(self, segment: Segment, table: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/segments/{segment.name}/{table}")

    def _gone(self, segment: Segment, table: str, schema: str) -> DataFrame | None:
        paths = [f"{self.folder}/changes/{c}/{table}/segment={segment.name}" for c in segment.deleted_in]
        return self.spark.read.schema(schema).parquet(*paths) if paths else None

    def live(self, segment: Segment, rows: DataFrame) -> DataFrame:
        """``rows`` (fp, ...) of a segment without those of documents that were deleted in it."""
        gone = self._gone(segment, "deleted", "fp string")
        return rows if gone is None else rows.join(gone, "fp", "left_anti").select(*rows.columns)

    def _union(self, parts: list[DataFrame], schema: str) -> DataFrame:
        out = parts[0] if parts else self.spark.createDataFrame([], schema)
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _all(self, table: str, schema: str) -> DataFrame:
        return self._union([self.live(s, self.read(s, table, schema)) for s in self.segments], schema)

    def pages(self) -> DataFrame:
        """(fp, path, page_index, text, dl)"""
        return self._all("pages", PAGES).drop("doc_bucket", "cell", "number")

    def pages_of(self, hits: DataFrame) -> DataFrame:
        """``hits`` (fp, page_index, ...) with path and text: only the folders of their documents are read."""
        parts = []
        for s in self.segments:
            by = hits.withColumn("doc_bucket", bucket_of(F.col("fp"), s.doc_buckets))
            parts.append(self.live(s, self.read(s, "pages", PAGES).drop("dl", "cell", "number").join(by, ["doc_bucket", "fp", "page_index"]).drop("doc_bucket")))
        return self._union(parts, "fp string, page_index int, path string, text string") if parts else hits.withColumns({"path": F.lit(""), "text": F.lit("")})

    def documents(self, segment: Segment, fps: DataFrame | None = None) -> DataFrame:
        """Live documents of a segment; of those named, if any are, in the folders of their names."""
        rows = self.read(segment, "documents", DOCUMENTS)
        if fps is not None:
            named = fps.select("fp").distinct()
            wanted = [r[0] for r in named.select(bucket_of(F.col("fp"), segment.doc_buckets)).distinct().collect()]  # folders at most
            rows = rows.where(F.col("doc_bucket").isin(wanted)).join(named, "fp", "left_semi")
        return self.live(segment, rows)

    def forward(self, segment: Segment, fps: DataFrame) -> DataFrame:
        """(fp, page_count, n_tokens, terms (term, df, cf)) of the named documents that are live in a segment: their pages are read in the
        folders of their names, and their words counted."""
        named = self.documents(segment, fps).select("fp", "path", "doc_bucket")
        pages = self.read(segment, "pages", PAGES).join(named.select("fp", "doc_bucket"), ["doc_bucket", "fp"], "left_semi")
        return StoredIndex._counted(pages, named.select("fp", "path")).drop("path")

    def registry(self) -> DataFrame:
        """(fp, path, page_count, last_indexed)"""
        return self._all("documents", DOCUMENTS).select("fp", "path", "page_count", "last_indexed")

    def _named(self, segment: Segment, lists: DataFrame, more: tuple[str, ...] = (), positions: bool = True, blocks: DataFrame | None = None) -> DataFrame:
        """Rows of postings as one row a posting, with the columns ``more`` of the list: its page's number gives fp, page_index, dl.
        Those of deleted documents are left out, and those outside ``blocks``, if any are given."""
        each = F.inline(F.arrays_zip("places", "tfs", *(["positions"] if positions else [])))
        posts = lists.select("part", *more, each).withColumn("number", F.col("part") * RANGE + F.col("places")).withColumn("block", F.floor(F.col("number") / BLOCK_PAGES))
        if blocks is not None:
            posts = posts.join(blocks, "block", "left_semi")
        names = self.live(segment, self.read(segment, "pages", PAGES).select("fp", "page_index", "dl", "number"))
        kept = ["dl", F.col("tfs").alias("tf"), *(["positions"] if positions else []), "block"]
        first, rest = (["term"], [m for m in more if m != "term"]) if "term" in more else ([], more)
        return posts.join(names, "number").select(*first, "fp", "page_index", *kept, *rest)

    def segment_postings(self, segment: Segment, terms: list[str] | None = None, prefixes: list[str] = (), positions: bool = True, blocks: DataFrame | None = None) -> DataFrame:
        """With the columns ``block`` and ``term_bucket``; of the named terms and prefixes only, read in their folders."""
        posts = self.read(segment, "postings", LISTS)
        if terms is not None:
            wanted, test = {bucket_number(t, segment.buckets) for t in terms}, F.col("term").isin(list(terms)) if terms else F.lit(False)
            for p in prefixes:
                # the dictionary is in order: a prefix is a range of it
                found = self.read(segment, "terms", TERMS).where(F.col("term").startswith(p))
                wanted |= {r[0] for r in found.select(bucket_of(F.col("term"), segment.buckets)).distinct().collect()}  # folders at most
                test = test | F.col("term").startswith(p)
            posts = posts.where(F.col("term_bucket").isin(sorted(wanted)) & test)
        return self._named(segment, posts, ("term", "term_bucket"), positions, blocks)

    def postings(self, terms: list[str] | None = None, prefixes: list[str] = ()) -> DataFrame:
        """(term, fp, page_index, dl, tf, positions)"""
        return self._union([self.segment_postings(s, terms, prefixes) for s in self.segments], POSTINGS).drop("term_bucket", "block")

    def postings_of(self, asked: DataFrame, positions: bool = True) -> DataFrame:
        """Postings joined to a table of asked terms (term, ...): only the folders of asked terms are read."""
        parts = []
        for s in self.segments:
            by_term = asked.withColumn("term_bucket", bucket_of(F.col("term"), s.buckets))
            found = self.read(s, "postings", LISTS).join(by_term, ["term_bucket", "term"]).drop("term_bucket")
            parts.append(self._named(s, found, tuple(asked.columns), positions).drop("block"))
        return self._union(parts, "term string, fp string, page_index int, dl int, tf int, positions array<int>") if parts else asked.withColumns({"fp": F.lit(""), "page_index": F.lit(0), "dl": F.lit(0), "tf": F.lit(0), "positions": F.array().cast("array<int>")}).limit(0)

    def segment_terms(self, segment: Segment) -> DataFrame:
        """(term, df, cf) parts of a segment's statistics: what it was written with, less what was deleted."""
        own, gone = self.read(segment, "terms", TERMS), self._gone(segment, "gone", TERMS)
        return own if gone is None else own.unionByName(gone.select("term", (-F.col("df")).alias("df"), (-F.col("cf")).alias("cf")))

    def terms(self) -> DataFrame:
        """(term, df, cf), exact whatever was changed."""
        if len(self.segments) == 1 and not self.segments[0].deleted_in:
            return self.read(self.segments[0], "terms", TERMS)
        parts = self._union([self.segment_terms(s) for s in self.segments], TERMS)
        return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df > 0")

    def totals(self) -> DataFrame:
        """One row: n_pages, n_tokens, avgdl."""
        return self.spark.createDataFrame([(self.n_pages, self.n_tokens, self.avgdl)], "n_pages long, n_tokens long, avgdl double")

    def candidates(self, grams: list[str]) -> DataFrame:
        """(fp, path, page_index, text) of the pages that hold all of the three-character strings, in segments that have them; of the
        others all pages."""
        parts = []
        for s in self.segments:
            rows = self.read(s, "pages", PAGES).select("fp", "path", "page_index", "text", "number")
            if s.trigrams:
                found = self.read(s, "page_grams", TRIGRAMS).where(F.col("gram_bucket").isin(sorted({bucket_number(g, s.buckets) for g in grams})) & F.col("gram").isin(grams))
                each = found.select("gram", "part", F.explode("places").alias("place")).select("gram", (F.col("part") * RANGE + F.col("place")).alias("number"))
                full = each.groupBy("number").agg(F.count_distinct("gram").alias("c")).where(F.col("c") == len(grams)).select("number")
                rows = rows.join(full, "number", "left_semi")
            parts.append(self.live(s, rows.drop("number")))
        return self._union(parts, "fp string, path string, page_index int, text string")

    def blocks(self, segment: Segment, terms: list[str]) -> DataFrame:
        """(term, block, n, best): ``best`` bounds a contribution at the present mean length."""
        rows = self.read(segment, "blocks", BLOCKS).where(F.col("term_bucket").isin(sorted({bucket_number(t, segment.buckets) for t in terms})) & F.col("term").isin(list(terms)))
        rows = rows.groupBy("term", "block").agg(F.sum("n").alias("n"), F.max("best").alias("best"))
        return rows.select("term", "block", "n", (F.col("best") * F.lit(max(1.0, self.avgdl / segment.avgdl) if segment.avgdl else 1.0)).alias("best"))


class StoredIndex:
    """Writes changes of the index in ``folder``; ``now()`` is what it holds."""

    def __init__(self, spark: SparkSession, folder: str, trigrams: bool = False, words: bool = True):
        self.spark, self.folder, self.trigrams, self.words = spark, folder.rstrip("/"), trigrams, words
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def published(self) -> list[str]:
        """Names of the changes, in order."""
        return [n.split("-", 1)[1] for n in self._numbers()]

    def _numbers(self) -> list[str]:
        at = self._path(f"{self.folder}/published")
        names = sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []
        return [n for n in names if not n.startswith(".")]

    def now(self) -> Snapshot:
        names = self._numbers()
        if not names:
            return Snapshot(self.spark, self.folder, [])
        stream = self._fs.open(self._path(f"{self.folder}/published/{names[-1]}"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Snapshot(self.spark, self.folder, [Segment(**s) for s in json.loads(text)["segments"]])

    def _publish(self, change: str, segments: list[Segment]) -> None:
        number = len(self._numbers())
        temporary, final = self._path(f"{self.folder}/.next-{uuid.uuid4().hex}"), self._path(f"{self.folder}/published/{number:012d}-{change}")
        self._fs.mkdirs(final.getParent())
        out = self._fs.create(temporary, True)
        out.write(bytearray(json.dumps({"segments": [asdict(s) for s in segments]}).encode()))
        out.close()
        if not self._fs.rename(temporary, final):
            raise OSError(f"{final} is there already: another writer")

    def _write(self, df: DataFrame, at: str, by: str | None = None) -> None:
        writer = df.write.mode("overwrite").options(**PACKED)
        conf = df.sparkSession.conf  # a stream's batch has a session of its own
        # batches of long pages stay small in the Python workers, and shuffle files are deleted when the table is written
        held = {"spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
        before = {k: conf.get(k, None) for k in held}
        try:
            for k, v in held.items():
                conf.set(k, v)
            (writer.partitionBy(by) if by else writer).parquet(f"{self.folder}/{at}")
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)

    def _segment(self, name: str, docs: DataFrame, pages: DataFrame, indexed_at: Column, buckets: int | None, doc_buckets: int | None) -> Segment | None:
        """Write ``pages`` (fp, path, page_index, text) of ``docs`` (fp, path) as a segment."""
        chars = pages.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
        folders = folders_for(chars)
        segment = Segment(name, 0, 0, buckets or (min(TERM_FOLDERS, folders) if self.words else folders), doc_buckets or folders, 0.0, words=self.words)
        distinct = F.size(F.array_distinct("tokens"))
        cell = F.floor(SIZES * F.log2(F.col("dl") + 1)) * 16 + F.least(F.lit(15), F.floor(16 * (1 - distinct / F.greatest(F.col("dl"), F.lit(1)))))
        rows = with_tokens(pages).select("fp", "path", "page_index", "text", "dl", cell.cast("int").alias("cell"), bucket_of(F.col("fp"), segment.doc_buckets).alias("doc_bucket"))
        self._write_pages(segment, rows)
        stored = self._stored(segment)
        whole = stored.agg(F.count(F.lit(1)).alias("c"), F.coalesce(F.sum("dl"), F.lit(0)).alias("t")).first()
        segment.pages, segment.tokens = whole["c"], whole["t"]
        segment.avgdl = segment.tokens / segment.pages if segment.pages else 0.0
        counts = stored.groupBy("fp").agg(F.count(F.lit(1)).alias("page_count"), F.sum("dl").alias("n_tokens"))
        told = docs.select("fp", "path").dropDuplicates(["fp"]).join(counts, "fp", "left").na.fill(0, ["page_count", "n_tokens"])
        self._write_documents(segment, told.withColumn("last_indexed", indexed_at.cast("timestamp")))
        self._write_found(segment, self.trigrams)
        return segment

    def _stored(self, segment: Segment) -> DataFrame:
        return Snapshot(self.spark, self.folder, []).read(segment, "pages", PAGES)

    def _write_found(self, segment: Segment, trigrams: bool) -> None:
        """What finds the stored pages: trigrams, if they are asked for, and postings."""
        if trigrams:
            self._write_trigrams(segment, self._stored(segment))
        if segment.words:
            self._write_postings(segment)

    @staticmethod
    def _counted(stored: DataFrame, docs: DataFrame | None = None) -> DataFrame:
        """(fp, path, page_count, n_tokens, terms) of the stored pages, or of ``docs`` (fp, path), with pages or without: a document's
        texts come together once, and its words are counted where they are, without a shuffle of postings."""
        rows = stored.where(F.col("text").isNotNull()).select("fp", F.lit(None).cast("string").alias("path"), F.lit(docs is None).alias("named"), "text")
        if docs is not None:
            rows = rows.unionByName(docs.select("fp", "path", F.lit(True).alias("named"), F.lit(None).cast("string").alias("text")))
        rows = rows.repartition("fp").sortWithinPartitions("fp").withColumn("tokens", tokenize(F.col("text")))
        return forward_index(rows).where("named").drop("named")

    def _write_pages(self, segment: Segment, rows: DataFrame) -> None:
        rows = rows.hint("rebalance", "doc_bucket").sortWithinPartitions("doc_bucket", "cell", "fp", "page_index")
        self._write(rows.withColumn("number", F.monotonically_increasing_id()), f"segments/{segment.name}/pages", "doc_bucket")

    def _write_trigrams(self, segment: Segment, stored: DataFrame) -> None:
        rows = page_grams(stored).withColumn("gram_bucket", bucket_of(F.col("gram"), segment.buckets))
        self._write(rows.hint("rebalance", "gram_bucket").sortWithinPartitions("gram_bucket", "gram"), f"segments/{segment.name}/page_grams", "gram_bucket")
        segment.trigrams = True

    def _write_documents(self, segment: Segment, documents: DataFrame) -> None:
        rows = documents.withColumn("doc_bucket", bucket_of(F.col("fp"), segment.doc_buckets))
        self._write(rows.hint("rebalance", "doc_bucket").sortWithinPartitions("doc_bucket", "fp"), f"segments/{segment.name}/documents", "doc_bucket")

    def _write_postings(self, segment: Segment) -> None:
        """Postings of the stored pages, and what is made from them: no posting is shuffled, a frequent term's are those of many tasks."""
        at, view = f"segments/{segment.name}", Snapshot(self.spark, self.folder, [])
        tasks = max(self.spark.sparkContext.defaultParallelism, segment.tokens // TASK_TOKENS)
        lists = posting_lists(with_tokens(self._stored(segment).coalesce(tasks)).withColumn("size", F.floor(F.col("cell") / 16).cast("smallint")), RANGE).withColumn("term_bucket", bucket_of(F.col("term"), segment.buckets))
        self._write(lists.sortWithinPartitions("term_bucket", "term", "part"), f"{at}/postings", "term_bucket")
        written = view.read(segment, "postings", LISTS)
        of_row = written.select("term", F.size("places").alias("df"), F.aggregate("tfs", F.lit(0).cast("long"), lambda n, tf: n + tf).alias("cf"))
        stats = of_row.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        self._write(stats.repartitionByRange("term").sortWithinPartitions("term"), f"{at}/terms")
        frequent = view.read(segment, "terms", TERMS).where(F.col("df") >= FREQUENT).select("term")
        if frequent.limit(SENT + 1).count() <= SENT:
            frequent = F.broadcast(frequent)
        best = block_maxima(written.join(frequent, "term", "left_semi"), segment.avgdl)
        self._write(best.sortWithinPartitions("term_bucket", "term", "block"), f"{at}/blocks", "term_bucket")

    def _delete(self, view: Snapshot, fps: DataFrame, change: str) -> list[Segment]:
        """Segments after the documents ``fps`` are deleted in them; their names and statistics are noted under ``change``."""
        if not view.segments:
            return []
        found = [view.documents(s, fps).select(F.lit(s.name).alias("segment"), "fp", "page_count", "n_tokens") for s in view.segments]
        self._write(view._union(found, ""), f"changes/{change}/deleted", "segment")
        words = [view.forward(s, fps).select(F.lit(s.name).alias("segment"), F.inline("terms")) for s in view.segments if s.words]
        gone = view._union(words, "segment string, term string, df long, cf long").groupBy("segment", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        self._write(gone, f"changes/{change}/gone", "segment")
        noted = self.spark.read.schema("fp string, page_count long, n_tokens long, segment string").parquet(f"{self.folder}/changes/{change}/deleted")
        counts = {r["segment"]: r for r in noted.groupBy("segment").agg(F.sum("page_count").alias("p"), F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("c")).collect()}
        out = []
        for s in view.segments:
            if r := counts.get(s.name):
                s = Segment(**asdict(s))
                s.pages, s.tokens, s.deleted_in = s.pages - r["p"], s.tokens - r["t"], [*s.deleted_in, change]
                # a document without words leaves no statistics: the folder is there for readers all the same
                self._fs.mkdirs(self._path(f"{self.folder}/changes/{change}/gone/segment={s.name}"))
            out.append(s)
        return out

    def upsert(self, docs: DataFrame, pages: DataFrame, indexed_at: Column, change: str, buckets: int | None = None, doc_buckets: int | None = None) -> bool:
        """Pages of all ``docs`` (fp, path) are replaced by ``pages``; False if the change was already there."""
        if change in self.published():
            return False
        rest = self._delete(self.now(), docs, change)
        self._publish(change, [*rest, self._segment(change, docs, pages, indexed_at, buckets, doc_buckets)])
        return True

    def remove(self, fps: DataFrame, change: str) -> bool:
        if change in self.published():
            return False
        self._publish(change, self._delete(self.now(), fps, change))
        return True

    def merge(self, change: str, fan: int = FAN, everything: bool = False) -> bool:
        """Merge the segments of each size class (powers of ``fan``) that has ``fan`` of them, or all; False if there are none."""
        view = self.now()
        if change in self.published():
            return False
        classes: dict[int, list[Segment]] = {}
        for s in view.segments:
            size = 0
            while not everything and s.pages >= fan ** (size + 1):
                size += 1
            classes.setdefault(size, []).append(s)
        due = [c for c in classes.values() if len(c) >= (2 if everything else fan) or everything and c[0].deleted_in]
        if not due:
            return False
        segments = list(view.segments)
        for n, group in enumerate(due):
            segments = [s for s in segments if s not in group] + [self._merged(f"{change}-{n}", Snapshot(self.spark, self.folder, group))]
        self._publish(change, segments)
        return True

    def _merged(self, name: str, view: Snapshot) -> Segment:
        """One segment of the live pages of several, which get new numbers and postings."""
        size = lambda kind: min(4096, 1 << (sum(getattr(s, kind) for s in view.segments) - 1).bit_length())
        words = {s.words for s in view.segments}
        if len(words) > 1:
            raise ValueError("segments with words and without them can't be merged")
        segment = Segment(name, view.n_pages, view.n_tokens, size("buckets"), size("doc_buckets"), view.avgdl or 0.0, words=words.pop())
        if segment.words:
            segment.buckets = min(segment.buckets, max(TERM_FOLDERS, *(s.buckets for s in view.segments)))
        pages = view._all("pages", PAGES).drop("number").withColumn("doc_bucket", bucket_of(F.col("fp"), segment.doc_buckets))
        self._write_pages(segment, pages)
        self._write_documents(segment, view._all("documents", DOCUMENTS).drop("doc_bucket"))
        self._write_found(segment, all(s.trigrams for s in view.segments))
        return segment

    def vacuum(self) -> None:
        """Delete segments and changes that the last list doesn't name; nobody may be reading them any more."""
        view = self.now()
        kept = {"segments": {s.name for s in view.segments}, "changes": {c for s in view.segments for c in s.deleted_in}}
        for table, names in kept.items():
            at = self._path(f"{self.folder}/{table}")
            for f in self._fs.listStatus(at) if self._fs.exists(at) else []:
                if f.getPath().getName() not in names:
                    self._fs.delete(f.getPath(), True)

    def pages(self) -> DataFrame:
        return self.now().pages()

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        return self.now().postings(terms)

    def terms(self) -> DataFrame:
        return self.now().terms()

    def registry(self) -> DataFrame:
        return self.now().registry()


def write_index(pages: DataFrame, folder: str, indexed_at: Column, buckets: int | None = None, doc_buckets: int | None = None, trigrams: bool = False, words: bool = True) -> StoredIndex:
    """A new index of pages (fp, path, page_index, text) in ``folder``."""
    index = StoredIndex(pages.sparkSession, folder, trigrams, words)
    index.upsert(pages.select("fp", "path"), pages, indexed_at, "first", buckets, doc_buckets)
    return index
