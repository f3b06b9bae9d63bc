"""Files as rows: listing, classification, fingerprints and page layers."""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.scalars import HEAD_BYTES, fingerprint, non_blank, ts_to_ticks

#: kind, path ending (regular expression, any case), first bytes; the first rule that fits wins.
RULES = (
    ("Pdf", r"\.pdf$", b"%PDF-"),
    ("Djvu", r"\.djvu?$", b"AT&TFORM"),
    ("Epub", r"\.epub$", None),
    ("Fb2", r"\.fb2$", None),
    ("Mobi", r"\.mobi$", None),
    ("Image", r"\.(?:png|jpe?g|tiff?|bmp|gif)$", b"\x89PNG"),
)


#: Heads in a batch of rows.
HEADS_AT_ONCE = 64


def scan_files(spark: SparkSession, folder: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """(path, modificationTime, length, content) of files with their whole content; a missing folder is an error,
    and Spark lists no empty files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(folder)


def open_file(path: str) -> BinaryIO:
    """A file of any store that Arrow knows, by its path as Spark lists it: a URI whose signs are not escaped."""
    scheme, host, name = re.fullmatch(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//[^/]*)?(.*)", path, re.S).groups()
    fs, name = pafs.FileSystem.from_uri(f"{scheme or 'file'}:{host or '//'}{quote(name)}")
    return fs.open_input_file(name)


def _heads(size: int, opener: Callable[[str], BinaryIO]):
    """Batches of (path, modificationTime, length) with the files' first bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, HEADS_AT_ONCE):
                part, found = b.slice(at, HEADS_AT_ONCE), []
                for path in part["path"].to_pylist():
                    with opener(path) as f:
                        found.append(_first(f, size))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], [*part.schema.names, "content"])

    return run


def _first(f: BinaryIO, size: int) -> bytes:
    """The first ``size`` bytes, also of streams that give fewer than asked for at a time."""
    out = io.BytesIO()
    while out.tell() < size and (more := f.read(size - out.tell())):
        out.write(more)
    return out.getvalue()


def scan_heads(spark: SparkSession, folder: str, glob: str = "*", recursive: bool = True, size: int = HEAD_BYTES, opener: Callable[[str], BinaryIO] = open_file) -> DataFrame:
    """(path, modificationTime, length, content) of files, where content is the first ``size`` bytes only: enough to
    classify and fingerprint files of any length. A missing folder is an error; empty files are not listed, as in ``scan_files``.

    Spark lists the files and deals them to tasks without opening any; tasks read heads by range.
    ``opener`` opens the path of a store that Arrow doesn't know.
    """
    listed = scan_files(spark, folder, glob, recursive).select("path", "modificationTime", "length")
    return listed.mapInArrow(_heads(size, opener), "path string, modificationTime timestamp, length long, content binary")


def classify(path: Column, head: Column, rules=RULES) -> Column:
    """Kind of a file by its ending or its first bytes (binary); null for blank paths and unknown files."""
    out = None
    for kind, ending, magic in rules:
        test = path.rlike("(?i)" + ending)
        if magic is not None:
            test = test | F.coalesce(F.hex(F.substring(head, 1, len(magic))) == magic.hex().upper(), F.lit(False))
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return F.when(non_blank(path).isNotNull(), out)


def classify_format(files: DataFrame, rules=RULES) -> tuple[DataFrame, DataFrame]:
    """(files with ``kind``, rejects) of a table with path and content."""
    marked = files.withColumn("kind", classify(F.col("path"), F.col("content"), rules))
    return marked.where("kind is not null"), marked.where("kind is null")


def with_fingerprint(files: DataFrame) -> DataFrame:
    return files.withColumn("fp", fingerprint(F.col("content"), F.col("length"), ts_to_ticks(F.col("modificationTime"))))


def scan_page_layers(files: DataFrame, extractor=None, schema: str | None = None, sep: str = "\f") -> DataFrame:
    """(fp, path, page_index, text) of files with content: by the caller's extractor (batches to batches), or by
    cutting texts at ``sep``. Null layers are dropped."""
    if extractor is not None:
        return files.mapInPandas(extractor, schema).where("text is not null")
    text = F.try_validate_utf8(F.decode("content", "UTF-8"))
    return files.select("fp", "path", F.posexplode(F.split(text, sep, -1)).alias("page_index", "text")).where("text is not null")
