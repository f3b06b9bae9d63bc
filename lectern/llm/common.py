"""Shared pieces of the training-data operators: tables, word rule, lineage cuts."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, and the words themselves (fixed by the contracts).
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark from whatever store the path names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for lineage cuts: the session's checkpoint folder; a local session that has none gets a temporary one."""
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lectern-"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: later stages depend on
    the files, not on the executors that made them."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(name, None)
    conf.set(name, str(16 << 20))  # batches of long rows stay small in the Python workers
    try:
        df.write.parquet(path)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results are written.

    It does so when the driver's garbage is collected, which in a driver with little to do may be
    long after the disks are full; results don't depend on it.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``cut`` wrote, once all that was made from it is itself written."""
    spark = df.sparkSession
    for f in {name.rsplit("/", 1)[0] for name in df.inputFiles() if "/cut-" in name}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row (a one-element transform)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Words of a text by the contract's rule; null or blank text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds`` (null for a null id)."""
    return F.crc32(doc_id.cast("string")) % folds
