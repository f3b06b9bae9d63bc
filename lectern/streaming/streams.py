"""The long-running loops as streams: indexing, cache maintenance, recent lists."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from lectern.functions.scalars import normal_path
from lectern.operators import ledger as L
from lectern.operators.index import page_layers
from lectern.operators.recents import LIMIT, replay_python
from lectern.sources.stored import StoredIndex

#: Files per micro-batch: what waits is bounded, but nothing is dropped.
BATCH_FILES = 32

#: Setting that streams with timers and lists in their state need when they start.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Documents with several versions in a batch up to which their names go to all tasks.
MANY = 200_000


def last_versions(rows: DataFrame) -> DataFrame:
    """(fp, ts, path, text), the last version of each document: only texts of documents that have several are compared."""
    rows = rows.select("fp", "ts", "path", "text")
    often = rows.groupBy("fp").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("fp")
    n = often.limit(MANY + 1).count()
    if not n:
        return rows
    often = F.broadcast(often) if n <= MANY else often
    last = rows.join(often, "fp", "left_semi").groupBy("fp").agg(F.max(F.struct("ts", "path", "text")).alias("d")).select("fp", "d.*")
    return rows.join(often, "fp", "left_anti").unionByName(last)


def index_stream(documents: DataFrame, store: StoredIndex, checkpoint: str, quarantine: str | None = None, **trigger) -> StreamingQuery:
    """Index a stream of (fp, path, text, ts): pages, postings and registry; of several versions in a batch the last counts.
    A batch is one change of the index that searches read, named by its number, so a repeated one changes nothing; small
    segments are merged as they gather. Rows without fp or text go to the quarantine."""

    def take(batch: DataFrame, number: int) -> None:
        good, bad = batch.where("fp is not null and text is not null"), batch.where("fp is null or text is null")
        if quarantine and bad.limit(1).count():
            bad.write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
        good = last_versions(good)
        pages = page_layers(good, F.col("fp"), F.col("text"), F.col("path"))
        times = good.agg(F.max("ts")).first()[0]
        store.upsert(good, pages, F.lit(times), f"batch-{number:010d}")
        store.merge(f"merge-{number:010d}")

    return documents.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def _states(spark: SparkSession, folder: str):
    """File system of a folder of states, and their numbers in order."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath() for f in fs.listStatus(path)] if fs.exists(path) else []
    whole = [p.getName() for p in names if p.getName().startswith("state=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return fs, sorted(int(n.removeprefix("state=")) for n in whole)


def latest_state(spark: SparkSession, folder: str) -> str | None:
    """Path of the newest whole state of a ledger that ``janitor_stream`` keeps."""
    numbers = _states(spark, folder)[1]
    return f"{folder}/state={numbers[-1]}" if numbers else None


def janitor_stream(accesses: DataFrame, spark: SparkSession, folder: str, checkpoint: str, hard: int = L.HARD_LIMIT, soft_percent: int = L.SOFT_PERCENT, **trigger) -> StreamingQuery:
    """Apply a stream of accesses (key, ts) to the ledger in ``folder`` and evict. ``state=-1`` is the ledger to begin with;
    without one there is nothing to touch.

    Each batch writes the next state beside the last one, so a failed one leaves it as it was and is tried
    again from the same state. States before the last one are deleted.
    """

    def tick(batch: DataFrame, number: int) -> None:
        fs, numbers = _states(spark, folder)
        earlier = [n for n in numbers if n < number]
        if not earlier:
            return
        before = spark.read.parquet(f"{folder}/state={earlier[-1]}")
        after = L.janitor(L.touch(before, batch), hard, soft_percent)
        after.write.mode("overwrite").parquet(f"{folder}/state={number}")
        for n in earlier[:-1]:
            fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/state={n}"), True)

    return accesses.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "30 seconds"})).start()


class _InOrder(StatefulProcessor):
    """A workspace's list, and the steps that an earlier one may still precede."""

    def __init__(self, k: int):
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.listed = handle.getValueState("listed", "paths array<string>")
        self.waiting = handle.getListState("waiting", "at long, seq long, op string, path string")
        self.timers = handle

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for f in rows:
            none = f["seq"].isna() | f["path"].isna()
            if none.any():
                f = f.astype(object).where(f.notna(), None)
            self.waiting.appendList(list(zip(*(f[c].tolist() for c in ("at", "seq", "op", "path")), strict=True)))
        known, paths = self._settle(timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame({"workspace": [key[0]], "paths": [replay_python(known, paths, self.k)]})

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._settle(timerValues.getCurrentWatermarkInMs())  # the list as last told doesn't change
        return iter(())

    def _settle(self, mark: int) -> tuple[list[tuple[str, str | None]], list[str]]:
        """Folds the steps that the watermark has passed; returns the later ones, in order, and the list before them."""
        steps = sorted(self.waiting.get(), key=lambda s: (s[0], s[1] is not None, s[1] or 0, s[2] or "", s[3] or ""))
        passed = [s for s in steps if s[0] <= mark * 1000]
        later = steps[len(passed) :]
        paths = list(self.listed.get()[0]) if self.listed.exists() else []
        if passed:
            paths = replay_python([(s[2], s[3]) for s in passed], paths, self.k)
            self.listed.update((paths,))
            self.waiting.clear()
            if later:
                self.waiting.put([tuple(s) for s in later])
        for t in list(self.timers.listTimers()):
            self.timers.deleteTimer(t)
        if later:
            self.timers.registerTimer(max(mark, later[0][0] // 1000) + 1)
        return [(s[2], s[3]) for s in later], paths


def recents_stream(log: DataFrame, k: int = LIMIT, time: str | None = None, delay: str = "1 minute") -> DataFrame:
    """(workspace, paths) after each batch of a stream of (workspace, seq, op, path): k paths of state a workspace.

    With a column of event times, ``time``, steps take effect in order of it and of ``seq``, in whatever batches they come: those
    of the last ``delay`` are kept apart until the watermark has passed them, and each list told is that of all
    steps known. State is k paths and the steps of one delay a workspace. Steps later than that, or without a time,
    are dropped. The query must be started with RocksDB as its state store (``STATE_STORE``).

    Without event times, steps are taken in order of ``seq`` inside a batch, and one that comes in a later batch than one
    with a larger ``seq`` is applied when it comes. What precedes a batch's last clear is dropped before the rest is folded.
    """
    normal = log.withColumn("workspace", F.col("workspace").cast("string")).withColumn("path", normal_path(F.col("path")))
    if time is not None:
        steps = normal.where(F.col(time).isNotNull()).withWatermark(time, delay)
        steps = steps.select("workspace", F.col(time), F.unix_micros(F.col(time).cast("timestamp")).alias("at"), F.col("seq").cast("long").alias("seq"), "op", "path")
        return steps.groupBy("workspace").transformWithStateInPandas(_InOrder(k), "workspace string, paths array<string>", "Update", "EventTime")

    def fold(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        paths, kept = list(state.get[0]) if state.exists else [], []
        for f in frames:
            cleared = f.loc[f["op"] == "clear", "seq"].max()
            if pd.notna(cleared):
                kept, paths = [x[x["seq"] >= cleared] for x in [*kept, f]], []
            else:
                kept.append(f)
        rows = pd.concat(kept).sort_values("seq", kind="stable")
        steps = [(op, None if pd.isna(p) else p) for op, p in zip(rows["op"], rows["path"], strict=True)]
        paths = replay_python(steps, paths, k)
        state.update((paths,))
        yield pd.DataFrame({"workspace": [key[0]], "paths": [paths]})

    return normal.groupBy("workspace").applyInPandasWithState(fold, "workspace string, paths array<string>", "paths array<string>", "update", GroupStateTimeout.NoTimeout)
