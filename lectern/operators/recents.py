"""Most-recently-used lists of paths, by workspace."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.scalars import non_blank, normal_path

LIMIT = 20

#: Paths that one summary of a part of a log may name; a part with more becomes several.
PART_PATHS = 4096

_TOUCH = pa.struct([("key", pa.string()), ("front", pa.bool_()), ("room", pa.int32())])
_OWN = pa.struct([("key", pa.string()), ("path", pa.string()), ("maybe", pa.bool_())])


def recents(opens: DataFrame, k: int = LIMIT) -> DataFrame:
    """(workspace, place, path) of a log of opens (workspace, seq, path): newest first, one per path in any case.
    Paths are in their normal form (``normal_path``)."""
    good = opens.where(non_blank(F.col("path")).isNotNull()).withColumn("path", normal_path(F.col("path"))).withColumn("_key", F.lower("path"))
    last = good.groupBy("workspace", "_key").agg(F.max(F.struct("seq", "path")).alias("e"))
    place = F.row_number().over(Window.partitionBy("workspace").orderBy(F.desc("e.seq"), "_key"))
    return last.withColumn("place", place).where(F.col("place") <= k).select("workspace", "place", F.col("e.path").alias("path"))


class Part:
    """What a part of a log does to any list that it may begin with.

    ``own``: paths the part itself leaves in front. ``touches``: in order, the paths that it takes out of the list it
    began with, and how much room its own paths then leave to that list. What the room pushes out doesn't
    come back. After a clear, or once the part's own paths fill the list, the rest of the old list is gone, and touches
    are no longer noted.

    A path added while the part has none of its own may be in front already, and then keeps its casing: ``front``
    marks such a touch, ``maybe`` the path whose casing depends on it.
    """

    def __init__(self, k: int):
        self.k, self.own, self.touches, self.seen, self.gone = k, [], [], set(), False

    def _touch(self, key: str, front: bool) -> None:
        if not self.gone and key not in self.seen:
            self.seen.add(key)
            self.touches.append([key, front, self.k])

    def step(self, op: str, path: str | None, key: str | None) -> None:
        if op == "clear":
            self.own, self.gone = [], True
        elif key is not None and op == "remove":
            self._touch(key, False)
            self.own = [e for e in self.own if e[0] != key]
        elif key is not None and op == "add" and not (self.own and self.own[0][0] == key):
            front = not (self.own or self.gone or key in self.seen)
            self._touch(key, front)
            self.own = [(key, path, front), *(e for e in self.own if e[0] != key)][: self.k]
            if not self.gone:
                self.touches[-1][2] = min(self.touches[-1][2], self.k - len(self.own))
                self.gone = len(self.own) >= self.k
        if self.gone and self.touches and not any(maybe for *_, maybe in self.own):
            self.touches, self.seen = [], set()


def applied(touches: list[dict], own: list[dict], gone: bool, old: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The list of (key, path) that a part of a log makes of ``old``."""
    casing = {}
    for t in touches:
        if t["front"] and old and old[0][0] == t["key"]:
            casing[t["key"]] = old[0][1]
        old = [e for e in old if e[0] != t["key"]][: t["room"]]
    return [(e["key"], casing.get(e["key"], e["path"]) if e["maybe"] else e["path"]) for e in own] + ([] if gone else old)


def _summaries(k: int, most: int):
    """Sorted steps (workspace, seq, op, path, key; no path if it is blank) to parts (workspace, first, touches, own, gone) in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, first, kinds = None, None, None, None
        for b in batches:
            done = []
            kinds = (b["workspace"].type, b["seq"].type)
            for w, seq, op, path, key in zip(*(b[c].to_pylist() for c in ("workspace", "seq", "op", "path", "key")), strict=True):
                if part is None or w != now or len(part.touches) >= most:
                    done += [(now, first, part)] if part else []
                    part, now, first = Part(k), w, (seq, op, path)
                part.step(op, path, key)
            if done:
                yield _rows(done, kinds)
        if part:
            yield _rows([(now, first, part)], kinds)

    return run


def _rows(done: list[tuple], kinds: tuple[pa.DataType, pa.DataType]) -> pa.RecordBatch:
    first = pa.struct([("seq", kinds[1]), ("op", pa.string()), ("path", pa.string())])
    columns = {
        "workspace": pa.array([w for w, *_ in done], kinds[0]),
        "first": pa.array([dict(zip(("seq", "op", "path"), f, strict=True)) for _, f, _ in done], first),
        "touches": pa.array([[dict(zip(("key", "front", "room"), t, strict=True)) for t in p.touches] for *_, p in done], pa.list_(_TOUCH)),
        "own": pa.array([[dict(zip(("key", "path", "maybe"), e, strict=True)) for e in p.own] for *_, p in done], pa.list_(_OWN)),
        "gone": pa.array([p.gone for *_, p in done], pa.bool_()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts sorted by workspace and first step to (workspace, paths); holds one list and one part."""
    begun, now, state, kind = False, None, [], None
    for b in batches:
        done, kind = [], b["workspace"].type
        for i in range(b.num_rows):
            w = b["workspace"][i].as_py()
            if not begun or w != now:
                done += [(now, state)] if begun else []
                begun, now, state = True, w, []
            state = applied(b["touches"][i].as_py(), b["own"][i].as_py(), b["gone"][i].as_py(), state)
        if done:
            yield _lists(done, kind)
    if begun:
        yield _lists([(now, state)], kind)


def _lists(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([w for w, _ in done], kind), pa.array([[p for _, p in s] for _, s in done], pa.list_(pa.string()))], ["workspace", "paths"])


def summaries(log: DataFrame, k: int = LIMIT, most: int = PART_PATHS) -> DataFrame:
    """(workspace, first, touches, own, gone): parts of a log (workspace, seq, op, path) as functions on lists (``Part``).

    The log is split into ranges of (workspace, seq), whatever its workspaces' sizes, so a workspace with most of the
    steps is summarised by all tasks. A part that fills its list, or clears it, is k paths.
    """
    steps = log.select("workspace", "seq", "op", normal_path(F.col("path")).alias("path"))
    kinds = {f.name: f.dataType.simpleString() for f in log.select("workspace", "seq").schema}
    shape = f"workspace {kinds['workspace']}, first struct<seq:{kinds['seq']},op:string,path:string>, touches array<struct<key:string,front:boolean,room:int>>, own array<struct<key:string,path:string,maybe:boolean>>, gone boolean"
    order = ("workspace", "seq", "op", "path")
    tasks = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, as the fold costs more than the few bytes of a step suggest
    keyed = steps.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("key", F.lower("path"))
    return keyed.mapInArrow(_summaries(k, max(2, most)), shape)


def replay(log: DataFrame, k: int = LIMIT, most: int = PART_PATHS) -> DataFrame:
    """(workspace, paths) after a log (workspace, seq, op, path) of add, remove and clear, folded in order (ties of seq: by op and path).

    Paths are compared and kept in their normal form (``normal_path``). Not the latest k that were not removed: what the limit pushes out stays out. Blank
    paths and unknown operations change nothing. Parts of the log are summarised in parallel (``summaries``); what
    goes on to a workspace's one task is a row a part, taken in order.
    """
    parts = summaries(log, k, most)
    kind = parts.schema["workspace"].dataType.simpleString()
    return parts.repartition("workspace").sortWithinPartitions("workspace", "first").mapInArrow(_compose, f"workspace {kind}, paths array<string>")


def replay_python(steps: list[tuple[str, str | None]], paths: list[str], k: int = LIMIT) -> list[str]:
    """The same fold on one workspace's steps (op, path), for the stream's state."""
    for op, path in steps:
        if op == "clear":
            paths = []
        elif path and path.strip():
            others = [p for p in paths if p.lower() != path.lower()]
            if op == "remove":
                paths = others
            elif op == "add" and not (paths and paths[0].lower() == path.lower()):
                paths = [path, *others][:k]
    return paths
