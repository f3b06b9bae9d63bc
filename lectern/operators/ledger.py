"""The ledger of cached entries: (key, size, last_access, doc_fp), bulk changes and eviction.

Changes take a table of requests instead of one key at a time and return the new ledger; counts of
what they touch come from the difference.
"""

from __future__ import annotations

from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ("key", "size", "last_access", "doc_fp")
#: Default limit in bytes, and per cent of it to evict down to: fixed values.
HARD_LIMIT, SOFT_PERCENT = 5 * 1024**3, 90


def total_size(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total_size"))


def size_by_document(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("doc_fp").agg(F.sum("size").cast("long").alias("total_size"), F.count(F.lit(1)).alias("entries"))


def put(ledger: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries replace those of the same key; of several in one batch the latest access wins, then the larger."""
    latest = F.max(F.struct("last_access", "size", "doc_fp")).alias("e")
    new = entries.groupBy("key").agg(latest).select("key", "e.size", "e.last_access", "e.doc_fp")
    return ledger.select(*COLUMNS).join(new.select("key"), "key", "left_anti").unionByName(new)


def touch(ledger: DataFrame, reads: DataFrame) -> DataFrame:
    """Reads (key, ts) move the last access forward; unknown keys are ignored."""
    seen = reads.groupBy("key").agg(F.max("ts").alias("ts"))
    return ledger.join(seen, "key", "left").select("key", "size", F.greatest("last_access", "ts").alias("last_access"), "doc_fp")


def remove(ledger: DataFrame, keys: DataFrame) -> DataFrame:
    return ledger.join(keys.select("key").distinct(), "key", "left_anti")


def clear(ledger: DataFrame) -> DataFrame:
    return ledger.limit(0)


def invalidate(ledger: DataFrame, fps: DataFrame) -> DataFrame:
    """Entries of the documents go."""
    return ledger.join(fps.select("doc_fp").distinct(), "doc_fp", "left_anti").select(*COLUMNS)


def invalidated_counts(ledger: DataFrame, fps: DataFrame) -> DataFrame:
    """(doc_fp, removed) for every document asked for, 0 included."""
    gone = ledger.groupBy("doc_fp").agg(F.count(F.lit(1)).alias("removed"))
    return fps.select("doc_fp").distinct().join(gone, "doc_fp", "left").select("doc_fp", F.coalesce("removed", F.lit(0)).alias("removed"))


def _start_of(key: Column) -> Column:
    """A string's first six bytes as a number: larger for strings that sort later, but for ties."""
    return F.conv(F.rpad(F.hex(F.substring(key.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")


def _below(bounds: list[float], x: Column, cells: int = 1024) -> Column:
    """How many of the sorted ``bounds`` are smaller than ``x``. A grid over them tells most rows without a comparison: a value in a
    later cell is larger, and only the bounds of its own cell are looked at."""
    if not bounds:
        return F.lit(0)
    width = (bounds[-1] - bounds[0]) / cells or 1.0
    cell = lambda v: max(0, min(cells, floor((v - bounds[0]) / width)))
    held = [0] * (cells + 1)
    for v in bounds:
        held[cell(v)] += 1
    before = [0]
    for n in held:
        before.append(before[-1] + n)
    at = F.greatest(F.lit(0), F.least(F.lit(cells), F.floor((x - F.lit(bounds[0])) / F.lit(width)))).cast("int")
    of = lambda values: F.get(F.array(*[F.lit(v) for v in values]), at)
    near = F.slice(F.array(*[F.lit(v) for v in bounds]), of(before[:-1]) + 1, of(held))
    return of(before[:-1]) + F.when(of(held) > 0, F.size(F.filter(near, lambda v: v < x))).otherwise(0)


def sizes_before(ledger: DataFrame, order: list[str], ranges: int | None = None, by: str | None = None) -> DataFrame:
    """``ledger`` with ``before``: the summed size of all rows (of the same ``by``) that come earlier in ``order`` (time, key).

    Rows are cut into ranges of the order by quantile bounds: of the time, and where many rows have one time
    also of the key. Sums of the ranges give each range its offset, and only rows of a range are sorted
    together. Ranges are named by the rows' values alone, so a lost task makes the same ranges again.
    """
    return _placed(ledger, order, ranges, by).select(*ledger.columns, "before")


def _placed(ledger: DataFrame, order: list[str], ranges: int | None, by: str | None) -> DataFrame:
    """``sizes_before`` with ``_whole``, the summed size of all rows (of the same ``by``).

    A range's offset goes to its rows as one more row of the range, not by a join.
    """
    n = ranges or int(ledger.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first, second = order
    kind = ledger.schema[first].dataType.simpleString()
    zoneless = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {first})")
    number = {"timestamp": F.unix_micros(F.col(first)), "timestamp_ntz": zoneless}.get(kind, F.col(first)).cast("double")
    numbered = ledger.withColumn("_number", number)
    cuts = [k / n for k in range(1, n)] or [1.0]
    found = numbered.agg(F.percentile_approx("_number", cuts, 10_000)).first()[0] or []
    level = F.lit(0)
    # a time that fills several quantiles is cut again by its keys
    hot = sorted({x for x, y in zip(found, found[1:], strict=False) if x == y})
    if hot:
        numbered = numbered.withColumn("_start", _start_of(F.col(second)))
        inner = F.lit(0)
        rows = numbered.where(F.col("_number").isin(hot)).groupBy("_number").agg(F.percentile_approx("_start", cuts, 10_000).alias("q")).collect()  # n values for each of under n times
        for r in rows:
            inner = F.when(F.col("_number") == r["_number"], _below(sorted(set(r["q"])), F.col("_start"))).otherwise(inner)
        # inside a time's range, earlier times come before its first key
        level = F.when(F.col("_number").isin(hot), inner + 1).otherwise(0)
    place = F.coalesce(_below(sorted(set(found)), F.col("_number")), F.lit(-1)) * (n + 1) + level
    ranged = numbered.withColumn("_range", place).drop("_number", "_start").withColumn("_row", F.lit(True))
    groups = [by] if by else []
    sums = ranged.groupBy(*groups, "_range").agg(F.sum("size").alias("_s"))
    # a row for each range (of each group)
    of_group = Window.partitionBy(*(groups or [F.lit(0)]))
    up_to = of_group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*groups, "_range", F.coalesce(F.sum("_s").over(up_to), F.lit(0)).alias("_offset"), F.coalesce(F.sum("_s").over(of_group), F.lit(0)).alias("_whole"))
    here = Window.partitionBy(*groups, "_range")
    inside = F.coalesce(F.sum("size").over(here.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = ranged.unionByName(offsets, allowMissingColumns=True)
    # the offset's row has neither time nor key, and the two are told for the whole range
    told = told.select(*ledger.columns, "_row", inside.alias("_inside"), F.max("_offset").over(here).alias("_offset"), F.max("_whole").over(here).alias("_whole"))
    return told.where("_row").select(*ledger.columns, (F.col("_offset") + F.col("_inside")).alias("before"), "_whole")


#: Entries up to which what is left is summed in order, and ranges of time into which more are cut.
FEW, RANGES = 100_000, 4096


def _number(ledger: DataFrame, name: str) -> Column:
    """A time as a number; none sorts first."""
    kind = ledger.schema[name].dataType.simpleString()
    zoneless = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {name})")
    number = {"timestamp": F.unix_micros(F.col(name)), "timestamp_ntz": zoneless}.get(kind, F.col(name).cast("long"))
    return F.coalesce(number, F.lit(-(1 << 62)))


def _common(a: str, b: str) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def oldest(ledger: DataFrame, amount: int, few: int = FEW) -> Column:
    """A condition that the least recently used entries (by time, then key) meet: those before which less than ``amount`` bytes lie.

    A weighted selection: entries are cut into ranges of their time, sizes are summed by range, and of all ranges only the one in
    which the sum passes ``amount`` is cut again, a single time by its keys, beginning where these differ. Ranges before it go
    and ranges after it stay; nothing but the last few entries is sorted, and nothing shuffled but sums. A range is all that
    lies between two times (and keys), so each pass tests the entries as they are stored.
    """
    if amount <= 0:
        return F.lit(False)
    time, key = _number(ledger, "last_access"), F.coalesce(F.col("key").cast("string"), F.lit(""))
    entries = ledger.select(time.alias("t"), key.alias("k"), "size")
    told = [F.count(F.lit(1)).alias("n"), F.min("t").alias("a"), F.max("t").alias("b"), F.min("k").alias("ka"), F.max("k").alias("kb")]
    rows, r = entries, entries.agg(*told).first()
    for _ in range(40):
        if r["n"] <= few or (r["a"] == r["b"] and r["ka"] == r["kb"]):
            break
        if r["a"] < r["b"]:
            place = F.expr(f"(t - ({r['a']}L)) div {-(-(r['b'] - r['a'] + 1) // RANGES)}L")
        else:  # two bytes of the keys, from where they differ
            place = F.floor(_start_of(F.substring(F.col("k"), F.lit(_common(r["ka"], r["kb"]) + 1), F.lit(6))) / (1 << 32))
        sums = rows.groupBy(place.alias("r")).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("s"), *told).orderBy("r").collect()  # a row a range
        if len(sums) == 1:
            break  # keys that agree in more than what the numbers tell
        for r in sums:
            if r["s"] >= amount:
                break
            amount -= r["s"]
        else:
            amount += r["s"]
        rows = entries.where(F.col("t").between(r["a"], r["b"]))
        if r["a"] == r["b"]:
            rows = rows.where(F.col("k").between(r["ka"], r["kb"]))
    before = F.sum("size").over(Window.orderBy("t", "k").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    last = rows.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < amount).agg(F.max(F.struct("t", "k")).alias("e")).first()["e"]
    if last is None:
        return F.lit(False)
    return (time < last["t"]) | ((time == last["t"]) & (key <= last["k"]))


def _amount(ledger: DataFrame, target: int) -> int:
    return (ledger.agg(F.sum("size")).first()[0] or 0) - target


def evictions(ledger: DataFrame, target: int, few: int = FEW) -> DataFrame:
    """Entries to evict, least recently used first, while more than ``target`` bytes remain: those before
    which the rest is still over the target."""
    return ledger.where(oldest(ledger, _amount(ledger, target), few)).select(*COLUMNS)


def evict_lru(ledger: DataFrame, target: int, few: int = FEW) -> DataFrame:
    """What is left after the evictions."""
    return ledger.where(~oldest(ledger, _amount(ledger, target), few)).select(*COLUMNS)


def janitor(ledger: DataFrame, hard: int = HARD_LIMIT, soft_percent: int = SOFT_PERCENT) -> DataFrame:
    """Evicts down to the soft limit, but only when the hard limit is exceeded."""
    over = _amount(ledger, hard)
    return evict_lru(ledger, hard * soft_percent // 100) if over > 0 else ledger.select(*COLUMNS)


def evict_per_document(ledger: DataFrame, capacity: int, percent: int = 30) -> DataFrame:
    """What is left when no document may hold more than ``percent`` of the capacity: its least recently used entries go.
    A document's entries lie in many ranges of time, however many it has."""
    cap = capacity * percent // 100
    placed = _placed(ledger, ["last_access", "key"], None, "doc_fp")
    return placed.where(F.col("_whole") - F.col("before") <= cap).select(*ledger.columns)
