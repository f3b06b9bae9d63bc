"""Size-aware heavy-light Jaccard join on word n-grams, and the components of its links.

Sets of n-grams (64-bit hashes) that are equal are one class; links are sought between classes.

Small sets enumerate subsets. Two sets of sizes a <= b link when they share o(a, b) elements, a
number fixed by the sizes, so every set writes, for each pair of sizes it can take part in, its
subsets of exactly that many elements. Sets that meet in such a subset are linked: nothing is
left to verify.

Large sets go through inverted lists. Elements are ordered by hash; two linked sets share an
element among the first few of each. A list longer than ``long_list`` (a passage that thousands
of texts share) is left out: its element counts as one that comes last in the order, and since
every set writes some spare elements, most sets still have as many short lists as they need.
Those that don't (members of a large group of near copies, mostly) are joined among themselves
in another order: all their elements are counted, and each set writes its first elements with the
rarest first. What only one of them has can't be shared and is not even written, so a copy with
more edits than a link allows writes nothing; a copy with fewer lies near the middle of its group.

Before sets are compared, sizes, the places of the shared element in both orders and the distance
of 128-cell histograms (a lower bound of the symmetric difference) exclude most pairs exactly.
Sets are compared in two rounds: first each with one candidate partner, and the members of a
rarest-first list with the one in which fewest elements are rarer; then, as most candidates now
lie inside one component, only those in different components. In a list, only members outside its
largest component look for partners. Comparisons inside a component can't change it, so nothing
is lost.

The boundary between small and large is the size for which the number of subsets written plus
``list_cost`` times the number of list entries written is least, from the counts of sets by size.

Defined cases: null or wordless text has an empty set, linked with nothing; texts with fewer
words than n have their whole sequence as the one element; repeated rows and equal texts are
one class; a null doc_id takes part, its rows' component is the smallest id of the others, or
null; an empty table gives an empty result; extra columns are ignored. Distinct n-grams are
told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut, discard, release

CELLS = 128
#: Sets up to this size are kept whole next to their list keys, as subsets are made from them.
SMALL_MOST = 40
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of a text (unsigned)."""
    found = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    with np.errstate(over="ignore"):
        if len(h) < words:
            s = np.zeros(1, np.uint64)
            for x in h:
                s = s * _M + x
            return _mix(s + np.uint64(len(h)))
        n = len(h) - words + 1
        s = h[:n].copy()
        for k in range(1, words):
            s = s * _M + h[k : k + n]
        return np.unique(_mix(s))


def overlap(a: int, b: int, percent: int) -> int:
    """Least shared elements of linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def probe_length(n: int, percent: int) -> int:
    """First elements that must meet those of a linked set not larger."""
    return n - -(-percent * n // 100) + 1


def written_length(n: int, percent: int) -> int:
    """First elements that a set writes: those above, and spare ones for elements with long lists."""
    p = probe_length(n, percent)
    return min(n, p + 3 * p // 10 + 12)


def subset_keys(s: np.ndarray, most: int, percent: int) -> list[tuple[int, int]]:
    """(key, whether sets of two sizes must meet in it) of the subsets of a set that decide links
    with a smaller set of at most ``most`` elements."""
    n, out = len(s), []
    with np.errstate(over="ignore"):
        mixed = _mix(s * _M + np.uint64(1))
        total = mixed.sum()
        for m in range(-(-percent * n // 100), 100 * n // percent + 1):
            a, b = min(n, m), max(n, m)
            if a > most or (o := overlap(a, b, percent)) > a or (a == b and o == n):
                continue
            tag = np.uint64((a << 32) + b)
            gone = list(combinations(range(n), n - o))
            sums = total - mixed[np.array(gone, np.int64)].sum(axis=1) if n > o else np.array([total])
            out += [(int(k), a != b) for k in _mix(sums.astype(np.uint64) + tag * _M).view(np.int64)]
    return out


def subset_count(n: int, most: int, percent: int) -> int:
    """How many keys ``subset_keys`` makes for a set of size n."""
    total = 0
    for m in range(-(-percent * n // 100), 100 * n // percent + 1):
        a, b = min(n, m), max(n, m)
        if a <= most and not (a == b and overlap(a, b, percent) == n) and overlap(a, b, percent) <= a:
            total += comb(n, n - overlap(a, b, percent))
    return total


def boundary(sizes: dict[int, int], percent: int, list_cost: float) -> int:
    """The size up to which sets enumerate subsets, of least total cost."""
    best, least = 0, None
    for most in range(SMALL_MOST * percent // 100 + 1):
        cost = sum(c * subset_count(n, most, percent) for n, c in sizes.items() if n <= SMALL_MOST and n <= 100 * most // percent)
        cost += list_cost * sum(c * probe_length(n, percent) for n, c in sizes.items() if most < n)
        if least is None or cost < least:
            best, least = most, cost
    return best


def _slices(b: pa.RecordBatch, chars: int = 4_000_000) -> Iterator[tuple[int, list[str | None]]]:
    start, total, part = 0, 0, []
    for t in b["text"].to_pylist():
        if part and total + len(t or "") > chars:
            yield start, part
            start, total, part = start + len(part), 0, []
        part.append(t)
        total += len(t or "")
    if part:
        yield start, part


def _class(s: np.ndarray) -> int:
    """Number of a class of equal sets."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64)) if len(s) else 0


def _sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Per row: doc_id, n, node (class of equal sets), cells (histogram), small (the set, if small)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, part in _slices(b):
                sets = [shingle_set(t, words) for t in part]
                signed = [s.view(np.int64) for s in sets]
                cells = [np.minimum(127, np.bincount((s >> np.uint64(57)).astype(np.int64), minlength=CELLS)).astype(np.int8) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        b["doc_id"].slice(start, len(part)), pa.array([len(s) for s in sets], pa.int64()), pa.array([_class(s) for s in sets], pa.int64()), pa.array(cells, pa.list_(pa.int8())),
                        pa.array([x if 0 < len(x) <= SMALL_MOST else None for x in signed], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n", "node", "cells", "small"],
                )

    return docs.mapInArrow(run, "doc_id long, n long, node long, cells array<byte>, small array<long>")


def _subset_links(classes: DataFrame, most: int, percent: int) -> DataFrame:
    """(a, b) links that small sets give through common subsets."""
    small = classes.where((F.col("n") * percent <= most * 100) & F.col("small").isNotNull()).select("node", "n", "small")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 500):
                part = b.slice(start, 500)
                found = [subset_keys(np.array(s, np.int64).view(np.uint64), most, percent) for s in part["small"].to_pylist()]
                sizes = [len(keys) for keys in found]
                yield pa.RecordBatch.from_arrays([pa.array([k for keys in found for k, _ in keys], pa.int64()), pa.array([two for keys in found for _, two in keys], pa.bool_()), pa.array(np.repeat(part["node"].to_numpy(), sizes)), pa.array(np.repeat(part["n"].to_numpy(), sizes))], ["key", "two", "node", "n"])

    keyed = cut(small.mapInArrow(run, "key long, two boolean, node long, n long"))
    # all that meet in a subset are connected, if both sizes that the subset is for are there
    lists = keyed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z"), F.min("n").alias("least"), F.max("n").alias("largest"), F.max("two").alias("two"))
    lists = lists.where((F.col("a") != F.col("z")) & (~F.col("two") | (F.col("least") < F.col("largest")))).select("key", "a")
    return keyed.select("key", F.col("node").alias("b")).join(lists, "key").where("a != b").select("a", "b").distinct()


def _fits(n: Column, m: Column, percent: int) -> Column:
    return (n * 100 >= m * percent) & (m * 100 >= n * percent)


def _may_link(n: Column, m: Column, c: Column, d: Column, percent: int) -> Column:
    """Whether sizes and histograms leave a link possible."""
    apart = F.aggregate(F.zip_with(c, d, lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda s, x: s + x)
    return _fits(n, m, percent) & (apart <= n + m - 2 * F.ceil(percent * (n + m) / (100 + percent)))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets (node, elements as bytes) link."""
    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("right"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b["left"], b["right"], strict=True):
                both = np.sort(np.frombuffer(x.as_py() + y.as_py(), np.uint64))  # each set has an element once
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                good.append(100 * shared >= percent * (len(both) - shared))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([b["a"].filter(mask), b["b"].filter(mask)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, part): the smallest node reachable, for all nodes of ``links`` (a, b)."""
    links = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    parts = cut(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("part")))
    while True:
        seen = links.join(parts.select(F.col("node").alias("b"), "part"), "b").groupBy("a").agg(F.min("part").alias("near"))
        step = parts.join(seen, F.col("node") == F.col("a")).select("node", F.least("part", "near").alias("part"), F.col("part").alias("old"))
        step = cut(step)
        # follow the pointer once more: halves the way to the smallest node
        jump = step.select(F.col("node").alias("part"), F.col("part").alias("next"))
        new = cut(step.join(jump, "part").select("node", F.least("part", "next").alias("part"), "old"))
        discard(parts)
        discard(step)
        parts = new.select("node", "part")
        if not new.where("part != old").limit(1).count():
            discard(links)
            return parts


def _bitmap(nodes: DataFrame, bits: int) -> np.ndarray:
    """One bit for each class by its smallest id: a fixed ``bits`` / 8 bytes, whatever the number of classes."""
    place = F.pmod(F.coalesce("first", F.lit(0)), F.lit(bits)) + 1  # the bitmap functions count from 1
    rows = nodes.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("m")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        at = (r["k"] - 1) * 4096
        out[at : at + len(r["m"])] = np.frombuffer(r["m"], np.uint8)[: len(out) - at]
    return out


def linked_components(docs: DataFrame, words: int = 5, percent: int = 80, long_list: int = 50, list_cost: float = 8.0, bits: int = 1 << 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id reachable by links)."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = cut(_sets(slim, words, percent))
    classes = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first"), F.min("n").alias("n"))
    sizes = {r["n"]: r["c"] for r in classes.where(F.col("n") <= 4 * SMALL_MOST).groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
    most = boundary(sizes, percent, list_cost)
    plain = cut(rows.where("n > 0").groupBy("node").agg(F.min("n").alias("n"), F.any_value("cells").alias("cells"), F.any_value("small").alias("small")))
    about = plain.select("node", F.col("n").alias("size"), "cells")
    exact = cut(_subset_links(plain, most, percent))
    # inverted lists of large sets
    entry = cut(_entries(slim, classes.where(F.col("n") > most), words, percent, bits))
    lists = entry.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    met = cut(entry.join(lists, "key"))
    discard(entry)
    del entry, lists
    release(met.sparkSession)
    needed = F.col("n") - F.ceil(percent * F.col("n") / 100) + 1
    written = F.least(F.col("n"), needed + F.floor(3 * needed / 10) + 12)
    lost = met.where(F.col("members") > long_list).groupBy("node").agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("lost"))
    busy = cut(lost.where(written - F.col("lost") < needed).select("node"))
    # the smaller one meets in its first elements; up to written - needed of those before may have long lists
    lead = F.col("at") < F.col("n") - F.ceil(2 * percent * F.col("n") / (100 + percent)) + 1 + written - needed
    short = met.where(F.col("members") <= long_list).select("key", "node", "n", lead.alias("lead"))
    pairs = cut(_near(_listed(short, percent), about, percent))
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().withColumn("busy", F.lit(False)).unionByName(busy.withColumn("busy", F.lit(True)))
    wanted = wanted.groupBy("node").agg(F.max("busy").alias("busy"))
    sets = _whole_sets(slim, wanted.join(classes.select("node", "first"), "node"), words, bits)
    del wanted, short
    release(met.sparkSession)
    # lists of the sets that are left, rarest elements first
    ranked = _rarest_first(sets.where("busy"), percent)
    # first round: each node with its smallest candidate, each such list with its most central member
    pivot = ranked.groupBy("key").agg(F.min(F.struct("at", "node", "n")).alias("p")).select("key", F.col("p.node").alias("a"), F.col("p.n").alias("an"))
    stars = ranked.join(pivot, "key").where((F.col("a") != F.col("node")) & _fits(F.col("an"), F.col("n"), percent))
    stars = stars.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
    chosen = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").union(_near(stars, about, percent)).distinct()
    links = cut(exact.unionByName(_verified(chosen, sets, percent)))
    del chosen, stars, pivot
    parts = components(links)
    release(met.sparkSession)
    # second round: candidates in different components
    of = lambda c: parts.select(F.col("node").alias(c), F.col("part").alias(f"{c}_part"))
    rest = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("a_part", "a") != F.coalesce("b_part", "b")).select("a", "b")
    crossed = _crossed(ranked.join(parts, "node", "left").select("key", "node", "n", "at", F.coalesce("part", "node").alias("part")), about, percent)
    second = cut(_verified(rest.unionByName(crossed).distinct(), sets, percent))
    if second.limit(1).count():
        parts = components(links.unionByName(second))
    # what only the links needed goes
    for used in (plain, exact, met, busy, pairs, sets, ranked, links, second):
        discard(used)
    # classes to components to the smallest id
    placed = classes.join(parts, "node", "left").select("node", F.coalesce("part", "node").alias("part"), "first")
    smallest = placed.groupBy("part").agg(F.min("first").alias("component_id"))
    named = placed.join(smallest, "part").select(F.col("node").alias("c_node"), "component_id")
    out = rows.join(named, (rows["node"] == named["c_node"]) & (rows["n"] > 0), "left")
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _listed(members: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a < b) of nodes whose sizes fit that meet in a short list (key, node, n, lead)."""
    # a list has as many members as ``long_list`` allows
    lists = members.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "node", "lead"))).alias("l"))

    def partners(x: Column, i: Column) -> Column:
        later = F.filter(F.slice(F.col("l"), i + 2, F.size("l")), lambda y: (x["n"] * 100 >= y["n"] * percent) & (x["node"] != y["node"]))
        met = F.transform(later, lambda y: F.struct(F.least(x["node"], y["node"]).alias("a"), F.greatest(x["node"], y["node"]).alias("b")))
        return F.when(x["lead"], met).otherwise(F.array().cast("array<struct<a:bigint,b:bigint>>"))

    return lists.select(F.explode(F.flatten(F.transform("l", partners))).alias("p")).select("p.a", "p.b").distinct()


def _rarest_first(sets: DataFrame, percent: int) -> DataFrame:
    """(key, node, n, at): the first elements of each of ``sets`` (node, elements), ordered by the number of
    these sets that have them; ``at`` is the place in that order. Elements of a single set come
    first and are left out, with lists of one member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.frombuffer(x.as_py(), np.int64) for x in b["elements"]]
            if found:
                sizes = np.array([len(s) for s in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.repeat(b["node"].to_numpy(), sizes)), pa.array(np.repeat(sizes, sizes))], ["key", "node", "n"])

    element = cut(sets.select("node", "elements").mapInArrow(run, "key long, node long, n long"))
    common = element.groupBy("key").agg(F.count(F.lit(1)).alias("owners")).where("owners > 1")
    # a list here is a part of one document's set
    per = element.join(common, "key").groupBy("node").agg(F.min("n").alias("n"), F.array_sort(F.collect_list(F.struct("owners", "key"))).alias("l"))
    alone = F.col("n") - F.size("l")
    needed = F.col("n") - F.ceil(percent * F.col("n") / 100) + 1 - alone
    first = per.where(needed > 0).select("node", "n", alone.alias("alone"), F.posexplode(F.slice("l", 1, needed.cast("int"))).alias("at", "e"))
    first = cut(first.select(F.col("e.key").alias("key"), "node", "n", (F.col("at") + F.col("alone")).alias("at")))
    return cut(first.join(first.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("key"), "key"))


def _crossed(members: DataFrame, about: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a < b) of nodes in different components that meet in a list (key, node, n, at, part)
    and may link; the join gives no others. Members of a list's largest component only wait for others."""
    by_part = members.groupBy("key", "part").agg(F.count(F.lit(1)).alias("c"))
    lists = by_part.groupBy("key").agg(F.max_by("part", F.struct("c", "part")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("key", "main")
    both = cut(members.join(lists, "key").join(about.select("node", "cells"), "node"))
    names = ("key", "node", "n", "at", "cells", "part")
    one = both.where("part != main").select(*[F.col(c).alias(f"a_{c}") for c in names])
    two = both.select(*[F.col(c).alias(f"b_{c}") for c in names], (F.col("part") == F.col("main")).alias("waits"))
    test = (F.col("a_key") == F.col("b_key")) & (F.col("a_part") != F.col("b_part")) & (F.col("waits") | (F.col("a_node") < F.col("b_node")))
    least = F.ceil(percent * (F.col("a_n") + F.col("b_n")) / (100 + percent))
    test = test & (F.col("a_at") <= F.col("a_n") - least) & (F.col("b_at") <= F.col("b_n") - least)
    test = test & _may_link(F.col("a_n"), F.col("b_n"), F.col("a_cells"), F.col("b_cells"), percent)
    return one.join(two, test).select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()


def _near(pairs: DataFrame, about: DataFrame, percent: int) -> DataFrame:
    left = about.select(F.col("node").alias("a"), F.col("size").alias("an"), F.col("cells").alias("ac"))
    right = about.select(F.col("node").alias("b"), F.col("size").alias("bn"), F.col("cells").alias("bc"))
    both = pairs.join(right, "b").join(left, "a")
    return both.where(_may_link(F.col("an"), F.col("bn"), F.col("ac"), F.col("bc"), percent)).select("a", "b")


def _chosen_rows(flags, bits: int, b: pa.RecordBatch) -> pa.RecordBatch:
    """Rows whose id's bit is set, or that have no id."""
    place = np.mod(pc.fill_null(b["doc_id"], 0).to_numpy(), bits)
    hit = pa.array((flags[place // 8] >> (place % 8).astype(np.uint8)) & 1 == 1)
    return b.filter(pc.or_(hit, b["doc_id"].is_null()))


def _entries(slim: DataFrame, classes: DataFrame, words: int, percent: int, bits: int) -> DataFrame:
    """(key, node, n, at) of the first elements of each class (node, n, first), made from the row of its
    smallest id. A row that only shares a bit with such an id repeats its class's entries, which
    makes no new pair."""
    flags = slim.sparkSession.sparkContext.broadcast(_bitmap(classes, bits))  # bits / 8 bytes
    least = classes.agg(F.min("n")).first()[0] or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = flags.value
        for b in batches:
            for _, part in _slices(_chosen_rows(mask, bits, b)):
                sets = [s for s in (shingle_set(t, words) for t in part) if len(s) >= least]
                keys = [s[: written_length(len(s), percent)].view(np.int64) for s in sets]
                if keys:
                    sizes = [len(k) for k in keys]
                    at = np.concatenate([np.arange(n) for n in sizes])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(np.array([_class(s) for s in sets]), sizes)), pa.array(np.repeat(np.array([len(s) for s in sets]), sizes)), pa.array(at.astype(np.int32))], ["key", "node", "n", "at"])

    return slim.mapInArrow(run, "key long, node long, n long, at int")


def _whole_sets(slim: DataFrame, wanted: DataFrame, words: int, bits: int) -> DataFrame:
    """(node, elements, busy) of the wanted (node, busy, first), made again from the texts.

    Each class is read from the row of its smallest id. A bit for each hashed id lets most other
    rows go before they are shuffled; ids that share a bit only cost time.
    """
    wanted = cut(wanted)
    flags = slim.sparkSession.sparkContext.broadcast(_bitmap(wanted, bits))  # bits / 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = flags.value
        for b in batches:
            b = _chosen_rows(mask, bits, b)
            for start, part in _slices(b):
                sets = [shingle_set(t, words) for t in part]
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(start, len(part)), pa.array([_class(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "made", "elements"])

    made = slim.mapInArrow(run, "doc_id long, made long, elements binary")
    # rows of equal texts that share a bit give the same set again: one is kept, without a further shuffle
    return cut(made.join(wanted, F.col("made") == F.col("node")).select("node", "busy", "elements").dropDuplicates(["node"]))
