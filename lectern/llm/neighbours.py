"""Approximate nearest neighbours by an inverted multi-index.

Both halves of the (unit-length) vectors are quantised on their own; a pair of centroids is a
cell. A query walks the pairs in order of summed distance with a heap until the cells it has met
hold enough rows, and the vectors of those cells are reranked by exact cosine in double
precision. How many rows are enough is measured: for some ``tuning`` queries the true neighbours
are found by brute force, in blocks, and the walk must reach ``recall`` of them. Vectors without
structure need long walks, vectors in clusters short ones.

Cells are packed into shards of about ``shard_rows`` rows, and a larger cell is split over several
by hash, so a cell that holds a third of all rows is read by many tasks. Queries go to the shards
of their cells in blocks of about ``query_rows`` from neighbouring cells; in a pair of blocks a query is
multiplied with the rows of its own cells only. Each pair returns its best few per query and a
ranking keeps the best of those.

Codebooks are fitted on a bounded sample (``sample_rows``); every row is indexed. Only codebooks
and cell sizes (centroids squared numbers) go to the tasks whole; their bound is ``MOST_CENTROIDS``
centroids of a half, and tables of more than 5.9 million rows have larger cells instead of more.

Defined cases: vectors that are null, empty, zero, of another length than most, or hold null or
non-finite numbers take no part, neither as queries nor as candidates; a query never finds the
row it stands for; ties go to the smaller id; equal vectors are candidates of their own; with
fewer candidates than asked all are returned; an empty table gives an empty result; extra
columns are ignored; rows that repeat an id are one candidate each.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import cut


def usable(vec: Column, width: int) -> Column:
    """Vectors that can take part: right length, all numbers finite, not all zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vec) == width) & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # before squaring: no overflow, no underflow
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def kmeans(rows: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    distinct = np.unique(rows, axis=0)
    k = min(k, len(distinct))
    centres = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        near = _distances(rows, centres).argmin(axis=1)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
        if (~full).any():
            centres[~full] = distinct[rng.choice(len(distinct), int((~full).sum()))]
    return centres


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0, (rows**2).sum(1)[:, None] - 2 * rows @ centres.T + (centres**2).sum(1)[None])


class MultiIndex:
    """Two codebooks; cells are numbered first * size of the second + second."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second = first, second
        self.half = first.shape[1]

    def cells(self, rows: np.ndarray) -> np.ndarray:
        a = _distances(rows[:, : self.half], self.first).argmin(axis=1)
        b = _distances(rows[:, self.half :], self.second).argmin(axis=1)
        return a * len(self.second) + b

    def walk(self, row: np.ndarray) -> Iterator[int]:
        """Cells by summed distance of their two centroids, nearest first."""
        da = _distances(row[None, : self.half], self.first)[0]
        db = _distances(row[None, self.half :], self.second)[0]
        oa, ob = np.argsort(da, kind="stable"), np.argsort(db, kind="stable")
        heap, seen = [(da[oa[0]] + db[ob[0]], 0, 0)], {(0, 0)}
        while heap:
            _, i, j = heapq.heappop(heap)
            yield int(oa[i]) * len(self.second) + int(ob[j])
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(oa) and y < len(ob) and (x, y) not in seen:
                    seen.add((x, y))
                    heapq.heappush(heap, (da[oa[x]] + db[ob[y]], x, y))


def fit(vectors: DataFrame, vec_col: str, centroids: int, sample_rows: int) -> MultiIndex | None:
    """Codebooks from at most ``sample_rows`` rows, drawn by hash of the vector."""
    got = vectors.select(vec_col).orderBy(F.xxhash64(vec_col)).limit(sample_rows).collect()
    if not got:
        return None
    rows = unit(np.array([r[0] for r in got], np.float64))
    half = max(1, rows.shape[1] // 2)
    return MultiIndex(kmeans(rows[:, :half], centroids), kmeans(rows[:, half:], centroids) if rows.shape[1] > 1 else np.zeros((1, 0)))


def _pack(sizes: dict[int, int], shard_rows: int) -> tuple[list[tuple[int, int, int]], int]:
    """(cell, its first shard, over how many shards) and the number of shards: small cells share one."""
    plan, shard, room = [], -1, 0
    for cell, n in sorted(sizes.items()):
        parts = -(-n // shard_rows)
        if parts > 1:
            plan.append((cell, shard + 1, parts))
            shard, room = shard + parts, 0
        else:
            if n > room:
                shard, room = shard + 1, shard_rows
            plan.append((cell, shard, 1))
            room -= n
    return plan, shard + 1


def _blocks(held: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score) of the k best for each query in each pair of blocks: ``held`` (shard, id,
    vec, cell) against ``asked`` (shard, block, query_id, vec, cells; null cells: all)."""
    asked = cut(asked)
    pairs = asked.select(F.col("shard").alias("at"), F.col("block").alias("with")).distinct()
    rows = held.join(pairs, F.col("shard") == F.col("at")).select("shard", F.col("with").alias("against"), "id", "vec", "cell")

    def rank(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "id": np.empty(0, np.int64), "score": np.empty(0)})
        right = right.sort_values(["cell", "id"], kind="stable")
        stored, asks = (np.stack(x["vec"].to_numpy()).astype(np.float64) for x in (right, left))
        cells, starts = np.unique(right["cell"].to_numpy(), return_index=True)
        wanted = np.stack([np.ones(len(cells), bool) if c is None else np.isin(cells, c) for c in left["cells"]])
        return best(left["query_id"].to_numpy(), asks, right["id"].to_numpy(), stored, k, starts, wanted)

    return asked.groupBy("shard", "block").cogroup(rows.groupBy("shard", "against")).applyInPandas(rank, "query_id long, id long, score double")


def _merged(found: DataFrame, k: int, id_col: str) -> DataFrame:
    # the limit on the rank is applied before and after the shuffle
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


#: Rows that an average cell is to hold, and the most centroids a half may have: cell sizes are collected.
PER_CELL, MOST_CENTROIDS = 90, 256


def centroids_for(rows: int) -> int:
    """Centroids of a half: their square, the number of cells, grows with the table."""
    return int(min(MOST_CENTROIDS, max(8, round((rows / PER_CELL) ** 0.5))))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, centroids: int | None = None, recall: float = 0.96, tuning: int = 128, least: int = 1000, sample_rows: int = 20_000, shard_rows: int = 8192, query_rows: int = 2048, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score) of the ``k`` nearest rows found for each query row. ``centroids`` of a half: by default
    as many as the table's size asks for."""
    spark = vectors.sparkSession
    slim = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("id is not null")
    # the commonest length is the table's; ties to the longer
    top = slim.where("size(vec) > 0").groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    width = top["n"] if top else 0
    slim = slim.where(usable(F.col("vec"), width))
    index = fit(slim, "vec", centroids or centroids_for(slim.count()), sample_rows) if width else None
    if index is None:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    shared = spark.sparkContext.broadcast(index)  # 2 * centroids rows
    kind = slim.schema["vec"].dataType.simpleString()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for b in batches:
            b["cell"] = own.cells(unit(np.stack(b["vec"].to_numpy()).astype(np.float64))).astype(np.int32) if len(b) else np.empty(0, np.int32)
            yield b

    placed = cut(slim.mapInPandas(place, f"id long, vec {kind}, asks boolean, cell int"))
    sizes = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}  # centroids squared at most
    plan, shards = _pack(sizes, shard_rows)
    at = spark.createDataFrame(plan, "cell int, shard int, parts int")  # one row a cell
    held = placed.join(F.broadcast(at), "cell").select((F.col("shard") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("shard"), "id", "vec", "cell")
    enough = _enough(placed, held, shards, index, sizes, k, recall, tuning, least)
    known = spark.sparkContext.broadcast((sizes, {c: (s, n) for c, s, n in plan}))
    # queries of neighbouring cells meet the same shards: they make a block
    asking = {r["cell"]: r["count"] for r in placed.where("asks").groupBy("cell").count().collect()}
    blocks = spark.createDataFrame(_pack(asking, query_rows)[0], "cell int, block int, parts int")  # one row a cell

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, (many, shard_of) = shared.value, known.value
        for b in batches:
            rows = []
            for q, v, block in zip(b["id"], b["vec"], b["block"], strict=True):
                by_shard: dict[int, list[int]] = {}
                met = 0
                for cell in own.walk(unit(np.asarray(v, np.float64)[None])[0]):
                    if n := many.get(cell, 0):
                        first, parts = shard_of[cell]
                        for s in range(first, first + parts):
                            by_shard.setdefault(s, []).append(cell)
                        met += n
                        if met >= enough:
                            break
                rows += [(s, block, q, v, cells) for s, cells in by_shard.items()]
            yield pd.DataFrame(rows, columns=["shard", "block", "query_id", "vec", "cells"])

    asks = placed.where("asks").join(F.broadcast(blocks), "cell").select("id", "vec", (F.col("block") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("block"))
    asked = asks.mapInPandas(probe, f"shard int, block int, query_id long, vec {kind}, cells array<int>")
    return _merged(_blocks(held, asked, k), k, id_col)


def _enough(placed: DataFrame, held: DataFrame, shards: int, index: MultiIndex, sizes: dict[int, int], k: int, recall: float, tuning: int, least: int) -> int:
    """Rows that a walk must meet so that ``recall`` of the true neighbours of ``tuning`` queries lie in its cells."""
    asks = placed.where("asks").orderBy(F.xxhash64("id", F.lit(1)), "id").limit(tuning).select("id", "vec")
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    asked = asks.select(everywhere.alias("shard"), F.lit(0).alias("block"), F.col("id").alias("query_id"), "vec", F.lit(None).cast("array<int>").alias("cells"))
    truth = _merged(_blocks(held, asked, k), k, "id").join(placed.select("id", "cell"), "id").select("query_id", "cell").collect()  # tuning * k rows
    vec = {r["id"]: r["vec"] for r in asks.collect()}
    needed = []
    for q in {r["query_id"] for r in truth}:
        wanted = [r["cell"] for r in truth if r["query_id"] == q]
        met = 0
        for cell in index.walk(unit(np.asarray(vec[q], np.float64)[None])[0]):
            met += sizes.get(cell, 0)
            if cell in wanted:
                needed += [met] * wanted.count(cell)
                wanted = [c for c in wanted if c != cell]
                if not wanted:
                    break
    return max(least, int(np.quantile(needed, recall))) if needed else least


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest numbers near 1: exact, and no square overflows."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=-1, keepdims=True))[1])


def cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact cosines in double precision, each computed alone so that equal vectors score equally."""
    query, rows = scaled(query), scaled(rows)
    dot = np.einsum("ij,j->i", rows, query)
    return dot / (np.sqrt(np.einsum("ij,ij->i", rows, rows)) * np.sqrt(np.einsum("j,j->", query, query)))


def products(queries: np.ndarray, rows: np.ndarray, starts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Products of queries and rows, cell by cell: only those that a query wants (queries x cells) are multiplied, the others
    are -inf. ``rows`` are sorted by cell, ``starts`` tells where each begins."""
    out = np.full((len(queries), len(rows)), -np.inf)
    for c, (s, e) in enumerate(zip(starts, [*starts[1:], len(rows)], strict=True)):
        mine = np.flatnonzero(wanted[:, c])
        out[mine, s:e] = queries[mine] @ rows[s:e].T
    return out


def best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, starts: np.ndarray, wanted: np.ndarray) -> pd.DataFrame:
    """The k best of ``rows`` for each query, by cosine, then smaller id; ``starts`` and ``wanted`` as in ``products``."""
    q_out, i_out, s_out = [], [], []
    rough = products(unit(queries), unit(rows), starts, wanted)
    for n, q in enumerate(query_ids):
        score = np.where(ids != q, rough[n], -np.inf)
        keep = np.flatnonzero(score > -np.inf)
        if len(keep) > k:
            edge = np.partition(score, len(score) - k)[len(score) - k]
            keep = np.flatnonzero(score >= edge - 1e-9)  # rounding of the matrix product must lose no tie
        exact = cosines(queries[n], rows[keep])
        top = np.lexsort((ids[keep], -exact))[:k]
        q_out += [q] * len(top)
        i_out += ids[keep][top].tolist()
        s_out += exact[top].tolist()
    return pd.DataFrame({"query_id": np.array(q_out, np.int64), "id": np.array(i_out, np.int64), "score": np.array(s_out, np.float64)})
