"""Near-duplicate vectors by a robust-pruned flat graph.

Vectors of one label are grouped into cluster shards: a group with more than ``shard_rows`` vectors
is split by centroids fitted on a sample of it, again and again. Shards overlap: each vector has
one home, the shard of its nearest centroid, and is a guest in every other shard whose side of the
dividing plane is within ``margin`` times the link distance. Where splitting doesn't pay (a clump
of near copies would be a guest everywhere) the group is dealt into blocks by hash, and each block
of homes is searched for in each block of the group.

Per shard a graph is built: vectors are inserted in batches, each finds its neighbourhood by a
beam search from the shard's medoids, robust pruning keeps at most ``degree`` of what it met, and
the kept ones link back. A vector's lists from all its shards, out and in, are united. Then every
home vector is searched for in its shard, from the medoids and from itself; once a node within
range is met, everything within ``widen`` times the range that hangs together with it is walked
through. What the walk finds within range is verified by its exact cosine in double precision.

Links are counted at the home of each vector, and connections leave a shard as one edge a vector to
its local component's first node, so a group of copies never becomes a table of pairs. Components
of those edges are joined by the same steps as in ``jaccard``.

The graph's recall is audited: for ``audit_rows`` vectors, drawn by hash, links are counted by brute
force over all rows. If less than ``recall`` of them were found, graphs are built and searched
again with a beam and a margin twice as wide, up to ``rounds`` times. The last audit is in ``Links.found_share``.

Defined cases: vectors that are null, empty, zero or hold null or non-finite numbers, and rows
without a label, link with nothing and are a component of their own; equal vectors of a label
are one node with a number of copies, all linked with each other; vectors of different lengths
never link; vectors on one ray are one graph node, verified one by one; a null id takes part, its
component is the smallest other id or null, and it is kept if that is null; rows that repeat an
id get a result each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut, discard
from lectern.llm.jaccard import components
from lectern.llm.neighbours import kmeans, scaled, unit


@dataclass(frozen=True)
class Shape:
    """How graphs are built and walked."""

    degree: int = 24
    beam: int = 48
    alpha: float = 1.2
    widen: float = 1.25
    batch: int = 256


def beam_search(rows: np.ndarray, adjacency: np.ndarray, starts: np.ndarray, asked: np.ndarray, beam: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(ids, cosines) of the ``beam`` best nodes met for each of ``asked``, best first (id -1: fewer were met). ``rows`` are
    unit vectors followed by one row of zeros, ``adjacency`` holds len(rows) - 1 where there is no neighbour."""
    none, many = len(rows) - 1, len(asked)
    starts = starts[:beam]
    ids = np.full((many, beam), -1)
    near = np.full((many, beam), -np.inf, np.float32)
    ids[:, : len(starts)], near[:, : len(starts)] = starts, asked @ rows[starts].T
    order = np.argsort(-near, axis=1, kind="stable")
    ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
    done = ids < 0
    seen = np.zeros((many, none + 1), bool)
    seen[:, starts] = seen[:, none] = True
    while len(active := np.flatnonzero(~done.all(axis=1))):
        part = active[:, None]
        pick = np.argsort(done[active], axis=1, kind="stable")[:, :width]  # the best that are not expanded
        taken = np.where(done[part, pick], none, ids[part, pick])
        done[part, pick] = True
        met = np.where((taken == none)[:, :, None], none, adjacency[np.minimum(taken, none - 1)]).reshape(len(active), -1)
        met.sort(axis=1)
        fresh = ~seen[part, met]
        fresh[:, 1:] &= met[:, 1:] != met[:, :-1]
        seen[part, met] = True
        at, to = np.nonzero(fresh)
        score = np.full(met.shape, -np.inf, np.float32)
        score[at, to] = np.einsum("ij,ij->i", asked[active[at]], rows[met[at, to]])
        all_ids = np.concatenate([ids[active], np.where(fresh, met, -1)], axis=1)
        all_near = np.concatenate([near[active], score], axis=1)
        all_done = np.concatenate([done[active], ~fresh], axis=1)
        order = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
        ids[active], near[active], done[active] = (np.take_along_axis(x, order, 1) for x in (all_ids, all_near, all_done))
    return ids, near


def robust_prune(rows: np.ndarray, ids: np.ndarray, near: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most ``degree`` of each row of candidates ``ids`` (-1: none) with cosines ``near``: the nearest is kept, and candidates
    that are ``alpha`` times nearer to it than to the centre go; and so on. Empty places hold len(rows) - 1."""
    many, line = len(ids), np.arange(len(ids))
    vectors = rows[ids]
    apart = 2 - 2 * vectors @ vectors.transpose(0, 2, 1)
    far = np.where(ids >= 0, 2 - 2 * near, np.inf)
    out = np.full((many, degree), len(rows) - 1)
    alive = ids >= 0
    for k in range(degree):
        left = np.where(alive, far, np.inf)
        best = left.argmin(axis=1)
        some = alive[line, best]
        if not some.any():
            break
        out[some, k] = ids[line, best][some]
        alive &= alpha * alpha * apart[line, best] > far
        alive[line, best] = False
    return out


def _merge(first: tuple[np.ndarray, np.ndarray], ids: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidates of both without repeats."""
    ids, near = np.concatenate([first[0], ids], axis=1), np.concatenate([first[1], near], axis=1)
    order = np.argsort(ids, axis=1, kind="stable")
    ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
    again = np.zeros(ids.shape, bool)
    again[:, 1:] = ids[:, 1:] == ids[:, :-1]
    return np.where(again, -1, ids), near


def medoids(rows: np.ndarray, most: int = 16) -> np.ndarray:
    """Nodes nearest to the centres of a few clusters, the first of them that of all rows."""
    centres = np.concatenate([rows.mean(axis=0, keepdims=True), kmeans(rows[:: max(1, len(rows) // 2048)].astype(np.float64), most, 4).astype(np.float32)])
    picked = (rows @ centres.T).argmax(axis=0)
    return picked[np.sort(np.unique(picked, return_index=True)[1])]


def build(rows: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """(adjacency, medoids) of a robust-pruned graph over unit vectors ``rows``; len(rows) marks an empty place."""
    n = len(rows)
    padded = np.concatenate([rows, np.zeros((1, rows.shape[1]), rows.dtype)])
    adjacency = np.full((n, shape.degree), n)
    starts = medoids(rows)
    order = np.random.default_rng(7).permutation(n)
    order = np.concatenate([starts, order[~np.isin(order, starts)]])
    at = 0
    while at < n:
        size = max(len(starts), min(shape.batch, at // 4))
        batch, at = order[at : at + size], at + size
        asked = rows[batch]
        found = beam_search(padded, adjacency, starts, asked, shape.beam) if at > size else (np.full((len(batch), 1), -1), np.full((len(batch), 1), -np.inf, np.float32))
        # those that come together see each other
        among = asked @ asked.T
        np.fill_diagonal(among, -np.inf)
        few = np.argsort(-among, axis=1, kind="stable")[:, : min(16, len(batch) - 1)]
        ids, near = _merge(found, batch[few], np.take_along_axis(among, few, 1))
        ids = np.where(ids == batch[:, None], -1, ids)
        kept = robust_prune(padded, ids, near, shape.degree, shape.alpha)
        adjacency[batch] = kept
        _link_back(padded, adjacency, batch, kept, shape)
    return adjacency, starts


def _link_back(padded: np.ndarray, adjacency: np.ndarray, batch: np.ndarray, kept: np.ndarray, shape: Shape) -> None:
    """Edges from the kept neighbours to the nodes of the batch; full lists are pruned again."""
    n, degree = len(adjacency), shape.degree
    to, of = kept.ravel(), np.repeat(batch, kept.shape[1])
    to, of = to[to < n], of[to < n]
    order = np.argsort(to, kind="stable")
    to, of = to[order], of[order]
    targets, first, many = np.unique(to, return_index=True, return_counts=True)
    held = (adjacency[targets] < n).sum(axis=1)
    for room in (True, False):
        mine = np.flatnonzero((held + many <= degree) == room)
        mine = mine[np.argsort(many[mine], kind="stable")]
        for s in range(0, len(mine), 64):
            part = mine[s : s + 64]
            ids = np.full((len(part), degree + many[part].max()), -1)
            old = adjacency[targets[part]]
            ids[:, :degree] = np.where(old < n, old, -1)
            for i, p in enumerate(part):
                ids[i, degree : degree + many[p]] = of[first[p] : first[p] + many[p]]
            near = np.einsum("id,ikd->ik", padded[targets[part]], padded[ids])
            ids, near = _merge((ids, near), ids[:, :0], near[:, :0])
            near[ids < 0] = -np.inf
            if room:
                order = np.argsort(-near, axis=1, kind="stable")[:, :degree]
                best = np.take_along_axis(ids, order, 1)
                best = np.pad(best, ((0, 0), (0, degree - best.shape[1])), constant_values=-1)
                adjacency[targets[part]] = np.where(best < 0, n, best)
            else:
                adjacency[targets[part]] = robust_prune(padded, ids, near, degree, shape.alpha)


def rays(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each ray, ray of each row): unit vectors that agree to five digits are one graph node."""
    keys = np.ascontiguousarray(np.round(rows, 5) + 0.0).view(f"V{rows.shape[1] * rows.itemsize}").ravel()
    _, first, ray = np.unique(keys, return_index=True, return_inverse=True)
    order = np.argsort(first)
    rank = np.empty(len(first), np.int64)
    rank[order] = np.arange(len(first))
    return first[order], rank[ray]


def both_ways(adjacency: np.ndarray) -> list[np.ndarray]:
    """Each node's neighbours, out and in."""
    n = len(adjacency)
    of, to = np.repeat(np.arange(n), adjacency.shape[1]), adjacency.ravel()
    of, to = of[to < n], to[to < n]
    code = np.unique(np.concatenate([of * n + to, to * n + of]))
    return np.split(code % n, np.searchsorted(code // n, np.arange(1, n)))


class Walk:
    """A shard's united graph, ready to be searched. ``rows``: original vectors; ``lists``: neighbours of each row, or none."""

    def __init__(self, rows: np.ndarray, lists: list[np.ndarray], shape: Shape):
        self.shape, self.exact = shape, scaled(rows)
        self.norms = np.sqrt(np.einsum("ij,ij->i", self.exact, self.exact))
        whole = unit(rows).astype(np.float32)
        self.first, self.ray = rays(whole)
        self.rows = whole[self.first]
        n = len(self.rows)
        sizes = np.array([len(x) for x in lists])
        of, to = np.repeat(self.ray, sizes), self.ray[np.concatenate(lists)] if sizes.sum() else np.empty(0, np.int64)
        code = np.unique((of * n + to)[of != to])
        self.to, self.at = code % n, np.searchsorted(code // n, np.arange(n + 1))
        self.members, self.member_at = np.argsort(self.ray, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(self.ray, minlength=n))])
        # the beam reads the nearest of each list
        wide = min(max(1, int(np.diff(self.at).max(initial=0))), 2 * shape.degree)
        self.padded = np.concatenate([self.rows, np.zeros((1, self.rows.shape[1]), np.float32)])
        self.adjacency = np.full((n, wide), n)
        for i in range(n):
            mine = self.to[self.at[i] : self.at[i + 1]]
            if len(mine) > wide:
                mine = mine[np.argsort(-(self.rows[mine] @ self.rows[i]), kind="stable")[:wide]]
            self.adjacency[i, : len(mine)] = mine
        self.starts = medoids(self.rows)

    def _slices(self, keys: np.ndarray, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        sizes = at[keys + 1] - at[keys]
        return values[np.repeat(at[keys] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())] if len(keys) else np.empty(0, np.int64)

    def within(self, vectors: np.ndarray, own: np.ndarray, threshold: float) -> Iterator[np.ndarray]:
        """For each of ``vectors`` (its row in the shard, or -1, is ``own``) the rows found with a cosine of ``threshold`` or more."""
        chord = 2 - 2 * threshold
        reach, wide = 1 - (chord + 1e-4) / 2, 1 - self.shape.widen**2 * chord / 2
        exact, asked = scaled(vectors), unit(vectors).astype(np.float32)
        norms = np.sqrt(np.einsum("ij,ij->i", exact, exact))
        for s in range(0, len(asked), self.shape.batch):
            ids, near = beam_search(self.padded, self.adjacency, self.starts, asked[s : s + self.shape.batch], self.shape.beam)
            for i in range(len(ids)):
                q = s + i
                front = ids[i][(ids[i] >= 0) & (near[i] >= wide)]
                if own[q] >= 0:
                    front = np.union1d(front, self.ray[own[q]])
                seen = np.zeros(len(self.rows), bool)
                seen[front] = True
                met = [front]
                while len(front):
                    near_by = np.unique(self._slices(front, self.at, self.to))
                    near_by = near_by[~seen[near_by]]
                    seen[near_by] = True
                    front = near_by[self.rows[near_by] @ asked[q] >= wide]
                    met.append(front)
                met = np.concatenate(met)
                rows = self._slices(met[self.rows[met] @ asked[q] >= reach], self.member_at, self.members)
                cosine = np.einsum("ij,j->i", self.exact[rows], exact[q]) / (self.norms[rows] * norms[q])
                yield rows[(cosine >= threshold) & (rows != own[q])]


class Sets:
    """Components of numbered nodes, joined a whole set at a time."""

    def __init__(self, n: int):
        self.part = np.arange(n)

    def join(self, nodes: np.ndarray) -> None:
        parts = np.unique(self.part[nodes])
        if len(parts) > 1:
            self.part[np.isin(self.part, parts)] = parts[0]


def _key(*columns: Column | str) -> Column:
    return F.xxhash64(*columns)


def _nodes(slim: DataFrame) -> DataFrame:
    """(grp, node, vec, copies, first): distinct vectors of each label and length."""
    return slim.groupBy("grp", "node").agg(F.any_value("vec").alias("vec"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("first"))


def _split(members: DataFrame, large: DataFrame, level: int, shard_rows: int, fit_rows: int, reach: float) -> DataFrame:
    """The members of large groups (grp, c) as members of child groups: (parent, grp, node, vec, copies, home)."""
    kind = members.schema["vec"].dataType.simpleString()
    some = F.pmod(_key("node", F.lit(level)), F.lit(1 << 30)) < F.ceil(F.lit(float(fit_rows << 30)) / F.col("c"))
    sample = members.where("home").join(large, "grp").where(some).select("grp", "c", "node", "vec")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node", kind="stable")
        k = int(min(32, max(2, -(-2 * group["c"].iloc[0] // shard_rows))))
        centres = kmeans(unit(np.stack(group["vec"].to_numpy()).astype(np.float64)), k, 8)
        return pd.DataFrame({"grp": [group["grp"].iloc[0]], "centres": [[list(c) for c in centres]]})

    centres = cut(sample.groupBy("grp").applyInPandas(fit, "grp long, centres array<array<double>>"))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for grp, part in b.groupby("grp", sort=True):
                own = np.stack([np.asarray(c, np.float64) for c in part["centres"].iloc[0]])
                rows = unit(np.stack(part["vec"].to_numpy()).astype(np.float64))
                far = np.maximum(0, (rows**2).sum(1)[:, None] - 2 * rows @ own.T + (own**2).sum(1)[None])
                best = far.argmin(axis=1)
                between = np.sqrt(np.maximum(((own[:, None] - own[None]) ** 2).sum(-1), 1e-18))
                plane = (far - far.min(axis=1, keepdims=True)) / (2 * between[best])  # distance to the plane that divides the two
                at, child = np.nonzero((plane <= reach) | (np.arange(len(own)) == best[:, None]))
                out = part.iloc[at][["grp", "node", "vec", "copies", "home"]].rename(columns={"grp": "parent"})
                yield out.assign(child=child.astype(np.int32), home=out["home"].to_numpy() & (child == best[at]))

    both = members.join(centres, "grp").select("grp", "node", "vec", "copies", "home", "centres")
    dealt = both.mapInPandas(deal, f"parent long, node long, vec {kind}, copies long, home boolean, child int")
    return dealt.select("parent", _key("parent", "child", F.lit(level)).alias("grp"), "node", "vec", "copies", "home")


def shards(nodes: DataFrame, shard_rows: int, fit_rows: int, reach: float, levels: int = 12) -> DataFrame:
    """(grp, node, vec, copies, home, blocks): members of the final groups; those of more than one block are dealt by hash."""
    done, members = [], nodes.select("grp", "node", "vec", "copies", F.lit(True).alias("home"))
    for level in range(levels):
        counts = cut(members.groupBy("grp").agg(F.count(F.lit(1)).alias("c")))
        large = counts.where(F.col("c") > shard_rows)
        if not large.limit(1).count():
            break
        children = cut(_split(members, large, level, shard_rows, fit_rows, reach))
        # splitting pays if the shards' squares are less than the group's by half, and none is as large as the group
        sizes = children.groupBy("parent", "grp").agg(F.count(F.lit(1)).alias("n")).groupBy("parent").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("work"), F.max("n").alias("most"))
        pays = cut(sizes.join(large, F.col("parent") == F.col("grp")).where((F.col("work") < F.col("c").cast("double") * F.col("c") / 2) & (F.col("most") < 0.9 * F.col("c"))).select("parent"))
        done.append(members.join(pays, F.col("grp") == F.col("parent"), "left_anti"))
        members = children.join(pays, "parent", "left_semi").select("grp", "node", "vec", "copies", "home")
    done.append(members)
    whole = done[0]
    for d in done[1:]:
        whole = whole.unionByName(d)
    whole = cut(whole)
    counts = whole.groupBy("grp").agg(F.count(F.lit(1)).alias("c"))
    return whole.join(counts, "grp").select("grp", "node", "vec", "copies", "home", F.ceil(F.col("c") / shard_rows).cast("int").alias("blocks"))


def _block(blocks: str) -> Column:
    return F.pmod(_key("node", F.lit(5)), F.col(blocks)).cast("int")


def united(members: DataFrame, shape: Shape) -> DataFrame:
    """(node, lists): neighbours of each node in the graphs of all its shards (grp, block)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node", kind="stable").reset_index(drop=True)
        whole = unit(np.stack(group["vec"].to_numpy()).astype(np.float64)).astype(np.float32)
        first, _ = rays(whole)
        names = group["node"].to_numpy()[first]
        adjacency, _ = build(whole[first], shape)
        return pd.DataFrame({"node": names, "lists": [names[x] for x in both_ways(adjacency)]})

    built = members.groupBy("grp", "block").applyInPandas(run, "node long, lists array<long>")
    return built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("lists"))).alias("lists"))


def _searched(members: DataFrame, lists: DataFrame, threshold: float, shape: Shape) -> DataFrame:
    """(node, links, root): links found for home vectors, copies counted, and edges (node, root) of local components."""
    held = members.join(lists, "node", "left").select("grp", "block", "node", "vec", "copies", "lists", "blocks")
    held = held.withColumn("asking", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = members.where("home").withColumn("against", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = asked.select(F.col("grp").alias("of"), F.col("block").alias("by"), F.col("against").alias("at"), F.col("node").alias("asks"), F.col("vec").alias("like"))

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"node": np.empty(0, np.int64), "links": np.empty(0, np.int64), "root": np.empty(0, np.int64)})
        left, right = (x.sort_values(c, kind="stable").reset_index(drop=True) for x, c in ((left, "asks"), (right, "node")))
        names, copies, asks = right["node"].to_numpy(), right["copies"].to_numpy(), left["asks"].to_numpy()
        place = lambda x: np.minimum(np.searchsorted(names, x), len(names) - 1)
        near = []
        for x in right["lists"]:
            x = np.asarray(x, np.int64) if x is not None else np.empty(0, np.int64)
            p = place(x)
            near.append(p[names[p] == x])
        walk = Walk(np.stack(right["vec"].to_numpy()).astype(np.float64), near, shape)
        own = place(asks)
        own = np.where(names[own] == asks, own, -1)
        # nodes of the shard, then askers from other blocks
        number = np.where(own >= 0, own, len(names) + np.arange(len(asks)))
        sets, links = Sets(len(names) + len(asks)), np.zeros(len(asks), np.int64)
        for i, found in enumerate(walk.within(np.stack(left["like"].to_numpy()).astype(np.float64), own, threshold)):
            links[i] = copies[found].sum()
            sets.join(np.append(found, number[i]))
        every = np.concatenate([names, asks])
        joined = np.flatnonzero(sets.part != np.arange(len(every)))
        node, root = every[joined], every[sets.part[joined]]
        return pd.DataFrame({"node": np.concatenate([asks, node]), "links": np.concatenate([links, np.full(len(node), -1)]), "root": np.concatenate([asks, root])})

    return asked.groupBy("of", "at", "by").cogroup(held.groupBy("grp", "block", "asking")).applyInPandas(run, "node long, links long, root long")


def _audited(nodes: DataFrame, found: DataFrame, threshold: float, audit_rows: int) -> float:
    """Share of the true links of ``audit_rows`` nodes, drawn by hash, that were found; brute force over all nodes."""
    some = nodes.orderBy(_key("node", F.lit(9)), "node").limit(audit_rows).select("grp", "node", "vec").collect()
    groups: dict[int, list] = {}
    for r in some:
        groups.setdefault(r["grp"], []).append(r)
    asked = {g: (np.array([r["node"] for r in rows]), np.array([r["vec"] for r in rows], np.float64)) for g, rows in groups.items()}
    shared = nodes.sparkSession.sparkContext.broadcast(asked)  # audit_rows vectors

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for b in batches:
            for grp, part in b.groupby("grp"):
                if grp in own:
                    names, vectors = own[grp]
                    linked = unit(vectors) @ unit(np.stack(part["vec"].to_numpy()).astype(np.float64)).T >= threshold
                    linked &= names[:, None] != part["node"].to_numpy()[None]
                    yield pd.DataFrame({"node": names, "truth": (linked * part["copies"].to_numpy()[None]).sum(axis=1)})

    truth = nodes.select("grp", "node", "vec", "copies").mapInPandas(count, "node long, truth long").groupBy("node").agg(F.sum("truth").alias("truth"))
    r = truth.join(found, "node", "left").agg(F.sum("truth").alias("truth"), F.sum(F.least("truth", F.coalesce("links", F.lit(0)))).alias("got")).first()
    return float(r["got"] / r["truth"]) if r["truth"] else 1.0


@dataclass(frozen=True)
class Links:
    """``rows``: one row a vector; ``found_share``: of the audited links, those that the graph found."""

    rows: DataFrame
    found_share: float


def graph_links(vectors: DataFrame, threshold: float = 0.98, shard_rows: int = 8192, fit_rows: int = 4096, margin: float = 0.5, recall: float = 0.99, audit_rows: int = 2048, rounds: int = 3, shape: Shape = Shape(), id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> Links:
    """Links of cosine ``threshold`` or more between vectors of equal labels: id, n_links, component_id, kept."""
    vec = F.col(vec_col)
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col(label_col).isNotNull() & (F.size(vec) > 0) & finite & F.exists(vec, lambda x: x != 0), F.lit(False))
    grp = _key(F.col(label_col), F.size(vec))
    slim = vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"), F.when(usable, grp).alias("grp"), F.when(usable, _key(grp, vec)).alias("node"))
    nodes = cut(_nodes(slim.where("node is not null")))
    share = 1.0
    for turn in range(rounds):
        reach = min(1.0, margin * 2**turn) * float(np.sqrt(2 - 2 * threshold))
        wider = Shape(shape.degree, shape.beam << turn, shape.alpha, shape.widen, shape.batch)
        members = cut(shards(nodes, shard_rows, fit_rows, reach).withColumn("block", _block("blocks")))
        lists = cut(united(members, wider))
        found = cut(_searched(members, lists, threshold, wider))
        links = cut(found.where("links >= 0").groupBy("node").agg(F.sum("links").alias("links")))
        share = _audited(nodes, links, threshold, audit_rows)
        discard(members)
        discard(lists)
        if share >= recall:
            break
    parts = components(found.where("links < 0").select(F.col("node").alias("a"), F.col("root").alias("b")))
    told = nodes.select("node", "copies", "first").join(links, "node", "left").join(parts, "node", "left")
    told = told.select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("part", "node").alias("part"), "first")
    smallest = told.groupBy("part").agg(F.min("first").alias("component_id"))
    told = cut(told.join(smallest, "part").select(F.col("node").alias("of"), "n_links", "component_id"))
    out = slim.select("id", "node").join(told, F.col("node") == F.col("of"), "left")
    component = F.when(F.col("of").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
    return Links(out, share)
