"""Masked pseudo-likelihood: each word predicted from the words on both sides.

The vocabulary is counted over the whole corpus: the ``frequent`` commonest words are classes of
their own, all others fall by crc32 into ``buckets`` classes; a rare word's probability is its
class's times the word's counted share of the class. A network over a window of two words on
either side (embeddings, one hidden layer, and a softmax in two steps: first a group of classes,
then the class inside the group) starts from the counted shares of the classes and is trained in
numpy inside the tasks: every task passes over all words of all documents of its partition, and the
tasks' weights are averaged by Spark, weighted by words seen. Scoring sums the conditional
log-probabilities of all words of each whole text.

Counts meet the texts by blocks of ``BLOCK`` bytes of neighbouring rows: each block lists its
distinct words once, Spark joins these lists to the table of counts and brings each block's rows and
counts together. So neither texts nor tokens are joined, and no table of words has to fit anywhere.

A word that was not counted counts as one seen once. How rows are dealt to tasks decides which words
each task trains on, so weights are the same again only where the input is split the same way.

What goes to the driver and back is bounded: the frequent words, the buckets' counts and the
network's weights.

Defined cases: null or blank text has no words, sum 0 and null mean; rows that repeat each give a
row; an empty table gives an empty result; with nothing to train on the network gives the counted
shares; extra columns are ignored, also such as are named like the result's.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut

SIDE = 2  # words of context on either side
SHAPE = {"embedding": 12, "hidden": 32}
#: Bytes of text whose distinct words are counted and looked up together.
BLOCK = 24 << 20


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, block): rows as they lie, numbered by the bytes before them in their task; written, so that numbers stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, seen = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            before = seen + np.cumsum(sizes) - sizes
            seen += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([b["id"], b["text"], pa.array(first + before // BLOCK)], ["id", "text", "block"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return cut(slim.mapInArrow(run, "id long, text string, block long"))


def block_words(rows: DataFrame) -> DataFrame:
    """(block, word, n): how often each word occurs in each block of ``blocks``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []
        for b in batches:
            number = b["block"].to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1, [len(number)]])
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                if e > s:
                    if at is not None and number[s] != at:
                        yield _counted(at, parts)
                        parts = []
                    at = int(number[s])
                    for part in _slices(b["text"].slice(s, e - s)):
                        words, which, _ = coded(part)
                        parts.append((words, np.bincount(which, minlength=len(words))))
        if at is not None:
            yield _counted(at, parts)

    return cut(rows.mapInArrow(run, "block long, word binary, n long"))


def _counted(block: int, parts: list[tuple[pa.Array, np.ndarray]]) -> pa.RecordBatch:
    """The words of a block from those of its parts, with their counts there."""
    both = pa.concat_arrays([words for words, _ in parts]).dictionary_encode()
    n = np.bincount(both.indices.to_numpy(), np.concatenate([n for _, n in parts]), len(both.dictionary)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), block)), both.dictionary, pa.array(n)], ["block", "word", "n"])


class Vocabulary:
    """Classes of words: frequent ones in order, then crc32 buckets with their numbers of distinct words
    and of occurrences; ``inside`` is the log-probability of a word seen once given its class, ``weight``
    the occurrences of each class. ``counts`` (word, n) stays with Spark."""

    def __init__(self, frequent: list[bytes], often: list[int], types: list[int], totals: list[int], counts: DataFrame | None = None):
        self.frequent, self.often, self.types, self.totals, self.counts = frequent, often, types, totals, counts
        self.weight = np.array([*often, *totals], np.float64)
        self.inside = np.concatenate([np.zeros(len(frequent)), -np.log(np.maximum(1, np.array(totals, np.float64)))])

    def __getstate__(self):
        return self.frequent, self.often, self.types, self.totals

    def __setstate__(self, state):
        self.__init__(*state)

    @property
    def size(self) -> int:
        return len(self.frequent) + len(self.types)

    def classes(self, words: pa.Array) -> np.ndarray:
        """The class of each of the words (binary)."""
        known = pc.fill_null(pc.index_in(words, value_set=pa.array(self.frequent, pa.binary())), -1).to_numpy()
        bucket = np.fromiter(map(zlib.crc32, words.to_numpy(zero_copy_only=False)), np.int64, len(words)) % len(self.types)
        return np.where(known < 0, len(self.frequent) + bucket, known)


def count_vocabulary(docs: DataFrame, text_col: str = "text", frequent: int = 192, buckets: int = 64, words: DataFrame | None = None) -> Vocabulary:
    """Counts of all words of all texts (or of ``words``, if they are counted by block already); the table of counts stays distributed."""
    if words is None:
        words = block_words(blocks(docs.select(F.lit(0).alias("id"), text_col), "id", text_col))
    counts = cut(words.groupBy("word").agg(F.sum("n").alias("n")))
    top = counts.orderBy(F.desc("n"), "word").limit(frequent).collect()
    common = [bytes(r["word"]) for r in top]
    bucket = (F.crc32("word") % buckets).cast("int")
    rare = counts.where(~F.col("word").isin(common)) if common else counts
    found = {r["b"]: r for r in rare.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("types"), F.sum("n").alias("total")).collect()}
    types, totals = ([found[b][c] if b in found else 0 for b in range(buckets)] for c in ("types", "total"))
    return Vocabulary(common, [r["n"] for r in top], types, totals, counts)


class WindowNet:
    """Weights in one flat vector: embeddings of classes and the edge, hidden layer, groups, classes inside the groups."""

    def __init__(self, classes: int, flat: np.ndarray | None = None, seed: int = 11, weight: np.ndarray | None = None):
        d, h = SHAPE["embedding"], SHAPE["hidden"]
        m = int(np.ceil(np.sqrt(classes)))  # classes in a group
        g = -(-classes // m)
        self.classes, self.inner = classes, m
        self.parts = [(classes + 1, d), (2 * SIDE * d, h), (h,), (h, g), (g,), (g, h, m), (g, m)]
        self.flat = np.zeros(sum(int(np.prod(p)) for p in self.parts), np.float32)
        self.views = self.split(self.flat)
        if flat is not None:
            self.flat[:] = flat
            return
        rng = np.random.default_rng(seed)
        self.views[0][:], self.views[1][:] = rng.normal(0, 0.3, self.parts[0]), rng.normal(0, 1 / np.sqrt(2 * SIDE * d), self.parts[1])
        # without weights all classes are equally likely; places beyond the last class have no chance
        share = np.zeros(g * m)
        share[:classes] = 1.0 if weight is None else np.maximum(weight, 0.5)
        share = share.reshape(g, m)
        self.views[4][:] = np.log(share.sum(axis=1) / share.sum())
        self.views[6][:] = np.where(share > 0, np.log(np.maximum(share, 1e-30) / share.sum(axis=1, keepdims=True)), -1e9)

    def split(self, flat: np.ndarray) -> list[np.ndarray]:
        views, at = [], 0
        for p in self.parts:
            n = int(np.prod(p))
            views.append(flat[at : at + n].reshape(p))
            at += n
        return views

    def contexts(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Neighbour classes of each word; the edge class beyond a text's ends."""
        n = len(ids)
        lengths = lengths[lengths > 0]
        # texts one after the other with two edges between them
        start = np.cumsum(lengths) - lengths + SIDE * (1 + np.arange(len(lengths)))
        place = np.arange(n) + np.repeat(start - (np.cumsum(lengths) - lengths), lengths)
        row = np.full(n + SIDE * (len(lengths) + 1), self.classes, np.int32)
        row[place] = ids
        return row.take(place[:, None] + np.array([k for k in range(-SIDE, SIDE + 1) if k]))

    def hidden(self, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.views[0].take(ctx, axis=0).reshape(len(ctx), -1)
        h = x @ self.views[1]
        h += self.views[2]
        return x, np.tanh(h, out=h)

    @staticmethod
    def exp(z: np.ndarray) -> np.ndarray:
        """Replaces scores, of at most 60, by their exponentials; returns the rows' sums."""
        np.minimum(z, 60, out=z)
        np.exp(z, out=z)
        return z @ np.ones(z.shape[1], z.dtype)

    def pick(self, ctx: np.ndarray, ids: np.ndarray, out: np.ndarray | None, grad: list[np.ndarray] | None) -> None:
        """Log-probabilities of words in order of their classes into ``out``, sums of gradients of their loss into ``grad``."""
        emb, w1, _, wg, bg, wm, bm = self.views
        x, h = self.hidden(ctx)
        group = ids // self.inner
        member, each = ids - group * self.inner, np.arange(len(ids))
        z = h @ wg
        z += bg
        if out is not None:
            out[:] = np.minimum(z[each, group], 60)
        total = self.exp(z)
        if out is not None:
            out -= np.log(total)
        if grad is not None:
            z /= total[:, None]
            z[each, group] -= 1
            grad[3][:], grad[4][:] = h.T @ z, z.sum(axis=0)
            dh = z @ wg.T
            grad[5][:], grad[6][:] = 0, 0
        ends = np.searchsorted(group, np.arange(len(bg) + 1))
        for g in np.flatnonzero(np.diff(ends)):
            s = slice(ends[g], ends[g + 1])
            own, which, at = h[s], member[s], each[: ends[g + 1] - ends[g]]
            z = own @ wm[g]
            z += bm[g]
            if out is not None:
                out[s] += np.minimum(z[at, which], 60)
            total = self.exp(z)
            if out is not None:
                out[s] -= np.log(total)
            if grad is not None:
                z /= total[:, None]
                z[at, which] -= 1
                grad[5][g], grad[6][g] = own.T @ z, z.sum(axis=0)
                dh[s] += z @ wm[g].T
        if grad is not None:
            h *= h
            np.subtract(1, h, out=h)
            dh *= h
            grad[1][:], grad[2][:] = x.T @ dh, dh.sum(axis=0)
            at, dx = ctx.ravel(), np.ascontiguousarray((dh @ w1.T).reshape(-1, emb.shape[1]).T)
            for k, each in enumerate(dx):
                grad[0][:, k] = np.bincount(at, weights=each, minlength=len(emb))

    def log_probs(self, ids: np.ndarray, lengths: np.ndarray, chunk: int = 16384) -> np.ndarray:
        ctx, out = self.contexts(ids, lengths), np.empty(len(ids), np.float32)
        for s in range(0, len(ids), chunk):
            order = np.argsort(ids[s : s + chunk].astype(np.int16 if self.classes < 1 << 15 else np.int64), kind="stable") + s
            got = np.empty(len(order), np.float32)
            self.pick(ctx.take(order, axis=0), ids.take(order), got, None)
            out[order] = got
        return out.astype(np.float64)

    def learn(self, ids: np.ndarray, lengths: np.ndarray, square: np.ndarray, rate: float = 0.1, batch: int = 8192, seed: int = 1) -> None:
        """One pass of Adagrad over the words in random order. ``square``: sums of squared gradients."""
        ctx = self.contexts(ids, lengths)
        order = np.random.default_rng(seed).permutation(len(ids))
        grad = np.zeros_like(self.flat)
        views, small = self.split(grad), ids.astype(np.int16 if self.classes < 1 << 15 else np.int64)
        for s in range(0, len(order), batch):
            k = order[s : s + batch]
            k = k[np.argsort(small[k], kind="stable")]
            self.pick(ctx.take(k, axis=0), ids.take(k), None, views)
            grad /= len(k)
            square += grad * grad
            self.flat -= rate * grad / np.sqrt(square)


def coded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words as binary, each word's number among them, words of each text), in the order of the texts."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, sizes = parts.flatten(), pc.list_value_length(parts).to_numpy().astype(np.int64)
    # white space at a text's ends leaves empty strings
    real = pc.greater(pc.binary_length(flat), 0)
    before, ends = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))]), np.cumsum(sizes)
    found = flat.filter(real).cast(pa.binary()).dictionary_encode()
    return found.dictionary, found.indices.to_numpy(), before[ends] - before[ends - sizes]


def _slices(texts: pa.Array | pa.ChunkedArray, chars: int = 2_000_000) -> Iterator[pa.Array]:
    for c in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        start = total = 0
        for k, n in enumerate(pc.fill_null(pc.utf8_length(c), 0).to_pylist()):
            if k > start and total + n > chars:
                yield c.slice(start, k - start)
                start, total = k, 0
            total += n
        if start < len(c):
            yield c.slice(start)


def train(docs: DataFrame, vocabulary: Vocabulary, rounds: int = 1, text_col: str = "text") -> WindowNet:
    """Average of the networks that the tasks train, each on all documents of its partition."""
    net = WindowNet(vocabulary.size, weight=vocabulary.weight)
    chosen = docs.select(F.col(text_col).cast("string").alias("text"))
    for turn in range(rounds):
        sent = docs.sparkSession.sparkContext.broadcast((vocabulary, net.flat))  # the network's fixed size

        def run(batches: Iterator[pa.RecordBatch], sent=sent, turn=turn) -> Iterator[pa.RecordBatch]:
            words, flat = sent.value
            own = WindowNet(words.size, flat)
            square, seen = np.full(len(flat), 1e-8, np.float32), 0
            for b in batches:
                for part in _slices(b["text"]):
                    found, at, lengths = coded(part)
                    own.learn(words.classes(found)[at], lengths, square, seed=turn)
                    seen += len(at)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([float(seen)]), pa.array([own.flat.tolist()], pa.list_(pa.float32()))], ["seen", "flat"])

        made = chosen.mapInArrow(run, "seen double, flat array<float>").select("seen", F.posexplode("flat").alias("k", "w"))
        mean = made.groupBy("k").agg((F.sum(F.col("w") * F.col("seen")) / F.sum("seen")).alias("w")).collect()  # one number a weight
        if mean:
            flat = np.zeros_like(net.flat)
            for r in mean:
                flat[r["k"]] = r["w"]
            net = WindowNet(vocabulary.size, flat)
    return net


def score(docs: DataFrame, vocabulary: Vocabulary, net: WindowNet, id_col: str = "doc_id", text_col: str = "text", rows: DataFrame | None = None, words: DataFrame | None = None) -> DataFrame:
    """Per row: id, n_words, log_prob (sum over the words), mean_log_prob. ``rows`` and ``words``: the
    blocks of ``docs`` and their words, where they are made already."""
    rows = blocks(docs, id_col, text_col) if rows is None else rows
    words = block_words(rows) if words is None else words
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, net.flat))

    def run(texts: pa.Table, listed: pa.Table) -> pa.Table:
        known, flat = sent.value
        own = WindowNet(known.size, flat)
        often = dict(zip(listed["word"].to_numpy(), np.log(listed["n"].to_numpy()).tolist(), strict=True))
        sums, sizes = [], []
        for part in _slices(texts["text"]):
            found, at, lengths = coded(part)
            ids = known.classes(found)
            inside = known.inside[ids] + np.fromiter(map(often.get, found.to_numpy(zero_copy_only=False), repeat(0.0)), np.float64, len(found))
            total = own.log_probs(ids[at], lengths) + inside[at] if len(at) else np.empty(0)
            run_up = np.concatenate([[0.0], np.cumsum(total)])
            ends = np.cumsum(lengths)
            sums += (run_up[ends] - run_up[ends - lengths]).tolist()
            sizes += lengths.tolist()
        return pa.table({"id": texts["id"], "n_words": pa.array(sizes, pa.int64()), "log_prob": pa.array(sums, pa.float64())})

    # words seen once have the share that ``inside`` gives already, frequent ones are classes of their own
    rare = words.where(~F.col("word").isin(vocabulary.frequent)) if vocabulary.frequent else words
    again = rare.select("block", "word").join(vocabulary.counts.where("n > 1"), "word").select("block", "word", "n")
    out = rows.groupBy("block").cogroup(again.groupBy("block")).applyInArrow(run, "id long, n_words long, log_prob double")
    return out.select(F.col("id").alias(id_col), "n_words", "log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")).alias("mean_log_prob"))


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = blocks(docs, id_col, text_col)
    words = block_words(rows)
    vocabulary = count_vocabulary(rows, words=words)
    return score(docs, vocabulary, train(rows, vocabulary), id_col, text_col, rows, words)
