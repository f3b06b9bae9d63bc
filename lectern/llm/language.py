"""Language of each word by a linear-chain conditional random field, and of each document.

Emissions are sums of learned weights of a word's affixes and character n-grams (hashed), of the
word itself, and of its membership in each language's lexicon (its most telling frequent words);
transitions between languages are learned with them from sequences in which passages of
different languages follow each other, as code-switched text has them. Forward-backward gives
every word's posterior; a document's language is the one with the largest sum of posteriors over
its words that have a letter, its score their mean.

Training uses a bounded sample (``per_language`` documents a language, a parameter); every
document is labelled, whole. Long documents are cut into blocks for speed: transfer matrices of
all blocks at once, then block boundaries in order, then all blocks again, which is the exact
forward-backward of the whole text.

Defined cases: null text or text without a letter is ``und`` with score 0; with nothing to learn
from all documents are ``und``; repeated rows each give a row; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from lectern.llm.common import fold_of
from lectern.llm.wordfeats import long_word_features, word_features

DIMS = 1 << 16
LENGTHS = (2, 3, 4)
BLOCK = 64
#: Longer tokens (scripts without blanks) aren't remembered, and their features are made in parts.
KEPT = 256
NONE = "und"


def bare(token: str) -> str:
    """A token without the signs around it, in lower case; '' if it has no letter."""
    t = token.lower()
    if not t.isalpha():
        t = t.strip("".join({c for c in t if not c.isalnum()})) if t else t
        if not any(c.isalpha() for c in t):
            return ""
    return t


class LanguageModel:
    def __init__(self, labels: list[str], weights: np.ndarray, trans: np.ndarray, start: np.ndarray, lexicon: dict[str, int]):
        self.labels, self.weights, self.trans, self.start, self.lexicon = labels, weights, trans, start, lexicon
        self.place: dict[str, int] = {}
        self.rows = np.zeros((0, len(labels)), np.float32)
        self.has: np.ndarray = np.zeros(0, bool)

    def __getstate__(self):
        return self.labels, self.weights, self.trans, self.start, self.lexicon

    def __setstate__(self, state):
        self.__init__(*state)

    def emissions(self, words: list[str]) -> np.ndarray:
        wi, fi = features([w if len(w) <= KEPT else "" for w in words], self.lexicon)
        out = np.stack([np.bincount(wi, weights=self.weights[fi, k], minlength=len(words)) for k in range(len(self.labels))], axis=1)
        for k, w in enumerate(words):
            if len(w) > KEPT:
                out[k] = sum(self.weights[f].sum(axis=0, dtype=np.float64) for f in long_word_features(w, DIMS, LENGTHS))
        return out

    def _index(self, split: list[list[str]], limit: int = 200_000) -> None:
        if len(self.rows) > limit:
            self.__init__(*self.__getstate__())
        fresh = list(set().union(*split).difference(self.place)) if split else []
        if not fresh:
            return
        words = [bare(t) for t in fresh]
        rows = self.emissions(words).astype(np.float32)
        has = np.array([bool(w) for w in words])
        rows[~has] = 0.0
        at = len(self.rows)
        self.place.update(zip(fresh, range(at, at + len(fresh)), strict=True))
        self.rows, self.has = np.concatenate([self.rows[:at], rows]), np.concatenate([self.has[:at], has])

    def posteriors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(posterior of each word, whether it has a letter, number of words of each text)."""
        split = [t.split() for t in texts]
        self._index(split)
        lengths = np.array([len(s) for s in split], np.int64)
        get = self.place.__getitem__
        at = np.fromiter((get(t) for s in split for t in s), np.int64, int(lengths.sum()))
        for t in [t for t in set().union(*split) if len(t) > KEPT] if split else ():
            del self.place[t]
        return forward_backward(self.rows[at], lengths, self.trans, self.start), self.has[at], lengths

    def label(self, texts: list[str]) -> list[tuple[str, float]]:
        gamma, has, lengths = self.posteriors(texts)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        sums = np.concatenate([np.zeros((1, gamma.shape[1])), np.cumsum(gamma * has[:, None], axis=0, dtype=np.float64)])
        counts = np.concatenate([[0], np.cumsum(has)])
        out = []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            n = counts[b] - counts[a]
            if not n:
                out.append((NONE, 0.0))
                continue
            s = sums[b] - sums[a]
            k = int(np.argmax(s))
            out.append((self.labels[k], float(min(1.0, max(0.0, s[k] / n)))))
        return out


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words, and DIMS + place for words of a lexicon."""
    wi, fi = word_features(words, DIMS, LENGTHS)
    listed = [(k, DIMS + lexicon[w]) for k, w in enumerate(words) if w in lexicon]
    if listed:
        extra = np.array(listed, np.int64)
        wi, fi = np.concatenate([wi, extra[:, 0]]), np.concatenate([fi, extra[:, 1]])
    return wi, fi


def forward_backward(emission: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray, forward: bool = False):
    """Posteriors of all words of texts of the given lengths (rows of ``emission`` in a row); with
    ``forward`` also the forward messages."""
    n, k = emission.shape
    if not n:
        return (np.zeros((0, k), np.float32),) * 2 if forward else np.zeros((0, k), np.float32)
    e_all = np.exp(emission - emission.max(axis=1, keepdims=True)).astype(np.float32)
    a = np.exp(trans - trans.max()).astype(np.float32)
    first = np.exp(start - start.max()).astype(np.float32)
    lengths = lengths[lengths > 0]
    blocks = -(-lengths // BLOCK)
    doc_first = np.concatenate([[0], np.cumsum(blocks)[:-1]])  # number of each text's first block
    total = int(blocks.sum())
    doc = np.repeat(np.arange(len(lengths)), blocks)
    nth = np.arange(total) - doc_first[doc]
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])[doc] + nth * BLOCK
    size = np.minimum(BLOCK, lengths[doc] - nth * BLOCK)
    width = int(size.max())
    place = np.minimum(begin + np.arange(width)[:, None], n - 1)
    e = e_all[place]  # step by block by label; rows beyond a block's end are never used
    head = nth == 0
    by_size = [np.flatnonzero(size == t + 1) for t in range(width)]
    norm = lambda x: x / np.maximum(x.sum(axis=-1, keepdims=True), np.float32(1e-30))
    into = np.full((total, k), 1.0 / k, np.float32)
    out = np.ones((total, k), np.float32)
    multi = np.flatnonzero(blocks[doc] > 1)  # texts of one block need no transfer matrix
    if len(multi):
        # 1: what each block makes of any state before it
        m = np.zeros((total, k, k), np.float32)
        em, ms = e[:, multi], [np.flatnonzero(size[multi] == t + 1) for t in range(width)]
        now = np.broadcast_to(np.eye(k, dtype=np.float32), (len(multi), k, k))
        for t in range(width):
            now = (now.reshape(-1, k) @ a).reshape(-1, k, k)
            if t == 0:
                now[head[multi]] = first
            now = now * em[t][:, None, :]
            if t % 4 == 3:
                now /= np.maximum(now.max(axis=(1, 2), keepdims=True), np.float32(1e-30))
            if len(ms[t]):
                m[multi[ms[t]]] = now[ms[t]]
        m /= np.maximum(m.max(axis=(1, 2), keepdims=True), np.float32(1e-30))
        # 2: states at block boundaries, in order
        most = int(blocks.max())
        for j in range(1, most):
            b = doc_first[blocks > j] + j
            into[b] = norm(np.einsum("bi,bij->bj", into[b - 1], m[b - 1]))
        for j in range(most - 1, 0, -1):
            b = doc_first[blocks > j] + j
            out[b - 1] = norm(np.einsum("bij,bj->bi", m[b], out[b]))
    # 3: inside all blocks
    alpha = np.empty((width, total, k), np.float32)
    state = into
    for t in range(width):
        new = state @ a
        if t == 0:
            new[head] = first
        new *= e[t]
        state = norm(new)
        alpha[t] = state
    used = np.arange(width) < size[:, None]
    ahead = alpha.transpose(1, 0, 2)[used] if forward else None
    beta, back = out.copy(), np.ascontiguousarray(a.T)
    for t in range(width - 1, -1, -1):
        if len(by_size[t]):
            beta[by_size[t]] = out[by_size[t]]
        alpha[t] *= beta
        beta = norm((e[t] * beta) @ back)
    gamma = alpha.transpose(1, 0, 2)[used]  # rows in text order
    gamma = gamma / np.maximum(gamma.sum(axis=1, keepdims=True), np.float32(1e-30))
    return (gamma, ahead) if forward else gamma


def train(texts: list[str], langs: list[str], width: int = 30, rounds: int = 5, rate: float = 0.3, lexicon_size: int = 400, seed: int = 5) -> LanguageModel | None:
    """Fit weights and transitions on texts of known languages; None without any."""
    labels = sorted(set(langs))
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    k = len(labels)
    tokens = [[w for w in (bare(t) for t in x.split()) if w] for x in texts]
    counts = [Counter() for _ in labels]
    for ws, lang in zip(tokens, langs, strict=True):
        counts[labels.index(lang)].update(ws)
    lexicon: dict[str, int] = {}
    for j, c in enumerate(counts):
        share = {w: v / max(1, sum(x[w] for x in counts)) for w, v in c.most_common(4 * lexicon_size)}
        for w in [w for w in share if share[w] > 0.8][:lexicon_size]:
            lexicon.setdefault(w, j)
    # whole texts in windows, singly and followed by one of another language
    pieces: list[tuple[list[str], int]] = []
    for ws, lang in zip(tokens, langs, strict=True):
        pieces += [(ws[at : at + width], labels.index(lang)) for at in range(0, len(ws), width)]
    rng.shuffle(pieces)
    sequences = []
    while pieces:
        take = min(len(pieces), int(rng.integers(1, 4)))
        got, pieces = pieces[:take], pieces[take:]
        cut = [(ws[: int(rng.integers(3, width + 1))] if take > 1 else ws, y) for ws, y in got]
        sequences.append(([w for ws, _ in cut for w in ws], [y for ws, y in cut for _ in ws]))
    weights = np.zeros((DIMS + k, k))
    square = np.full((DIMS + k, k), 1e-2)
    trans, start = np.eye(k) * 2.0, np.zeros(k)
    for _ in range(rounds):
        for at in range(0, len(sequences), 64):
            batch = sequences[at : at + 64]
            words = [w for ws, _ in batch for w in ws]
            y = np.array([v for _, ys in batch for v in ys])
            lengths = np.array([len(ws) for ws, _ in batch])
            wi, fi = features(words, lexicon)
            em = np.stack([np.bincount(wi, weights=weights[fi, j], minlength=len(words)) for j in range(k)], axis=1)
            gamma, ahead = forward_backward(em, lengths, trans, start, forward=True)
            grad = gamma.astype(np.float64)
            grad[np.arange(len(y)), y] -= 1
            used, back = np.unique(fi, return_inverse=True)
            g = np.stack([np.bincount(back, weights=grad[wi, j], minlength=len(used)) for j in range(k)], axis=1) + 1e-3 * weights[used]
            square[used] += g * g
            weights[used] -= rate * g / np.sqrt(square[used])
            # transitions: counts seen against counts expected
            inner = np.ones(len(y), bool)
            inner[np.cumsum(lengths) - 1] = False
            p = np.flatnonzero(inner)
            seen = np.zeros((k, k))
            np.add.at(seen, (y[p], y[p + 1]), 1)
            # pair marginals: the forward message, the transition, and what the next posterior adds to them
            reach = ahead[p][:, :, None] * np.exp(trans - trans.max())[None]
            pair = reach * (gamma[p + 1] / np.maximum(reach.sum(axis=1), 1e-30))[:, None, :]
            trans += 0.5 * (seen - pair.sum(axis=0)) / max(1, len(p)) * 4 - 1e-3 * trans
            begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            start -= 0.1 * (gamma[begin].mean(axis=0) - np.bincount(y[begin], minlength=k) / len(begin))
        rate *= 0.8
    return LanguageModel(labels, weights.astype(np.float32), trans, start, lexicon)


def training_rows(docs: DataFrame, per_language: int = 300, folds: int = 3, held_out: int = 1) -> list:
    """At most ``per_language`` (text, lang) rows of each language outside the held-out fold, by hash of the id; rows that
    repeat an id and its text count once."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).where(fold_of(F.col("doc_id"), folds) != held_out)
    known = known.select("doc_id", "lang", "text", F.xxhash64("text").alias("_text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "_text")
    # ids and hashes first, copies of a row once, texts only of the chosen
    drawn = known.select("doc_id", "lang", "_text").distinct().withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_language).drop("_n")
    rows = known.join(F.broadcast(drawn), ["doc_id", "lang", "_text"]).dropDuplicates(["doc_id", "lang", "_text"])  # per_language rows a language
    return rows.orderBy("lang", F.xxhash64("doc_id"), "doc_id", "_text").select("text", "lang").collect()


def fit(docs: DataFrame, per_language: int = 300) -> LanguageModel | None:
    rows = training_rows(docs, per_language)
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def _slices(b: pa.RecordBatch, chars: int = 3_000_000) -> Iterator[list[str]]:
    part: list[str] = []
    total = 0
    for t in b["text"].to_pylist():
        t = t or ""
        if part and total + len(t) > chars:
            yield part
            part, total = [], 0
        part.append(t)
        total += len(t)
    if part:
        yield part


def detect(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if model is None:
        return slim.select(F.col("id").alias(id_col), F.lit(NONE).alias("lang_pred"), F.lit(0.0).alias("score"))
    spread = docs.sparkSession.sparkContext.broadcast(model)  # DIMS rows of numbers, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = spread.value
        for b in batches:
            got = [x for part in _slices(b) for x in own.label(part)]
            yield pa.RecordBatch.from_arrays([b["id"], pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], ["id", "lang_pred", "score"])

    schema = StructType([slim.schema["id"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return slim.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def label_words(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and runs of equally labelled words: array of (lang, first word, number of words)."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    spread = docs.sparkSession.sparkContext.broadcast(model)
    run_type = StructType([StructField("lang", StringType()), StructField("first", IntegerType()), StructField("words", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = spread.value
        for b in batches:
            rows = []
            for part in _slices(b):
                gamma, _, lengths = own.posteriors(part)
                best, at = gamma.argmax(axis=1), 0
                for n in lengths:
                    y = best[at : at + n]
                    edges = np.concatenate([[0], np.flatnonzero(np.diff(y)) + 1, [n]]) if n else np.zeros(1, int)
                    rows.append([{"lang": own.labels[y[s]], "first": int(s), "words": int(e - s)} for s, e in zip(edges[:-1], edges[1:], strict=True)])
                    at += n
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(rows, pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("words", pa.int32())])))], ["id", "runs"])

    return slim.mapInArrow(run, StructType([slim.schema["id"], StructField("runs", ArrayType(run_type))])).withColumnRenamed("id", id_col)


def language_digest(docs: DataFrame, per_language: int = 300) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    found = detect(docs, fit(docs, per_language))
    return found.select("doc_id", F.coalesce(fold_of(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
