"""Toxicity by a counterfactually regularised classifier.

A word's score is a linear function of hashed character features of the word; a text scores as
its most toxic word, so one slur in a long text counts and thousands of neutral words add
nothing. Weights start from log-odds of feature counts in toxic and clean training texts and
are refined by logistic loss on the texts, plus a counterfactual loss on their sentences: wherever
a labelled sentence mentions an identity term, the term is swapped for another of its group, the
sentence and its twin are scored alike (most toxic word), and the squared difference of the two
scores, times ``penalty``, is added to the loss. A neutral mention of a group then raises no alarm,
while a slur next to it, which scores the same in both, is left as it is.

Runs of letters longer than ``RUN`` (scripts without blanks, long addresses) are scored by
overlapping slices of that length, all of them, so nothing of a text is left out.

Training uses a bounded sample of labelled rows (``max_train``, a parameter); every document is
scored, whole.

Defined cases: null and empty texts, and texts without a letter or digit, get the score of a
text without evidence (below the threshold); repeated rows each give a row; an empty table gives
an empty result; with no labelled rows all documents score the prior; extra columns are ignored,
also such as are named like the result's.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lectern.llm.common import fold_of
from lectern.llm.wordfeats import WordMemo, word_features

#: Identity terms by group: members of a group replace each other in counterfactuals.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("female", "male", "transgender", "nonbinary"),
    ("gay", "lesbian", "bisexual", "straight", "queer", "heterosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic"), ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "atheists"),
    ("black", "white", "asian", "latino", "hispanic", "arab", "african", "european"), ("immigrant", "native", "refugee", "foreigner"), ("immigrants", "natives", "refugees", "foreigners"),
    ("mexican", "chinese", "american", "indian", "german", "french", "turkish", "polish", "russian", "nigerian"),
    ("disabled", "blind", "deaf", "autistic", "elderly", "young", "old"),
    ("frauen", "männer", "mädchen", "jungen"), ("schwul", "lesbisch", "bisexuell", "queer"), ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"), ("deutsche", "türken", "polen", "araber", "russen", "franzosen"), ("flüchtlinge", "einwanderer", "ausländer", "einheimische"), ("behindert", "blind", "taub", "alt", "jung"),
    ("femmes", "hommes", "filles", "garçons"), ("gay", "lesbienne", "bisexuel", "hétérosexuel"), ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"), ("arabes", "africains", "français", "allemands", "russes", "turcs"), ("réfugiés", "immigrés", "étrangers"), ("handicapé", "aveugle", "sourd", "vieux", "jeune"),
    ("mujeres", "hombres", "niñas", "niños"), ("gay", "lesbiana", "bisexual", "heterosexual"), ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"), ("mexicanos", "árabes", "africanos", "españoles", "gitanos", "rusos"), ("refugiados", "inmigrantes", "extranjeros"), ("discapacitado", "ciego", "sordo", "viejo", "joven"),
)
DIMS = 1 << 18
LENGTHS = (3, 4, 5, 6)
#: Longer runs of letters are scored by overlapping slices of this length; longer tokens aren't kept in the memo.
RUN, KEPT = 64, 256
_SUB = re.compile(r"[^\W_]+")
#: Signs often written for letters.
_LOOKALIKE = str.maketrans("0134578@$!", "oieastbasi")


def _slices(run: str) -> list[str]:
    """A run of letters, or all slices of a long one, each overlapping the next by half."""
    return [run] if len(run) <= RUN else [run[k : k + RUN] for k in range(0, len(run) - RUN // 2, RUN // 2)]


def _parts(token: str) -> list[str]:
    """The words a blank-separated token may hold: its runs of letters and digits, and the token with
    signs removed or read as the letters they stand for."""
    token = token.lower()
    if token.isalpha():
        return _slices(token)
    runs = _SUB.findall(token)
    if not runs:
        return []
    if len(runs) > 1 or not runs[0].isalpha():
        joined = "".join(runs)
        if any(c.isalpha() for c in joined):
            runs = [*runs, joined]
        plain = "".join(_SUB.findall(token.translate(_LOOKALIKE)))
        if any(c.isalpha() for c in token):
            runs.append(plain)
    return list(dict.fromkeys(x for r in runs if not r.isdigit() for x in _slices(r))) or [x for r in runs for x in _slices(r)]


class ToxicityModel:
    """Weights of word features; ``score`` maps texts to probabilities."""

    def __init__(self, weights: np.ndarray, scale: float, bias: float, floor: float):
        self.weights, self.scale, self.bias, self.floor = weights, scale, bias, floor
        self.memo: WordMemo | None = None

    def __getstate__(self):
        return self.weights, self.scale, self.bias, self.floor

    def __setstate__(self, state):
        self.__init__(*state)

    def word_scores(self, words: list[str]) -> np.ndarray:
        w, f = word_features(words, DIMS, LENGTHS)
        n = np.maximum(1, np.bincount(w, minlength=len(words)))
        return np.bincount(w, weights=self.weights[f], minlength=len(words)) / n

    def _tokens(self, tokens: list[str]) -> list[float]:
        parts = [_parts(t) for t in tokens]
        flat = [p for ps in parts for p in ps]
        scores = self.word_scores(flat)
        out, at = [], 0
        for ps in parts:
            out.append(float(scores[at : at + len(ps)].max()) if ps else self.floor)
            at += len(ps)
        return out

    def _long(self, token: str) -> float:
        parts = _parts(token)
        return max((float(self.word_scores(parts[k : k + 2000]).max()) for k in range(0, len(parts), 2000)), default=self.floor)

    def score(self, texts: list[str | None]) -> list[float]:
        if self.memo is None:
            self.memo = WordMemo(self._tokens)
        split = [set(t.split()) if t else set() for t in texts]
        known = self.memo.lookup({t for tokens in split for t in tokens if len(t) <= KEPT})
        out = []
        for tokens in split:
            best = max([known[t] if len(t) <= KEPT else self._long(t) for t in tokens], default=self.floor)
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, self.scale * best + self.bias)))))
        return out


def _twins(texts: list[str], place: dict[str, int], rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """(words, words with one identity term swapped) of each mention in each sentence of the texts; words by their
    number in ``place``, which grows as needed."""
    other: dict[str, list[str]] = {}
    for g in IDENTITY_TERMS:
        for t in g:
            other.setdefault(t, []).extend(x for x in g if x != t)
    found: dict[tuple, None] = {}
    for text in texts:
        for sentence in re.split(r"[.!?\n]+", text):
            words = list(dict.fromkeys(p for t in sentence.split() for p in _parts(t)))
            for w in words:
                if w in other:
                    swapped = other[w][int(rng.integers(len(other[w])))]
                    ids = [place.setdefault(x, len(place)) for x in words]
                    twin = [place.setdefault(swapped if x == w else x, len(place)) for x in words]
                    found[tuple(ids), tuple(twin)] = None
    return [(np.array(a), np.array(b)) for a, b in found]


def train(texts: list[str], labels: list[int], rounds: int = 6, rate: float = 0.5, penalty: float = 1.0, seed: int = 7) -> ToxicityModel:
    """Fit on (text, 0/1). ``penalty`` weighs the squared score change of sentences under identity swaps."""
    rng = np.random.default_rng(seed)
    docs = [list(dict.fromkeys(p for t in dict.fromkeys(text.split()) for p in _parts(t))) for text in texts]
    y = np.array(labels, np.float64)
    floor = -1.0
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 0.1) / (len(y) + 10)
        return ToxicityModel(np.zeros(DIMS), 1.0, math.log(p / (1 - p)), 0.0)
    vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for d in docs for w in d))}
    twins = _twins(texts, vocabulary, rng) if penalty else []
    words = list(vocabulary)
    # features of all words in order, made a slice at a time to keep the driver small
    made, counts = [], []
    for s in range(0, len(words), 20_000):
        w, f = word_features(words[s : s + 20_000], DIMS, LENGTHS)
        made.append(f.astype(np.int32)[np.argsort(w, kind="stable")])
        counts.append(np.bincount(w, minlength=len(words[s : s + 20_000])))
    fi = np.concatenate([*made, np.empty(0, np.int32)])
    starts = np.concatenate([[0], np.cumsum(np.concatenate([*counts, np.empty(0, np.int64)]))]).astype(np.int64)
    del made, counts
    # document frequency of features by class
    df = np.zeros((2, DIMS))
    members = [np.array([vocabulary[w] for w in d], np.int64) for d in docs]
    for m, lab in zip(members, labels, strict=True):
        if len(m):
            f = np.unique(np.concatenate([fi[starts[k] : starts[k + 1]] for k in m]))
            df[lab, f] += 1
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    weights = np.log((df[1] + 0.05) / (n[1] + 0.1)) - np.log((df[0] + 0.5) / (n[0] + 1.0))
    weights[df[0] + df[1] < 3] = floor  # too rare to tell
    weights = np.clip(weights, -3.0, 4.0)
    per_word = np.maximum(1, np.diff(starts))

    def totals() -> np.ndarray:
        each = np.zeros(len(fi) + 1, np.float32)
        np.take(weights.astype(np.float32), fi, out=each[:-1])
        return np.add.reduceat(each, np.minimum(starts[:-1], len(fi))) / per_word

    scale, bias = 2.0, -2.0
    for _ in range(rounds):
        score = totals()
        best = np.array([score[m].max() if len(m) else floor for m in members])
        arg = [int(m[np.argmax(score[m])]) if len(m) else -1 for m in members]
        for _ in range(60):  # calibrate the two outer parameters
            p = 1 / (1 + np.exp(-(scale * best + bias)))
            g = p - y
            h = p * (1 - p) + 1e-6
            hess = np.array([[np.sum(h * best * best) + 0.1, np.sum(h * best)], [np.sum(h * best), np.sum(h) + 0.1]])
            step = np.linalg.solve(hess, np.array([np.sum(g * best) + 0.1 * (scale - 4.0), np.sum(g) + 0.1 * (bias + 2.0)]))
            scale, bias = float(np.clip(scale - 0.5 * step[0], 0.2, 12.0)), float(np.clip(bias - 0.5 * step[1], -20.0, 10.0))
        p = 1 / (1 + np.exp(-(scale * best + bias)))
        for k, gain in zip(arg, y - p, strict=True):
            if k >= 0 and abs(gain) > 0.02:
                f = fi[starts[k] : starts[k + 1]]
                weights[f] += rate * gain / max(1, len(f)) * 4
        # counterfactual loss: penalty * (score of a sentence - score of its twin) ** 2, by gradient steps
        # on the word that makes either score; where both scores are those of one word they don't differ
        for _ in range(4 if twins else 0):
            score = totals()
            top = np.array([(a[np.argmax(score[a])], b[np.argmax(score[b])]) for a, b in twins])
            apart = score[top[:, 0]] - score[top[:, 1]]
            high = np.where(apart >= 0, top[:, 0], top[:, 1])
            pull, hits = np.bincount(high, weights=abs(apart), minlength=len(words)), np.bincount(high, minlength=len(words))
            # the lower score is the target: a common word that makes it isn't lifted towards the term
            for k in np.flatnonzero(pull):
                f = fi[starts[k] : starts[k + 1]]
                weights[f] -= penalty / (1 + penalty) * pull[k] / hits[k]
    return ToxicityModel(weights.astype(np.float32), scale, bias, floor)


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int = 3000, folds: int = 4, held_out: int = 2) -> list:
    """At most ``max_train`` labelled (text, toxic) rows outside the held-out fold, by hash of the id."""
    known = labels.select(F.col("doc_id").alias("l_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and l_id is not null").where(fold_of(F.col("l_id"), folds) != held_out)
    # the sample is drawn among ids, texts are joined to it afterwards
    half = max(1, max_train // 2)
    sample = known.where("toxic = 1").orderBy(F.xxhash64("l_id"), "l_id").limit(half).unionByName(known.where("toxic = 0").orderBy(F.xxhash64("l_id"), "l_id").limit(max_train - half))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("l_id"))  # max_train rows of two numbers
    return rows.where("text is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_train).select("text", "toxic").collect()


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 3000) -> ToxicityModel:
    rows = training_rows(docs, labels, max_train)
    return train([r["text"] for r in rows], [r["toxic"] for r in rows])


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), out_col: str = "score") -> DataFrame:
    """Rows of ``docs`` (id, text and ``keep``) with the score in ``out_col``."""
    spread = docs.sparkSession.sparkContext.broadcast(model)  # DIMS numbers, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = spread.value
        for b in batches:
            for s in range(0, b.num_rows, 500):
                part = b.slice(s, 500)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own.score(part[text_col].to_pylist()), pa.float64())], [*part.schema.names, out_col])

    slim = docs.select(*dict.fromkeys([id_col, text_col, *keep]))
    return slim.mapInArrow(run, StructType([*slim.schema.fields, StructField(out_col, DoubleType())]))


def toxicity_digest(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_train: int = 3000) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = score_toxicity(slim, fit(slim, labels, max_train))
    return scored.select("doc_id", F.coalesce(fold_of(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
