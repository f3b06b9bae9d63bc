"""Spelling variants by finite-state composition.

Words are the letter runs of all texts. Two words are near if one edit (a code point inserted, deleted or
replaced) leads from one to the other; the near word that occurs most, if it does so ``ratio``
times as often, is a word's form, and following forms to the last one gives its root.

Near pairs come from composing the vocabulary's acceptor with a one-edit transducer and the acceptor
again. The composed machine is cut at initial states. Of two near words with m code points in the
shorter one either the first half of m code points is equal, or the last half is and the edit lies
before it; both are told by keys, and words with equal keys share an initial state. A partition of keys
is a Spark partition, sorted by key. For each key the minimised acceptor of what remains of its words
is built (equal right languages are one state), and the composition is walked from its initial
state: before the edit both sides are in the same states, the edit takes them apart, and from then
on the two right languages are intersected. Accepted pairs come as pairs of word numbers, found once for
each pair of states. Each pair is accepted under one key alone, as the edit is read at the end of the longest
common beginning.

A key with more than ``most_words`` words is cut again by halves of what remains, so no task gets
an unbounded group. Each key sends, for a word, how many near words it found and the best of them; Spark adds these up.

Defined cases: null and wordless texts have no words; a null id is read as an empty one where letters are
dropped; repeated rows count again; of forms with equal counts the first in code-point order wins; a
word without near words has no form and is its own root; an empty table gives an empty result;
other columns are ignored; words of any length are compared.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut, discard

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def lower(text: str) -> str:
    """A-Z in lower case, all else as it is."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")


def word_counts(docs: DataFrame, shortest: int, one_in: int | None, most: int = 500_000) -> DataFrame:
    """Partial counts (word, n) of ``docs`` (doc_id, text). ``one_in``: a run whose hash with its document's id is
    divisible by it loses a code point (None: no run does)."""
    pattern = re.compile(rf"[a-zÀ-ÿ]{{{shortest},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for b in batches:
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
                found = Counter(pattern.findall(lower(text.as_py() or "")))
                if one_in:
                    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for w in [w for w in found if not zlib.crc32(w.encode(), start) % one_in]:
                        at = zlib.crc32(w.encode(), start) % len(w)
                        n = found.pop(w)
                        if len(w) > shortest:
                            held[w[:at] + w[at + 1 :]] += n
                held.update(found)
            if len(held) > most:
                yield flush()
        yield flush()

    return docs.mapInArrow(run, "word string, n long")


class Acceptor:
    """The minimised acceptor of sorted words of two lengths. Each arc has the number of the words before it, so that a path is a
    word's number in its sorted list."""

    FINAL = 0

    def __init__(self, *lists: list[str]):
        self.arcs: list[dict[str, tuple[int, int]]] = [{}]
        self.size = [1]
        self.known: dict[tuple, int] = {}
        self.roots = [self._state(words, 0, len(words), 0) if words else None for words in lists]
        self.both: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.replaced: dict[int, list[tuple[int, int]]] = {}
        self.inserted: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def _state(self, words: list[str], lo: int, hi: int, depth: int) -> int:
        """The state that accepts what follows ``depth`` characters in words[lo:hi], all of one length."""
        if depth == len(words[lo]):
            return self.FINAL
        arcs, at = [], lo
        while at < hi:
            c, first = words[at][depth], at
            while at < hi and words[at][depth] == c:
                at += 1
            arcs.append((c, self._state(words, first, at, depth + 1), first - lo))
        key = tuple(arcs)
        if key not in self.known:
            self.known[key] = len(self.arcs)
            self.arcs.append({c: (s, before) for c, s, before in arcs})
            self.size.append(hi - lo)
        return self.known[key]

    def common(self, s: int, t: int) -> list[tuple[int, int]]:
        """Numbers (under s, under t) of the words that both states accept."""
        if s == t:
            return [(i, i) for i in range(self.size[s])]
        found = self.both.get((s, t))
        if found is None:
            found, right = [], self.arcs[t]
            for c, (s2, i0) in self.arcs[s].items():
                if c in right:
                    t2, j0 = right[c]
                    found += [(i0 + i, j0 + j) for i, j in self.common(s2, t2)]
            self.both[s, t] = found
        return found

    def one_replaced(self, s: int) -> list[tuple[int, int]]:
        """Numbers of the words under s that differ in one character."""
        found = self.replaced.get(s)
        if found is None:
            arcs, found = list(self.arcs[s].values()), []
            for k, (a, i0) in enumerate(arcs):
                found += [(i0 + i, i0 + j) for i, j in self.one_replaced(a)]
                for b, j0 in arcs[k + 1 :]:
                    found += [(i0 + i, j0 + j) for i, j in self.common(a, b)]
            self.replaced[s] = found
        return found

    def one_inserted(self, s: int, t: int, at_end: bool) -> list[tuple[int, int]]:
        """Numbers of the words under s and t, the latter with one more character; the character differs from the one after
        it. ``at_end``: also as the last one."""
        found = self.inserted.get((s, t))
        if found is None:
            found, short, long = [], self.arcs[s], self.arcs[t]
            for b, (t2, j0) in long.items():
                if t2 == self.FINAL and s == self.FINAL and at_end:
                    found.append((0, j0))
                after = self.arcs[t2]
                for c, (s3, i1) in short.items():
                    if c != b and c in after:
                        t3, j1 = after[c]
                        found += [(i1 + i, j0 + j1 + j) for i, j in self.common(s3, t3)]
                if b in short:
                    s2, i0 = short[b]
                    found += [(i0 + i, j0 + j) for i, j in self.one_inserted(s2, t2, at_end)]
            self.inserted[s, t] = found
        return found


def near_pairs(short: list[str], long: list[str], at_end: bool) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Numbers of near words among ``short`` (all of one length), and between them and ``long`` (one longer); both sorted."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 10 * (len(long[0]) if long else len(short[0])) + 1000))
    machine = Acceptor(short, long)
    root, other = machine.roots
    return machine.one_replaced(root), machine.one_inserted(root, other, at_end) if long else []


def _halves(records: DataFrame) -> DataFrame:
    """Each record (key, m, rest, at_end, word, n) under two keys: the first half of m, and the last."""
    half = F.floor(F.col("m") / 2).cast("int")
    tail = F.col("m") - half
    length = F.length("rest")
    first = F.struct(F.concat("key", F.lit("<"), F.substring("rest", F.lit(1), half)).alias("key"), tail.alias("m"), F.substring("rest", half + 1, length).alias("rest"), F.col("at_end").alias("at_end"))
    last = F.struct(F.concat("key", F.lit(">"), F.substring("rest", length - tail + 1, tail)).alias("key"), half.alias("m"), F.substring("rest", F.lit(1), length - tail).alias("rest"), F.lit(False).alias("at_end"))
    return records.select(F.explode(F.array(first, last)).alias("r"), "word", "n").select("r.*", "word", "n")


def _keyed(words: DataFrame, most_words: int) -> DataFrame:
    """Words under the keys of their initial states; no key that can be cut has more than ``most_words``."""
    short = F.explode(F.array(F.length("word") - 1, F.length("word")))
    records = words.select(short.alias("m"), "word", "n").select(F.col("m").cast("string").alias("key"), "m", F.col("word").alias("rest"), F.lit(True).alias("at_end"), "word", "n")
    records, done = _halves(records), []
    while True:
        large = cut(records.where("m > 1").groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > most_words).select("key"))
        if not large.limit(1).count():
            break
        done.append(records.join(large, "key", "left_anti"))
        records = cut(_halves(records.join(large, "key", "left_semi")))
    for d in done:
        records = records.unionByName(d)
    return records


def _composed(records: DataFrame) -> DataFrame:
    """(word, near, best_n, best): what each key finds for its words."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        held: list[tuple] = []
        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns), strict=True)
            for key, part in groupby(rows, lambda r: r[0]):
                if held and held[0][0] != key:
                    yield held
                    held = []
                held += part
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {"word": [], "near": [], "best_n": [], "best": []}
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        for group in groups(batches):
            m, at_end = group[0][1], group[0][3]
            short = [r for r in group if len(r[2]) == m]
            if not short or len(group) < 2:
                continue
            long = [r for r in group if len(r[2]) > m]
            replaced, inserted = near_pairs([r[2] for r in short], [r[2] for r in long], at_end)
            found: dict[str, tuple[int, int, str]] = {}
            for one, two, pairs in ((short, short, replaced), (short, long, inserted)):
                for i, j in pairs:
                    (a, a_n), (b, b_n) = one[i][4:], two[j][4:]
                    for w, v, n in ((a, b, b_n), (b, a, a_n)):
                        old = found.get(w)
                        if old is None:
                            found[w] = (1, n, v)
                        elif n > old[1] or n == old[1] and v < old[2]:
                            found[w] = (old[0] + 1, n, v)
                        else:
                            found[w] = (old[0] + 1, *old[1:])
            for w, told in found.items():
                for name, value in zip(out, (w, *told), strict=True):
                    out[name].append(value)
            if len(out["word"]) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out.values(), kinds, strict=True)], list(out))
                for x in out.values():
                    x.clear()
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out.values(), kinds, strict=True)], list(out))

    dealt = records.select("key", "m", "rest", "at_end", "word", "n").repartition("key").sortWithinPartitions("key", "rest")
    return dealt.mapInArrow(run, "word string, near long, best_n long, best string")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of all words with a form (word, root so far): forms are followed, two steps becoming one each time."""
    now = cut(forms)
    while True:
        after = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(now.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = step.where("moved").limit(1).count()
        discard(now)
        now = step.select("word", "root")
        if not moved:
            return now


def near_words(words: DataFrame, most_words: int = 20_000) -> DataFrame:
    """(word, near, best_n, best) for the words (word, n) that have near words."""
    found = _composed(_keyed(words, most_words))
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))).alias("b")  # largest count, then first word
    return found.groupBy("word").agg(F.sum("near").alias("near"), best).select("word", "near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def variants(docs: DataFrame, shortest: int = 6, least: int = 5, ratio: int = 5, one_in: int | None = 199, most_words: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n for all words of ``shortest`` code points and ``least`` occurrences."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    words = cut(word_counts(slim, shortest, one_in).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    near = near_words(words, most_words)
    told = words.join(near, "word", "left").withColumn("has", F.col("best_n") >= F.col("n") * ratio)
    told = cut(told.select("word", F.when(F.col("has"), F.col("best")).alias("form"), "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("has"), F.col("best_n")).alias("form_n")))
    roots = _roots(told.where("form is not null").select("word", F.col("form").alias("root")))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
