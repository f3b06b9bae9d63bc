"""Collocations: phrases of two to four words by direct-address tiling.

Words that occur ``least`` times are ranked by frequency and texts are written once as word numbers.
The commonest ``head`` words (over all languages) have their rank as number; every other frequent
word has a number made from its hash, and a bit map of ``bits`` bits tells tasks which hashes to
keep (a bit shared by a rare word costs time only, as its pairs never become frequent). So what goes
to the tasks whole has a fixed bound, and no frequent word is left out.

Pairs of numbers are counted in tiles: a tile of ``EDGE`` x ``EDGE`` ranks that a batch fills well is
counted by a dense ``numpy.bincount``, all other pairs as sorted coordinates with counts. A task sends
one row a distinct pair, Spark sums them. Frequent pairs are ranked again and take the place of
words: a triple is a frequent pair and the word that follows, a phrase of four a frequent triple
and the word that follows. A phrase is no more frequent than its parts, so nothing is lost.

Scores: cutting a phrase of count a into parts with counts l and r gives floor(2000000 a / (l + r)), in
decimals; the lowest-scoring cut counts, ties to the shorter first part. Phrases that lie inside a
longer candidate with at least ``inside`` per cent of their count are dropped.

Defined cases: null and empty texts have no words; a null language is ``und``; repeated rows count
as often as they occur; ids play no part; a language without frequent phrases has no rows; an
empty table gives an empty result; other columns are ignored. Phrases outside the heads are told
apart by 62-bit hashes, which hold for one language and length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import cut, discard

_FOLD = bytes(255 if chr(c) in ".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
_END = b"\xff"  # no byte of a text in UTF-8
#: Ranks on a side of a tile, and tiles on a side of the square in which tiles can be dense.
EDGE, SIDE = 1024, 4
#: Numbers made from hashes lie above all ranks.
HASHED = 1 << 62
_U = np.uint64


def split_words(text: str | None) -> list[bytes]:
    """Lower-case words of a text with a mark at each end of a piece."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).replace(_END, b" \xff ").split() if text else []


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << _U(r)) | (x >> _U(64 - r))


def hash_longs(*columns: np.ndarray) -> np.ndarray:
    """What Spark's xxhash64 gives for columns of longs (primes of XXH64)."""
    p1, p2, p3, p4, p5 = (_U(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    h = np.full(len(columns[0]), 42, _U)
    with np.errstate(over="ignore"):
        for c in columns:
            h = h + p5 + _U(8)
            h ^= _rotl(c.view(_U) * p2, 31) * p1
            h = _rotl(h, 27) * p1 + p4
            h = (h ^ (h >> _U(33))) * p2
            h = (h ^ (h >> _U(29))) * p3
            h ^= h >> _U(32)
    return h.view(np.int64)


class Tiles:
    """Counts of pairs (left, right) of numbers in one language."""

    def __init__(self):
        self.dense: dict[int, np.ndarray] = {}
        self.sparse: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, left: np.ndarray, right: np.ndarray, most: int = 4_000_000) -> None:
        low = (left < EDGE * SIDE) & (right < EDGE * SIDE)
        a, b = left[low], right[low]
        tile = (a // EDGE) * SIDE + b // EDGE
        filled = np.bincount(tile, minlength=SIDE * SIDE)
        rest = np.ones(len(a), bool)
        for t in np.flatnonzero(filled * 64 >= EDGE * EDGE):
            mine = tile == t
            rest &= ~mine
            counts = np.bincount((a[mine] % EDGE) * EDGE + b[mine] % EDGE, minlength=EDGE * EDGE)
            self.dense[int(t)] = self.dense[int(t)] + counts if int(t) in self.dense else counts
        left, right = np.concatenate([left[~low], a[rest]]), np.concatenate([right[~low], b[rest]])
        self._coordinates(left, right, np.ones(len(left), np.int64))
        if self.held > most:
            parts, self.sparse, self.held = self.sparse, [], 0
            self._coordinates(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    def _coordinates(self, left: np.ndarray, right: np.ndarray, counts: np.ndarray) -> None:
        if not len(left):
            return
        packed = max(left.max(), right.max()) < 1 << 31
        code = left << 31 | right if packed else hash_longs(left, right)
        order = np.argsort(code, kind="stable")
        code = code[order]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        sums = np.add.reduceat(counts[order], first)
        self.sparse.append((left[order[first]], right[order[first]], sums))
        self.held += len(first)

    def rows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for t, counts in self.dense.items():
            at = np.flatnonzero(counts)
            yield (t // SIDE) * EDGE + at // EDGE, (t % SIDE) * EDGE + at % EDGE, counts[at]
        if self.sparse:
            parts, self.sparse = self.sparse, []
            self._coordinates(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield from self.sparse
        self.dense, self.sparse, self.held = {}, [], 0


def _bits(table: DataFrame, key: Column, bits: int) -> np.ndarray:
    """A bit for each hash ``key`` of ``table``: ``bits`` / 8 bytes, whatever the number of rows."""
    place = key.bitwiseAND(F.lit(bits - 1)) + 1  # the bitmap functions count from 1
    rows = table.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("m")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        at = (r["k"] - 1) * 4096
        out[at : at + len(r["m"])] = np.frombuffer(r["m"], np.uint8)[: len(out) - at]
    return out


def _has(bit: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h & (8 * len(bit) - 1)
    return (bit[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def _numbered(counts: DataFrame, keys: list[str], head: int) -> DataFrame:
    """Frequent rows (lang, *keys, n) with their number ``id``: the rank in its language for the ``head`` commonest, else from the hash."""
    counts = cut(counts)
    order = [F.desc("n"), "lang", *keys]
    top = counts.orderBy(*order).limit(head)  # a bounded table
    top = cut(top.withColumn("id", (F.row_number().over(Window.partitionBy("lang").orderBy(*order)) - 1).cast("long")).withColumn("ranked", F.lit(True)))
    rest = counts.join(top.select("lang", *keys), ["lang", *keys], "left_anti")
    hashed = F.xxhash64(*keys).bitwiseAND(F.lit(HASHED - 1)) + F.lit(HASHED)
    return cut(top.unionByName(rest.withColumn("id", hashed).withColumn("ranked", F.lit(False))))


class Names:
    """What tasks know of frequent pairs of numbers: the ranked ones by language, and a bit for each hash of the others."""

    def __init__(self, table: DataFrame, bits: int):
        head = table.where("ranked").select("lang", "left", "right", "id").toPandas()
        self.head: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for lang, part in head.groupby("lang"):
            code = hash_longs(part["left"].to_numpy(), part["right"].to_numpy())
            order = np.argsort(code)
            self.head[lang] = code[order], part["id"].to_numpy()[order]
        self.bit = _bits(table.where(~F.col("ranked")), F.xxhash64("left", "right"), bits)

    def of(self, lang: str, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Number of each pair; -1: not frequent, or no pair."""
        out = np.full(len(left), -1, np.int64)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        code = hash_longs(left[at], right[at])
        found = np.where(_has(self.bit, code), (code & (HASHED - 1)) + HASHED, -1)
        if lang in self.head:
            known, ids = self.head[lang]
            place = np.minimum(np.searchsorted(known, code), len(known) - 1)
            found = np.where(known[place] == code, ids[place], found)
        out[at] = found
        return out


def word_counts(docs: DataFrame, most: int = 500_000) -> DataFrame:
    """Partial counts (lang, word, n); a null word counts all words of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, c in held.items():
                total = sum(c.values()) - c.pop(_END, 0)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(c) + 1), pa.string()), pa.array([None, *c.keys()], pa.binary()), pa.array([total, *c.values()], pa.int64())], ["lang", "word", "n"])
            held.clear()

        for b in batches:
            for lang, text in zip(b["lang"], b["text"], strict=True):
                held.setdefault(lang.as_py(), Counter()).update(split_words(text.as_py()))
            if sum(map(len, held.values())) > most:
                yield from flush()
        yield from flush()

    return docs.mapInArrow(run, "lang string, word binary, n long")


def _encoded(docs: DataFrame, words: DataFrame, bits: int) -> DataFrame:
    """(lang, ids): each text as word numbers; -1 stands for ends of pieces and words that aren't frequent."""
    heads: dict[str, dict[bytes, int]] = {}
    for r in words.where("ranked").select("lang", "word", "id").toLocalIterator():
        heads.setdefault(r["lang"], {})[bytes(r["word"])] = r["id"]
    shared = docs.sparkSession.sparkContext.broadcast((heads, _bits(words.where(~F.col("ranked")), F.xxhash64("word"), bits)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bit = shared.value
        for b in batches:
            langs, out = b["lang"].to_pylist(), []
            for lang, text in zip(langs, b["text"], strict=True):
                found = split_words(text.as_py())
                found.append(_END)
                ids = np.fromiter(map(known.get(lang, {}).get, found, repeat(-2)), np.int64, len(found))
                missed = np.flatnonzero(ids == -2)
                missed_words = [found[i] for i in missed]
                h = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in missed_words), _U, len(missed)).view(np.int64)
                kept = _has(bit, h) & np.fromiter((w != _END for w in missed_words), bool, len(missed))
                ids[missed] = np.where(kept, (h & (HASHED - 1)) + HASHED, -1)
                # of several breaks in a row one is enough
                gap = ids < 0
                out.append(ids[~(gap & np.concatenate([[True], gap[:-1]]))])
            sizes = np.cumsum([0, *map(len, out)])
            if len(out):
                yield pa.RecordBatch.from_arrays([b["lang"], pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(out)))], ["lang", "ids"])

    return docs.mapInArrow(run, "lang string, ids array<long>")


def _paired(encoded: DataFrame, names: list[Names], least: int) -> DataFrame:
    """Frequent (lang, left, right, n): a number of ``names``' last level (a word's, if there is none) and the word that follows."""
    shared = encoded.sparkSession.sparkContext.broadcast(names)  # heads and bits of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, held = shared.value, {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, tiles in held.items():
                for left, right, n in tiles.rows():
                    for s in range(0, len(left), 200_000):
                        part = slice(s, s + 200_000)
                        yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(left[part]), np.int32))), pa.array(left[part]), pa.array(right[part]), pa.array(n[part])], ["lang", "left", "right", "n"])
            held.clear()

        for b in batches:
            langs = np.array(b["lang"].to_pylist(), object)
            for lang in dict.fromkeys(langs):
                x = b["ids"].filter(pa.array(langs == lang)).flatten().to_numpy(zero_copy_only=False)
                left, right = x[:-1], x[1:]
                for k, level in enumerate(levels):
                    named = level.of(lang, left, right)
                    # a phrase goes on only if what follows its first word is frequent as well
                    left, right = np.where(named[1:] >= 0, named[:-1], -1), x[k + 2 :]
                ok = (left >= 0) & (right >= 0)
                if ok.any():
                    if lang not in held and len(held) >= 4:
                        yield from flush()
                    held.setdefault(lang, Tiles()).add(left[ok], right[ok])
            if sum(t.held for t in held.values()) > 6_000_000:
                yield from flush()
        yield from flush()

    counted = encoded.mapInArrow(run, "lang string, left long, right long, n long")
    return counted.groupBy("lang", "left", "right").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def phrase_counts(docs: DataFrame, least: int = 30, head: int = 1 << 17, bits: int = 1 << 27) -> tuple[DataFrame, DataFrame]:
    """((lang, words, a) of the frequent phrases of one to four words, (lang, n) counts of all words); docs: lang, text."""
    counted = word_counts(docs).groupBy("lang", "word").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | F.col("word").isNull())
    counted = cut(counted)
    totals = counted.where("word is null").select("lang", "n")
    words = _numbered(counted.where("word is not null"), ["word"], head)
    encoded = cut(_encoded(docs, words, bits))
    spelled = words.select("lang", "id", F.array(F.col("word").cast("string")).alias("words"), "n")
    last, names, out = spelled, [], [spelled.select("lang", "words", F.col("n").alias("a"))]
    for length in (2, 3, 4):
        pairs = _numbered(_paired(encoded, names, least), ["left", "right"], head)
        if length < 4:
            names = [*names, Names(pairs, bits)]
        before = last.select("lang", F.col("id").alias("left"), F.col("words").alias("so_far"))
        after = spelled.select("lang", F.col("id").alias("right"), F.col("words").alias("next"))
        last = cut(pairs.join(before, ["lang", "left"]).join(after, ["lang", "right"]).select("lang", "id", F.concat("so_far", "next").alias("words"), "n"))
        out.append(last.select("lang", "words", F.col("n").alias("a")))
        discard(pairs)
    discard(encoded)
    whole = out[0]
    for o in out[1:]:
        whole = whole.unionByName(o)
    return whole, totals


def collocations(docs: DataFrame, least: int = 30, inside: int = 80, top: int | None = 2000, head: int = 1 << 17, bits: int = 1 << 27, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` collocations of each language (None: all)."""
    slim = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts, totals = phrase_counts(slim, least, head, bits)
    joined = lambda words: F.array_join(words, " ")
    known = counts.select("lang", joined("words").alias("part"), "a")
    longer = counts.where(F.size("words") > 1)
    # what lies inside longer candidates
    size = F.size("words")
    spans = F.filter(F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.struct(i.alias("i"), k.alias("k"))))), lambda x: x["k"] < size)
    held = longer.where(size > 2).withColumn("at", F.explode(spans)).select("lang", joined(F.slice("words", F.col("at.i"), F.col("at.k"))).alias("phrase"), F.col("a").alias("most"))
    held = held.groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    phrases = longer.select("lang", joined("words").alias("phrase"), "words", "a").join(held, ["lang", "phrase"], "left")
    big = lambda c: F.col(c).cast("decimal(20,0)")
    kept = phrases.where(F.col("most").isNull() | (big("most") * 100 < big("a") * inside)).select("lang", "phrase", "words", "a")
    # cuts
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.slice("words", F.lit(1), F.col("k"))).alias("first"), joined(F.slice("words", F.col("k") + 1, size)).alias("rest"))
    of = lambda name, n: known.select("lang", F.col("part").alias(name), F.col("a").alias(n))
    cuts = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    cuts = cuts.withColumn("score", F.expr("(cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    least_cut = F.min(F.struct("score", "k", "l", "r")).alias("c")
    scored = cuts.groupBy("lang", "phrase", "a").agg(least_cut).select("lang", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), F.col("c.score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    ranked = scored.withColumn("rank", rank)
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
