"""Hashed character features of words, computed for many words at once in numpy."""

from __future__ import annotations

import numpy as np

#: Marks put around each word, so that prefixes and suffixes are n-grams of their own.
_OPEN, _CLOSE = "\x02", "\x03"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)


def word_features(words: list[str], dims: int, lengths: tuple[int, ...] = (2, 3, 4, 5)) -> tuple[np.ndarray, np.ndarray]:
    """(word number, feature) pairs: character n-grams inside the marked word (so affixes too) and
    the word as a whole. ``dims`` must be a power of two. Features of a word may repeat."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    joined = _OPEN + (_CLOSE + _OPEN).join(words) + _CLOSE
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    opens = codes == 2
    number = np.cumsum(opens) - 1
    shift = np.uint64(64 - (dims.bit_length() - 1))
    out_w, out_f = [], []
    with np.errstate(over="ignore"):
        h = codes.copy()
        for n in range(2, max(lengths) + 1):
            h = h[:-1] * _BASE + codes[n - 1 :]
            if n in lengths:
                inside = number[n - 1 :] == number[: len(h)]
                g = (h + np.uint64(n)) * _MIX
                g ^= g >> np.uint64(29)
                out_w.append(number[: len(h)][inside])
                out_f.append(((g * _MIX) >> shift)[inside])
        starts = np.flatnonzero(opens)
        place = (np.arange(len(codes)) - starts[number]).astype(np.uint64)
        whole = np.add.reduceat(codes * ((place * np.uint64(2) + np.uint64(1)) * _MIX ^ (place << np.uint64(17))), starts) * _MIX
        whole ^= whole >> np.uint64(31)
        out_w.append(np.arange(len(starts)))
        out_f.append((whole * _MIX) >> shift)
    return np.concatenate(out_w), np.concatenate(out_f).astype(np.int64)


def long_word_features(word: str, dims: int, lengths: tuple[int, ...] = (2, 3, 4, 5), size: int = 1 << 17):
    """The features that ``word_features`` gives for one word, in parts, so that a word of any length takes little memory."""
    codes = np.frombuffer((_OPEN + word + _CLOSE).encode("utf-32-le", "surrogatepass"), np.uint32)
    shift, whole = np.uint64(64 - (dims.bit_length() - 1)), np.uint64(0)
    for s in range(0, len(codes), size):
        part, made = codes[s : s + size + max(lengths) - 1].astype(np.uint64), []
        with np.errstate(over="ignore"):
            h = part.copy()
            for n in range(2, max(lengths) + 1):
                h = h[:-1] * _BASE + part[n - 1 :]
                if n in lengths:
                    g = (h[:size] + np.uint64(n)) * _MIX
                    g ^= g >> np.uint64(29)
                    made.append(((g * _MIX) >> shift).astype(np.int64))
            place = np.arange(s, s + len(part[:size])).astype(np.uint64)
            whole += (part[:size] * ((place * np.uint64(2) + np.uint64(1)) * _MIX ^ (place << np.uint64(17)))).sum()
        yield from made
    with np.errstate(over="ignore"):
        whole *= _MIX
        whole ^= whole >> np.uint64(31)
        last = (whole * _MIX) >> shift
    yield np.array([last]).astype(np.int64)


class WordMemo:
    """Rows of numbers per word, computed in bulk on first sight and kept for the frequent words.

    Two generations bound the memory: when the younger is full it becomes the older one. ``step`` words
    are computed at once, so that what a word needs meanwhile stays small.
    """

    def __init__(self, compute, limit: int = 100_000, step: int = 10_000):
        self.compute, self.limit, self.step = compute, limit, step
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def lookup(self, words: set[str]) -> dict[str, object]:
        """A mapping that holds all of ``words`` (and more)."""
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        asked = words.difference(young)
        young.update({w: old[w] for w in asked if w in old})
        fresh = [w for w in asked if w not in old]
        for s in range(0, len(fresh), self.step):
            part = fresh[s : s + self.step]
            young.update(zip(part, self.compute(part), strict=True))
        return young
