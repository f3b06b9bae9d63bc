"""Text functions: token fold, tokens, page text, snippets, literal occurrences."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token is a run of letters, digits or private-use characters.
TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _fold_table() -> tuple[str, str]:
    """Latin letters with marks and the bare letters they fold to; combining marks at the end fold to nothing."""
    pairs = {}
    for point in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        low = chr(point).lower()
        if len(low) != 1:
            continue
        base = "".join(c for c in unicodedata.normalize("NFD", low) if not unicodedata.combining(c))
        if len(base) == 1 and base != low and base.isascii():
            pairs[low] = base
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(pairs) + marks, "".join(pairs.values())


FOLD_FROM, FOLD_TO = _fold_table()


def fold(text: Column) -> Column:
    """Lower case without Latin diacritics; other scripts keep theirs."""
    return F.translate(F.lower(text), FOLD_FROM, FOLD_TO)


def fold_literal(text: str) -> str:
    """The same for a query word, in Python."""
    table = str.maketrans({c: (FOLD_TO[k] if k < len(FOLD_TO) else None) for k, c in enumerate(FOLD_FROM)})
    return text.lower().translate(table)


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))


def literal_tokens(text: str) -> list[str]:
    """Tokens of a query text: letters, digits and private-use characters of the folded text."""
    out, run = [], []
    for c in fold_literal(text):
        if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co":
            run.append(c)
        elif run:
            out.append("".join(run))
            run = []
    return [*out, "".join(run)] if run else out


def plain_text(runs: Column) -> Column:
    """Texts of the runs of a layer in order, without a separator."""
    return F.array_join(F.transform(runs, lambda r: r["text"]), "")


def any_case(needle: str) -> str:
    """A regular expression for the needle as it stands, in any case."""
    return "(?iu)" + re.sub(r"([^\w\s]|_)", r"\\\1", needle)


def occurrence_count(text: Column, needle: str) -> Column:
    """How often the needle occurs, left to right, without overlaps."""
    return F.when(text.isNull(), 0).otherwise(F.size(F.split(text, any_case(needle), -1)) - 1).cast("long")


def running(values: Column, start, step, chunk: int = 256) -> Column:
    """What ``step`` (add, or the larger of two) makes of all values before each one, beginning with ``start``. Values are folded
    in chunks and chunks of chunks, so a long array costs little more than its length."""
    fold = lambda x, first: F.aggregate(x, first, step)

    def told(x: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / chunk).cast("int")), lambda c: F.slice(x, c * chunk + 1, F.lit(chunk)))

        def placed(parts: Column) -> Column:
            wholes = F.transform(parts, lambda p: fold(p, start))
            return let(wholes, lambda w: F.flatten(F.transform(parts, lambda p, k: let(fold(F.slice(w, F.lit(1), k), start), lambda first: F.transform(p, lambda _, i: fold(F.slice(p, F.lit(1), i), first))))))

        return F.when(F.size(x) > 0, let(chunks, placed)).otherwise(F.slice(x, F.lit(1), F.lit(0)))

    return let(values, told)


#: Characters of a block of ``blocks_of``.
BLOCK = 2048


def blocks_of(text: Column) -> Column:
    """A text cut into blocks, so that ``part_of`` needn't read it from its beginning each time."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def part_of(blocks: Column, start: Column, length: Column) -> Column:
    """``length`` characters of a text in blocks from ``start`` (from 0) on; fewer at its end."""
    first = F.floor(start / BLOCK).cast("int")
    near = F.array_join(F.slice(blocks, first + 1, F.floor((start + length) / BLOCK).cast("int") - first + 1), "")
    return F.substring(near, start - first * BLOCK + 1, length)


def occurrence_starts(text: Column, needle: str) -> Column:
    """Start of each occurrence in code points, as an array."""
    size = len(needle)
    reach = F.transform(F.split(text, any_case(needle), -1), lambda g: F.length(g) + size)
    # the text before the k-th occurrence is k + 1 gaps and k needles long
    ends = running(reach, F.lit(0), lambda a, y: a + y)
    return F.when(text.isNotNull(), F.transform(F.slice(ends, F.lit(2), F.greatest(F.size(ends) - 1, F.lit(0))), lambda e: e - size))


def substring_snippet(text: Column, start: Column, length: int, around: int = 30) -> Column:
    """``around`` characters on both sides of an occurrence on one line, ``...`` where text was cut off."""
    first = F.greatest(start - around, F.lit(0))
    last = F.least(start + length + around, F.length(text))
    body = F.translate(F.substring(text, first + 1, last - first), "\n\r", "  ")
    body = F.regexp_replace(body, r"^\s+|\s+$", "")
    return F.concat(F.when(first > 0, "...").otherwise(""), body, F.when(last < F.length(text), "...").otherwise(""))


def highlight_units(text: Column, units: Column, width: int = 32) -> Column:
    """At most ``width`` tokens of a page around what a query asks for, matches in [ ], ` … ` at cut sides.

    ``units`` is an array of (words, prefix): words next to each other, the last one perhaps a prefix.
    The window is the one with the most distinct units, then the most matches, then the earliest; it is
    centred on what it covers. Overlapping matches share one pair of brackets. Text between tokens stays
    as it is.
    """
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    gaps = F.split(text, TOKEN, -1)

    def hits_of(folded: Column) -> Column:
        def begins(u: Column, i: Column) -> Column:
            own = F.slice(folded, i + 1, F.size(u["words"]))
            last = F.element_at(u["words"], -1)
            same = F.size(own) == F.size(u["words"])
            close = (F.slice(own, F.lit(1), F.size(own) - 1) == F.slice(u["words"], F.lit(1), F.size(u["words"]) - 1)) & F.element_at(own, -1).startswith(last)
            return same & F.when(u["prefix"], close).otherwise(own == u["words"])

        def here(i: Column) -> Column:
            return F.filter(F.transform(units, lambda u, k: F.when(begins(u, i), F.struct(i.alias("at"), (i + F.size(u["words"])).alias("to"), k.alias("unit")))), lambda h: h.isNotNull())

        return F.flatten(F.transform(folded, lambda w, i: here(i)))

    def start_of(hits: Column, n: Column) -> Column:
        def seen_from(h: Column, i: Column) -> Column:
            # hits are in order of their places, so those of a window come one after the other
            near = F.slice(hits, i + 1, F.size(units) * width)
            inside = F.filter(near, lambda o: (o["at"] >= h["at"]) & (o["to"] <= h["at"] + width))
            return F.struct(F.size(F.array_distinct(F.transform(inside, lambda o: o["unit"]))).alias("kinds"), F.size(inside).alias("n"), (-h["at"]).alias("early"), F.array_max(F.transform(inside, lambda o: o["to"])).alias("last"))

        best = lambda b: F.greatest(F.lit(0), F.least(F.floor((F.coalesce(b["last"], 1 - b["early"]) - 1 - b["early"]) / 2).cast("int") - width // 2 + 1, n - width))
        return F.when(F.size(hits) > 0, let(F.array_max(F.transform(hits, seen_from)), best)).otherwise(0)

    def told(x: Column) -> Column:
        words, seps, a, spans = x["words"], x["seps"], x["start"], x["spans"]
        n = F.size(words)
        b = F.least(a + width, n)
        opens, closes = F.transform(spans, lambda s: s["at"]), F.transform(spans, lambda s: s["to"] - 1)

        def one(w: Column, i: Column) -> Column:
            # a match that the window cuts is marked as far as it is shown
            first = F.array_contains(opens, a + i) | ((i == 0) & F.exists(spans, lambda s: (s["at"] < a) & (s["to"] > a)))
            last = F.array_contains(closes, a + i) | ((a + i == b - 1) & F.exists(spans, lambda s: (s["at"] < b) & (s["to"] > b)))
            shown = F.concat(F.when(first, "[").otherwise(""), w, F.when(last, "]").otherwise(""))
            return F.concat(F.when(i > 0, F.element_at(seps, a + i + 1)).otherwise(""), shown)

        left = F.when(a > 0, F.lit(" … ")).otherwise(F.element_at(seps, 1))
        right = F.when(b < n, F.lit(" … ")).otherwise(F.element_at(seps, -1))
        return F.concat(left, F.array_join(F.transform(F.slice(words, a + 1, F.lit(width)), one), ""), right)

    def merged(hits: Column) -> Column:
        """Overlapping matches as one."""
        empty = F.array().cast("array<struct<at:int,to:int>>")

        def add(acc: Column, h: Column) -> Column:
            last = F.try_element_at(acc, F.lit(-1))
            joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["at"].alias("at"), F.greatest(last["to"], h["to"]).alias("to"))))
            return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["to"] > h["at"]), joined).otherwise(F.concat(acc, F.array(F.struct(h["at"].alias("at"), h["to"].alias("to")))))

        return F.aggregate(hits, empty, add)

    def made(x: Column) -> Column:
        folded = F.transform(x["words"], lambda w: F.translate(F.lower(w), FOLD_FROM, FOLD_TO))

        def marked(h: Column) -> Column:
            # what doesn't reach into the window is not shown
            shown = lambda a: merged(F.filter(h, lambda o: (o["to"] > a) & (o["at"] < a + width)))
            return let(start_of(h, F.size(x["words"])), lambda a: F.struct(x["words"].alias("words"), x["seps"].alias("seps"), a.alias("start"), shown(a).alias("spans")))

        return let(let(let(folded, hits_of), marked), told)

    return F.when(F.size(tokens) > 0, let(F.struct(tokens.alias("words"), gaps.alias("seps")), made)).otherwise(text)


def highlight_snippet(text: Column, terms: list[str], width: int = 32) -> Column:
    """``highlight_units`` for single words."""
    units = F.array(*[F.struct(F.array(F.lit(fold_literal(t))).alias("words"), F.lit(False).alias("prefix")) for t in terms])
    return highlight_units(text, units, width)


def dehyphenate(text: Column) -> Column:
    """Words cut by a hyphen at a line end are joined."""
    return F.regexp_replace(text, r"(\p{L})-\n(\p{L})", "$1$2")
