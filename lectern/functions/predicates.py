"""Structured match predicates on a page's tokens, and their units for scoring.

A unit is one scored part of a query: a term, a phrase or a prefix. Each has a count of its
occurrences on a page; a predicate asks for more than none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import any_case, let, literal_tokens


@dataclass(frozen=True)
class Unit:
    """``words`` adjacent in order; the last one may be a prefix."""

    words: tuple[str, ...]
    prefix: bool = False

    def count(self, tokens: Column) -> Column:
        """Occurrences among the tokens; overlapping ones count."""
        n = len(self.words)
        if n == 1:
            return F.size(F.filter(tokens, (lambda t: t.startswith(self.words[0])) if self.prefix else (lambda t: t == self.words[0])))
        words, prefix = self.words, self.prefix

        def places(seen: Column) -> Column:
            def fits(i: Column) -> Column:
                test = F.element_at(seen, i) == words[0]
                for k in range(1, n):
                    at = F.element_at(seen, i + k)
                    test = test & (at.startswith(words[k]) if prefix and k == n - 1 else at == words[k])
                return test

            found = F.filter(F.sequence(F.lit(1), F.size(seen) - (n - 1)), fits)
            return F.when(F.size(seen) >= n, F.size(found)).otherwise(0)

        return let(tokens, places)


def terms(text: str) -> list[Unit]:
    return [Unit((w,)) for w in literal_tokens(text)]


def phrase(text: str) -> Unit:
    return Unit(tuple(literal_tokens(text)))


def prefix(text: str) -> Unit:
    return Unit(tuple(literal_tokens(text)), prefix=True)


def match_all(tokens: Column, units: list[Unit]) -> Column:
    test = F.lit(True)
    for u in units:
        test = test & (F.array_contains(tokens, u.words[0]) if len(u.words) == 1 and not u.prefix else u.count(tokens) > 0)
    return test


def match_any(tokens: Column, units: list[Unit]) -> Column:
    plain = [u.words[0] for u in units if len(u.words) == 1 and not u.prefix]
    test = F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in plain])) if plain else F.lit(False)
    for u in units:
        if len(u.words) > 1 or u.prefix:
            test = test | (u.count(tokens) > 0)
    return test


def match_not(tokens: Column, wanted: list[Unit], unwanted: list[Unit]) -> Column:
    return match_all(tokens, wanted) & ~match_any(tokens, unwanted)


def match_phrase(tokens: Column, text: str) -> Column:
    return phrase(text).count(tokens) > 0


def match_prefix(tokens: Column, text: str) -> Column:
    return prefix(text).count(tokens) > 0


def match_first(tokens: Column, word: str) -> Column:
    """The word is the page's first token."""
    return F.coalesce(F.get(tokens, F.lit(0)) == literal_tokens(word)[0], F.lit(False))


def within(hits: Column, n_units: Column | int, most: int) -> Column:
    """Whether ``hits`` (at, unit), in order of ``at``, have all ``n_units`` units in a stretch with at most ``most`` tokens between
    the first and the last: one sweep that knows the last place of each unit."""
    never = F.lit(-(1 << 30))
    n = F.lit(n_units) if isinstance(n_units, int) else n_units.cast("int")
    start = F.struct(F.array_repeat(never, n).alias("last"), F.lit(False).alias("met"))

    def step(state: Column, hit: Column) -> Column:
        last = F.transform(state["last"], lambda v, i: F.when(i == hit["unit"], hit["at"]).otherwise(v))
        return let(last, lambda x: F.struct(x.alias("last"), (state["met"] | (hit["at"] - F.array_min(x) <= most + 1)).alias("met")))

    return F.aggregate(hits, start, step, lambda s: s["met"])


def match_near(tokens: Column, text: str, most: int = 10) -> Column:
    """All words within one stretch with at most ``most`` tokens between the first and the last."""
    words = list(dict.fromkeys(literal_tokens(text)))
    wanted = F.array(*[F.lit(w) for w in words])
    hits = F.filter(F.transform(tokens, lambda t, i: F.struct(i.alias("at"), (F.array_position(wanted, t) - 1).cast("int").alias("unit"))), lambda h: h["unit"] >= 0)
    return within(hits, len(words), most)


def contains_ci(text: Column, needle: str) -> Column:
    """The needle as it stands, in any case; no word boundaries, no folding of accents."""
    return F.coalesce(text.rlike(any_case(needle)), F.lit(False))


def real_query(text: Column, max_results: Column) -> Column:
    """Queries that ask for anything: not blank, and with room for a result."""
    return F.coalesce((F.trim(text) != "") & (max_results > 0), F.lit(False))
