"""Quality rules under weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation over the table of
distinct vote patterns (three to the number of rules at most, whatever the number of documents)
estimates how often each rule votes rightly for either class and the share of good documents;
the posterior of a document's pattern is its quality. A document is kept at ``least`` or more.

Defined cases: null or blank text has no words and fails the base test; repeated rows each give
a row; an empty table gives an empty result; extra columns are ignored; texts are read whole.
Repeats of 8-word windows are found by 64-bit hashes within one text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import GAP, WORD, cut, let, words_of

SPAN = 8
#: Very frequent words of the corpus languages (English, German, French, Spanish), a fixed list.
STOP_WORDS = (
    "the of and to a in is that it for was on with as be by this are at from or "
    "der die und in den von zu das mit sich des auf für ist im nicht ein eine als "
    "de la le et les des en un du une que est pour qui dans par sur pas au avec "
    "el y los se del las por con no una su para es al lo"
).split()


def _repeated(words: Column) -> Column:
    """Words that lie in an 8-word window found twice or more in the text, first ones included."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (SPAN - 1)), lambda i: F.xxhash64(F.slice(h, i, SPAN)))

    def covered(x: Column) -> Column:
        ordered = F.sort_array(F.transform(x, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
        twice = lambda o: F.filter(o, lambda e, k: (F.get(o, k - 1)["v"].eqNullSafe(e["v"])) | (F.get(o, k + 1)["v"].eqNullSafe(e["v"])))
        starts = F.sort_array(F.transform(let(ordered, twice), lambda e: e["i"]))
        width = lambda s: F.aggregate(F.transform(s, lambda p, k: F.least(F.lit(SPAN), F.coalesce(F.get(s, k + 1) - p, F.lit(SPAN)))), F.lit(0), lambda a, b: a + b)
        return let(starts, width)

    counted = lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), F.lit(0)).otherwise(covered(x))
    return F.when(F.size(words) > SPAN, let(let(hashes, windows), counted)).otherwise(F.lit(0)).cast("long")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The numbers the rules look at, one row per document."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    text, stop = F.col("t"), F.array(*[F.lit(w) for w in sorted(set(STOP_WORDS))])
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).alias("n_repeat_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    bare = F.regexp_replace(text, GAP, "")
    row = slim.select(
        "doc_id", let(words_of(text), of_words).alias("w"), let(lines, of_lines).alias("l"), F.length(bare).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size(F.array_intersect(words_of(F.lower(text)), stop)).cast("long").alias("n_stops"),
        F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}\p{N}]++(?![^\x20\x09-\x0D])")).cast("long").alias("n_bare"),
        F.regexp_count(text, F.lit(r"[.!?](?=[\x20\x09-\x0D]|$)")).cast("long").alias("n_ends"),
    )
    return row.select("doc_id", "w.*", "l.*", "word_chars", "n_symbols", "n_stops", "n_bare", "n_ends")


def rules() -> dict[str, Column]:
    """Votes of each rule on the columns of ``measure``: 1 good, -1 bad, 0 abstains."""
    c = F.col
    per = lambda a, b: c(a) / F.greatest(c(b), F.lit(1))
    vote = lambda bad, good: F.when(bad, -1).when(good, 1).otherwise(0)
    enough = c("n_words") >= 20
    return {
        "length": vote(~enough, c("n_words") >= 30),
        "symbols": vote(per("n_symbols", "n_words") > 0.08, per("n_symbols", "n_words") <= 0.03),
        "lines": vote(per("n_dup_lines", "n_lines") > 0.3, per("n_dup_lines", "n_lines") <= 0.15),
        "repeats": vote(per("n_repeat_words", "n_words") > 0.25, enough & (per("n_repeat_words", "n_words") <= 0.2)),
        "variety": vote((per("n_distinct", "n_words") < 0.3) & (c("n_words") < 2000), per("n_distinct", "n_words") > 0.4),
        "stops": vote(enough & (c("n_stops") < 3), c("n_stops") >= 5),
        "endings": vote(enough & (per("n_ends", "n_words") < 0.04), per("n_ends", "n_words") > 0.06),
        "separators": vote(per("n_bare", "n_words") > 0.1, per("n_bare", "n_words") <= 0.03),
        "shape": vote(per("word_chars", "n_words") > 9, per("word_chars", "n_words").between(3.5, 7.0)),
    }


#: Chance that a rule that votes says good or bad: of good documents, and of bad ones, before anything is learned.
START = ((0.9, 0.1), (0.35, 0.65))
#: Weight of the starting values, as a share of all documents: it keeps the two classes from
#: drifting to some other division of the corpus.
ANCHOR = 0.05


def learn_accuracies(patterns: DataFrame, names: list[str], rounds: int = 40) -> DataFrame:
    """Expectation-maximisation over (v_<rule>..., n), as one column expression over the array of
    patterns (at most three to the number of rules): a row (good, chance) with the share of good
    documents and chance[2 * rule + vote] = (given good, given bad). A rule that abstains says
    nothing about a document."""
    voted = F.filter(F.array(*[F.when(F.col(f"v_{r}") == 1, 2 * k).when(F.col(f"v_{r}") == -1, 2 * k + 1) for k, r in enumerate(names)]), lambda j: j.isNotNull())
    rows = patterns.select(F.struct(F.col("n").cast("double").alias("n"), voted.alias("votes")).alias("p"))
    pair = lambda g, b: F.struct(g.alias("g"), b.alias("b"))
    start = F.array(*[pair(F.lit(START[0][v]), F.lit(START[1][v])) for _ in names for v in range(2)])
    state = lambda good, chance: F.struct(good.alias("good"), chance.alias("chance"))

    def learned(ps: Column) -> Column:
        def turn(model: Column, _: Column) -> Column:
            weigh = lambda p: F.struct(p["votes"].alias("votes"), p["n"].alias("n"), (p["n"] * _chance(model, p["votes"])).alias("g"))

            def again(ws: Column) -> Column:
                total = lambda f: F.aggregate(ws, F.lit(0.0), lambda a, w: a + f(w))
                both = F.struct(total(lambda w: w["n"]).alias("n"), total(lambda w: w["g"]).alias("g"))

                def updated(t: Column) -> Column:
                    def entry(j: Column) -> Column:
                        twin = j + 1 - 2 * (j % 2)
                        has = lambda w, k: F.array_contains(w["votes"], k)
                        summed = lambda k: pair(total(lambda w: F.when(has(w, k), w["g"]).otherwise(0.0)), total(lambda w: F.when(has(w, k), w["n"] - w["g"]).otherwise(0.0)))
                        first, anchor = F.element_at(start, j + 1), t["n"] * ANCHOR + 1
                        return let(F.struct(summed(j).alias("own"), summed(twin).alias("other")), lambda x: pair(*[(x["own"][k] + anchor * first[k]) / (x["own"][k] + x["other"][k] + anchor) for k in "gb"]))

                    return state((t["g"] + 8) / (t["n"] + 10), F.transform(F.sequence(F.lit(0), F.lit(2 * len(names) - 1)), entry))

                return let(both, updated)

            return let(F.transform(ps, weigh), again)

        return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), state(F.lit(0.8), start), turn)

    return rows.agg(F.collect_list("p").alias("ps")).select(let(F.col("ps"), learned).alias("m")).select("m.good", "m.chance")


def _chance(model: Column, votes: Column) -> Column:
    """Posterior of good documents given the votes (as places in ``chance``)."""
    odds = F.aggregate(votes, F.log(model["good"] / (1 - model["good"])), lambda a, j: a + F.log(F.element_at(model["chance"], j + 1)["g"] / F.element_at(model["chance"], j + 1)["b"]))
    return 1 / (1 + F.exp(-odds))


def posterior(model: dict, names: list[str]) -> Column:
    """Chance that a document with these votes (columns v_<rule>) is good."""
    odds = F.lit(math.log(model["good"] / (1 - model["good"])))
    for k, r in enumerate(names):
        say = [math.log(g / b) for g, b in model["chance"][2 * k : 2 * k + 2]]
        odds = odds + F.when(F.col(f"v_{r}") == 1, say[0]).when(F.col(f"v_{r}") == -1, say[1]).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def quality(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, base numbers, base_failed, quality (posterior) and kept."""
    votes = rules()
    names = list(votes)
    measured = cut(measure(docs, id_col, text_col).select("*", *[v.alias(f"v_{r}") for r, v in votes.items()]))
    patterns = measured.groupBy(*[f"v_{r}" for r in names]).agg(F.count(F.lit(1)).alias("n"))
    model = learn_accuracies(patterns, names).first().asDict()
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    good = posterior(model, names)
    return measured.select(
        F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (good >= least)).alias("kept"), good.alias("quality"), *[f"v_{r}" for r in names]
    )
