"""Search over a stored index: postings with positions, statistics, pages, and the registry of documents.

Only the postings of asked terms are read (their buckets' folders alone), statistics come from
the stored tables, and text is read for the best hits only, for their snippets. Ranks, ties and
operators are those of ``lectern.operators.search``: results are the same as by scanning pages.
"""

from __future__ import annotations

from collections import Counter
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.predicates import Unit, real_query, within
from lectern.functions.text import highlight_units, let, tokenize
from lectern.operators.index import page_entries, postings, with_tokens
from lectern.operators.search import IDF_FLOOR, idf, search_substring, weight
from lectern.sources.stored import FREQUENT, Segment, Snapshot, StoredIndex, grams_of

#: What a row of a query table may ask for in ``op``: all or any of its words, the words as a phrase, a phrase whose last
#: word is a prefix, all words near each other, the word as the first of a page.
OPS = ("all", "any", "phrase", "prefix", "near", "first")
NEAR = 10


def _starts(unit: Unit, found: dict[tuple[str, bool], Column]) -> Column:
    """Positions at which the unit begins on a page, from its words' positions."""
    out = None
    for k, word in enumerate(unit.words):
        at = F.transform(found[word, unit.prefix and k == len(unit.words) - 1], lambda p: p - k)  # noqa: B023
        out = at if out is None else F.array_intersect(out, at)
    return out


def _numbers(view: Snapshot, words: dict[str, int]) -> dict[str, dict[str, int]]:
    """df of each word in each segment, from the stored statistics."""
    parts = [view.segment_terms(s).where(F.col("term").isin(list(words))).select(F.lit(s.name).alias("segment"), "term", "df") for s in view.segments]
    rows = view._union(parts, "segment string, term string, df long").groupBy("segment", "term").agg(F.sum("df").alias("df")).collect()  # words times segments
    out: dict[str, dict[str, int]] = {}
    for r in rows:
        out.setdefault(r["segment"], {})[r["term"]] = r["df"]
    return out


def _of_word(values: dict[str, float]) -> Column:
    """The value of the row's term."""
    out = F.lit(0.0)
    for w, v in values.items():
        out = F.when(F.col("term") == w, F.lit(float(v))).otherwise(out)
    return out


class PlainSearch:
    """Ranked pages for plain words, all or any of them, from frequencies alone.

    Frequent words are pruned by block maxima. The best blocks by the sum of their words' largest
    contributions are scored first; the rank of the k-th page there is a threshold, and of all other blocks only
    those whose sum can reach it are read.
    """

    def __init__(self, view: Snapshot, words: dict[str, int], any_unit: bool, fp: str | None = None):
        self.view, self.words, self.any_unit, self.fp = view, words, any_unit, fp
        self.by_segment = _numbers(view, words)
        self.df = {w: sum(d.get(w, 0) for d in self.by_segment.values()) for w in words}
        self.idf = {w: max(log((view.n_pages - n + 0.5) / (n + 0.5)), IDF_FLOOR) * words[w] for w, n in self.df.items() if n > 0}

    def nothing(self) -> bool:
        return not self.idf or (not self.any_unit and len(self.idf) < len(self.words))

    def scored(self, blocks: dict[str, DataFrame] | None = None) -> DataFrame:
        """(fp, page_index, rank) of matching pages, in the given blocks of each segment only, if any are given."""
        parts = []
        for s in self.view.segments:
            if blocks is None or s.name in blocks:
                posts = self.view.segment_postings(s, list(self.idf), positions=False, blocks=None if blocks is None else blocks[s.name])
                if self.fp is not None:
                    posts = posts.where(F.col("fp") == self.fp)
                parts.append(posts.select("term", "fp", "page_index", "dl", "tf"))
        part = weight(_of_word(self.idf), F.col("tf"), F.col("dl"), F.lit(self.view.avgdl))
        pages = self.view._union(parts, "term string, fp string, page_index int, dl int, tf int").groupBy("fp", "page_index").agg((-F.sum(part)).alias("rank"), F.count(F.lit(1)).alias("met"))
        return (pages if self.any_unit else pages.where(F.col("met") == len(self.idf))).select("fp", "page_index", "rank")

    def bounds(self, segment: Segment) -> DataFrame | None:
        """(block, bound, n) of a segment's blocks that may hold a match; None: a word is too rare there to have blocks."""
        here = self.by_segment.get(segment.name, {})
        if any(0 < n < FREQUENT for n in here.values()):
            return None
        rows = self.view.blocks(segment, list(self.idf)).groupBy("block").agg(F.sum(_of_word(self.idf) * F.col("best")).alias("bound"), F.count(F.lit(1)).alias("met"), F.min("n").alias("n"))
        return (rows if self.any_unit else rows.where(F.col("met") == len(self.idf))).select("block", "bound", "n")

    def pruned(self, k: int, first: int = 64) -> dict[str, DataFrame]:
        """For each segment the blocks that can hold one of the k best pages (None: all of them)."""
        bounds = {s.name: self.bounds(s) for s in self.view.segments}
        whole = {name for name, b in bounds.items() if b is None}
        bounds = {name: b for name, b in bounds.items() if b is not None}
        if not bounds:
            return dict.fromkeys(whole)
        named = [b.withColumn("segment", F.lit(name)) for name, b in bounds.items()]
        best = self.view._union(named, "").orderBy(F.desc("bound"), "segment", "block").limit(max(first, 2 * k)).collect()
        chosen = {name: [r["block"] for r in best if r["segment"] == name] for name in bounds}
        tried = {name: self.view.spark.createDataFrame([(b,) for b in blocks], "block long") for name, blocks in chosen.items() if blocks}
        ranks = [r["rank"] for r in self.scored(tried).orderBy("rank").limit(k).collect()] if tried else []
        if len(ranks) < k:
            return dict.fromkeys([*whole, *bounds])
        return dict.fromkeys(whole) | {name: b.where(F.col("bound") >= -ranks[-1] - 1e-9).select("block") for name, b in bounds.items()}

    def best(self, k: int, prune_from: int) -> DataFrame:
        prune = self.fp is None and sum(self.df.values()) >= prune_from
        return self.scored(self.pruned(k) if prune else None).orderBy("rank", "fp", "page_index").limit(k)


#: Postings of a query's words from which on blocks are looked at first.
PRUNE_FROM = 2_000_000


def search_index(index: StoredIndex, units: list[Unit], k: int = 100, fp: str | None = None, any_unit: bool = False, unwanted: list[Unit] = (), prune_from: int = PRUNE_FROM) -> DataFrame:
    """(fp, path, page_index, rank, snippet) of the k best pages with all units (or any) and none of the unwanted ones."""
    view = index.now()
    nothing = view.spark.createDataFrame([], "fp string, path string, page_index int, rank double, snippet string")
    if not units or k <= 0 or not view.n_pages:
        return nothing
    if all(len(u.words) == 1 and not u.prefix for u in units) and not unwanted:
        search = PlainSearch(view, dict(Counter(u.words[0] for u in units)), any_unit, fp)
        if search.nothing():
            return nothing
        best = search.best(k, prune_from)
    else:
        best = _best_of_units(view, units, k, fp, any_unit, unwanted)
    wanted = F.array(*[F.struct(F.array(*[F.lit(w) for w in u.words]).alias("words"), F.lit(u.prefix).alias("prefix")) for u in units])
    told = view.pages_of(F.broadcast(best))  # k rows
    return told.select("fp", "path", "page_index", "rank", highlight_units(F.col("text"), wanted).alias("snippet")).orderBy("rank", "fp", "page_index")


def _best_of_units(view: Snapshot, units: list[Unit], k: int, fp: str | None, any_unit: bool, unwanted: list[Unit]) -> DataFrame:
    """(fp, page_index, rank) of the k best pages by positions: phrases, prefixes, and what must not be there."""
    words = {(w, u.prefix and i == len(u.words) - 1): None for u in [*units, *unwanted] for i, w in enumerate(u.words)}
    posts = view.postings([w for w, p in words if not p], [w for w, p in words if p])
    none = F.array().cast("array<int>")

    def gathered(word: str, prefix: bool) -> Column:
        """Positions of a word on the page that is grouped; those of all words with a prefix."""
        if prefix:
            return F.flatten(F.collect_list(F.when(F.col("term").startswith(word), F.col("positions"))))
        return F.coalesce(F.any_value(F.when(F.col("term") == word, F.col("positions")), True), none)

    names = {w: f"w{i}" for i, w in enumerate(words)}
    per_page = posts.groupBy("fp", "page_index", "dl").agg(*[gathered(*w).alias(n) for w, n in names.items()])
    found = {w: F.col(n) for w, n in names.items()}
    tf = [F.size(_starts(u, found)).alias(f"tf{i}") for i, u in enumerate(units)]
    bad = F.lit(False)
    for u in unwanted:
        bad = bad | (F.size(_starts(u, found)) > 0)
    counted = per_page.select("fp", "page_index", "dl", *tf, bad.alias("bad"))
    df = counted.agg(F.struct(*[F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(units))])).scalar()
    met = F.lit(any_unit is False)
    for i in range(len(units)):
        met = met | (F.col(f"tf{i}") > 0) if any_unit else met & (F.col(f"tf{i}") > 0)
    matched = counted.where(met & ~F.col("bad"))
    if fp is not None:
        matched = matched.where(F.col("fp") == fp)
    matched = matched.withColumn("s", df)
    rank = F.lit(0.0)
    for i in range(len(units)):
        rank = rank - weight(idf(F.lit(view.n_pages), F.col(f"s.df{i}")), F.col(f"tf{i}"), F.col("dl"), F.lit(view.avgdl))
    return matched.select("fp", "page_index", rank.alias("rank")).orderBy("rank", "fp", "page_index").limit(k)


#: Rows of a table of queries (or of their words) up to which it goes to all tasks; a longer one is joined as Spark decides.
MANY = 200_000


def _sent(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.limit(MANY + 1).count() <= MANY else rows


def scan_postings(pages: DataFrame, asked: DataFrame) -> DataFrame:
    """Postings (term, fp, page_index, dl, tf) of pages (fp, page_index, text) joined to a table of asked terms (term, ...), where no
    index is kept: one pass over the pages, and only postings of asked terms leave it."""
    return postings(with_tokens(pages)).join(_sent(asked), "term")


def asked_queries(queries: DataFrame) -> DataFrame:
    """(query_id, op, k, only, t, u) of a table (query_id, text, max_results[, op, fp, unwanted]): words, and unwanted words."""
    column = lambda name, kind: (F.col(name) if name in queries.columns else F.lit(None)).cast(kind)
    op = F.coalesce(F.lower(column("op", "string")), F.lit("all"))
    base = queries.where(real_query(F.col("text"), F.col("max_results"))).select(
        "query_id", op.alias("op"), F.col("max_results").alias("k"), column("fp", "string").alias("only"), tokenize(F.col("text")).alias("t"), tokenize(F.coalesce(column("unwanted", "string"), F.lit(""))).alias("u")
    )
    return base.withColumn("t", F.when(F.col("op") == "near", F.array_distinct("t")).otherwise(F.col("t"))).where(F.size("t") > 0)


def _opened(asked: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, term): the dictionary's words that begin with the last word of a prefix query: an equi-join on the asked lengths."""
    prefixes = asked.where("op = 'prefix'").select("query_id", F.element_at("t", -1).alias("start"))
    lengths = prefixes.agg(F.collect_set(F.length("start"))).scalar()  # no more than lengths of words
    opened = terms.select("term", F.explode(lengths).alias("n")).where(F.col("n") <= F.length("term"))
    opened = opened.select("term", F.substring(F.col("term"), F.lit(1), F.col("n")).alias("start"))
    return prefixes.join(opened, "start").select("query_id", "term")


def _with_leads(asked: DataFrame, terms: DataFrame, positional: bool) -> tuple[DataFrame, DataFrame]:
    """(the words to look for, queries by each word that leads to their pages).

    Where all words must be there, the rarest one leads; else each of them (each word with the prefix, if that is all there is).
    ``dfs`` is parallel to ``t``. Queries with a word that no page has are left out, if they need it.
    """
    words = asked.select("query_id", F.posexplode("t").alias("i", "term"))
    unwanted = asked.select(F.explode("u").alias("term"))
    known = terms.select("term", "df").join(_sent(words.select("term").unionByName(unwanted).distinct()), "term")
    numbers = words.join(_sent(known), "term", "left").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("i", "df"))).alias("dfs"))
    told = asked.join(numbers.select("query_id", F.transform("dfs", lambda x: x["df"]).alias("dfs")), "query_id")
    whole = F.when(F.col("op") == "prefix", F.size("t") - 1).otherwise(F.size("t"))
    ranked = F.array_sort(F.transform(F.slice(F.arrays_zip("dfs", "t"), F.lit(1), whole), lambda x: F.struct(x["dfs"].alias("df"), x["t"].alias("term"))))
    each = F.col("op") == "any"
    first = F.when(each, F.array_distinct(F.transform(ranked, lambda x: x["term"]))).when(F.col("op") == "first", F.array(F.get("t", F.lit(0)))).when(whole > 0, F.array(F.get(ranked, F.lit(0))["term"])).otherwise(F.array())
    told = told.where(each | ~F.exists(ranked, lambda x: x["df"].isNull()))
    leads = told.withColumn("lead", F.explode(first))
    wanted = known.select("term")
    if positional:
        opened = _opened(asked, terms)
        alone = told.where(whole == 0).join(opened.withColumnRenamed("term", "lead"), "query_id")
        leads, wanted = leads.unionByName(alone.select(*leads.columns)), wanted.unionByName(opened.select("term"))
    return wanted.distinct(), leads


def score_index(index: StoredIndex, queries: DataFrame, near: int = NEAR) -> DataFrame:
    """(query_id, fp, page_index, k, rank) of all pages that match a query of the table, each by its own operator.

    A posting of an asked word is read and shuffled once, whatever the number of queries that ask for it: a page's are gathered, and
    meet the queries there, each by one word that leads to it. What is told of a page and a query stays in its row.
    """
    view = index.now()
    positional = "op" in queries.columns
    wanted, leads = _with_leads(asked_queries(queries), view.terms(), positional)
    posts = view.postings_of(wanted if positional else _sent(wanted), positional)
    entry = F.struct("term", "tf", *(["positions"] if positional else []))
    pages = posts.groupBy("fp", "page_index", "dl").agg(F.collect_list(entry).alias("entries"))
    return _met_queries(pages, leads, positional, view.n_pages, view.avgdl, near)


def score_pages(pages: DataFrame, queries: DataFrame, folder: str, near: int = NEAR) -> DataFrame:
    """``score_index`` of a batch of queries for which no index is kept, over pages (fp, page_index, text): one pass counts the
    asked words, in another a page's postings meet the queries in its row (in one more those that ask for phrases, prefixes or first
    words). None shuffles a posting; ``folder`` gets the counts, and the pages of phrases."""
    spark, positional, asked = pages.sparkSession, "op" in queries.columns, asked_queries(queries)
    rows = asked.select(F.explode(F.concat("t", "u")).alias("term"), F.lit(False).alias("start"))
    if positional:
        rows = rows.unionByName(asked.where("op = 'prefix'").select(F.element_at("t", -1).alias("term"), F.lit(True).alias("start")))
    named = rows.distinct().limit(MANY + 1).collect()
    # too many to send: pages keep all their words
    words = [r["term"] for r in named if not r["start"]] if len(named) <= MANY else None
    starts = [r["term"] for r in named if r["start"]]
    tokens = with_tokens(pages)
    row = lambda term, n: F.struct(term.alias("term"), F.lit(1).cast("long").alias("df"), n.cast("long").alias("cf"))
    of_page = F.concat(F.array(row(F.lit(None).cast("string"), F.col("dl"))), F.transform("entries", lambda e: row(e["term"], e["tf"])))
    counted = page_entries(tokens, words, starts).select(F.inline(of_page)).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    counts = _kept(counted, f"{folder}/terms")
    whole = counts.where("term is null").first()
    n_pages, avgdl = (whole["df"], whole["cf"] / whole["df"]) if whole else (0, None)
    _, leads = _with_leads(asked, counts.where("term is not null"), positional)
    return _met_queries(page_entries(tokens, words, starts, positional), leads, positional, n_pages, avgdl, near, f"{folder}/units")


def _kept(rows: DataFrame, folder: str) -> DataFrame:
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def _met_queries(pages: DataFrame, leads: DataFrame, positional: bool, n_pages: int, avgdl: float | None, near: int, folder: str | None = None) -> DataFrame:
    """(query_id, fp, page_index, k, rank) of pages (fp, page_index, dl, entries) and the queries that lead to them. What is needed twice is
    written to ``folder``, if one is given: pages aren't passed over again for it."""
    lead = F.explode(F.array_distinct(F.transform("entries", lambda e: e["term"])))
    met = pages.select("*", lead.alias("lead")).join(_sent(leads), "lead")
    entries, t = F.col("entries"), F.col("t")
    of = lambda w: F.filter(entries, lambda e: e["term"] == w)
    tf = lambda w: F.aggregate(of(w), F.lit(0), lambda n, e: n + e["tf"])
    there = lambda w: F.exists(entries, lambda e: e["term"] == w)
    # of several words that lead to a page, the first there is counts
    opened = (F.col("op") == "prefix") & (F.size("t") == 1)
    leading = F.filter(F.transform("entries", lambda e: e["term"]), lambda w: F.when(opened, w.startswith(F.get(t, F.lit(0)))).otherwise(F.array_contains(t, w)))
    several = (F.col("op") == "any") | opened
    met = met.where(F.when(several, F.col("lead") == F.array_min(leading)).otherwise(True) & F.when(F.col("op").isin("any", "prefix"), True).otherwise(F.forall("t", there)))
    inside = (F.col("only").isNull() | (F.col("only") == F.col("fp"))) & ~F.exists("u", there)
    out = ["query_id", "fp", "page_index", "k", "rank"]
    n_pages, avgdl = F.lit(n_pages), F.lit(avgdl).cast("double")
    share = lambda df, n: weight(idf(n_pages, df), n, F.col("dl"), avgdl)
    plain = met.where(inside & ~F.col("op").isin("phrase", "prefix", "first")) if positional else met.where(inside)
    if positional:
        # places of words are gathered for near queries only
        at = F.transform("t", lambda w, i: F.transform(F.flatten(F.transform(of(w), lambda e: e["positions"])), lambda p: F.struct(p.alias("at"), i.alias("unit"))))
        plain = plain.where(F.when(F.col("op") == "near", within(F.array_sort(F.flatten(at)), F.size("t"), near)).otherwise(True))
    sums = F.aggregate(F.arrays_zip("t", "dfs"), F.lit(0.0), lambda x, w: x + F.when(there(w["t"]), share(w["dfs"], tf(w["t"]))).otherwise(0.0))
    plain = plain.withColumn("rank", -sums).select(*out)
    if not positional:
        return plain
    # phrases, prefixes and first words: places where the unit begins, and then the pages that have it
    last = F.size("t") - 1
    places = F.transform("t", lambda w, i: F.transform(F.flatten(F.transform(F.filter(entries, lambda e: F.when((F.col("op") == "prefix") & (i == last), e["term"].startswith(w)).otherwise(e["term"] == w)), lambda e: e["positions"])), lambda p: p - i))
    begun = F.aggregate(F.slice(places, F.lit(2), F.size(places)), F.get(places, F.lit(0)), F.array_intersect)
    first = F.when(F.forall("t", lambda w: F.exists(of(w), lambda e: F.array_contains(e["positions"], 0))), 1).otherwise(0)
    found = met.where(F.col("op").isin("phrase", "prefix", "first")).withColumn("tf", F.when(F.col("op") == "first", first).otherwise(F.size(begun))).where("tf > 0")
    found = found.select("query_id", "fp", "page_index", "k", "dl", "tf", F.when(F.col("op") == "first", F.size("t")).otherwise(1).alias("units"), inside.alias("inside"))
    found = _kept(found, folder) if folder else found
    df = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("df"))
    more = found.where("inside").join(df, "query_id")
    return plain.unionByName(more.withColumn("rank", -share(F.col("df"), F.col("tf")) * F.col("units")).select(*out))


def search_index_batch(index: StoredIndex, queries: DataFrame, near: int = NEAR) -> DataFrame:
    """(query_id, place, fp, path, page_index, rank, snippet): the best hits of every query of a table
    (query_id, text, max_results[, op, fp, unwanted]) in one pass. Paths and texts join after the top k."""
    order = Window.partitionBy("query_id").orderBy(F.round("rank", 9), "fp", "page_index")  # sums come in any order
    best = score_index(index, queries, near).withColumn("place", F.row_number().over(order)).where("place <= k").drop("k")
    op = F.coalesce(F.lower("op"), F.lit("all")) if "op" in queries.columns else F.lit("all")
    t = tokenize(F.col("text"))
    each = let(t, lambda x: F.transform(x, lambda w: F.struct(F.array(w).alias("words"), F.lit(False).alias("prefix"))))
    units = F.when(op.isin("phrase", "prefix"), F.array(F.struct(t.alias("words"), (op == "prefix").alias("prefix")))).otherwise(each)
    told = index.now().pages_of(best).join(queries.select("query_id", units.alias("units")), "query_id")
    return told.select("query_id", "place", "fp", "path", "page_index", "rank", highlight_units(F.col("text"), F.col("units")).alias("snippet"))


def substring_index(index: StoredIndex, needle: str, k: int = 100) -> DataFrame:
    """``search_substring`` over the index: pages that hold all three-character strings of the needle are read and searched, no
    others. A needle without such strings is searched for in all pages."""
    view, grams = index.now(), grams_of(needle)
    if not grams or not needle.strip() or k <= 0:
        return search_substring(view.pages(), needle, k)
    return search_substring(view.candidates(grams), needle, k)
