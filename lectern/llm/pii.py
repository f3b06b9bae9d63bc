"""Personal data: regular expressions propose spans, checksums confirm, context adjusts the score.

All in Spark column expressions. A pattern is applied twice by Spark's regex functions: once for
the matches and once for what lies between them; lengths of both give each match's place in code
points. Validators (Luhn, mod-97, octets up to 255, digit counts) drop a failing match without
retry. Words near a span raise or lower its score; base kinds (email, ip, card, phone) always
stay, the kinds added by the method (iban, ssn, secret) stay from ``least_score`` on.

The patterns are the contract's, with look-behinds and possessive quantifiers that change no
match but keep the time linear in the text and the matcher's stack flat.

Defined cases: null text is the empty text (no spans, hash of ''); texts of any length are read
whole; a span of one kind may overlap a span of another; repeated rows each give a row; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import blocks_of, part_of, running
from lectern.llm.common import let

#: kind, pattern, a cheap test that a text must pass to hold any match
BASE = (
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", None),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", None),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
)
ADDED = (
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", None),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-"),
    ("secret", r"(?i)(?<![a-z0-9_])(?:password|passwd|pwd|secret|token|api_?key)\x20?[=:]\x20?[\"']?[A-Za-z0-9+/_-]{8,}+", None),
)
KINDS = tuple(k for k, _, _ in BASE + ADDED)
#: Words that make a span of the kind likelier, looked for in ``WINDOW`` characters on both sides.
CONTEXT = {
    "email": "mail|contact|write|address|contacto|correo|adresse",
    "ip": "ip|host|server|address|login|client|servidor|serveur",
    "card": "card|credit|visa|payment|pay|tarjeta|carte|karte",
    "phone": "phone|call|tel|mobile|fax|telefon|llame|appelez",
    "iban": "iban|account|bank|konto|cuenta|compte|transfer",
    "ssn": "ssn|social|security|tax|identity",
    "secret": "password|secret|token|key|login|credential",
}
AGAINST = "example|sample|test|dummy|version|isbn|order|invoice"
WINDOW = 60
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "secret": 0.6}


def luhn(digits: Column) -> Column:
    """Luhn checksum of a string of digits."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: let(F.substring(digits, i, F.lit(1)).cast("int") * (1 + ((n - i) % 2)), lambda d: d - F.when(d > 9, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(iban: Column) -> Column:
    """IBAN check: first four characters to the end, letters as 10..35, remainder 1."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, F.lit(1), F.lit(4)))
    def step(acc, i):
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        # a longer run than 3 digits may still be at most 255 by leading zeros
        return F.forall(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), let(digits, luhn)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return let(F.regexp_replace(match, r"\x20", ""), lambda c: F.when(F.length(c).between(15, 34), mod97(c)).otherwise(F.lit(False)))
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9[0-9][0-9])") & ~match.rlike("-00-|-0000$")
    return F.lit(True)


_SPAN = "array<struct<start:int,place:int,kind:string,end:int,score:double>>"


def _spans(text: Column, kind: str, pattern: str, least_score: float | None) -> Column:
    """Spans of one kind: array of (start, place of the kind, kind, end, score)."""
    def scored(x: Column, blocks: Column) -> Column:
        first = F.greatest(x["start"] - WINDOW, F.lit(0))
        around = F.lower(F.concat_ws(" ", part_of(blocks, first, x["start"] - first), part_of(blocks, x["end"], F.lit(WINDOW))))
        near = lambda words: around.rlike(rf"(?<![a-z])(?:{words})")
        score = F.lit(PRIOR[kind]) + F.when(near(CONTEXT[kind]), 0.3).otherwise(0.0) - F.when(near(AGAINST), 0.3).otherwise(0.0)
        score = F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0))
        return F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("place"), F.lit(kind).alias("kind"), x["end"].alias("end"), score.alias("score"))

    def placed(m: Column) -> Column:
        """The matches with their places: each begins after all gaps up to its own and the matches before it."""

        def told(x: Column) -> Column:
            ends = running(F.transform(m, lambda y, i: F.element_at(x["gaps"], i + 1) + F.length(y)), F.lit(0), lambda a, y: a + y)
            starts = F.transform(ends, lambda e, i: e + F.element_at(x["gaps"], i + 1))
            spans = F.zip_with(m, starts, lambda y, at: F.struct(at.alias("start"), (at + F.length(y)).alias("end"), y.alias("match")))
            return F.transform(F.filter(spans, lambda y: _valid(kind, y["match"])), lambda y: scored(y, x["blocks"]))

        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
        return F.when(F.size(m) > 0, let(F.struct(gaps.alias("gaps"), blocks_of(text).alias("blocks")), told))

    out = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    if least_score is not None:
        out = F.filter(out, lambda x: x["score"] >= least_score)
    return F.coalesce(out, F.array()).cast(_SPAN)


def find_pii(docs: DataFrame, least_score: float = 0.5, text_col: str = "text", out_col: str = "pii") -> DataFrame:
    """``docs`` with ``out_col``: spans (start, place, kind, end, score) in order of start and kind. A column of that name is replaced."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    none = F.array().cast(_SPAN)
    digit = text.rlike("[0-9]")
    parts = []
    for kind, pattern, needs in BASE + ADDED:
        test = text.contains(needs) if needs else digit
        if kind == "secret":
            test = text.rlike("(?i)passw|pwd|secret|token|key")
        parts.append(F.when(test, _spans(text, kind, pattern, least_score if (kind, pattern, needs) in ADDED else None)).otherwise(none))
    return docs.withColumn(out_col, F.array_sort(F.concat(*parts)))


def span_string(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def pii_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts of the base kinds, base_sha256 and spans."""
    found = find_pii(docs.select(id_col, text_col), text_col=text_col)
    base = F.filter("pii", lambda x: x["place"] < len(BASE))
    counts = [_count(i).alias(f"n_{kind}") for i, (kind, _, _) in enumerate(BASE)]
    return found.select(id_col, *counts, F.sha2(span_string(base).cast("binary"), 256).alias("base_sha256"), span_string(F.col("pii")).alias("spans"))


def _count(place: int) -> Column:
    return F.size(F.filter("pii", lambda x: x["place"] == place)).cast("long")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span replaced by [KIND] in the text; overlapping spans are joined to the
    earliest one. Null texts stay null."""
    columns, name = docs.columns, "spans"
    while name in {c.lower() for c in columns}:
        name += "_"
    found = find_pii(docs, text_col=text_col, out_col=name)
    text = F.coalesce(F.col(text_col), F.lit(""))
    # the end of all spans before each one: a span that begins before it lies in another
    ends = running(F.transform(name, lambda x: x["end"]), F.lit(0), lambda a, y: F.greatest(a, y))

    def made(blocks):
        def piece(x, at):
            return F.when(x["start"] >= at, F.concat(part_of(blocks, at, x["start"] - at), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise("")

        last = F.array_max(F.transform(name, lambda x: x["end"]))
        return F.concat(F.array_join(F.zip_with(name, ends, piece), ""), part_of(blocks, last, F.length(text) - last))

    new = let(blocks_of(text), made)
    return found.withColumn(text_col, F.when(F.size(name) > 0, new).otherwise(F.col(text_col))).select(*columns)
