"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import table


def _piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.toxicity import toxicity_digest

    return toxicity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.quality import quality

    return quality(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.language import language_digest

    return language_digest(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.jaccard import linked_components

    return linked_components(table(spark, sf_dir, "documents"), words=4, percent=85)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.pieces import piece_digests

    return piece_digests(table(spark, sf_dir, "documents"), _piece_model())


def op6_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.pseudo import pseudo_likelihood

    return pseudo_likelihood(table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.pii import pii_digest

    return pii_digest(table(spark, sf_dir, "documents"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.licences import licence_digest

    return licence_digest(table(spark, sf_dir, "documents"))


def op11_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.flatgraph import graph_links

    return graph_links(table(spark, sf_dir, "embeddings")).rows


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.variants import variants

    return variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_quality_rules, op3_language, op4_ngram_jaccard, op5_sentencepiece, op6_pseudo_likelihood, op7_source_mixing, op8_nearest, op9_pii, op10_licences, op11_flat_graph, op12_collocations, op13_spelling_variants)}


def _pii_sql() -> str:
    """Patterns as the contract has them; what look-arounds say about the neighbours of a match is tested afterwards."""
    from lectern.llm.pii import AGAINST, CONTEXT, KINDS, PRIOR, WINDOW

    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9](?:[ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]",
        "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "secret": r"(?i)(?:password|passwd|pwd|secret|token|api_?key) ?[=:] ?[\x22']?[A-Za-z0-9+/_-]{8,}",
    }
    valid = {
        "email": "true",
        "ip": "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CAST('0' || ltrim(x, '0') AS HUGEINT) > 255)) = 0",
        "card": "length(d) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i: CAST(substr(d, i, 1) AS INT) * (1 + (length(d) - i) % 2) - CASE WHEN CAST(substr(d, i, 1) AS INT) * (1 + (length(d) - i) % 2) > 9 THEN 9 ELSE 0 END)) % 10 = 0",
        "phone": "length(d) BETWEEN 9 AND 15",
        "iban": "length(c) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(string_split(substr(c, 5) || substr(c, 1, 4), ''), lambda x: CASE WHEN x >= 'A' THEN ascii(x) - 55 ELSE ascii(x) - 48 END)), lambda x, y: (x * CASE WHEN y >= 10 THEN 100 ELSE 10 END + y) % 97) = 1",
        "ssn": "NOT regexp_matches(p || ' ' || q, '[0-9-]') AND NOT regexp_matches(m, '^(?:000|666|9[0-9][0-9])') AND NOT regexp_matches(m, '-00-|-0000$')",
        "secret": "NOT regexp_matches(lower(p), '[a-z0-9_]')",
    }
    parts = []
    for kind in KINDS:
        pattern = patterns[kind].replace("'", "''")
        score = f"{PRIOR[kind]} + CASE WHEN regexp_matches(around, '(?:^|[^a-z])(?:{CONTEXT[kind]})') THEN 0.3 ELSE 0.0 END - CASE WHEN regexp_matches(around, '(?:^|[^a-z])(?:{AGAINST})') THEN 0.3 ELSE 0.0 END"
        # a word boundary takes the underscore for a letter, which the operator doesn't
        source = "replace(text, '_', '-')" if kind == "iban" else "text"
        keep = "true" if kind in ("email", "ip", "card", "phone") else f"{score} >= 0.5"
        parts.append(f"""SELECT doc_id, {KINDS.index(kind)} AS place, '{kind}' AS kind, a, a + length(m) AS e FROM (
  SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS d, replace(m, ' ', '') AS c, CASE WHEN a > 0 THEN substr(text, a, 1) ELSE '' END AS p, substr(text, a + length(m) + 1, 1) AS q,
    lower(substr(text, greatest(a + 1 - {WINDOW}, 1), least(a, {WINDOW})) || ' ' || substr(text, a + length(m) + 1, {WINDOW})) AS around FROM (
    SELECT doc_id, text, ms[i] AS m, CAST(list_sum(list_transform(list_slice(gs, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(ms, 1, i - 1), lambda x: length(x))), 0) AS BIGINT) AS a FROM (
      SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, text, regexp_extract_all({source}, '{pattern}') AS ms, regexp_split_to_array({source}, '{pattern}') AS gs FROM documents)))) WHERE {valid[kind]} AND {keep}""")
    told = "string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, place)"
    counts = ", ".join(f"count(*) FILTER (place = {i}) AS n_{k}" for i, k in enumerate(KINDS[:4]))
    return f"""WITH f AS ({' UNION ALL '.join(parts)}), t AS (SELECT doc_id, {counts}, coalesce({told} FILTER (place < 4), '') AS base, {told} AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in KINDS[:4])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id"""


ORACLE_SQL: dict[str, str] = {
    "op11_flat_graph": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, label, e FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a), m AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, least(v.vec_id, coalesce(m.m, v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce(m.m, v.vec_id)) AS kept
FROM v LEFT JOIN n ON v.vec_id = n.a LEFT JOIN m ON v.vec_id = m.a""",
    "op12_collocations": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
inside AS (SELECT lang, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, max(a) AS most FROM c, (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS i) WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN inside USING (lang, phrase) WHERE most IS NULL OR 100 * CAST(most AS HUGEINT) < 80 * CAST(a AS HUGEINT)),
cuts AS (SELECT kept.lang, kept.phrase, kept.a, j, x.a AS l, y.a AS r, CAST(2000000 * CAST(kept.a AS HUGEINT) // (x.a + y.a) AS BIGINT) AS score FROM kept, (SELECT unnest([1, 2, 3]) AS j), f x, f y
  WHERE j < kept.k AND x.lang = kept.lang AND y.lang = kept.lang AND x.phrase = array_to_string(list_slice(kept.w, 1, j), ' ') AND y.phrase = array_to_string(list_slice(kept.w, j + 1, kept.k), ' ')),
s AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM cuts),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM s WHERE o = 1)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM t JOIN n USING (lang) WHERE rank <= 2000""",
    "op4_ngram_jaccard": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
u AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(m.m, n.doc_id)) AS component_id FROM n LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) m ON n.doc_id = m.a""",
    "op13_spelling_variants": r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)) AS t),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents),
d AS (SELECT doc_id, w, count(*) AS n FROM r WHERE length(w) >= 6 GROUP BY ALL),
b AS (SELECT w, n, flatten(list_transform(string_split(doc_id || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, CAST(unicode(c) AS BIGINT) - 64] END)) AS bytes FROM d),
h AS (SELECT w, n, xor(list_reduce(bytes, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295), 4294967295) AS h FROM b, tab),
o AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM o WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
k AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
x AS (SELECT word, n, i, substr(word, 1, CAST(i - 1 AS INT)) || chr(0) || substr(word, CAST(i + 1 AS INT)) AS hole, substr(word, 1, CAST(i - 1 AS INT)) || substr(word, CAST(i + 1 AS INT)) AS less FROM k),
p AS (SELECT a.word AS a, b.word AS b, b.n AS n FROM x a JOIN x b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT x.word, v.word, v.n FROM x JOIN v ON x.less = v.word
  UNION SELECT v.word, x.word, x.n FROM x JOIN v ON x.less = v.word),
m AS (SELECT a, count(*) AS n_near, max(n) AS best_n, arg_min(b, (-n, b)) AS best FROM p GROUP BY a),
f AS (SELECT word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * v.n THEN best END AS form, CASE WHEN best_n >= 5 * v.n THEN best_n END AS form_n FROM v LEFT JOIN m ON v.word = m.a),
c AS (SELECT word, form AS at FROM f WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form FROM c JOIN f ON c.at = f.word WHERE f.form IS NOT NULL),
e AS (SELECT c.word, c.at FROM c JOIN f ON c.at = f.word WHERE f.form IS NULL)
SELECT f.word, f.form, coalesce(e.at, f.word) AS root, f.n, f.n_near, f.form_n FROM f LEFT JOIN e ON f.word = e.word""",
    "op9_pii": _pii_sql(),
}
