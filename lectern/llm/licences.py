"""Licence scan of paragraphs, in DataFrame and Spark ML functions only.

A multinomial logistic regression over sparse word n-grams (one to three words) is trained on
wordings of licence families and, for the class ``none``, on paragraphs of a bounded sample of
the corpus and on sentences that only sound like licences. A second, one-feature regression turns
the margin over ``none`` into a calibrated chance; its margins come from models that have not seen
the wording in question in any variant (whole wordings are dealt to ``FOLDS`` folds by hash). Every
paragraph of every document is scored; those above the calibrated bar are compared with the
templates of the predicted family, and a paragraph that repeats most of a template's word triples
is confirmed. What looks like a licence but matches no template of its family is ``unknown``.

Only n-grams of the wordings carry weight (a table bounded by the wordings). A document, and then
a paragraph, without any of the words whose n-grams it takes to reach the bar is left out before
its n-grams are built; this loses nothing. A paragraph without any weighted n-gram is none.

Defined cases: null text has no paragraphs; blank lines are none; each row is a document
with a score of its own, whatever its doc_id (paragraphs are keyed by the text's sha-256); an empty table gives an empty result; extra columns are ignored; texts are read
whole.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import cut, let
from lectern.llm.quality import STOP_WORDS

#: Wordings of licence families (fixed values: short public licence notices).
WORDINGS: dict[str, tuple[str, ...]] = {
    "mit": (
        "Released under the MIT License.", "This project is licensed under the MIT License.", "Licensed under the MIT license", "Distributed under the terms of the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.", "This work is licensed under the Apache License 2.0", "Released under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License version 2", "Released under the GNU GPL version 3 or later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ),
    "lgpl": ("Licensed under the GNU Lesser General Public License, version 3.", "This library is distributed under the GNU Lesser General Public License", "Released under the GNU LGPL version 2.1"),
    "agpl": ("Licensed under the GNU Affero General Public License, version 3.", "Released under the GNU AGPL version 3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    "bsd": (
        "Licensed under the BSD 3-Clause License.", "Released under the BSD 2-Clause License", "Use of this source code is governed by a BSD-style license",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0", "Released under the MPL 2.0"),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License", "Available under the Creative Commons Attribution License"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Text is available under the Creative Commons Attribution-ShareAlike License"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Available under CC BY-NC for noncommercial use"),
    "cc0": ("Released under CC0 1.0.", "This work is dedicated to the public domain under CC0", "To the extent possible under law, the author has waived all copyright and related rights to this work", "This work is in the public domain"),
    "proprietary": ("All rights reserved.", "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission", "Proprietary and confidential. Unauthorized copying is strictly prohibited"),
}
#: Sentences that use licence words without granting one.
NOT_LICENCES = (
    "He got his driving license last week", "The club lost its liquor license", "You need a license to fish here", "a licensed electrician should do this work", "She asked for permission to leave early", "The copyright debate went on for years",
    "students at MIT built a robot", "The Apache helicopter landed at the base", "civil rights and human rights for all", "The table was reserved for all guests", "a public library in general use", "the general public was not admitted",
    "version 2.0 of the game came out", "the software was released in May", "This work is hard", "the terms of the treaty", "commons and lords", "a creative writer", "she released the record under another name", "free of charge for children",
    "gehen wir mit ihm", "mit der Bahn und mit dem Rad", "por la licencia del camino", "la licence de pêche", "the source of the river", "conditions are met by many", "no part of the house", "written permission from a parent",
)
NONE, UNKNOWN = "none", "unknown"


def _tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9à-ÿ.+]+|[.](?![0-9])"), "")


def _ngrams(words: Column, longest: int = 3) -> Column:
    """Distinct n-grams of an array of words."""
    def of(w: Column) -> Column:
        return F.array_distinct(F.concat(w, *[_of_length(w, n) for n in range(2, longest + 1)]))

    return let(words, of)


def _telling(grams: Column) -> Column:
    """N-grams with a word that isn't among the commonest of their language."""
    stop = F.array(*[F.lit(w) for w in sorted(set(STOP_WORDS))])
    return F.filter(grams, lambda g: F.exists(F.split(g, " "), lambda w: ~F.array_contains(stop, w)))


def _of_length(words: Column, n: int) -> Column:
    made = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, made).otherwise(F.array().cast("array<string>"))


def _triples(words: Column) -> Column:
    """What templates are compared by: word triples, or pairs of a two-word text."""
    return F.array_distinct(F.when(F.size(words) >= 3, _of_length(words, 3)).otherwise(_of_length(words, 2)))


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "par")).where(r"par rlike '\\S'")


class LicenceModel:
    """Weights of n-grams for each class (``none`` is the last), and the calibration of the margin."""

    def __init__(self, classes: list[str], weights: dict[str, list[float]], bias: list[float], slope: float, shift: float):
        self.classes, self.weights, self.bias, self.slope, self.shift = classes, weights, bias, slope, shift

    def anchors(self, bar: float) -> list[str] | None:
        """Words of which a paragraph must have one to reach the bar; None if a single n-gram may do.

        Each n-gram that speaks for a family is put under its longest word. Words are left out,
        common ones first and then those that matter least, as long as all n-grams under them
        together can't lift any family over the bar.
        """
        none = self.classes.index(NONE)
        margin = (math.log(bar / (1 - bar)) - self.shift) / self.slope
        room = [self.bias[none] - b + margin - 1e-6 for b in self.bias[:none]]
        if min(room) <= 0:
            return None
        under: dict[str, list[float]] = {}
        for gram, w in self.weights.items():
            gain = [max(0.0, x - w[none]) for x in w[:none]]
            if any(gain):
                word = max(gram.split(" "), key=lambda t: (t not in STOP_WORDS, len(t), t))
                under[word] = [x + y for x, y in zip(under.get(word, [0.0] * none), gain, strict=True)]
        kept = []
        for word in sorted(under, key=lambda t: (t not in STOP_WORDS, max(under[t]), t)):
            left = [r - g for r, g in zip(room, under[word], strict=True)]
            if min(left) > 0:
                room = left
            else:
                kept.append(word)
        return sorted(kept)


def _has_any(text: Column, words: list[str]) -> Column:
    """Whether one of ``words`` may be a token of the text; true wherever it is one."""
    parts: dict[str, list[str]] = {}
    for w in words:
        parts.setdefault(w[0], []).append(re.escape(w[1:]))
    pattern = "|".join(f"{re.escape(c)}(?:{'|'.join(sorted(rest))})" for c, rest in sorted(parts.items()))
    return F.lower(text).rlike(f"(?<![a-z0-9à-ÿ])(?:{pattern})(?![a-z0-9à-ÿ])") if words else F.lit(False)


def _examples() -> list[tuple[str, str, str, float]]:
    """(paragraph, family, wording it comes from, weight)."""
    rows = []
    for family, texts in WORDINGS.items():
        for t in texts:
            words = t.split()
            rows += [(t, family, t, 4.0), (f"{t} and the rest of it was seen by all of them that day", family, t, 1.0), (f"© 2020 The authors. {t}", family, t, 1.0)]
            rows += [(" ".join(words[:-1]), family, t, 1.0), (" ".join(words[1:]), family, t, 1.0)] if len(words) > 4 else []
    return rows + [(t, NONE, t, 4.0) for t in NOT_LICENCES]


def sampled_paragraphs(docs: DataFrame, id_col: str, text_col: str, sample_docs: int) -> DataFrame:
    """Distinct paragraphs of at most ``sample_docs`` documents: ids and hashes are drawn first, texts
    are joined to the drawn ones, so that no text is sorted."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    marked = slim.withColumn("h", F.xxhash64("text"))
    drawn = marked.select(F.col("doc_id").alias("d_id"), F.col("h").alias("d_h")).orderBy(F.xxhash64("d_id"), "d_id", "d_h").limit(sample_docs)
    chosen = marked.join(F.broadcast(drawn), (F.col("doc_id") == F.col("d_id")) & (F.col("h") == F.col("d_h")), "left_semi")  # sample_docs rows
    return paragraphs(chosen, "doc_id", "text").select("par").distinct()


FOLDS = 3


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 200, regular: float = 2e-4) -> LicenceModel:
    """Fit on the wordings and on paragraphs of at most ``sample_docs`` documents, drawn by hash of the
    id; the few sampled paragraphs that repeat half of a template are no examples of ``none``."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.functions import array_to_vector, vector_to_array

    spark = docs.sparkSession
    classes = [*WORDINGS, NONE]
    none = len(classes) - 1
    named = spark.createDataFrame(_examples(), "par string, family string, wording string, weight double")
    named = named.select(_tokens(F.col("par")).alias("words"), "family", "wording", "weight")
    # spread over tasks: n-grams of the sample are the costly part
    seen = cut(sampled_paragraphs(docs, id_col, text_col, sample_docs)).repartition(max(8, spark.sparkContext.defaultParallelism)).select("par", _tokens(F.col("par")).alias("words"))
    known = _compared(seen.select("par", _triples(F.col("words")).alias("triples")), template_table(spark)).where("share >= 0.5").select("par").distinct()
    plain = seen.join(known, "par", "left_anti").select("words", F.lit(NONE).alias("family"), F.col("par").alias("wording"), F.lit(1.0).alias("weight"))
    telling = named.where(F.col("family") != NONE).select(_telling(_ngrams(F.col("words"))).alias("grams"))
    vocabulary = CountVectorizer(inputCol="grams", outputCol="features", binary=True, vocabSize=4000, minDF=2.0).fit(telling)
    label = F.coalesce(*[F.when(F.col("family") == c, F.lit(float(k))) for k, c in enumerate(classes)])
    fold = (F.crc32(F.col("wording").cast("binary")) % FOLDS).cast("int")
    rows = vocabulary.transform(named.unionByName(plain).select(_ngrams(F.col("words")).alias("grams"), label.alias("label"), fold.alias("fold"), "weight"))
    rows = cut(rows.select("features", "label", "fold", "weight")).repartition(2).cache()  # a bounded sample
    # none, the last class, has examples in every fold, so there are as many classes whatever a fold holds
    fit = LogisticRegression(family="multinomial", regParam=regular, elasticNetParam=0.2, maxIter=60, weightCol="weight", standardization=False).fit
    raw = vector_to_array("rawPrediction")
    margin = F.array_max(F.slice(raw, 1, none)) - F.element_at(raw, none + 1)
    unseen = [fit(rows.where(F.col("fold") != k)).transform(rows.where(F.col("fold") == k)) for k in range(FOLDS)]
    pairs = reduce(DataFrame.unionByName, [x.select(array_to_vector(F.array(margin)).alias("features"), (F.col("label") != none).cast("double").alias("label")) for x in unseen]).cache()
    slope, shift = 1.0, 0.0
    if pairs.select("label").distinct().count() == 2:
        platt = LogisticRegression(regParam=0.01, maxIter=40).fit(pairs)
        slope, shift = float(platt.coefficients[0]), float(platt.intercept)
    fitted = fit(rows)
    matrix, bias = fitted.coefficientMatrix.toArray(), [float(x) for x in fitted.interceptVector.toArray()]
    weights = {g: [float(x) for x in matrix[:, k]] for k, g in enumerate(vocabulary.vocabulary) if abs(matrix[:, k]).max() > 1e-6}
    rows.unpersist()
    pairs.unpersist()
    return LicenceModel(classes, weights, bias, max(0.05, slope), shift)


def template_table(spark: SparkSession) -> DataFrame:
    """(template, family, wanted): the word triples of each wording; a few dozen rows."""
    rows = [(f, t) for f, ts in WORDINGS.items() for t in ts]
    return spark.createDataFrame(rows, "family string, template string").withColumn("wanted", _triples(_tokens(F.col("template"))))


def _compared(pars: DataFrame, templates: DataFrame) -> DataFrame:
    """Shares of each template's triples that a paragraph has, for templates it has one of. ``triples`` is its array."""
    by = templates.select("family", "template", F.size("wanted").alias("size"), F.explode("wanted").alias("triple"))
    hits = pars.withColumn("triple", F.explode("triples")).join(F.broadcast(by), "triple")  # as many rows as the wordings have triples
    keys = [c for c in pars.columns if c != "triples"]
    return hits.groupBy(*keys, F.col("family").alias("t_family"), "template").agg((F.count(F.lit(1)) / F.first("size")).alias("share"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, text): what is found depends on the text only, so its hash is the key."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("key"), text.alias("text"))


def scan(docs: DataFrame, model: LicenceModel, bar: float = 0.5, confirm: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Paragraphs of each row taken for licences: doc_id, place, family, chance, confirmed, predicted."""
    keyed = _keyed(docs, id_col, text_col)
    return keyed.drop("text").join(_scan(keyed.drop("doc_id"), model, bar, confirm).withColumnRenamed("doc_id", "key"), "key").drop("key")


def _scan(texts: DataFrame, model: LicenceModel, bar: float = 0.5, confirm: float = 0.6) -> DataFrame:
    """Paragraphs of texts (key, text) taken for licences, once for each distinct text: doc_id (the key), place, family, chance, confirmed, predicted."""
    spark = texts.sparkSession
    none = model.classes.index(NONE)
    anchors = model.anchors(bar)
    if anchors is None:
        pars = paragraphs(texts, "key", "text").withColumn("words", _tokens(F.col("par"))).drop("par")
    else:
        some = paragraphs(texts.where(_has_any(F.col("text"), anchors)), "key", "text").where(_has_any(F.col("par"), anchors))
        listed = F.array(*[F.lit(a) for a in anchors]).cast("array<string>")
        pars = some.withColumn("words", _tokens(F.col("par"))).where(F.arrays_overlap("words", listed)).drop("par")
    pars = pars.dropDuplicates(["doc_id", "place"])  # copies of a text count once
    pars = pars.select("doc_id", "place", _ngrams(F.col("words")).alias("grams"))
    # n-grams with a weight, and the templates' own ones, which the comparison needs
    wanted = template_table(spark).select(F.explode("wanted").alias("gram"), F.lit(True).alias("known")).distinct()
    table = spark.createDataFrame([(g, w) for g, w in model.weights.items()], "gram string, w array<double>")
    nothing = F.array(*[F.lit(0.0) for _ in model.classes])
    table = table.join(wanted, "gram", "full").select("gram", F.coalesce("w", nothing).alias("w"), F.coalesce("known", F.lit(False)).alias("known"))
    hits = pars.select("doc_id", "place", F.explode("grams").alias("gram")).join(F.broadcast(table), "gram")  # bounded by the wordings' n-grams
    sums = hits.groupBy("doc_id", "place").agg(F.array(*[F.sum(F.element_at("w", k + 1)) + b for k, b in enumerate(model.bias)]).alias("raw"), F.collect_set(F.when(F.col("known"), F.col("gram"))).alias("triples"))
    best = F.array_max(F.slice("raw", 1, none))
    chance = 1 / (1 + F.exp(-((best - F.element_at("raw", none + 1)) * model.slope + model.shift)))
    named = F.element_at(F.array(*[F.lit(c) for c in model.classes]), F.array_position("raw", best).cast("int"))
    found = cut(sums.select("doc_id", "place", named.alias("predicted"), chance.alias("chance"), "triples").where(F.col("chance") >= bar))
    shares = _compared(found, template_table(spark))
    top = shares.groupBy("doc_id", "place").agg(F.max_by("t_family", F.struct("share", "t_family")).alias("t_family"), F.max("share").alias("share"), F.max(F.when(F.col("t_family") == F.col("predicted"), F.col("share"))).alias("own"))
    out = found.drop("triples").join(top, ["doc_id", "place"], "left")
    confirmed = F.coalesce(F.col("own") >= confirm, F.lit(False))
    return out.select("doc_id", "place", F.when(confirmed, F.col("predicted")).otherwise(F.lit(UNKNOWN)).alias("family"), "chance", confirmed.alias("confirmed"), "predicted")


def licence_digest(docs: DataFrame, model: LicenceModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_licences, n_confirmed, families (sorted, comma-joined), chance (of the likeliest)."""
    keyed = _keyed(docs, id_col, text_col)
    found = _scan(keyed.drop("doc_id"), model or train(docs, id_col, text_col))
    per = found.groupBy(F.col("doc_id").alias("l_id")).agg(F.count(F.lit(1)).alias("n_licences"), F.count(F.when(F.col("confirmed"), 1)).alias("n_confirmed"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), F.max("chance").alias("chance"))
    joined = keyed.drop("text").join(per, F.col("key") == F.col("l_id"), "left")
    zero = F.lit(0).cast("long")
    return joined.select(F.col("doc_id").alias(id_col), F.coalesce("n_licences", zero).alias("n_licences"), F.coalesce("n_confirmed", zero).alias("n_confirmed"), F.coalesce("families", F.lit("")).alias("families"), F.coalesce("chance", F.lit(0.0)).alias("chance"))
