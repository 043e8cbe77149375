"""Operator 9, license scans: a trained paragraph classifier confirmed by templates.

Every line of every whole text is a paragraph, and so is every shortest run of two or more
lines (those without words left out, line breaks read as blanks) that holds a template, as
notices are usually hard-wrapped; before its last line a run has fewer than ``SPAN`` words, twice
those of the longest template, however short the lines are. A text holds a template if it
has ``contained`` of its bigrams and what tells its family from others with much the same notice
(``TELLS``: *Affero*, the number of a version). A sparse multinomial logistic regression over
hashed word unigrams and bigrams, those that the texts below have, says which licence family a
paragraph states, or none: training rows are variants of the templates below (words dropped by
hash), ordinary sentences about licences, rights and permissions, and every paragraph of the
corpus, unless it holds half of a template or half of its own bigrams are a template's (a torn-off
line of a notice). Paragraphs with the same features are one training row with their number as
its weight; together they weigh ``plain_weight`` rows at most, so that the templates keep their
share. The unknown class is calibrated on the fifth of variants and paragraphs held back from
training: the least probability that a family needs is set so that at most ``false_share`` of the
held-back ordinary paragraphs reach it. A prediction counts as confirmed if the paragraph holds a
template of its family.

Only the slots that a known word or bigram hashes to can be set, so those few hundred columns are
what is fitted and scored: the driver's optimiser holds no others.

DataFrame functions and Spark ML's own estimators only; no Python runs on executors.

Defined results: one row per row of the table, repeated rows and null ids included;
``n_paragraphs`` counts lines, the other counts lines and runs of lines; a null text has no
paragraphs, an empty one has one empty paragraph; an empty table gives no rows; long texts are read
whole. Only id and text are read, other columns may have any name.
"""

from __future__ import annotations

from functools import reduce
from operator import or_
from string import ascii_lowercase, digits
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, NGram, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, Matrices, SparseMatrix
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txgraph.llm.common import cut

# Notices by which works state their licence, by family.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files, to deal in the Software without restriction",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file "
        "except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the "
        "License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "either version 2 of the License, or (at your option) any later version",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL": (
        "Licensed under the GNU Lesser General Public License.",
        "under the terms of the GNU Lesser General Public License as published by the Free "
        "Software Foundation",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU Lesser General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
    ),
    "AGPL": (
        "Licensed under the GNU Affero General Public License.",
        "under the terms of the GNU Affero General Public License as published by the Free "
        "Software Foundation",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU Affero General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
    ),
    "BSD": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International "
        "License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
        "International License.",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "the author has waived all copyright and related or neighboring rights to this work",
    ),
    "all-rights-reserved": (
        "All rights reserved.",
        "No part of this publication may be reproduced without the prior written permission of the "
        "publisher.",
    ),
}
ORDINARY = (
    "She renewed her driving license before the general election.",
    "The court reserved its judgment on the rights of the tenants.",
    "The public library holds a free copy of the work.",
    "A fishing licence is required by law in this state.",
    "The committee gave permission to use the software in all schools.",
    "The foundation published version 3 of its report.",
    "The museum asked for written permission from the author.",
    "All seats are reserved for members of the general public.",
    "Copyright law has changed many times since then.",
    "The license fee was raised under the new terms.",
    "He was released under the condition that he would report weekly.",
    "Creative work is rarely free of charge.",
    "An Apache helicopter landed at MIT.",
    "The work was published in 2020 by the press.",
    "You may not use this door except in an emergency.",
)
UNKNOWN = "none"
FAMILIES = (UNKNOWN, *TEMPLATES)
FEATURES = 1 << 16
# Steps of the least probability.
STEPS = 10_000
# Words before the last line of a run: twice those of the longest template.
SPAN = 2 * max(len(t.split()) for texts in TEMPLATES.values() for t in texts)
# Characters of words.
INNER = ascii_lowercase + digits
# Words and bigrams that tell a family from others with much the same notice; a
# text must have one of each list.
TELLS = {
    "GPL-2.0": (("2", "2.0", "v2"),),
    "GPL-3.0": (("3", "3.0", "v3"), ("gnu general",)),
    "LGPL": (("lesser",),),
    "AGPL": (("affero",),),
    "CC-BY": (("by", "attribution"),),
    "CC-BY-SA": (("by-sa", "attribution-sharealike"),),
    "CC-BY-NC": (("by-nc", "attribution-noncommercial"),),
}


def words(text):
    """Words (letters, digits; inner dots and hyphens of versions are kept) of lower-cased text. The
    repeats are possessive: others recurse for each separator, and a long run of them, such as a text
    in another script, overflows the stack. The classes name each character: Java looks those up in
    a table, while it tries ranges one by one for every character of a text."""
    return F.filter(F.split(text, rf"(?:[^{INNER}.\-]++|[.\-](?![{INNER}]))++"), lambda w: w != "")


def with_features(df: DataFrame) -> DataFrame:
    """Adds ``bigrams``, the ``grams`` that the known texts have too and their sparse vector
    ``features`` to rows with ``words``."""
    df = NGram(n=2, inputCol="words", outputCol="bigrams").transform(df)
    known = vocabulary()
    return hashed(df.withColumn("grams", F.array_distinct(F.filter(
        F.concat("words", "bigrams"), lambda g: g.isin(known)))))


def _hashing() -> HashingTF:
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="hashes")


def slots() -> list[int]:
    """The columns that the known words and bigrams hash to, rising."""
    index = _hashing().indexOf
    return sorted({index(g) for g in vocabulary()})


def hashed(df: DataFrame) -> DataFrame:
    """Adds the hashed ``grams``, cut down to the ``slots``, as ``features``."""
    return VectorSlicer(inputCol="hashes", outputCol="features", indices=slots()).transform(
        _hashing().transform(df)).drop("hashes")


class Classifier(NamedTuple):
    """The model of the ``slots``; its coefficients are shown for all hashes."""

    fitted: LogisticRegressionModel
    slots: list[int]

    def transform(self, df: DataFrame) -> DataFrame:
        return self.fitted.transform(df)

    @property
    def interceptVector(self) -> DenseVector:  # noqa: N802 - as Spark ML names it
        return self.fitted.interceptVector

    @property
    def coefficientMatrix(self) -> SparseMatrix:  # noqa: N802
        small = self.fitted.coefficientMatrix.toArray()
        rows, at = small.shape[0], {c: k for k, c in enumerate(self.slots)}
        ends = [0]
        for c in range(FEATURES):
            ends.append(ends[-1] + rows * (c in at))
        return Matrices.sparse(rows, FEATURES, ends, list(range(rows)) * len(at), small.T.ravel())


def _template_rows(spark: SparkSession) -> DataFrame:
    rows = [(i, f, t) for i, (f, t) in enumerate(
        [(f, t) for f, ts in TEMPLATES.items() for t in ts] + [(UNKNOWN, t) for t in ORDINARY])]
    return spark.createDataFrame(rows, "id int, family string, text string").withColumn(
        "words", words(F.lower("text")))


def _variants(templates: DataFrame, count: int) -> DataFrame:
    """``count`` variants of each row: variant 0 is the row, others lose about a tenth of
    their words."""
    return (templates.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
            .withColumn("words", F.expr(
                "filter(words, (w, i) -> variant = 0 OR pmod(xxhash64(id, variant, i), 10) <> 0)"))
            .select("family", "words", F.pmod(F.xxhash64("id", "variant"), F.lit(5)).alias("fold")))


def vocabulary() -> list[str]:
    """The words and bigrams of the fixed texts."""
    rows = _template_rows(SparkSession.getActiveSession()).select("words").collect()
    return sorted({g for r in rows for g in [*r.words, *(f"{a} {b}" for a, b in zip(r.words, r.words[1:]))]})


def known_templates() -> list[tuple[str, list[str]]]:
    """(family, bigrams) of the fixed templates."""
    rows = (_template_rows(SparkSession.getActiveSession()).filter(F.col("family") != UNKNOWN)
            .orderBy("id").select("family", "words").collect())
    return [(r.family, sorted({f"{a} {b}" for a, b in zip(r.words, r.words[1:])})) for r in rows]


def template_struct(family: str, grams: list[str]):
    texts = lambda xs: F.array(*map(F.lit, xs))
    tells = F.array(*map(texts, TELLS.get(family, ())))
    return F.struct(texts(grams).alias("grams"), tells.cast("array<array<string>>").alias("tells"))


def holds(words, bigrams, template, contained: float):
    """Whether a text of these words and bigrams holds the template."""
    return ((F.size(F.array_intersect(bigrams, template["grams"])) >= contained * F.size(template["grams"]))
            & F.forall(
                template["tells"], lambda t: F.arrays_overlap(words, t) | F.arrays_overlap(bigrams, t)))


def confirmed(contained: float):
    """Whether ``words`` and ``bigrams`` hold a template of the row's ``family``, as a column."""
    out = F.lit(False)
    known = known_templates()
    for family in TEMPLATES:
        own = F.array(*[template_struct(f, g) for f, g in known if f == family])
        out = F.when(F.col("family") == family, F.exists(
            own, lambda t: holds(F.col("words"), F.col("bigrams"), t, contained))).otherwise(out)
    return out


def _let(value, use):
    """``use`` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _bigrams(w):
    return F.when(F.size(w) > 1, F.zip_with(
        F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1),
        lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))


def _marks(templates: list[list[str]], contained: float) -> list[str]:
    """Words of which a text that holds ``contained`` of any template has one."""
    picked: set[str] = set()
    for grams in templates:
        for w in sorted({w for g in grams for w in g.split()}, key=lambda w: (-len(w), w)):
            if sum(not picked & set(g.split()) for g in grams) < contained * len(grams):
                break
            picked.add(w)
    return sorted(picked)


def wrapped_runs(text, lines, contained: float):
    """Words of the shortest runs of two or more of ``lines`` (arrays of words) that hold a
    template, as a column of arrays; empty where a text has none."""
    known = known_templates()
    every = F.array(*[template_struct(f, g) for f, g in known])
    none = F.array().cast("array<array<string>>")

    def held(w, among):
        return _let(w, lambda w: _let(_bigrams(w), lambda own: F.filter(
            among, lambda t: holds(w, own, t, contained))))

    lines = F.filter(lines, lambda w: F.size(w) > 0)
    here = _let(lines, lambda x: F.struct(x.alias("lines"), F.transform(x, F.size).alias("sizes"),
                                          held(F.flatten(x), every).alias("held")))

    def runs(x):
        cutout = lambda i, k: F.flatten(F.slice(x["lines"], i, k))

        def at(i):       # lines until the words before the last one reach the span
            last = F.aggregate(
                F.slice(x["sizes"], i, F.lit(SPAN)), F.struct(F.lit(0).alias("w"), F.lit(0).alias("k")),
                lambda a, n: F.when(a["w"] < SPAN, F.struct(
                    (a["w"] + n).alias("w"), (a["k"] + 1).alias("k"))).otherwise(a))["k"]
            return _let(last, lambda last: _let(held(cutout(i, last), x["held"]),
                                                lambda likely: starts(i, last, likely)))

        def starts(i, last, likely):
            def own(k):      # templates that a run holds and no shorter run in it does
                return F.array_except(
                    F.array_except(held(cutout(i, k), likely), held(cutout(i, k - 1), likely)),
                    held(cutout(i + 1, k - 1), likely))

            return F.when((F.size(likely) > 0) & (last > 1), F.transform(
                F.filter(F.sequence(F.lit(2), last), lambda k: F.size(own(k)) > 0),
                lambda k: cutout(i, k))).otherwise(none)

        return F.when((F.size(x["held"]) > 0) & (F.size(x["lines"]) > 1), F.flatten(
            F.transform(F.sequence(F.lit(1), F.size(x["lines"]) - 1), at))).otherwise(none)

    marked = reduce(or_, [F.contains(text, F.lit(w)) for w in _marks([g for _, g in known], contained)])
    return F.when(F.contains(text, F.lit("\n")) & marked, _let(here, runs)).otherwise(none)


def paragraphs(df: DataFrame, contained: float | None = None) -> DataFrame:
    """Words of the lines of lower-cased ``text``, each with ``line`` true; a null text keeps its
    row, with null words. With ``contained`` also the wrapped runs, with ``line`` null."""
    unit = lambda line, w: F.struct(line.alias("line"), w.alias("words"))
    line, run = F.lit(True), F.lit(None).cast("boolean")

    def units(lines):
        out = F.transform(lines, lambda w: unit(line, w))
        return out if contained is None else F.concat(out, F.transform(
            wrapped_runs(F.col("text"), lines, contained), lambda w: unit(run, w)))

    lines = F.transform(F.split("text", "\n", -1), words)
    return df.withColumn("unit", F.explode_outer(_let(lines, units))).select(
        *[c for c in df.columns if c != "text"], "unit.line", "unit.words")


def plain_features(df: DataFrame, text_col: str) -> DataFrame:
    """``(grams, fold, n)``: how many ordinary paragraphs of the corpus have the same known grams."""
    known = [F.array(*map(F.lit, g)) for _, g in known_templates()]
    lines = paragraphs(df.select(F.lower(F.col(text_col).cast("string")).alias("text")).filter("text is not null"))
    rows = with_features(lines.filter(F.size("words") > 0)).drop("features")

    def torn(x):
        def among(own):
            out = F.lit(False)
            for g in known:
                half = F.least(F.size(g), x["most"])
                out = out | ((F.size(own) * 2 >= half)      # else no need to look which they are
                             & (F.size(F.array_intersect(g, own)) * 2 >= half))
            return out

        return _let(F.filter(x["grams"], lambda g: F.contains(g, F.lit(" "))), among)

    # filtered in an array: a filter on rows is pushed below the columns, which are then computed twice
    here = F.struct("grams", F.greatest(F.size("bigrams"), F.lit(1)).alias("most"),
                    F.pmod(F.xxhash64("words"), F.lit(5)).alias("fold"))
    kept = rows.select(F.explode(F.filter(F.array(here), lambda x: ~torn(x))).alias("x"))
    return kept.select(F.array_sort("x.grams").alias("grams"), "x.fold").groupBy(
        "grams", "fold").agg(F.count(F.lit(1)).alias("n"))


def least_probability(held: DataFrame, false_share: float) -> float:
    """The least probability, in steps, that at most ``false_share`` of the rows ``(best, n)``, each
    counted ``n`` times, reach. The driver learns one number a step."""
    steps = held.groupBy(F.floor(F.col("best") * STEPS).alias("step")).agg(F.sum("n").alias("n")).collect()
    left = false_share * sum(r.n for r in steps)
    for r in sorted(steps, key=lambda r: -r.step):
        left -= r.n
        if left < 0:
            return (r.step + 1) / STEPS
    return 0.0


def fit(df: DataFrame, text_col: str = "text", plain_weight: int = 4000,
        variants: int = 40, false_share: float = 0.0005):
    """(model, least probability) from the templates and all paragraphs of the corpus."""
    plain = cut(plain_features(df, text_col), "licence-plain")
    total = plain.agg(F.sum("n").alias("n")).first().n or 0
    texts = with_features(_variants(_template_rows(df.sparkSession), variants)).select(
        "family", "grams", "fold", F.lit(1).cast("bigint").alias("n"), F.lit(1.0).alias("weight"))
    index = F.create_map(*[x for i, f in enumerate(FAMILIES) for x in (F.lit(f), F.lit(float(i)))])
    rows = hashed(cut(texts.unionByName(plain.withColumn("family", F.lit(UNKNOWN)).withColumn(
        "weight", F.col("n") * min(1.0, plain_weight / max(1, total)))).withColumn(
        "label", index[F.col("family")]), "licence-training"))
    model = LogisticRegression(maxIter=30, regParam=1e-3, family="multinomial", weightCol="weight").fit(
        rows.filter("fold <> 0"))
    model = Classifier(model, slots())
    held = model.transform(rows.filter((F.col("fold") == 0) & (F.col("family") == UNKNOWN)))
    best = F.array_max(F.slice(vector_to_array("probability"), 2, len(FAMILIES)))
    return model, min(0.95, max(0.5, least_probability(held.select(best.alias("best"), "n"), false_share)))


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 contained: float = 0.75, **fit_args) -> DataFrame:
    """(id, n_paragraphs, n_predicted, n_confirmed, families) of every row; ``families`` are
    the confirmed ones, sorted and joined by a comma."""
    model, least = fit(df, text_col, **fit_args)
    rows = df.select(F.col(id_col).alias("id"), F.lower(F.col(text_col).cast("string")).alias("text"),
                     F.monotonically_increasing_id().alias("uid"))
    lines = paragraphs(rows, contained).withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    scored = model.transform(with_features(lines))
    names = F.array(*map(F.lit, FAMILIES))
    best = F.element_at(vector_to_array("probability"), F.col("prediction").cast("int") + 1)
    scored = (scored.withColumn("family", F.when(
        best >= least, F.element_at(names, F.col("prediction").cast("int") + 1)).otherwise(UNKNOWN))
        .select("uid", "id", "line", "words", "bigrams", "family"))
    said = F.col("family") != UNKNOWN
    sure = F.when(said, confirmed(contained)).otherwise(False)
    return (scored.groupBy("uid", "id").agg(
        F.count("line").alias("n_paragraphs"),
        F.count(F.when(said, 1)).alias("n_predicted"),
        F.count(F.when(sure, 1)).alias("n_confirmed"),
        F.array_join(F.array_sort(F.collect_set(F.when(sure, F.col("family")))), ",").alias("families"))
        .select(F.col("id").alias(id_col), "n_paragraphs", "n_predicted", "n_confirmed", "families"))
