"""Licence scan: a trained paragraph classifier over sparse word n-grams (DataFrame functions and Spark ML only).

A multinomial logistic regression with an L1 penalty tells licence families from ordinary paragraphs by word uni- and bigrams. It is
trained on wordings of each family (below), each also cut into overlapping excerpts, against a bounded sample of the corpus's
own paragraphs (``sample_rows`` with the smallest hash out of ``sample_rows / 4`` documents, the documented bound; those that resemble a wording are left out). Of a
fifth of the training rows, set aside, a temperature is fitted, and the unknown class is calibrated: a paragraph whose best family stays below
``threshold`` (the 1 % quantile of the set-aside licence rows' chances, at least 0.5) is ``unknown``. A prediction is confirmed by
comparing the paragraph with the family's wordings: the share of a wording's words that the paragraph holds must reach
``CONFIRM``, otherwise it is ``unknown`` too.

The penalty leaves weight on few n-grams. A paragraph without any of them has the score of an empty one, which the model calls ordinary, so
only paragraphs with at least one weighted word are scored; none is skipped that could be anything else. If the empty paragraph
were not ordinary, all paragraphs would be scored.

Paragraphs are the lines of a text. Null and empty texts have none. Rows that repeat an identifier are scanned each. An empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import hash_sample, only

ORDINARY, UNKNOWN = "none", "unknown"
SAMPLE_ROWS = 3000
CONFIRM = 0.6
EXCERPT = 12

# Usual wordings of licence notices.
WORDINGS = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
}


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}.]*[\p{L}\p{N}]"), 0)


def n_grams(words: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)))
    return F.concat(words, F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>")))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, uid, at, paragraph) of every line that is not empty."""
    rows = only(docs, doc_id="doc_id", text="text").withColumn("uid", F.monotonically_increasing_id())
    return rows.select("doc_id", "uid", F.posexplode(F.split("text", "\n")).alias("at", "paragraph")).where("paragraph <> ''")


def _training(spark: SparkSession, docs: DataFrame, sample_rows: int) -> tuple[DataFrame, DataFrame]:
    """Wordings (family, words) and training rows (family, words)."""
    notices = spark.createDataFrame([(f, w) for f, ws in WORDINGS.items() for w in ws], "family string, text string").withColumn("words", words_of(F.col("text")))
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - EXCERPT, F.lit(1)), F.lit(3)), lambda i: F.slice("words", i, EXCERPT))
    licences = notices.select("family", F.explode(F.concat(F.array("words", "words", "words"), cut)).alias("words"))
    line = F.explode(F.split("text", "\n"))
    some = hash_sample(only(docs, text="text").where("text IS NOT NULL"), sample_rows // 4, "text")
    lines = hash_sample(cut_lineage(some.select(line.alias("text")).where("text <> ''")), sample_rows, "text")
    telling = [w for ws in WORDINGS.values() for text in ws for w in text.lower().replace(",", " ").replace(".", " ").split() if w.startswith(("licen", "redistribut", "copyright", "spdx"))]
    plain = lines.select(F.lit(ORDINARY).alias("family"), words_of(F.col("text")).alias("words")).where(~F.arrays_overlap("words", F.array(*[F.lit(w) for w in sorted(set(telling))])))
    # single words speak for no licence, whatever the corpus holds
    single = spark.createDataFrame([(ORDINARY, [w]) for w in ("the", "a", "of", "and", "to", "in", "by", "is")], "family string, words array<string>")
    return notices.select("family", "words"), licences.unionByName(plain).unionByName(single)


class Scanner:
    """A fitted classifier as weights per n-gram: small tables, bounded by the wordings and the sample."""

    def __init__(self, spark: SparkSession, docs: DataFrame, sample_rows: int = SAMPLE_ROWS):
        notices, rows = _training(spark, docs, sample_rows)
        rows = cut_lineage(rows.withColumns({"grams": n_grams(F.col("words")), "fold": F.pmod(F.xxhash64("family", "words"), F.lit(5))}).repartition(2))
        self.families = sorted(WORDINGS) + [ORDINARY]
        label = F.array_position(F.array(*[F.lit(f) for f in self.families]), F.col("family")).cast("double") - 1
        rows = rows.withColumn("label", label)
        # of words of the wordings only: no other word can speak for a family
        counter = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=1).fit(rows.where(F.col("family") != ORDINARY))
        table = counter.transform(rows)
        learner = LogisticRegression(regParam=0.002, elasticNetParam=1.0, maxIter=60, family="multinomial")
        model = learner.fit(table.where("fold <> 4"))
        weights = model.coefficientMatrix.toArray()
        self.bias = [float(x) for x in model.interceptVector]
        held = model.transform(table.where("fold = 4")).select("label", vector_to_array("rawPrediction").alias("z")).collect()  # a fifth of the bounded sample
        self.temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=lambda t: -sum(math.log(self._chance(r["z"], t)[int(r["label"])] + 1e-12) for r in held))
        sure = sorted(max(self._chance(r["z"], self.temperature)[:-1]) for r in held if r["label"] < len(self.families) - 1)
        self.threshold = max(0.5, sure[len(sure) // 100]) if sure else 0.5
        kept = [(g, [float(x) for x in weights[:, i]]) for i, g in enumerate(counter.vocabulary) if abs(weights[:, i]).max() > 1e-9]
        self.weights = spark.createDataFrame(kept, "gram string, w array<double>")
        self.vocabulary = [g for g, _ in kept]
        self.telling = sorted({w for g, _ in kept for w in g.split(" ")})
        self.empty_is_ordinary = max(self.bias) == self.bias[-1]
        self.notices = [(r["family"], r["words"]) for r in notices.collect()]  # the wordings above

    @staticmethod
    def _chance(z, t):
        e = [math.exp((x - max(z)) / t) for x in z]
        return [x / sum(e) for x in e]

    def scan(self, docs: DataFrame) -> DataFrame:
        """One row per paragraph that is not ordinary: doc_id, uid, at, family, chance, likeness, paragraph."""
        rows = paragraphs(docs).withColumn("words", words_of(F.col("paragraph")))
        if self.empty_is_ordinary:
            rows = rows.where(F.arrays_overlap("words", F.array(*[F.lit(w) for w in self.telling])))
        weighted = F.array_intersect(n_grams(F.col("words")), F.array(*[F.lit(g) for g in self.vocabulary]))  # before rows multiply
        grams = rows.select("doc_id", "uid", "at", "paragraph", F.explode(weighted if self.empty_is_ordinary else F.when(F.size(weighted) > 0, weighted).otherwise(F.array(F.lit("")))).alias("gram"))
        hits = grams.join(F.broadcast(self.weights), "gram", "left").withColumn("w", F.coalesce("w", F.array(*[F.lit(0.0)] * len(self.families))))
        n = len(self.families)
        sums = hits.groupBy("uid", "at").agg(*[F.sum(F.col("w")[k]).alias(f"z{k}") for k in range(n)], F.first("doc_id").alias("doc_id"), F.first("paragraph").alias("paragraph"))
        z = [(F.col(f"z{k}") + self.bias[k]) / self.temperature for k in range(n)]
        top = F.greatest(*z)
        total = sum((F.exp(x - top) for x in z[1:]), F.exp(z[0] - top))
        best = F.coalesce(*[F.when(z[k] == top, F.lit(self.families[k])) for k in range(n)])
        found = sums.withColumns({"best": best, "chance": 1 / total}).where(F.col("best") != ORDINARY)
        found = found.withColumn("words", F.array_distinct(words_of(F.col("paragraph"))))
        like = [(f, F.size(F.array_intersect("words", lit)) / F.size(F.array_distinct(lit))) for f, w in self.notices for lit in [F.array(*[F.lit(x) for x in w])]]
        likeness = F.greatest(*[F.when(F.col("best") == f, x).otherwise(0.0) for f, x in like])
        found = found.withColumn("likeness", likeness)
        sure = (F.col("chance") >= self.threshold) & (F.col("likeness") >= CONFIRM)
        return found.select("doc_id", "uid", "at", F.when(sure, F.col("best")).otherwise(UNKNOWN).alias("family"), "chance", "likeness", "paragraph")


def license_scan(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per paragraph of licence text: doc_id, paragraph_no, family (or ``unknown``), chance, likeness, paragraph."""
    found = Scanner(docs.sparkSession, docs, sample_rows).scan(docs)
    return found.select("doc_id", F.col("at").alias("paragraph_no"), "family", F.round("chance", 4).alias("chance"), F.round("likeness", 4).alias("likeness"), "paragraph")
