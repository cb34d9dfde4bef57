"""Licence scan by a trained paragraph classifier, in DataFrame functions only.

Every paragraph (line) becomes a sparse vector of word n-grams; a multinomial
logistic regression names the licence family or ``unknown``.  It is trained on licence notices, whole and in parts, and on
all of the corpus's own paragraphs without a licence word as the unknown class; equal vectors
of them are one row with a count.  The probability a family needs is calibrated on the same paragraphs,
each judged by a model of the other half of them.  A family
is confirmed if the paragraph holds most word pairs of one of its templates.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from operator import or_

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.llm.common import staged

UNKNOWN = "unknown"
#: What all paragraphs of the unknown class weigh together, at most: each weighs the same, and 1 at most.
UNKNOWN_WEIGHT = 4_000
#: A family needs at least this probability, and more than this share of unknown paragraphs reach.
MIN_PROBABILITY, CALIBRATION = 0.5, 0.999
#: Share of a template's word pairs that confirms a family.
MIN_CONTAINED = 0.6
SEED = 6
#: Licence words; a paragraph that holds one is reported, named or not. Every template holds one.
ANCHORS = r"(?i)licen[cs]|copyright|copyleft|spdx|warrant|redistribut|public domain|all rights reserved|permission|\bgnu\b|creative commons|\bcc0\b|\bcc[ -]by\b|\b[al]?gpl|proprietary|unauthori[sz]ed copying"
#: Lower-case strings one of which every licence word holds: cheaper to look for than the pattern.
NEEDLES = ("licen", "copyright", "copyleft", "spdx", "warrant", "redistribut", "public domain", "all rights reserved", "permission", "gnu", "creative commons",
           "cc0", "cc by", "cc-by", "gpl", "proprietary", "unauthori")
#: Notices by licence family.
TEMPLATES = {
    "MIT": ["released under the mit license", "licensed under the mit license", "spdx license identifier mit",
            "this project is licensed under the terms of the mit license",
            "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "Apache": ["licensed under the apache license version 2.0", "spdx license identifier apache 2.0", "released under the apache license 2.0",
               "you may not use this file except in compliance with the license you may obtain a copy of the license at"],
    "GPL": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 2",
            "spdx license identifier gpl 3.0", "released under the gpl",
            "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"],
    "LGPL": ["licensed under the gnu lesser general public license version 2.1", "spdx license identifier lgpl 2.1",
             "under the terms of the gnu lesser general public license as published by the free software foundation"],
    "AGPL": ["licensed under the gnu affero general public license version 3", "spdx license identifier agpl 3.0",
             "under the terms of the gnu affero general public license as published by the free software foundation"],
    "BSD": ["licensed under the bsd license", "released under the 3 clause bsd license", "spdx license identifier bsd 3 clause", "licensed under the bsd 2 clause license",
            "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "MPL": ["licensed under the mozilla public license version 2.0", "spdx license identifier mpl 2.0",
            "this source code form is subject to the terms of the mozilla public license"],
    "CC-BY": ["licensed under cc by 4.0", "licensed under a creative commons attribution 4.0 international license", "spdx license identifier cc by 4.0"],
    "CC-BY-SA": ["licensed under cc by sa 4.0", "licensed under a creative commons attribution sharealike 4.0 international license",
                 "spdx license identifier cc by sa 4.0"],
    "CC-BY-NC": ["licensed under cc by nc 4.0", "licensed under a creative commons attribution noncommercial 4.0 international license",
                 "spdx license identifier cc by nc 4.0"],
    "CC0": ["spdx license identifier cc0 1.0", "dedicated to the public domain under cc0 1.0 universal", "released into the public domain"],
    "ISC": ["licensed under the isc license", "spdx license identifier isc",
            "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "Proprietary": ["all rights reserved", "copyright all rights reserved no part of this work may be reproduced without permission",
                    "proprietary and confidential unauthorized copying of this file is strictly prohibited"],
}


def words(text: Column) -> Column:
    """Lower-case words: runs of letters and digits, and of dots between them."""
    return _cut(F.lower(text))


def _cut(low: Column) -> Column:
    plain = F.regexp_replace(low, r"[^\p{L}\p{N}.]+|\.(?![\p{L}\p{N}])", " ")
    return F.split(F.trim(plain), " +")


def ngrams(w: Column) -> Column:
    """Single words, and pairs joined by a space."""
    pairs = F.transform(F.slice(w, 1, F.size(w) - 1), lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1)))
    return F.concat(w, F.when(F.size(w) > 1, pairs).otherwise(F.array().cast("array<string>")))


def _templates(spark: SparkSession) -> DataFrame:
    rows = [(k, f"{k}/{i}", t) for k, ts in TEMPLATES.items() for i, t in enumerate(ts)]
    frame = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in rows) + " AS t(family, template, notice)")
    return frame.withColumn("w", words(F.col("notice")))


def _vocabulary() -> list[str]:
    grams: set[str] = set()
    for notices in TEMPLATES.values():
        for w in (n.split() for n in notices):
            grams.update(w)
            grams.update(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))
    return sorted(grams)


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (line number from 0), body: lines with a word."""
    lines = docs.where(F.col("text").isNotNull()).select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "body"))
    return lines.where(F.col("body").rlike(r"[\p{L}\p{N}]"))


def read(docs: DataFrame) -> DataFrame:
    """The paragraphs with their words ``w`` and whether they hold a licence word, ``anchored``."""
    # one-element arrays: what is filtered on later is computed once, not again in a filter pushed down
    low = paragraphs(docs).select("*", F.explode(F.array(F.lower("body"))).alias("low"))
    near = reduce(or_, [F.col("low").contains(x) for x in NEEDLES])
    both = F.struct(_cut(F.col("low")).alias("w"), (near & F.col("body").rlike(ANCHORS)).alias("anchored"))
    return low.select("doc_id", "paragraph", "body", F.explode(F.array(both)).alias("read")).select("doc_id", "paragraph", "body", "read.*")


def _vectors(df: DataFrame, vectorizer: CountVectorizerModel) -> DataFrame:
    return vectorizer.transform(df.withColumn("grams", ngrams(F.col("w"))))


def _label(family: Column) -> Column:
    names = [UNKNOWN, *TEMPLATES]
    return (F.array_position(F.array(*[F.lit(x) for x in names]), family) - 1).cast("double")


def unknown_vectors(spark: SparkSession, docs: DataFrame, vectorizer: CountVectorizerModel) -> DataFrame:
    """half, features, n: all paragraphs without a licence word, as their distinct
    vectors with the number of paragraphs; halves by a hash of id, line number and text."""
    half = F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "paragraph", "body"), F.lit(2)).cast("int")
    rows = _vectors(read(docs).where(~F.col("anchored")).select(half.alias("half"), "w"), vectorizer)
    return staged(spark, rows.groupBy("half", "features").agg(F.count(F.lit(1)).alias("n")), "licence-unknown")


class Scanner:
    """The trained classifier and the probability a family needs."""

    def __init__(self, vectorizer: CountVectorizerModel, model: LogisticRegressionModel, threshold: float):
        self.vectorizer, self.model, self.threshold = vectorizer, model, threshold

    def classify(self, df: DataFrame) -> DataFrame:
        """Adds ``guess`` (a family or unknown) and ``probability`` to rows with words ``w``."""
        return self.judge(_vectors(df, self.vectorizer))

    def judge(self, df: DataFrame) -> DataFrame:
        """``classify`` of rows that have ``features``."""
        names = F.array(*[F.lit(x) for x in [UNKNOWN, *TEMPLATES]])
        out = self.model.transform(df)
        out = out.withColumn("probability", F.element_at(vector_to_array("probability"), F.col("prediction").cast("int") + 1))
        return out.withColumn("guess", F.element_at(names, F.col("prediction").cast("int") + 1)).drop("grams", "features", "rawPrediction", "prediction")


def train(spark: SparkSession, docs: DataFrame) -> Scanner:
    """Notices count whole, without their first or last words, and inside
    other text; unknown paragraphs are all of the corpus's own without a licence word."""
    vectorizer = CountVectorizerModel.from_vocabulary(_vocabulary(), inputCol="grams", outputCol="features")
    vectorizer.setBinary(True)
    unknown = unknown_vectors(spark, docs, vectorizer)
    sizes = {r["half"]: r["n"] for r in unknown.groupBy("half").agg(F.sum("n").alias("n")).collect()}
    total = sum(sizes.values())
    notices = _templates(spark)
    parts = notices.select("family", F.explode(F.array(
        F.col("w"), F.slice("w", 2, F.size("w") - 1), F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(1))),
        F.concat(F.split(F.lit("this text and its parts are"), " "), F.col("w")), F.concat(F.col("w"), F.split(F.lit("see the file for the details"), " "))))
        .alias("w")).withColumn("weight", F.lit(5.0))
    # licence words alone name no family
    alone = spark.sql("SELECT explode(array('license', 'the license', 'copyright', 'permission', 'this license', 'the terms of the license', "
                      "'with permission of the author', 'copyright notice', 'a driving license', 'subject to a license agreement')) AS notice")
    alone = alone.select(F.lit(UNKNOWN).alias("family"), words(F.col("notice")).alias("w"), F.lit(10.0).alias("weight"))
    rows = parts.unionByName(alone).withColumn("label", _label(F.col("family")))
    rows = _vectors(staged(spark, rows, "licence-training"), vectorizer).select("features", "label", "weight")

    def fitted(own: DataFrame, n: int) -> Scanner:
        each = min(total, UNKNOWN_WEIGHT) / max(n, 1)
        corpus = own.select("features", F.lit(0.0).alias("label"), (F.col("n") * F.lit(each)).alias("weight"))
        model = LogisticRegression(family="multinomial", regParam=0.001, maxIter=60, weightCol="weight").fit(rows.unionByName(corpus))
        return Scanner(vectorizer, model, MIN_PROBABILITY)

    # the model of all, and for each half that of the other: no paragraph is judged by a model that it trained
    own = [(unknown, total), *((unknown.where(F.col("half") != h), total - n) for h, n in sizes.items())]
    with ThreadPoolExecutor(max_workers=len(own)) as pool:
        scanner, *halves = pool.map(lambda x: fitted(*x), own)
    held = [s.judge(unknown.where(F.col("half") == h)) for h, s in zip(sizes, halves, strict=True)]
    if held:
        # steps of a millionth: a bounded number of values
        p = F.when(F.col("guess") == UNKNOWN, 0.0).otherwise(F.floor(F.col("probability") * 1e6) / 1e6)
        reach = reduce(DataFrame.unionByName, held).select(p.alias("p"), "n").groupBy("p").agg(F.sum("n").alias("n"))
        scanner.threshold = max(MIN_PROBABILITY, reach.agg(F.expr(f"percentile(p, {CALIBRATION}, n)")).first()[0])
    return scanner


def scan(spark: SparkSession, docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """doc_id, paragraph, family, probability, guess, template, contained, confirmed.

    Every paragraph is classified.  One row for each that holds a licence word
    or is confirmed without one, as a line of a wrapped notice can be.
    ``family`` is the guess where its probability passes the threshold and the
    best template of the family is contained, else ``unknown``.  Null and empty texts have no
    paragraphs; repeated rows are scanned each; a null id stays null.  Columns
    beyond doc_id and text are not looked at.  Empty input: no rows."""
    scanner = scanner or train(spark, docs)
    kept = ("doc_id", "paragraph", "body", "w", "anchored")
    guessed = scanner.classify(read(docs)).select(*kept, F.explode(F.array(F.struct("guess", "probability"))).alias("found"))
    guessed = guessed.select(*kept, "found.*").where((F.col("guess") != UNKNOWN) | F.col("anchored"))
    held = ngrams(F.col("w"))
    # one array per family of its templates' pairs: fixed and small
    best = F.lit(None).cast("struct<contained:double,template:string>")
    for family, notices in TEMPLATES.items():
        options = []
        for i, notice in enumerate(notices):
            w = notice.split()
            pairs = sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})
            share = F.size(F.array_intersect(F.array(*[F.lit(p) for p in pairs]), F.col("held"))) / F.lit(float(len(pairs)))
            options.append(F.struct(share.alias("contained"), F.lit(f"{family}/{i}").alias("template")))
        best = F.when(F.col("guess") == family, F.greatest(*options)).otherwise(best)
    out = guessed.withColumn("held", held).withColumn("best", best)
    confirmed = F.coalesce((F.col("probability") >= scanner.threshold) & (F.col("best.contained") >= MIN_CONTAINED), F.lit(False))
    out = out.withColumn("confirmed", confirmed).where(F.col("confirmed") | F.col("anchored"))
    confirmed = F.col("confirmed")
    return out.select("doc_id", "paragraph", F.when(confirmed, F.col("guess")).otherwise(UNKNOWN).alias("family"), F.round("probability", 6).alias("probability"),
                      "guess", F.col("best.template").alias("template"), F.col("best.contained").alias("contained"), "confirmed", "body")
