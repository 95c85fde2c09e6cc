"""License scan: a trained paragraph classifier, confirmed by templates.

A multinomial logistic regression over word bigrams and trigrams, sparse by an L1 penalty, is
trained on variants of licence notices against prose. Only n-grams of the notices are features,
so a paragraph of the corpus meets the model in a join of its n-gram hashes with a table whose
size the templates fix. Probabilities are calibrated by a temperature on held-out variants; a
notice whose best family is not sure enough is of class `unknown`. A predicted family is
confirmed if the paragraph contains enough of the trigrams of one of its templates.
"""

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitecast.llm.common import cut

# Short notices of common licences, as their texts and stewards word them.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Released under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "Released under the GNU GPL version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License.",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "ISC": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0": [
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
    ],
}
# Notices of no family above, and prose that only speaks of licences.
OTHER_NOTICES = [
    "Licensed under the Acme Proprietary Software License, all rights reserved.",
    "This material is licensed under a commercial license agreement.",
    "Released under the terms of the vendor end user license agreement.",
    "All rights reserved. No part of this work may be reproduced without written permission.",
    "Licensed under the Eclipse Public License, version 1.0.",
    "Released under the zlib license.",
    "This software is licensed under the terms of the Artistic License.",
    "Use of this document is subject to the license terms of the publisher.",
]
PROSE = [
    "She renewed her driving license last week and went home.",
    "The general public was free to use the library for any purpose.",
    "Version 3 of the film was released under a new name.",
    "He wrote the terms of the agreement with the person in charge.",
    "The public foundation published a report on free software in schools.",
    "Permission to use the hall was granted by the mayor.",
    "You can modify the recipe with or without sugar.",
    "The file may not be in this room, said the clerk.",
]
NONE, UNKNOWN = "none", "unknown"
VARIANTS, DROPPED, HELD_OUT = 60, 12, 5
CORPUS_PARAGRAPHS, SEED = 2_000, 3
PENALTY, ITERATIONS = 2e-4, 60
PRECISION, CONFIRMED_SHARE = 0.99, 0.6
TEMPERATURES = (0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)


@dataclass(frozen=True)
class LicenceModel:
    """Weights per feature and class, the calibration, and the trigrams of the templates."""

    weights: DataFrame  # feature, w: array with one weight per class
    templates: DataFrame  # family, trigrams
    classes: list[str]
    bias: list[float]
    temperature: float
    sure: float


def words(text: Column) -> Column:
    """Lower-case words and numbers; marks around them are left out, those inside stay."""
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}.+-]+|[.+-]+(?![\p{L}\p{N}])", " ")
    return F.array_remove(F.split(F.trim(plain), " +"), "")


def _pairs(w: Column | str) -> Column:
    w = F.col(w) if isinstance(w, str) else w
    return F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1)))


def _triples(w: Column | str) -> Column:
    w = F.col(w) if isinstance(w, str) else w
    return F.transform(
        F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)),
    )


def paragraphs(docs: DataFrame) -> DataFrame:
    """_row, doc_id, paragraph (place of the line, from 0) and text of every line of a text."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text")
    return rows.select(
        "_row", "doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("paragraph", "text")
    )


def training_rows(docs: DataFrame) -> DataFrame:
    """text, family and variant: every notice with words left out, and prose.

    Prose is the list above and a random sample of at most about CORPUS_PARAGRAPHS lines of the
    corpus that name no licence; the bound keeps the training set as small as the templates.
    """
    spark = docs.sparkSession
    notices = [(t, f) for f, texts in TEMPLATES.items() for t in texts]
    notices += [(t, UNKNOWN) for t in OTHER_NOTICES] + [(t, NONE) for t in PROSE]
    base = spark.createDataFrame(notices, "text string, family string")
    many = base.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))))
    dropped = F.filter(
        F.split("text", " "),
        lambda x, i: (F.col("variant") == 0)
        | (F.pmod(F.xxhash64("text", "variant", i), F.lit(DROPPED)) != 0),
    )
    varied = many.withColumn("text", F.array_join(dropped, " "))
    rows = max(docs.count(), 1)
    lines = paragraphs(docs.sample(min(1.0, CORPUS_PARAGRAPHS / 4 / rows), SEED)).filter(
        ~F.col("text").rlike(r"(?i)licen[cs]e|copyright|public domain|permission")
    )
    prose = lines.select(
        "text", F.lit(NONE).alias("family"), F.pmod(F.xxhash64("text"), F.lit(VARIANTS)).cast("int").alias("variant")
    )
    return varied.unionByName(prose)


def train(docs: DataFrame) -> LicenceModel:
    """Fits and calibrates the model; the driver sees weights of features of the templates only."""
    spark = docs.sparkSession
    rows = training_rows(docs).withColumn("w", words(F.col("text")))
    features = F.transform(F.concat(_pairs("w"), _triples("w")), lambda h: h.cast("string"))
    rows = cut(rows.select("text", "family", "variant", features.alias("grams")))
    counter = CountVectorizer(inputCol="grams", outputCol="features", minDF=2, vocabSize=1 << 16)
    vocabulary = counter.fit(rows.filter(F.col("family") != NONE))
    classes = [NONE, UNKNOWN, *TEMPLATES]
    label = F.array_position(F.array(*map(F.lit, classes)), F.col("family")) - 1
    data = cut(vocabulary.transform(rows).select("features", label.cast("double").alias("label"), "variant"))
    held = F.pmod(F.col("variant"), F.lit(HELD_OUT)) == HELD_OUT - 1
    fit = LogisticRegression(
        family="multinomial", elasticNetParam=1.0, regParam=PENALTY, maxIter=ITERATIONS, standardization=False
    ).fit(data.filter(~held))
    temperature, sure = _calibrated(fit.transform(data.filter(held)), len(classes))
    matrix = fit.coefficientMatrix.toArray()
    table = [
        (int(term), [float(x) for x in matrix[:, i]])
        for i, term in enumerate(vocabulary.vocabulary)
    ]
    named = spark.createDataFrame([(f, t) for f, texts in TEMPLATES.items() for t in texts], "family string, text string")
    templates = named.withColumn("w", words(F.col("text"))).select(
        "family", F.array_distinct(F.concat(_pairs("w"), _triples("w"))).alias("grams")
    )
    return LicenceModel(
        spark.createDataFrame(table, "feature long, w array<double>"),
        templates,
        classes,
        [float(x) for x in fit.interceptVector],
        temperature,
        sure,
    )


def _calibrated(scored: DataFrame, n: int) -> tuple[float, float]:
    """The temperature with the least held-out loss, and the least probability of a family from
    which on PRECISION of the held-out predictions are right."""
    from pyspark.ml.functions import vector_to_array

    raw = scored.select("label", vector_to_array("rawPrediction").alias("z"))

    def softmax(t: float) -> Column:
        top = F.array_max("z")
        e = F.transform("z", lambda x: F.exp((x - top) / t))
        return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))

    right = F.col("label").cast("int")
    losses = [F.avg(-F.log(F.greatest(F.get(softmax(t), right), F.lit(1e-12)))) for t in TEMPERATURES]
    row = raw.agg(*losses).first()
    temperature = min(zip(row, TEMPERATURES, strict=True))[1] if row[0] is not None else 1.0
    p = raw.select("label", softmax(temperature).alias("p")).withColumn("best", F.array_max("p"))
    hit = (F.array_position("p", F.col("best")) - 1 == right).cast("int")
    rows = p.select("best", hit.alias("hit"), (F.array_position("p", F.col("best")) - 1).alias("at"))
    found = sorted(((r["best"], r["hit"]) for r in rows.filter("at > 1").collect()), reverse=True)
    sure, hits = 1.0, 0
    for i, (best, ok) in enumerate(found, 1):
        hits += ok
        if hits >= PRECISION * i:
            sure = best
    return temperature, max(sure, 0.5)


def scan(docs: DataFrame, model: LicenceModel | None = None) -> DataFrame:
    """Notices in `docs` (doc_id, text): doc_id, paragraph, family, probability, share, confirmed.

    One row per line of a text that reads like a licence notice. `family` is a key of TEMPLATES,
    or `unknown`; `share` is the largest share of the n-grams of one of the family's templates
    that the line has. NULL and empty texts and lines of one word have no n-gram and give no
    row; repeated rows give repeated notices; other columns are left out. The n-grams of a line
    are joined with the model's table and summed where they are, so a line moves as one row.
    """
    model = model or train(docs)
    grams = paragraphs(docs).withColumn("w", words(F.col("text")))
    each = grams.select(
        "_row", "doc_id", "paragraph", F.explode(F.concat(_pairs("w"), _triples("w"))).alias("feature")
    )
    met = each.join(F.broadcast(model.weights), "feature")
    sums = [F.sum(F.get("w", F.lit(i))).alias(f"z{i}") for i in range(len(model.classes))]
    lines = met.groupBy("_row", "paragraph").agg(
        F.first("doc_id").alias("doc_id"), F.collect_set("feature").alias("grams"), *sums
    )
    z = F.array(*[F.col(f"z{i}") + F.lit(b) for i, b in enumerate(model.bias)])
    lines = lines.select("doc_id", "paragraph", "grams", z.alias("z"))
    top = F.array_max("z")
    mass = F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp((x - top) / model.temperature))
    best = F.array_position("z", top).cast("int") - 1
    likely = lines.withColumn("probability", 1 / mass).withColumn("best", best)
    notices = likely.filter(F.col("best") > 0)
    family = F.get(F.array(*map(F.lit, model.classes)), F.col("best"))
    named = notices.withColumn(
        "family", F.when(F.col("probability") >= model.sure, family).otherwise(UNKNOWN)
    )
    kept = model.templates.groupBy("family").agg(F.collect_list("grams").alias("templates"))
    shares = F.transform(
        "templates", lambda t: F.size(F.array_intersect(t, F.col("grams"))) / F.size(t)
    )
    share = F.coalesce(F.array_max(shares), F.lit(0.0))
    joined = named.join(F.broadcast(kept), "family", "left").withColumn("share", share)
    return joined.select(
        "doc_id",
        "paragraph",
        "family",
        F.round("probability", 4).alias("probability"),
        F.round("share", 4).alias("share"),
        (F.col("share") >= CONFIRMED_SHARE).alias("confirmed"),
    )
