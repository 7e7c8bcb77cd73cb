"""Operator 8: licence scan by a trained paragraph classifier.

Paragraphs are the lines of a text. Features are hashed words and pairs of neighbouring words. A first logistic
regression separates licence paragraphs from others; a second one (one against the rest for each family) names the
family. Both are trained here, on the notices in ``NOTICES`` with some words left out or put before them, and on a bounded
sample of the corpus's own paragraphs (``SAMPLE`` of them, by a hash of their text, without the words of ``TELLTALE``).
Every fourth training paragraph is held out: the score from which on a paragraph counts as a licence lies halfway between
what the held-out plain paragraphs reach at most and what held-out notices reach at least, so that what is like none of
the families is unknown and passed over. A prediction is confirmed by comparison with the family's notices: the share of
the notice's words that the paragraph has must reach ``CONFIRM``; down to ``NEAR`` the paragraph counts as a licence of
unknown family, and below that as none.

DataFrame and SQL functions only; the weights are fitted on the driver on the bounded training set and go into the scoring
expression as a constant of fixed size.

Defined results: a null or empty text has no paragraphs; the result has one row for each id with a finding, so rows that
share an id are one row with the families of all, and rows without an id together are one; paragraphs that fit two families
equally take the first in the order of the notices; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

#: Short notices of licence families, as they stand in files and pages.
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Apache License Version 2.0, January 2004", "SPDX-License-Identifier: Apache-2.0"],
    "MIT": ["Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "The MIT License (MIT)", "SPDX-License-Identifier: MIT", "Licensed under the MIT license"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Use of this source code is governed by a BSD-style license", "Licensed under the BSD 3-Clause License", "Distributed under the BSD license", "SPDX-License-Identifier: BSD-3-Clause"],
    "GPL": ["This work is licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "Licensed under the GPL version 2", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1-only"],
    "AGPL": ["Licensed under the GNU Affero General Public License, version 3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: AGPL-3.0-only"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, version 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "Available under the Creative Commons Attribution license (CC BY)"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Text is available under the Creative Commons Attribution-ShareAlike License"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC-SA 4.0"],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related rights to this work", "Released under CC0 1.0 Universal, public domain dedication", "This work is in the public domain under CC0"],
    "Proprietary": ["All rights reserved", "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher", "Copyright (c) the author. All rights reserved", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited"],
}
TELLTALE = r"(?i)licen[sc]|copyright|rights reserved|permission|public domain|spdx|proprietary"
BUCKETS, SAMPLE = 1 << 13, 3000
CONFIRM, NEAR = 0.6, 0.3
SCALE = 1000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}.+-]+|\.(?=\s|$)"), lambda w: w != "")


def grams(tokens: Column) -> Column:
    """Bucket numbers of the words and of the pairs of neighbours."""

    def both(w: Column) -> Column:
        one = F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int"))
        two = F.transform(F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda x, i: F.pmod(F.xxhash64(F.get(w, i), x), F.lit(BUCKETS)).cast("int"))
        return F.concat(one, two)

    return let(tokens, both)


def variants(notice: str) -> list[str]:
    """A notice, whole, without its head or tail, and within other words."""
    w = notice.split()
    cut = max(1, len(w) // 6)
    return [notice, notice + ".", " ".join(w[cut:]) if len(w) > 6 else notice, " ".join(w[:-cut]) if len(w) > 8 else notice, "This file: " + notice, notice.upper(), notice.lower(), "(c) 2020 " + notice + " See LICENSE for details."]


def training_rows(spark: SparkSession, docs: DataFrame) -> list[tuple[str, list[int]]]:
    """(family or '', buckets): notices with variants, and the bounded sample of plain paragraphs."""
    rows = [(family, v) for family, notices in NOTICES.items() for n in notices for v in variants(n)]
    given = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.lit(v).alias("line")) for f, v in rows])).alias("r")).select("r.*")
    lines = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line")).filter(F.length("line").between(20, 400) & ~F.col("line").rlike(TELLTALE))
    # The sample: the lines with the least hashes, which Spark finds without a sort of all.
    plain = lines.withColumn("h", F.xxhash64("line")).orderBy("h", "line").limit(SAMPLE).select(F.lit("").alias("family"), "line")
    out = given.unionByName(plain).select("family", "line", grams(words(F.col("line"))).alias("g")).collect()
    return [(r["family"], r["g"]) for r in sorted(out, key=lambda r: (r["family"], r["line"]))]


def fit(rows: list[tuple[bool, list[int]]], epochs: int = 25, rate: float = 0.5) -> tuple[dict[int, float], float]:
    """Logistic regression by gradient steps, one example after another; features are shares of the n-grams."""
    weights: dict[int, float] = {}
    bias = 0.0
    yes = max(1, sum(y for y, _ in rows))
    balance = (len(rows) - yes) / yes
    for epoch in range(epochs):
        step = rate / (1 + epoch / 5)
        for y, g in rows:
            if not g:
                continue
            share = 1 / math.sqrt(len(g))
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + share * sum(weights.get(b, 0.0) for b in g)))))
            slope = (y - p) * (min(balance, 10.0) if y else 1.0) * step
            bias += 0.1 * slope
            for b in g:
                weights[b] = weights.get(b, 0.0) * (1 - 1e-5) + slope * share
    return weights, bias


def score(g: Column, model: tuple[dict[int, float], float]) -> Column:
    """SCALE times the log odds, in whole numbers."""
    weights, bias = model
    held = F.split(F.lit(",".join(str(round(SCALE * weights.get(b, 0.0))) for b in range(BUCKETS))), ",").cast("array<int>")
    total = F.aggregate(g, F.lit(0).cast("long"), lambda a, b: a + F.get(held, b))
    return (total / F.sqrt(F.greatest(F.size(g), F.lit(1))) + F.lit(SCALE * bias)).cast("long")


def _odds(g: list[int], model: tuple[dict[int, float], float]) -> float:
    return model[1] + sum(model[0].get(b, 0.0) for b in g) / math.sqrt(max(1, len(g)))


def train(rows: list[tuple[str, list[int]]]) -> tuple[tuple, dict[str, tuple], int]:
    """The gate's model, the families' models, and the least score of a licence paragraph."""
    fitted = [r for i, r in enumerate(rows) if i % 4]
    held = [r for i, r in enumerate(rows) if i % 4 == 0]
    gate = fit([(f != "", g) for f, g in fitted])
    families = {name: fit([(f == name, g) for f, g in fitted if f], rate=1.0) for name in NOTICES}
    plain = max((_odds(g, gate) for f, g in held if not f), default=0.0)
    licence = sorted(_odds(g, gate) for f, g in held if f)
    least = (plain + licence[len(licence) // 50]) / 2 if licence else 0.0
    return gate, families, round(SCALE * max(0.0, least))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, row, line, family, confirmed): the licence paragraphs of all documents."""
    gate, families, least = train(training_rows(docs.sparkSession, docs))
    lines = docs.select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    # The gate runs on every paragraph, the families only on what it lets through.
    passed = lines.withColumn("g", grams(words(F.col("line")))).filter((F.size("g") > 0) & (score(F.col("g"), gate) >= least))
    rated = passed.select("doc_id", "line", F.array_max(F.array(*[F.struct(score(F.col("g"), m).alias("score"), F.lit(name).alias("family")) for name, m in families.items()])).alias("best"))
    sets = {name: [sorted({w for w in re.split(r"[^\w.+-]+|\.(?=\s|$)", n.lower()) if w}) for n in notices] for name, notices in NOTICES.items()}
    own = F.array_distinct(words(F.col("line")))

    def shares(own: Column) -> Column:
        chain = F.when(F.lit(False), F.lit(0.0))
        for name, lists in sets.items():
            best = [F.size(F.array_intersect(own, F.array(*map(F.lit, ws)))) / F.lit(len(ws)) for ws in lists]
            chain = chain.when(F.col("best.family") == name, F.greatest(*best))
        return chain

    return rated.withColumn("share", let(own, shares)).filter(F.col("share") >= NEAR).select("doc_id", "line", F.when(F.col("share") >= CONFIRM, F.col("best.family")).otherwise("unknown").alias("family"), F.col("share").alias("share"))


def scan(docs: DataFrame) -> DataFrame:
    """One row a document with a licence paragraph: doc_id, families (ascending), n_paragraphs, n_unknown."""
    found = paragraphs(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    grouped = found.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.when(F.col("family") != "unknown", F.col("family")))).alias("families"), F.count("*").alias("n_paragraphs"), F.count_if(F.col("family") == "unknown").alias("n_unknown"))
    return grouped.filter((F.size("families") > 0) | (F.col("n_unknown") > 0))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
