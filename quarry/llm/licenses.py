"""Licence scans: a trained paragraph classifier over word n-grams, with an unknown class and a check against templates.

A sparse multinomial logistic regression over words and word pairs is fitted on the driver from templates of each licence
family, varied by a seeded rule, and on sentences that only sound alike. It names a family or none; a temperature fitted on
varied templates held back makes its confidence mean what it says, and paragraphs below the least confidence are unknown. A
prediction counts only if the paragraph shares enough words with a template of its family.

A paragraph is a line with those that go on with it: a line break inside a sentence (none of .!?:; before it, and text on the
next line) is where a notice was wrapped. Paragraphs with an anchor word are scored, and those that share enough words with a template to be confirmed,
one of them a word that tells (not a number or function word) and two at least: one word alone, as 'mit', is a word of prose
too. Without an anchor a paragraph counts only if it is confirmed. Scoring is a join with the bounded table of weights and sums by paragraph.

Nulls and texts without a paragraph in question have no licence; texts are told apart by their id and their hash, so one id, or
none, may stand for several; repeated rows of one id and text get equal results; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import functools
import json
import random
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import named

# Short notices and first sentences of public licences, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, without warranties or conditions of any kind",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Licensed under the GNU GPL v2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "bsd": (
        "Distributed under the 3-clause BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License, CC BY-SA 4.0.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0 for noncommercial use only.",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work, CC0 1.0 Universal public domain dedication.",
    ),
    "proprietary": (
        "All rights reserved.",
        "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
        "Copyright, all rights reserved. No part of this publication may be reproduced or distributed without prior written permission of the publisher.",
    ),
}
#: Sentences with anchor words that grant nothing.
OTHERS = (
    "He renewed his driving license at the city office.", "The license plate of the car was stolen.", "She has a license to teach in the state.",
    "A fishing license is required in this lake.", "The permission of the teacher was not needed.", "They lost the licence of the restaurant.",
    "The warranty of the washing machine ended in May.", "Copyright law is taught in the second year.", "Apache helicopters flew over the valley.",
    "The general public was invited to the version of the play.", "The software was redistributed among the schools of the region.",
    "Creative people have common interests and public goals.", "MIT researchers published a new study of the brain.", "Our licence fee will rise next year.",
    "All citizens have the same rights.", "All rights of the workers were debated.", "The table was reserved for all of them.",
)
#: Words of templates that tell nothing by themselves.
COMMON = frozenset("the of and to in a is by this or for you it that any be with not are on as at from all no may its has have an under use used work part file form other without".split())
#: One of these is part of every template, in lower case.
ANCHORS = ("licens", "licenc", "copyright", "permission", "redistribut", "warrant", "public domain", "all rights", "spdx", "copies or substantial")
#: Least calibrated confidence, and share of the shorter side's words that paragraph and template have in common.
CONFIDENCE, SHARED = 0.5, 0.6
NONE, UNKNOWN = "none", "unknown"
_NOISE = "file see the for details code here project version page author year copyright by and of a work text is data table readme below above note".split()


def words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def ngrams(ws: list[str]) -> set[str]:
    return set(ws) | {f"{a} {b}" for a, b in zip(ws, ws[1:])}


def _varied(ws: list[str], rng: random.Random) -> list[str]:
    """A template as it is met: words lost, cut at either end, other words around it."""
    if len(ws) > 5:
        cut = rng.randrange(0, len(ws) // 3)
        ws = ws[cut:] if rng.random() < 0.3 else ws[: len(ws) - cut] if rng.random() < 0.4 else ws
    ws = [w for w in ws if rng.random() > 0.05] or ws
    pad = [rng.choice(_NOISE) if rng.random() < 0.5 else "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(3, 9))) for _ in range(rng.randrange(0, 9))]
    at = rng.randrange(0, len(pad) + 1)
    return pad[:at] + ws + pad[at:]


@functools.lru_cache(maxsize=1)
def fitted(copies: int = 24, seed: int = 5, steps: int = 250) -> tuple[tuple[str, ...], dict[str, list[float]], list[float]]:
    """Classes (the last is none), weights by n-gram, and biases, both already divided by the temperature."""
    rng = random.Random(seed)
    classes = (*TEMPLATES, NONE)
    rows = [(ngrams(_varied(words(t), rng)), k) for k, family in enumerate(TEMPLATES) for t in TEMPLATES[family] for _ in range(copies)]
    rows += [(ngrams(_varied(words(t), rng)), len(classes) - 1) for t in OTHERS for _ in range(copies)]
    anchors = ["license", "licensed", "copyright", "permission", "licence", "warranty"]
    rows += [(ngrams(_varied([rng.choice(anchors)], rng)), len(classes) - 1) for _ in range(20 * copies)]
    rng.shuffle(rows)
    counts: dict[str, int] = {}
    for grams, _ in rows:
        for g in grams:
            counts[g] = counts.get(g, 0) + 1
    vocabulary = {g: i for i, g in enumerate(sorted(g for g, c in counts.items() if c >= copies // 3))}
    x = np.zeros((len(rows), len(vocabulary)), dtype=np.float32)
    for i, (grams, _) in enumerate(rows):
        x[i, [vocabulary[g] for g in grams if g in vocabulary]] = 1
    y = np.eye(len(classes), dtype=np.float32)[[k for _, k in rows]]
    fit = np.arange(len(rows)) % 5 != 0
    w, b = np.zeros((x.shape[1], len(classes)), np.float32), np.zeros(len(classes), np.float32)
    vw, vb, rate, shrink = np.zeros_like(w), np.zeros_like(b), np.float32(0.5), np.float32(2e-4)

    def softmax(z):
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    for _ in range(steps):
        err = softmax(x[fit] @ w + b) - y[fit]
        vw, vb = 0.9 * vw + x[fit].T @ err / fit.sum(), 0.9 * vb + err.mean(0)
        w, b = w - rate * vw, b - rate * vb
        w = np.sign(w) * np.maximum(np.abs(w) - rate * shrink, 0)  # few n-grams keep a weight
    z = x[~fit] @ w + b

    def loss(t):
        return -np.log((softmax(z / t) * y[~fit]).sum(1) + 1e-12).mean()

    heat = min((0.3, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=loss)
    names = sorted(vocabulary, key=vocabulary.get)
    weights = {g: [round(float(v), 6) for v in w[i] / heat] for i, g in enumerate(names) if np.abs(w[i]).sum() > 0}
    return classes, weights, [round(float(v), 6) for v in b / heat]


def _literal(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table as a literal of the plan."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def _worded(ws, shared: float):
    """Whether the words have a likeness of `shared` with a template, by two words and one that tells."""
    sets = sorted({tuple(sorted(set(words(t)))) for ts in TEMPLATES.values() for t in ts})
    telling = sorted({w for tw in sets for w in tw if not w.isdigit()} - COMMON)
    own = F.array_distinct(ws)

    def alike(tw):
        both = F.size(F.array_intersect(own, tw))
        return (both >= 2) & (both / F.least(F.size(own), F.size(tw)) >= shared)

    return F.arrays_overlap(ws, F.lit(telling)) & F.exists(F.array(*[F.lit(list(tw)) for tw in sets]), alike)


#: A line break inside a sentence.
WRAP = r"(?<![.!?:;\s])[ \t\r]*\n(?=[ \t]*[^\s])"


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text", shared: float = SHARED) -> DataFrame:
    """o (names the text), p (number of the paragraph), the words and anchored (has an anchor word) of each distinct paragraph in question."""

    def anchored(low):
        some = F.contains(low, F.lit(ANCHORS[0]))
        for a in ANCHORS[1:]:
            some = some | F.contains(low, F.lit(a))
        return some

    some = docs.filter(F.col(text).isNotNull()).select(named(key, text).alias("o"), F.lower(F.regexp_replace(F.col(text), WRAP, " ")).alias("t"))
    lines = some.select("o", F.posexplode(F.split("t", "\n")).alias("p", "line"))
    found = lines.select("o", "p", F.regexp_extract_all("line", F.lit("[a-z0-9]+"), F.lit(0)).alias("ws"), anchored(F.col("line")).alias("anchored"))
    return found.filter((F.size("ws") > 0) & (F.col("anchored") | _worded(F.col("ws"), shared))).distinct()


def scored(found: DataFrame) -> DataFrame:
    """found, with the family of the highest probability and its confidence."""
    spark = found.sparkSession
    classes, weights, bias = fitted()
    table = _literal(spark, [{"g": g, "w": w} for g, w in weights.items()], "g string, w array<double>")
    pairs = F.transform(F.sequence(F.lit(1), F.size("ws")), lambda i: F.when(i < F.size("ws"), F.concat_ws(" ", F.element_at("ws", i), F.try_element_at("ws", i + 1))))
    grams = found.select("o", "p", F.explode(F.array_distinct(F.array_compact(F.concat("ws", pairs)))).alias("g"))
    sums = grams.join(F.broadcast(table), "g").groupBy("o", "p").agg(*[F.sum(F.element_at("w", k + 1)).alias(f"s{k}") for k in range(len(classes))])
    z = F.array(*[F.coalesce(F.col(f"s{k}"), F.lit(0.0)) + F.lit(b) for k, b in enumerate(bias)])
    out = found.join(sums, ["o", "p"], "left").withColumn("z", z).withColumn("top", F.array_max("z"))
    total = F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    names = F.array(*map(F.lit, classes))
    return out.select(*found.columns, F.element_at(names, F.array_position("z", F.col("top")).cast("int")).alias("family"), (F.lit(1.0) / total).alias("confidence"))


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text", confidence: float = CONFIDENCE, shared: float = SHARED) -> DataFrame:
    """key, p, family, confidence, likeness and confirmed of each paragraph in question that is not none (repeated rows once).

    Paragraphs without an anchor word are among them only if confirmed. family is unknown where the classifier is not sure enough or no template confirms it.
    """
    return _scanned(docs, key, text, confidence, shared).select(F.col("o.d").alias(key), "p", "family", "confidence", "likeness", "confirmed")


def _scanned(docs: DataFrame, key: str, text: str, confidence: float, shared: float) -> DataFrame:
    spark = docs.sparkSession
    some = scored(paragraphs(docs, key, text, shared)).filter(F.col("family") != NONE)
    rows = [{"family": f, "tw": sorted(set(words(t)))} for f, ts in TEMPLATES.items() for t in ts]
    templates = _literal(spark, rows, "family string, tw array<string>")
    own = F.array_distinct("ws")
    like = F.size(F.array_intersect(own, F.col("tw"))) / F.least(F.size(own), F.size("tw"))
    best = some.join(F.broadcast(templates), "family").groupBy("o", "p").agg(F.max(like).alias("likeness"))
    out = some.join(best, ["o", "p"]).withColumn("confirmed", (F.col("confidence") >= confidence) & (F.col("likeness") >= shared))
    family = F.when(F.col("confirmed"), F.col("family")).otherwise(UNKNOWN)
    out = out.filter(F.col("confirmed") | F.col("anchored"))
    return out.select("o", "p", family.alias("family"), "confidence", "likeness", "confirmed")


def by_document(docs: DataFrame, key: str = "doc_id", text: str = "text", confidence: float = CONFIDENCE, shared: float = SHARED) -> DataFrame:
    """A row for each row of docs: families (sorted, joined by a comma; unknown among them; none if there are none), paragraphs and confidence."""
    hits = _scanned(docs, key, text, confidence, shared).groupBy("o").agg(
        F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), F.count("*").alias("n_paragraphs"),
        F.count_if(F.col("confirmed")).alias("n_confirmed"), F.max("confidence").alias("confidence"),
    )
    return docs.select(key, named(key, text).alias("o")).join(hits, "o", "left").select(key, F.coalesce("families", F.lit(NONE)).alias("families"), F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"), F.coalesce("n_confirmed", F.lit(0)).alias("n_confirmed"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def query(spark, sf_dir: str) -> DataFrame:
    from quarry.llm.common import documents

    return by_document(documents(spark, sf_dir))
