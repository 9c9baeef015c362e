"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is a line of a text. Its features are its distinct word n-grams of one to three words, words
being runs of a-z and 0-9 after lower case. A sparse softmax regression over licence families and an
``unknown`` class is trained on the driver from the templates below, variants of them, sentences that only
sound like licences, and a bounded sample of the corpus' own paragraphs; its confidence is calibrated by a
temperature and a threshold chosen on variants that were held back. A prediction is confirmed if the
paragraph holds at least :data:`SIMILAR` of the word trigrams of one of the family's templates.

Notices are often wrapped at 72 to 80 columns, so that no line of them holds half of a template. So the
template trigrams of a text are found across its lines too. Those of one template that follow each other
within a template's length are a notice (only texts that hold one of a few words without which there is none are
cut into trigrams); if together they hold :data:`SIMILAR` of the template and no line
does alone, the notice counts as a paragraph of that family, predicted and confirmed. Of families whose
notices cover each other by more than half, as those of the GNU licences do, the most similar one counts.

The main path is DataFrame functions only. Weights and templates are small fixed-size tables (at most
:data:`FEATURES` n-grams) and are broadcast. A paragraph without any word of the weights has the bias as
its score, which says unknown, so only paragraphs with such a word are cut into n-grams.

Null and empty texts have no paragraphs. Rows that share an id, or have none, share one result; each gets
a row. Of families with equal scores the first in the order of :data:`TEMPLATES` is taken; notices of equal similarity all count.
A very long text that may hold a notice is one array of its words in memory, any other one only its lines. An empty
table gives an empty one. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import cache, reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultfold.llm.common import sampled, written

UNKNOWN = "unknown"
FEATURES, SIMILAR, SAMPLE = 4096, 0.5, 300
#: Letters of words that are looked for in texts as they are.
RARE = 6

# Notices as their licences word them, by family.
TEMPLATES = {
    "agpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License",
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at",
        "Released under the Apache License, Version 2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met",
        "Released under the BSD 3-Clause License.",
        "Licensed under the 2-clause BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Licensed under the Creative Commons Attribution License, CC BY 4.0",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Available for non-commercial use under CC BY-NC 4.0",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License",
        "Released under the GNU General Public License v3",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is available under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction',
        "SPDX-License-Identifier: MIT",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this publication may be reproduced without permission.",
        "This material is proprietary and confidential; unauthorised copying is prohibited.",
    ),
    "public-domain": (
        "This work has been released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0",
        "This is free and unencumbered software released into the public domain.",
    ),
}
#: Sentences that share words with licences and are none.
DECOYS = (
    "She renewed her driving licence under the new rules",
    "The license plate of the public bus was found",
    "Researchers at MIT released a paper under review",
    "All rights of the people are protected by law",
    "Version 3 of the software is free to download",
    "The general public was free to use the library",
    "The creative commons room is available for students",
    "The Apache helicopter had version 2.0 of the radar",
    "No part of the work was permitted without a permit",
    "The source code of the program is under construction",
    "The table is reserved for four under the name of Berkeley",
    "mit",
    "mit der und die mit",
    "sa by nc",
)
STOP_WORDS = frozenset(
    "a all an and any are as at be by can for from has have in into is it its may no not of on or part that the this "
    "to under use was with without you".split()
)
_between = re.compile(r"[^a-z0-9]+")


def words(paragraph: str) -> list[str]:
    return _between.sub(" ", paragraph.lower()).split()


def ngrams(tokens: list[str], low: int = 1, high: int = 3) -> set[str]:
    return {" ".join(tokens[i : i + n]) for n in range(low, high + 1) for i in range(len(tokens) - n + 1)}


def template_grams() -> list[tuple[str, int, str]]:
    """Family, number and n-gram of each template: its trigrams, or itself if it is shorter."""
    out = []
    for family, templates in TEMPLATES.items():
        for number, template in enumerate(templates):
            tokens = words(template)
            size = min(3, len(tokens))
            out += [(family, number, gram) for gram in sorted(ngrams(tokens, size, size))]
    return out


@cache
def _template_sets() -> dict[str, list[set[str]]]:
    sets: dict[tuple[str, int], set[str]] = {}
    for family, number, gram in template_grams():
        sets.setdefault((family, number), set()).add(gram)
    return {f: [own for (family, _), own in sets.items() if family == f] for f in TEMPLATES}


def similarity(paragraph: str, family: str) -> float:
    """The greatest share of a template's n-grams that the paragraph holds."""
    grams = ngrams(words(paragraph))
    return max(len(own & grams) / len(own) for own in _template_sets()[family])


def is_similar(paragraph: str) -> bool:
    grams = ngrams(words(paragraph))
    return any(len(own & grams) >= SIMILAR * len(own) for sets in _template_sets().values() for own in sets)


@dataclass(frozen=True)
class Model:
    """``weights`` by n-gram and ``bias``, both by class; scores are divided by ``temperature``."""

    classes: tuple[str, ...]
    weights: dict[str, np.ndarray]
    bias: np.ndarray
    temperature: float
    threshold: float

    def predict(self, paragraph: str) -> tuple[str, float]:
        """The class and its probability; unknown if it is below the threshold."""
        grams = [g for g in sorted(ngrams(words(paragraph))) if g in self.weights]
        scores = (self.bias + sum((self.weights[g] for g in grams), np.zeros(len(self.bias)))) / self.temperature
        likely = np.exp(scores - scores.max())
        likely /= likely.sum()
        best = int(likely.argmax())
        name = self.classes[best] if likely[best] >= self.threshold else UNKNOWN
        return name, float(likely[best])


def _examples(paragraphs: list[str], rng) -> list[tuple[list[str], str]]:
    """Token lists and classes: templates, variants with words lost or put around them, and paragraphs without."""
    filler = [w for p in paragraphs for w in words(p)] or ["the"]
    out = []

    def some():
        return [filler[i] for i in rng.integers(0, len(filler), rng.integers(0, 12))]

    for family, templates in TEMPLATES.items():
        for template in templates:
            tokens = words(template)
            for k in range(24):
                kept = [w for w in tokens if k == 0 or rng.random() > 0.08 * (k % 3)]
                around = [some() if k % 2 else [] for _ in range(2)]
                out.append((around[0] + kept + around[1], family))
    plain = [p for p in paragraphs if not is_similar(p)]
    out += [(words(p), UNKNOWN) for p in plain]
    for decoy in DECOYS:
        tokens = words(decoy)
        for k in range(24):
            around = [some() if k % 2 else [] for _ in range(2)]
            out.append((around[0] + [w for w in tokens if k == 0 or rng.random() > 0.1] + around[1], UNKNOWN))
    return [(t, c) for t, c in out if t]


def train(paragraphs: list[str], epochs: int = 12, seed: int = 3) -> Model:
    """Weights by stochastic gradient descent, then a temperature and a threshold from held-back examples."""
    rng = np.random.default_rng(seed)
    names = (*TEMPLATES, UNKNOWN)
    vocabulary = set()
    for text in [t for templates in TEMPLATES.values() for t in templates] + list(DECOYS):
        vocabulary |= {g for g in ngrams(words(text)) if not set(g.split()) <= STOP_WORDS}
    place = {g: i for i, g in enumerate(sorted(vocabulary)[:FEATURES])}
    rows = [
        (np.array([place[g] for g in ngrams(tokens) if g in place], np.int64), names.index(c))
        for tokens, c in _examples(paragraphs, rng)
    ]
    order = rng.permutation(len(rows))
    held, used = order[: len(rows) // 5], order[len(rows) // 5 :]
    weights, bias = np.zeros((len(place), len(names))), np.zeros(len(names))
    bias[-1] = 2.0
    for epoch in range(epochs):
        rate = 0.3 / (1 + epoch / 3)
        weights *= 1 - 1e-3
        for i in rng.permutation(used):
            features, label = rows[i]
            scores = bias + weights[features].sum(0)
            error = np.exp(scores - scores.max())
            error /= error.sum()
            error[label] -= 1
            weights[features] -= rate * error
            bias -= 0.1 * rate * error
    scores = np.array([bias + weights[rows[i][0]].sum(0) for i in held])
    labels = np.array([rows[i][1] for i in held])

    def likely(t):
        e = np.exp((scores - scores.max(1, keepdims=True)) / t)
        return e / e.sum(1, keepdims=True)

    temperature = min(np.geomspace(0.25, 8, 41), key=lambda t: -np.log(likely(t)[np.arange(len(held)), labels] + 1e-12).mean())
    top = likely(temperature)
    best, sure = top.argmax(1), top.max(1)
    # The least threshold from a half on at which at most one in a hundred accepted predictions is wrong.
    threshold = next(
        (t for t in np.linspace(0.5, 0.95, 10) if (((sure >= t) & (best != labels)).sum() <= 0.01 * (sure >= t).sum())), 0.95
    )
    kept = np.flatnonzero(np.abs(weights).max(1) > 1e-9)
    spelled = sorted(place, key=place.get)
    return Model(names, {spelled[i]: weights[i] for i in kept}, bias, float(temperature), float(threshold))


def fit(documents: DataFrame, sample: int = SAMPLE) -> Model:
    """A model whose negatives are the paragraphs of at most ``sample`` documents."""
    texts = sampled(documents.where(F.col("text").isNotNull()), "doc_id", sample).select("doc_id", "text")
    rows = texts.select("doc_id", F.explode(F.split("text", "\n")).alias("p")).where("length(p) between 1 and 2000")
    rows = rows.orderBy(F.xxhash64("doc_id", "p"), "p").limit(10 * sample)
    return train(sorted(rows.select("p").toArrow().column("p").to_pylist()))


def _grams(tokens):
    """The distinct n-grams of one to three words of an array of words."""
    n = F.size(tokens)

    def size(k):
        at = F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1)))
        made = F.transform(at, lambda i: F.array_join(F.slice(tokens, i, k), " "))
        return F.when(n >= k, made).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(tokens, size(2), size(3)))


def paragraphs(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, paragraph, family, probability, similarity, confirmed`` of each paragraph taken for a licence."""
    spark = documents.sparkSession
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    tokens = F.array_remove(F.split(F.regexp_replace(F.lower("line"), "[^a-z0-9]+", " "), " "), "")
    known = sorted({g for g in model.weights if " " not in g})
    listed = F.array(*[F.lit(w) for w in known])
    lines = lines.select("doc_id", "paragraph", tokens.alias("words")).where(F.arrays_overlap("words", listed))
    # Ids may repeat, so paragraphs are told apart by a number of their own.
    lines = lines.withColumn("line_id", F.monotonically_increasing_id())
    grams = lines.select("line_id", "doc_id", "paragraph", F.explode(_grams(F.col("words"))).alias("gram"))
    weights = spark.createDataFrame(
        [(g, *map(float, w)) for g, w in sorted(model.weights.items())],
        "gram string, " + ", ".join(f"w{k} double" for k in range(len(model.classes))),
    )
    hit = written(grams.join(F.broadcast(weights), "gram"), "grams")
    scored = hit.groupBy("line_id").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("paragraph").alias("paragraph"),
        *[((F.sum(f"w{k}") + F.lit(float(b))) / model.temperature).alias(f"s{k}") for k, b in enumerate(model.bias)],
    )
    top = F.greatest(*[F.col(f"s{k}") for k in range(len(model.classes))])
    mass = sum((F.exp(F.col(f"s{k}") - F.col("top")) for k in range(len(model.classes))), F.lit(0.0))
    name = F.coalesce(*[F.when(F.col(f"s{k}") == F.col("top"), F.lit(c)) for k, c in enumerate(model.classes)])
    found = (
        scored.withColumn("top", top)
        .select("line_id", "doc_id", "paragraph", name.alias("family"), (1 / mass).alias("probability"))
        .where((F.col("family") != UNKNOWN) & (F.col("probability") >= model.threshold))
    )
    templates = spark.createDataFrame(template_grams(), "family string, template int, gram string")
    sizes = templates.groupBy("family", "template").agg(F.count("*").alias("of"))
    templates = templates.join(sizes, ["family", "template"])
    shared = (
        hit.select("line_id", "gram")
        .join(F.broadcast(templates), "gram")
        .groupBy("line_id", "family", "template")
        .agg((F.count("*") / F.first("of")).alias("share"))
        .groupBy("line_id", "family")
        .agg(F.max("share").alias("similarity"))
    )
    similar = F.coalesce("similarity", F.lit(0.0))
    return found.join(shared, ["line_id", "family"], "left").select(
        "doc_id", "paragraph", "family", "probability", similar.alias("similarity"), (similar >= SIMILAR).alias("confirmed")
    )


@cache
def anchors() -> tuple[str, ...]:
    """Words of which every text with a notice holds one: trigrams without them are less than :data:`SIMILAR` of any
    template. Words of :data:`RARE` letters or more are taken first, as other texts seldom hold them."""
    grams: dict[tuple[str, int], list[frozenset[str]]] = {}
    for family, number, gram in template_grams():
        if len(gram.split()) == 3:
            grams.setdefault((family, number), []).append(frozenset(gram.split()))

    def without(words: set[str]) -> list[list[frozenset[str]]]:
        """Of each template that has enough trigrams without ``words``, these trigrams."""
        rest = [(len(own), [g for g in own if not g & words]) for own in grams.values()]
        return [left for n, left in rest if len(left) >= SIMILAR * n]

    chosen: set[str] = set()
    while still := without(chosen):
        covers = Counter(w for left in still for gram in left for w in gram - STOP_WORDS)
        chosen.add(max(sorted(covers), key=lambda w: (len(w) >= RARE, covers[w])))
    for word in sorted(chosen, key=lambda w: (len(w), w)):
        if not without(chosen - {word}):
            chosen.remove(word)
    return tuple(sorted(chosen))


def _may_hold_notice(lower: Column) -> Column:
    """Whether a text in lower case holds an :func:`anchors` word; short ones as whole words, longer ones anywhere."""
    short = "|".join(w for w in anchors() if len(w) < RARE)
    found = [lower.contains(w) for w in anchors() if len(w) >= RARE]
    return reduce(or_, [*found, *([lower.rlike(f"(?<![a-z0-9])(?:{short})(?![a-z0-9])")] if short else [])])


def wrapped_notices(documents: DataFrame) -> DataFrame:
    """``doc_id, family, similarity`` of each notice that only several lines together confirm."""
    spark = documents.sparkSession
    templates = spark.createDataFrame(template_grams(), "family string, template int, gram string")
    sizes = templates.groupBy("family", "template").agg(F.count("*").alias("of"))
    templates = templates.where(F.size(F.split("gram", " ")) == 3).join(sizes, ["family", "template"])

    def line_words(line, number):
        tokens = F.array_remove(F.split(F.regexp_replace(line, "[^a-z0-9]+", " "), " "), "")
        return F.transform(tokens, lambda w: F.struct(w.alias("word"), number.alias("line")))

    # Ids may repeat, so texts are told apart by a number of their own.
    # The number keeps Spark from moving the filter before the change of case, which would be made for each word then.
    lower = documents.select("doc_id", F.monotonically_increasing_id().alias("text_id"), F.lower("text").alias("text"))
    words = lower.where(_may_hold_notice(F.col("text"))).select(
        "doc_id", "text_id", F.flatten(F.transform(F.split("text", "\n"), line_words)).alias("words")
    )
    at = F.sequence(F.lit(1), F.size("words") - 2)

    def trigram(i):
        three = [F.element_at("words", i + k) for k in range(3)]
        gram = F.concat_ws(" ", *[w["word"] for w in three])
        # The line of a trigram, or -1 if it goes over a line end.
        line = F.when(three[0]["line"] == three[2]["line"], three[0]["line"]).otherwise(-1)
        return F.struct(i.alias("at"), gram.alias("gram"), line.alias("line"))

    runs = words.where(F.size("words") > 2).select("doc_id", "text_id", F.explode(F.transform(at, trigram)).alias("t"))
    hits = runs.select("doc_id", "text_id", "t.at", "t.gram", "t.line").join(F.broadcast(templates), "gram")
    hits = written(hits, "trigrams")
    key = ["text_id", "family", "template"]
    order = Window.partitionBy(*key).orderBy("at")
    begins = (F.col("at") - F.lag("at").over(order) > F.col("of")).cast("int")
    hits = hits.withColumn("notice", F.sum(F.coalesce(begins, F.lit(0))).over(order))
    lines = hits.groupBy(*key, "notice", "line").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("of").alias("of"),
        F.min("at").alias("low"),
        F.max("at").alias("high"),
        F.collect_set("gram").alias("grams"),
    )
    notices = lines.groupBy(*key, "notice").agg(
        F.first("doc_id").alias("doc_id"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        (F.size(F.array_distinct(F.flatten(F.collect_list("grams")))) / F.first("of")).alias("similarity"),
        (F.max(F.when(F.col("line") >= 0, F.size("grams")).otherwise(0)) / F.first("of")).alias("alone"),
    )
    notices = notices.where(F.col("similarity") >= SIMILAR)
    entry = F.struct("low", "high", "family", "similarity", "alone")
    listed = notices.groupBy("text_id").agg(F.first("doc_id").alias("doc_id"), F.collect_list(entry).alias("all"))

    def better(one):
        def covers(other):
            shared = F.least(one["high"], other["high"]) - F.greatest(one["low"], other["low"]) + 3
            shorter = F.least(one["high"] - one["low"], other["high"] - other["low"]) + 3
            return (
                (other["family"] != one["family"]) & (other["similarity"] > one["similarity"]) & (2 * shared > shorter)
            )

        return covers

    best = F.filter("all", lambda one: (one["alone"] < SIMILAR) & ~F.exists(F.col("all"), better(one)))
    return listed.select("doc_id", F.explode(best).alias("n")).select("doc_id", "n.family", "n.similarity")


def scan(documents: DataFrame, model: Model) -> DataFrame:
    """One row a document: ``doc_id, licences, confirmed, n_paragraphs``.

    ``licences`` lists the families predicted and ``confirmed`` those confirmed by a template, each sorted and joined by
    commas; ``n_paragraphs`` counts the paragraphs predicted, and wrapped notices.
    """
    documents = documents.select("doc_id", "text")
    notices = wrapped_notices(documents).select("doc_id", "family", F.lit(True).alias("confirmed"))
    found = paragraphs(documents, model).select("doc_id", "family", "confirmed").union(notices)
    found = found.groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_set("family")), ",").alias("licences"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("confirmed"),
        F.count("*").alias("n_paragraphs"),
    )
    found = written(found, "licensed").withColumnRenamed("doc_id", "found_id")
    rows = documents.select("doc_id")
    return rows.join(found, rows.doc_id.eqNullSafe(found.found_id), "left").select(
        "doc_id",
        F.coalesce("licences", F.lit("")).alias("licences"),
        F.coalesce("confirmed", F.lit("")).alias("confirmed"),
        F.coalesce("n_paragraphs", F.lit(0)).cast("long").alias("n_paragraphs"),
    )
