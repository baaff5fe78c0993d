"""Licence scan: a trained paragraph classifier, in DataFrame functions only.

Features are word n-grams (one to three words). A multinomial logistic regression is trained on sentences of public licence texts by
family, on notices that name a family, on other licences and licence talk (class UNKNOWN) and on plain prose (class NONE). Its
lasso penalty chooses the features: most n-grams end with no weight and are none. The notices in NOTICES, which predictions are compared with (beside the longer sentences of the texts),
are not trained on. The temperature is the one that fits sentences held out of training best: each sentence, each way of naming a
family and each other licence is held out once.

A paragraph whose likeliest class is NONE has no row, so one without any feature has none: the intercepts say so. One whose
family is less probable than ``sure`` is ``unknown``, as is one of class UNKNOWN. The share of a family's template words found
in the paragraph then confirms the prediction or not.

A paragraph is a line, of any length, with the lines after it that go on with a notice: those whose first word
follows the last word of the line before in one of the notices. It has the number of its first line.

Cases: null and empty texts have no rows; each occurrence of a repeated
line or document has its own row; null ids are kept; an empty table gives no rows; ties go to
the family first by name; further columns are not read.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import let, softmax
from .license_texts import FRAMES, NAMES, OTHER_TEXTS, OTHERS, PROSE, TALK, TEXTS

# Short public licence notices by family.
NOTICES = {
    "AGPL-3.0": ["This program is licensed under the GNU Affero General Public License, version 3.", "Licensed under the AGPL version 3 or later."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0"],
    "BSD": ["Released under the BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright to this work under the CC0 license."],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "ISC": ["Released under the ISC License.", "SPDX-License-Identifier: ISC license"],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only"],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT license"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "Proprietary": ["All rights reserved.", "Copyright by the authors. All rights reserved. No part of this license may be reproduced."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Dedicated to the public domain under the Unlicense."],
}
UNKNOWN, NONE = "unknown", "none"
WORD = "[a-z0-9]+"


def tokens(text: str) -> list[str]:
    out, word = [], ""
    for c in text.lower() + " ":
        if c.isascii() and c.isalnum():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def ngrams(words: list[str]) -> list[str]:
    return [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


@dataclass
class Model:
    families: list[str]
    features: dict[str, int]
    weights: np.ndarray
    temperature: float

    def probabilities(self, text: str) -> np.ndarray:
        """The brute-force form of ``scan``'s scores."""
        own = {self.features[g] for g in ngrams(tokens(text)) if g in self.features}
        z = (self.weights[-1] + self.weights[sorted(own)].sum(0)) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


#: Copies of each sentence with words lost and others around it, steps of the regression, its penalty, and the parts in which sentences are held out.
COPIES, STEPS, PENALTY, FOLDS = 2, 150, 3e-4, 2
#: How much a sentence of a licence text weighs against a notice that only names a family.
TEXT_WEIGHT = 5.0
#: Different words of a training sentence that a prediction is compared with, at least.
LEAST_TEMPLATE = 12


def _altered(rng: np.random.Generator, words: list[str], fill: list[str]) -> list[str]:
    kept = [w for w in words if rng.random() > 0.1] or words
    around = lambda: [fill[i] for i in rng.integers(0, len(fill), rng.integers(0, 6))]
    return around() + kept + around()


def sentences() -> list[tuple[list[str], str, int, float]]:
    """(words, class, fold, weight) of all that is trained on, without the NOTICES. A fold holds whole sentences, names and other licences."""
    own = {tuple(tokens(n)) for ns in NOTICES.values() for n in ns}
    out = [(t, family, i % FOLDS, TEXT_WEIGHT) for family, ts in TEXTS.items() for i, t in enumerate(ts)]
    out += [(frame.format(name), family, i % FOLDS, 1.0) for family, names in NAMES.items() for i, name in enumerate(names) for frame in FRAMES]
    out += [(frame.format(name), UNKNOWN, i % FOLDS, 1.0) for i, name in enumerate(OTHERS) for frame in FRAMES]
    out += [(t, UNKNOWN, i % FOLDS, TEXT_WEIGHT) for i, t in enumerate(OTHER_TEXTS + TALK)] + [(t, NONE, i % FOLDS, TEXT_WEIGHT) for i, t in enumerate(PROSE)]
    return [(tokens(t), y, fold, weight) for t, y, fold, weight in out if tuple(tokens(t)) not in own]


def _soft(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights (the intercepts last) of the penalised regression, by proximal gradient steps with momentum."""
    w = z = np.zeros((x.shape[1], y.shape[1]), dtype=np.float32)
    rate, k = 4.0 / (x**2 * weight[:, None]).sum(1).mean(), 1.0
    for _ in range(STEPS):
        step = z - rate * (x.T @ (weight[:, None] * (_soft(x @ z) - y)) / weight.sum())
        new = np.sign(step) * np.maximum(np.abs(step) - rate * PENALTY, 0)
        new[-1] = step[-1]
        after = (1 + math.sqrt(1 + 4 * k * k)) / 2
        w, z, k = new, new + (k - 1) / after * (new - w), after
    return w


@lru_cache(maxsize=2)
def train(seed: int = 5) -> Model:
    rng = np.random.default_rng(seed)
    families = [*sorted(NOTICES), UNKNOWN, NONE]
    base = sentences()
    prose = {w for t in PROSE for w in tokens(t)}
    fill = sorted(prose - set(tokens(" ".join(sum(TEXTS.values(), [])))))
    rows = base + [(_altered(rng, w, fill), *rest) for w, *rest in base for _ in range(COPIES)]
    # N-grams of prose words alone tell nothing.
    grams = sorted({g for w, y, *_ in base if y != NONE for g in ngrams(w) if not prose.issuperset(g.split())})
    at = {g: i for i, g in enumerate(grams)}
    x = np.zeros((len(rows), len(grams) + 1), dtype=np.float32)
    x[:, -1] = 1
    for i, (w, *_) in enumerate(rows):
        x[i, [at[g] for g in ngrams(w) if g in at]] = 1
    y = np.eye(len(families), dtype=np.float32)[[families.index(c) for _, c, _, _ in rows]]
    weight = np.array([v for *_, v in rows], dtype=np.float32) / y.sum(0)[y.argmax(1)] ** 0.5
    fold = np.array([f for _, _, f, _ in rows])
    logits = np.zeros_like(y)
    for f in range(FOLDS):
        logits[fold == f] = x[fold == f] @ _regression(x[fold != f], y[fold != f], weight[fold != f])
    grid = np.geomspace(0.3, 4, 27)
    loss = [-(np.log(_soft(logits / t) + 1e-12) * y * weight[:, None]).sum() for t in grid]
    w = _regression(x, y, weight)
    w[:-1][np.abs(w[:-1]) < 1e-3] = 0
    kept = np.flatnonzero(w[:-1].any(1))
    return Model(families, {grams[i]: k for k, i in enumerate(kept)}, np.round(np.vstack((w[kept], w[-1:])).astype(float), 6), float(grid[int(np.argmin(loss))]))


def _either(words: set[str]) -> str:
    """A pattern of any of the words, as a tree of their letters."""
    heads: dict[str, set[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], set()).add(w[1:])
    parts = [c + _either(rest) for c, rest in sorted(heads.items())]
    body = parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"
    return "" if not parts else f"(?:{body})?" if "" in words else body


def covering(features: list[str], rare: set[str]) -> set[str]:
    """Words of which every feature holds one, preferring those not in ``rare``'s complement."""
    out: set[str] = set()
    for g in sorted(features, key=lambda g: len(g.split())):
        own = g.split()
        if not out.intersection(own):
            out.add(max(own, key=lambda w: (w in rare, len(w))))
    return out


def _strings(values: list[str]) -> Column:
    """A constant array, folded once."""
    return F.from_json(F.lit(json.dumps(values)), "array<string>")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _grams(words: Column) -> Column:
    def of(n: int) -> Column:
        return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(of(1), of(2), of(3)))


def _paragraphs(text: Column) -> Column:
    """The paragraphs of a text with the number of each one's first line."""
    words = [tokens(n) for notices in (*NOTICES.values(), *TEXTS.values()) for n in notices]
    pairs = _strings(sorted({f"{a} {b}" for own in words for a, b in zip(own, own[1:], strict=False)}))
    last = lambda line: F.regexp_extract(F.lower(line), r"(?<![a-z0-9])([a-z0-9]++)[^a-z0-9]*+$", 1)
    first = lambda line: F.regexp_extract(F.lower(line), r"^[^a-z0-9]*+([a-z0-9]++)", 1)

    def of(lines: Column) -> Column:
        goes_on = lambda i: (i > 0) & F.array_contains(pairs, F.concat_ws(" ", last(F.get(lines, i - 1)), first(F.get(lines, i))))
        starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: ~goes_on(i))
        return let(starts, lambda at: F.transform(at, lambda i, k: F.struct(i.alias("paragraph"), F.array_join(F.slice(lines, i + 1, F.coalesce(F.get(at, k + 1), F.size(lines)) - i), " ").alias("line"))))

    return let(F.split(text, "\n"), of)


def templates(family: str) -> list[str]:
    """What a prediction is compared with: the family's notices, and its sentences of enough different words."""
    return NOTICES[family] + [t for t in TEXTS[family] if len(set(tokens(t))) >= LEAST_TEMPLATE]


def scan(docs: DataFrame, model: Model | None = None, sure: float = 0.5, alike: float = 0.6) -> DataFrame:
    """doc_id, paragraph, family, probability, similarity, confirmed: a row for each paragraph that is likelier to be about a licence
    than not."""
    model = model or train()
    prose = {w for t in PROSE for w in tokens(t)}
    # Only paragraphs with a feature can have a row, and each feature holds one of these words.
    gate = "(?i)(?<![a-z0-9])" + _either(covering(list(model.features), {w for g in model.features for w in g.split()} - prose)) + "(?![a-z0-9])"
    text = F.col("text").cast("string")
    lines = docs.where(text.rlike(gate)).select(F.col("doc_id").cast("long").alias("doc_id"), F.inline(_paragraphs(text))).where(F.col("line").rlike(gate))
    grams = lines.withColumn("words", _words(F.col("line"))).withColumn("grams", _grams(F.col("words")))
    rows = [[float(x) for x in model.weights[i]] for i in model.features.values()]
    table = F.from_json(F.lit(json.dumps(dict(zip(model.features, rows, strict=True)))), "map<string,array<double>>")
    known = _strings(list(model.features))
    own = grams.withColumn("grams", F.array_intersect("grams", known)).where(F.size("grams") > 0)
    bias = F.from_json(F.lit(json.dumps([float(v) for v in model.weights[-1]])), "array<double>")
    total = F.aggregate("grams", bias, lambda a, g: F.zip_with(a, F.element_at(table, g), lambda u, v: u + v))
    z = own.withColumn("p", softmax(F.transform(total, lambda v: v / model.temperature)))
    z = z.withColumn("best", let(F.col("p"), lambda p: F.struct(F.array_max(p).alias("p"), F.array_position(p, F.array_max(p)).cast("int").alias("at"))))
    z = z.where(F.col("best.at") != model.families.index(NONE) + 1)
    z = z.withColumn("probability", F.col("best.p")).withColumn("family", F.when(F.col("best.p") >= sure, F.element_at(_strings(model.families), F.col("best.at"))).otherwise(UNKNOWN))

    def share(notice: str) -> Column:
        own = sorted(set(tokens(notice)))
        return F.size(F.array_intersect("words", _strings(own))) / F.lit(float(len(own)))

    similarity = F.lit(None).cast("double")
    for family in NOTICES:
        best = F.greatest(*map(share, templates(family)))
        similarity = F.when(F.col("family") == family, best).otherwise(similarity)
    z = z.withColumn("similarity", similarity)
    return z.select("doc_id", "paragraph", "family", F.round("probability", 6).alias("probability"), F.round("similarity", 6).alias("similarity"), F.coalesce(F.col("similarity") >= alike, F.lit(False)).alias("confirmed"))
