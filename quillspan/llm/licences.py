"""Licence scan by a trained paragraph classifier.

A multinomial logistic regression over sparse word one- and two-grams is trained on variants of short notices of each
family and on a bounded sample of the corpus's own paragraphs as the unknown class. A temperature fitted on held-back
examples calibrates its probabilities. Every paragraph (line) of every document is scored; those not unknown are
compared with their family's notices, which confirms the prediction or not.

Defined cases: null and empty texts have no paragraphs; an empty corpus trains on the notices alone; repeated rows
give their findings each; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import least_hashed, load
from quillspan.plans.registry import Builder

#: Notices by family, in the wording that files carry.
NOTICES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 license.", "Apache License Version 2.0, January 2004.",
        "SPDX-License-Identifier: Apache-2.0"),
    "mit": (
        "Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT"),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "GNU General Public License, version 3.", "Released under the GPL, version 2 or later.", "Licensed under the GNU GPL v3.", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.", "GNU Lesser General Public License, version 3.", "Licensed under the LGPL v3.",
        "SPDX-License-Identifier: LGPL-2.1-only"),
    "bsd": (
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Released under the 3-Clause BSD License.", "Licensed under the BSD License.", "SPDX-License-Identifier: BSD-3-Clause"),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "cc-by": (
        "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Available under the Creative Commons Attribution license."),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License."),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Available for non-commercial use under Creative Commons CC BY-NC."),
    "public-domain": (
        "This work has been dedicated to the public domain under CC0 1.0.", "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright to this work (CC0)."),
    "proprietary": (
        "All rights reserved.", "Copyright holder. All rights reserved. No part of this publication may be reproduced without permission.",
        "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."),
}
UNKNOWN = "unknown"
#: Bound on the corpus paragraphs that train the unknown class.
NEGATIVES = 4_000
VARIANTS = 60
MIN_PROBABILITY = 0.5
CONFIRMED = 0.5
SEED = 11
_TOKEN = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)*")


def tokens(paragraph: str) -> list[str]:
    return _TOKEN.findall(paragraph.lower())


def grams(words: list[str]) -> list[str]:
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


@dataclass
class Classifier:
    """Weights by term; ``vocabulary`` holds terms of the notices only, whatever else a paragraph has is scaled in by length."""

    families: list[str]
    vocabulary: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    notices: dict[str, list[tuple[set, int]]]

    def features(self, words: list[str]) -> dict[int, float]:
        """Term weights of a paragraph: counts over the square root of its length; the last is the share outside."""
        get, out = self.vocabulary.get, {}
        known = [w if w in self.vocabulary else None for w in words]
        scale = 1.0 / np.sqrt(max(1, len(words)))
        for w in known:
            if w is not None:
                out[get(w)] = out.get(get(w), 0.0) + scale
        for a, b in zip(known, known[1:]):
            if a is not None and b is not None and (at := get(f"{a} {b}")) is not None:
                out[at] = out.get(at, 0.0) + scale
        out[len(self.vocabulary)] = sum(w is None for w in known) * scale
        return out

    def probabilities(self, feats: dict[int, float]) -> np.ndarray:
        z = self.bias + np.array(list(feats.values())) @ self.weights[list(feats)]
        z = z / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def confirm(self, family: str, words: list[str]) -> float:
        """The largest share of a notice's word pairs that stand in the paragraph."""
        have = set(zip(words, words[1:]))
        return max((len(pairs & have) / n for pairs, n in self.notices[family]), default=0.0)

    def predict(self, paragraph: str) -> tuple[str, float, float] | None:
        words = tokens(paragraph)
        if not words:
            return None
        p = self.probabilities(self.features(words))
        best = int(p.argmax())
        if self.families[best] == UNKNOWN or p[best] < MIN_PROBABILITY:
            return None
        return self.families[best], float(p[best]), self.confirm(self.families[best], words)


def variants(rng: np.random.Generator, filler: list[list[str]]) -> list[tuple[str, list[str]]]:
    """Notices as they stand, with words lost, and inside corpus text."""
    out = []
    for family, texts in NOTICES.items():
        for text in texts:
            words = tokens(text)
            out.append((family, words))
            for _ in range(VARIANTS // len(texts) + 1):
                kept = [w for w in words if rng.random() > 0.08] or words
                if filler and rng.random() < 0.5:
                    other = filler[int(rng.integers(len(filler)))][: int(rng.integers(1, 30))]
                    kept = other + kept if rng.random() < 0.5 else kept + other
                out.append((family, kept))
    return out


def train(negatives: list[str], rounds: int = 300, l2: float = 1e-4) -> Classifier:
    """Full-batch gradient descent with momentum on the bounded examples; a fifth is held back for calibration."""
    rng = np.random.default_rng(SEED)
    own = {pair for texts in NOTICES.values() for t in texts for pair in zip(tokens(t), tokens(t)[1:])}
    plain = []
    for text in negatives:
        words = tokens(text)
        # A sampled paragraph that holds a notice is no example of the unknown class.
        if words and sum(pair in own for pair in zip(words, words[1:])) < 3:
            plain.append(words)
    examples = variants(rng, plain) + [(UNKNOWN, w) for w in plain]
    families = [*NOTICES, UNKNOWN]
    terms = sorted({g for texts in NOTICES.values() for t in texts for g in grams(tokens(t))})
    model = Classifier(families, {t: n for n, t in enumerate(terms)}, np.zeros((len(terms) + 1, len(families))),
                       np.zeros(len(families)), 1.0, {f: [(set(zip(tokens(t), tokens(t)[1:])), max(1, len(set(zip(tokens(t), tokens(t)[1:])))))
                                                          for t in texts] for f, texts in NOTICES.items()})
    x = np.zeros((len(examples), len(terms) + 1), np.float32)
    for row, (_, words) in enumerate(examples):
        for at, value in model.features(words).items():
            x[row, at] = value
    y = np.array([families.index(f) for f, _ in examples])
    share = Counter(y.tolist())
    weight = np.array([len(y) / (len(share) * share[c]) for c in y.tolist()], np.float32)
    held = rng.random(len(y)) < 0.2
    learn = ~held
    target = np.eye(len(families), dtype=np.float32)[y]
    step_w, step_b = np.zeros_like(model.weights), np.zeros_like(model.bias)
    for _ in range(rounds):
        z = x[learn] @ model.weights + model.bias
        e = np.exp(z - z.max(axis=1, keepdims=True))
        gap = (e / e.sum(axis=1, keepdims=True) - target[learn]) * weight[learn][:, None] / weight[learn].sum()
        step_w = 0.9 * step_w - 4.0 * (x[learn].T @ gap + l2 * model.weights)
        step_b = 0.9 * step_b - 4.0 * gap.sum(axis=0)
        model.weights, model.bias = model.weights + step_w, model.bias + step_b
    if held.any():
        z = x[held] @ model.weights + model.bias

        def loss(t: float) -> float:
            s = z / t
            s = s - s.max(axis=1, keepdims=True)
            log_p = s - np.log(np.exp(s).sum(axis=1, keepdims=True))
            return float(-(log_p[np.arange(len(s)), y[held]] * weight[held]).mean())

        model.temperature = float(min(np.geomspace(0.25, 4.0, 33), key=loss))
    return model


def fit(docs: DataFrame, text_col: str = "text", negatives: int = NEGATIVES) -> Classifier:
    """Train with the (at most) ``negatives`` corpus paragraphs of least hash."""
    parts = docs.select(F.explode(F.split(text_col, "\n")).alias("line")).where(F.trim("line") != "")
    drawn = least_hashed(parts, F.xxhash64("line"), negatives, parts.count())
    return train([r["line"] for r in drawn.collect()])


def scan(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, paragraph, family, probability, notice_share, confirmed) of every paragraph that is not unknown."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value
        for batch in batches:
            at, no, family, probability, share = [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                for number, line in enumerate((text or "").split("\n")):
                    found = judge.predict(line)
                    if found:
                        for column, value in zip((at, no, family, probability, share), (row, number, *found)):
                            column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(no, pa.int32()), pa.array(family, pa.string()),
                 pa.array(probability, pa.float64()), pa.array(share, pa.float64()),
                 pa.array([s >= CONFIRMED for s in share], pa.bool_())],
                ["id", "paragraph", "family", "probability", "notice_share", "confirmed"])

    return docs.select(id_col, text_col).mapInArrow(
        kernel, f"id {kind}, paragraph int, family string, probability double, notice_share double, confirmed boolean")


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph of every document that carries a licence, with its family and evidence."""
    docs = load(spark, sf_dir, "documents")
    return scan(docs, fit(docs)).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Builder] = {"op10_licence_scan": op10_licence_scan}
SQL: dict[str, str] = {}
