"""Licence scan: a trained paragraph classifier, confirmed by template comparison.

A paragraph is a line. Sparse one- and two-word features of the lines that mention
licensing go through a multinomial logistic regression, trained on the notices
below and on paragraphs of class "unknown". A family counts when its probability
reaches a threshold calibrated on folds left out of training, and when the line
shares enough three-word runs with a notice of that family; any other line that
mentions licensing is unknown.

Training takes the fixed notices only. Scanning is made of column expressions: no
Python on the data, no shuffle, one pass; lines without a cue word (every notice
has one) are passed over by a single pattern.

Defined results. Null and empty texts have no paragraphs: families "", counts 0.
Rows that repeat get equal results. Long texts are read whole. Extra columns are
ignored.
"""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Share of a line's three-word runs, or of a notice's, that they must have in common.
CONFIRMED = 0.6
FOLDS = 3
TOKEN = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
#: A line without any of these mentions no licence.
CUES = r"(?i)licen[sc]|copyright|rights reserved|permission is|redistribut|public domain|spdx"

# Licence notices by family, and paragraphs that only resemble them.
NOTICES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc": (
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright by the author. All rights reserved.",
        "No part of this publication may be reproduced without the prior written permission of the copyright holder; all rights reserved.",
    ),
    UNKNOWN: (
        "Bring your driver's license to the counter.",
        "The licence fee was raised by the council last year.",
        "He was accused of copyright infringement by the studio.",
        "Students need permission is what the teacher said.",
        "The license plate was found near the river.",
        "Please read the license agreement before you install the program.",
        "They redistributed the land among the villages.",
        "A fishing licence costs ten pounds a season.",
        "The old songs are in the public domain.",
        "Her medical license was suspended after the hearing.",
        "Water rights reserved for the farmers are disputed.",
    ),
}


def _grams(line: str) -> set[str]:
    words = re.findall(TOKEN, line.lower())
    return {*words, *map(" ".join, zip(words, words[1:]))}


class Model:
    """Weights of each n-gram for each family, biases and the calibrated threshold."""

    def __init__(self, notices: dict[str, tuple[str, ...]] = NOTICES):
        self.families = sorted(notices)
        rows = [(f, line) for f, lines in notices.items() for line in lines]
        self.vocabulary = sorted({g for _, line in rows for g in _grams(line)})
        place = {g: i for i, g in enumerate(self.vocabulary)}
        x = np.zeros((len(rows), len(self.vocabulary) + 1))
        x[:, -1] = 1
        for i, (_, line) in enumerate(rows):
            x[i, [place[g] for g in _grams(line)]] = 1
        y = np.array([self.families.index(f) for f, _ in rows])
        self.weights = self._fit(x, y)
        unknown = self.families.index(UNKNOWN)
        fold = np.arange(len(rows)) % FOLDS
        wrong = []
        for i in range(FOLDS):
            p = self._probabilities(x[fold == i], self._fit(x[fold != i], y[fold != i]))
            p[:, unknown] = 0
            wrong += p.max(axis=1)[(y[fold == i] == unknown)].tolist()
        # above what left-out unknown paragraphs reach, below certainty
        self.threshold = float(min(0.9, max(0.5, 1.05 * max(wrong, default=0))))

    @staticmethod
    def _probabilities(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
        z = x @ weights
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def _fit(self, x: np.ndarray, y: np.ndarray, steps: int = 400) -> np.ndarray:
        """Softmax regression by gradient descent with a light pull to zero."""
        target = np.eye(len(self.families))[y]
        weights = np.zeros((x.shape[1], len(self.families)))
        for _ in range(steps):
            slope = x.T @ (target - self._probabilities(x, weights)) / len(x) - 1e-3 * weights
            weights += 2.0 * slope
        return weights


def _doubles(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _runs(words: Column, n: int) -> Column:
    """Distinct runs of n words; a shorter line is one run."""
    last = F.greatest(F.size(words) - (n - 1), F.lit(1))
    return F.array_distinct(
        F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, n), " "))
    )


def _once(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def family_of(line: Column, model: Model, notices: dict[str, tuple[str, ...]] = NOTICES) -> Column:
    """Licence family of a paragraph, or "unknown"."""
    table = {g: model.weights[i].round(6).tolist() for i, g in enumerate(model.vocabulary)}
    weights = F.from_json(F.lit(json.dumps(table)), "map<string,array<double>>")
    templates = {
        f: [sorted(set(_text_runs(line, 3))) for line in lines] for f, lines in notices.items() if f != UNKNOWN
    }
    known = F.from_json(F.lit(json.dumps(templates)), "map<string,array<array<string>>>")

    def decide(words: Column) -> Column:
        pairs = F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))),
            lambda i: F.array_join(F.slice(words, i, 2), " "),
        )
        grams = F.array_distinct(F.concat(words, pairs))
        total = F.aggregate(
            grams,
            _doubles(model.weights[-1].round(6)),
            lambda sums, g: F.zip_with(
                sums, F.coalesce(F.try_element_at(weights, g), _doubles([0.0] * len(model.families))), lambda a, b: a + b
            ),
        )
        return _once(total, lambda z: confirm(words, z))

    def confirm(words: Column, z: Column) -> Column:
        top = F.array_max(z)
        mass = F.aggregate(z, F.lit(0.0), lambda s, v: s + F.exp(v - top))
        names = F.array(*[F.lit(f) for f in model.families])
        best = F.element_at(names, F.array_position(z, top).cast("int"))

        def close(own: Column) -> Column:
            def alike(template: Column) -> Column:
                common = F.size(F.array_intersect(own, template))
                return (common >= CONFIRMED * F.size(own)) | (common >= CONFIRMED * F.size(template))

            return F.exists(F.coalesce(F.try_element_at(known, best), F.array().cast("array<array<string>>")), alike)

        sure = (1.0 / mass >= model.threshold) & _once(_runs(words, 3), close)
        return F.when(sure, best).otherwise(F.lit(UNKNOWN))

    words = F.regexp_extract_all(F.lower(line), F.lit(TOKEN), F.lit(0))
    return _once(words, decide)


def _text_runs(line: str, n: int) -> list[str]:
    words = re.findall(TOKEN, line.lower())
    return [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, families (sorted, comma-separated), n_paragraphs and n_unknown of each row."""
    model = model or Model()
    text = F.coalesce("text", F.lit(""))
    mentions = F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(CUES)))
    lines = F.when(F.rlike(text, F.lit(CUES)), mentions).otherwise(F.array().cast("array<string>"))
    found = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.transform(lines, lambda line: family_of(line, model)).alias("_found")
    )
    sure = F.filter("_found", lambda f: f != UNKNOWN)
    return found.select(
        "doc_id",
        F.array_join(F.array_sort(F.array_distinct(sure)), ",").alias("families"),
        F.size(sure).cast("long").alias("n_paragraphs"),
        (F.size("_found") - F.size(sure)).cast("long").alias("n_unknown"),
    )
