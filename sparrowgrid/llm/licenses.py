"""License scans: a trained paragraph classifier over sparse word n-grams. Scoring uses DataFrame functions only.

A paragraph is a line of a text, and also a block of lines up to a blank one, so that a notice is found however it is
wrapped. Every paragraph is scored: a multinomial logistic regression with an L1 penalty over pairs of neighbouring
words names its family or `unknown`; its probabilities are calibrated by a temperature fitted on held-out variants, so
that `unknown` is a class with a meaning. A paragraph without any word pair of the model has the score of the biases,
which is `unknown`; so only pairs of the model need to be looked at, and that leaves nothing out.

A prediction then has to be confirmed by comparing the paragraph with the family's templates: enough of a template's
word pairs must occur in it, and enough of those that no other family's templates have.

The model is fitted on the driver from the templates, variants of them with words dropped or put around, and
counter-examples: ordinary sentences that use the same words, and at most `SAMPLE` lines of the corpus that are not like
a template themselves. It is of fixed size (word pairs of the templates), so its weights may be broadcast.
"""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_ID = -(1 << 63)
SAMPLE = 300  # corpus lines among the counter-examples, at most
LEAST = 0.6  # calibrated probability of a family
FEWEST = 2  # word pairs of a template that must occur, or all it has
CONFIRMED = 0.5  # part of a template's word pairs, and of those that only its family has
UNKNOWN = "unknown"
# Notices that licenses prescribe or that are in common use.
TEMPLATES = {
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "CC-BY-4.0": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "CC0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released under the Creative Commons Zero CC0 1.0 Universal public domain dedication.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "LGPL-3.0": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "rights reserved": ["All rights reserved.", "Copyright (c) The Authors. All rights reserved."],
    "warranty": [
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES",
        "in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY",
    ],
}
# Sentences that use the same words and grant nothing.
COUNTER = (
    "The driver lost his licence after the second offence.",
    "A licence to fish in the lake costs ten pounds a year.",
    "The council refused to grant a license for the new bar.",
    "The apache helicopter landed beside the river at noon.",
    "Gnus and zebras cross the plain in the dry season.",
    "He worked at Mozilla before he moved to the north.",
    "Poetic license is often mistaken for carelessness.",
    "The terms of the lease are set out below.",
    "You may not use this entrance except in an emergency.",
    "Wealth was redistributed by the new government.",
    "The state redistributes income through taxes and benefits.",
    "The version of events in the public record is free of charge.",
    "Licensed premises must close at midnight under the act.",
    "The software is distributed by an agent in the city.",
    "He has reserved all the seats in the front row.",
    "The copyright holders met in the town hall.",
    "The use of this file is described in the manual.",
    "You should have received a copy of the letter along with this form.",
    "Any person who is liable for damages may appeal.",
    "A copy of the software was found in the public domain of the library.",
)
_WORD = re.compile(r"[a-z0-9]+")


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _grams(words: list[str]) -> set[str]:
    return set(map(" ".join, zip(words, words[1:])))


def template_pairs() -> list[tuple[str, str, int, int, int, bool]]:
    """(pair, family, template's number, its pairs, those that only its family has, whether this is one of them)."""
    families: dict[str, set[str]] = {}
    for family, texts in TEMPLATES.items():
        for t in texts:
            for g in _grams(_words(t)):
                families.setdefault(g, set()).add(family)
    out = []
    for family, texts in TEMPLATES.items():
        for n, t in enumerate(texts):
            pairs = sorted(_grams(_words(t)))
            own = [g for g in pairs if families[g] == {family}]
            out += [(g, family, n, len(pairs), len(own), g in own) for g in pairs]
    return out


def likeness(grams: set[str]) -> dict[str, float]:
    """The confirmation of a set of word pairs for each family: of its best template, the lesser of the two parts."""
    best: dict[str, float] = {}
    count: dict[tuple, list] = {}
    for g, family, n, pairs, own, mine in template_pairs():
        c = count.setdefault((family, n), [0, 0, pairs, own])
        c[0] += g in grams
        c[1] += g in grams and mine
    for (family, _), (a, b, pairs, own) in count.items():
        best[family] = max(best.get(family, 0.0), min(a / pairs, b / own if own else 1.0) if a >= min(FEWEST, pairs) else 0.0)
    return best


class Model:
    """Weights of word pairs for each family, biases, and the temperature of the calibration."""

    def __init__(self, corpus: list[str], seed: int = 5, rounds: int = 200, penalty: float = 2e-4):
        rng = random.Random(seed)
        self.classes = [*TEMPLATES, UNKNOWN]
        vocabulary = sorted({g for ts in TEMPLATES.values() for t in ts for g in _grams(_words(t))})
        self.column = {g: i for i, g in enumerate(vocabulary)}
        corpus = [c for c in corpus if max(likeness(_grams(_words(c))).values()) < CONFIRMED]
        filler = [w for c in [*COUNTER, *corpus] for w in _words(c)]
        rows: list[tuple[list[str], int]] = []
        for k, name in enumerate(TEMPLATES):
            for t in TEMPLATES[name]:
                words = _words(t)
                for i in range(12):
                    kept = [w for w in words if rng.random() > 0.06]
                    around = rng.randrange(4) if i else 40  # once within a longer block
                    rows.append(([*rng.choices(filler, k=around), *kept, *rng.choices(filler, k=around)], k))
        other = len(TEMPLATES)
        for c in [*COUNTER, *corpus]:
            rows.append((_words(c), other))
            rows.append((_words(c)[rng.randrange(3) :], other))
        single = sorted({w for g in vocabulary for w in g.split(" ")})
        for n in range(300):  # the words of templates in no order, and single pairs of them
            rows.append((rng.choices(single, k=rng.randrange(3, 15)) if n % 3 else rng.choice(vocabulary).split(" "), other))
        rng.shuffle(rows)
        x, y = np.array([self.row(_grams(w)) for w, _ in rows], np.float32), np.array([k for _, k in rows])
        held = np.arange(len(rows)) % 4 == 0
        self.weights, self.bias = self._fit(x[~held], y[~held], rounds, penalty)
        logits = x[held] @ self.weights + self.bias
        # temperature with the least loss on the held-out part
        self.temperature = float(min(np.linspace(0.3, 3, 28), key=lambda t: -np.log(np.maximum(1e-12, self._softmax(logits / t)[np.arange(held.sum()), y[held]])).mean()))
        self.held_out = float((logits.argmax(axis=1) == y[held]).mean())

    def row(self, grams: set[str]) -> np.ndarray:
        out = np.zeros(len(self.column))
        out[[self.column[g] for g in grams if g in self.column]] = 1
        return out

    def named(self, text: str) -> tuple[str, float, float]:
        """Family, its probability and its confirmation, for one paragraph."""
        grams = _grams(_words(text))
        p = self._softmax(((self.row(grams) @ self.weights + self.bias) / self.temperature)[None])[0]
        k = int(p.argmax())
        family = self.classes[k] if p[k] >= LEAST else UNKNOWN
        return family, float(p[k]), likeness(grams).get(family, 0.0)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def _fit(self, x: np.ndarray, y: np.ndarray, rounds: int, penalty: float) -> tuple[np.ndarray, np.ndarray]:
        """Accelerated proximal gradient: a step on the likelihood, then the weights shrink towards 0."""
        target = np.eye(len(self.classes), dtype=np.float32)[y]
        w, b = np.zeros((x.shape[1], len(self.classes))), np.zeros(len(self.classes))
        at_w, at_b, t, rate = w, b, 1.0, 1.0
        for _ in range(rounds):
            d = (self._softmax(x @ at_w.astype(np.float32) + at_b.astype(np.float32)) - target) / len(x)
            step = at_w - rate * (x.T @ d)
            new_w, new_b = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0), at_b - rate * d.sum(axis=0)
            after = (1 + (1 + 4 * t * t) ** 0.5) / 2
            at_w, at_b = new_w + (t - 1) / after * (new_w - w), new_b + (t - 1) / after * (new_b - b)
            w, b, t = new_w, new_b, after
        return w.astype(float), b.astype(float)


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """The model; its counter-examples from the corpus are the lines with the least hash."""
    lines = docs.filter("text IS NOT NULL").select(F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''")
    few = lines.select("line", F.xxhash64("line").alias("h")).orderBy("h", "line").limit(sample)
    return Model(sorted(r["line"] for r in few.select("line").collect()))


def _units(docs: DataFrame) -> DataFrame:
    """id, th (a document's key), kind (0 line, 1 block of several lines), no, words."""
    d = docs.filter("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64("text").alias("th"), "text")
    unit = lambda kind: lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("no"), x.alias("x"))
    blocks = F.filter(F.transform(F.split("text", r"\n[ \t\r]*\n"), unit(1)), lambda u: F.instr(u["x"], "\n") > 0)
    both = F.concat(F.transform(F.split("text", "\n"), unit(0)), blocks)
    d = d.select("id", "th", F.explode(both).alias("u")).select("id", "th", "u.kind", "u.no", F.split(F.lower("u.x"), "[^a-z0-9]+").alias("words"))
    return d


def paragraphs(docs: DataFrame, model: Model) -> DataFrame:
    """id, th (a document's key), kind (0 line, 1 block), no, family, probability, likeness, confirmed: a row for each
    paragraph that has a word pair of the model. All others are unknown, by the biases alone.

    family is the class with the highest calibrated probability; below LEAST it is unknown."""
    spark = docs.sparkSession
    known = list(model.column)
    key = ["id", "th", "kind", "no"]
    pairs = _units(docs).select(*key, "words", F.posexplode("words").alias("at", "w"))
    pairs = pairs.filter(F.col("w").isin(sorted({g.split(" ")[0] for g in known}))).select(*key, F.concat_ws(" ", "w", F.get("words", F.col("at") + 1)).alias("g"))
    grams = pairs.filter(F.col("g").isin(known)).distinct()
    weights = spark.createDataFrame([(g, model.weights[i].tolist()) for g, i in model.column.items()], "g string, v array<double>")
    templates = spark.createDataFrame(template_pairs(), "g string, family string, t int, pairs int, own int, mine boolean")
    k = len(model.classes)
    scored = grams.join(F.broadcast(weights), "g").groupBy(*key).agg(*[F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(k)])
    z = F.array(*[(F.col(f"s{i}") + float(model.bias[i])) / model.temperature for i in range(k)])
    scored = scored.select(*key, z.alias("z")).select(*key, "z", F.array_max("z").alias("top"))
    p = 1 / F.aggregate("z", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))  # of the highest
    scored = scored.select(*key, p.alias("probability"), F.element_at(F.array(*map(F.lit, model.classes)), F.array_position("z", F.col("top")).cast("int")).alias("family"))
    scored = scored.withColumn("family", F.when(F.col("probability") >= LEAST, F.col("family")).otherwise(UNKNOWN))
    like = grams.join(F.broadcast(templates), "g").groupBy(*key, "family", "t").agg(F.count("*").alias("n"), F.first("pairs").alias("pairs"), (F.count_if("mine") / F.nullif(F.first("own"), F.lit(0))).alias("own"))
    like = like.groupBy(*key, "family").agg(F.max(F.when(F.col("n") >= F.least(F.lit(FEWEST), "pairs"), F.least(F.col("n") / F.col("pairs"), F.coalesce("own", F.lit(1.0)))).otherwise(0.0)).alias("likeness"))
    out = scored.join(like, [*key, "family"], "left").withColumn("likeness", F.coalesce("likeness", F.lit(0.0)))
    return out.withColumn("confirmed", (F.col("family") != UNKNOWN) & (F.col("likeness") >= CONFIRMED))


def _zero(c: str) -> Column:
    return F.coalesce(c, F.lit(0).cast("long")).alias(c)


def scan(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text -> doc_id, n_lines, n_confirmed, families (sorted, comma-separated), n_unconfirmed, probability (the
    highest of a confirmed paragraph, null without one); a row for each row of docs.

    n_lines are the lines that were scored, n_confirmed the confirmed lines, and blocks whose family none of their
    document's lines is confirmed for; n_unconfirmed the lines whose family the templates do not confirm. Null texts
    have no lines, an empty one has one. Rows that agree in doc_id and text are one document and get the same result; a
    null doc_id is one like any other. An empty table gives none; other columns are not read."""
    p = paragraphs(docs, train(docs, sample)).filter(F.col("family") != UNKNOWN)
    per = p.groupBy("id", "th", "family").agg(
        F.count_if(F.col("confirmed") & (F.col("kind") == 0)).alias("lines"), F.count_if(F.col("confirmed") & (F.col("kind") == 1)).alias("blocks"),
        F.count_if(~F.col("confirmed") & (F.col("kind") == 0)).alias("n_unconfirmed"), F.max(F.when(F.col("confirmed"), F.col("probability"))).alias("probability"),
    )
    n = F.when(F.col("lines") > 0, F.col("lines")).otherwise(F.col("blocks"))
    per = per.groupBy("id", "th").agg(
        F.sum(n).alias("n_confirmed"), F.array_join(F.array_sort(F.collect_set(F.when(n > 0, F.col("family")))), ",").alias("families"), F.sum("n_unconfirmed").alias("n_unconfirmed"), F.max("probability").alias("probability")
    )
    d = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64("text").alias("th"),
        F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"),
    )
    return d.join(per, ["id", "th"], "left").select("doc_id", "n_lines", _zero("n_confirmed"), F.coalesce("families", F.lit("")).alias("families"), _zero("n_unconfirmed"), "probability")


def op9_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
