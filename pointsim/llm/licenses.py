"""License scans: a trained paragraph classifier, confirmed by templates; scoring in DataFrame operations only.

A paragraph is a line of a text, or a run of neighbouring lines with words, joined, of which all but the last have fewer
than ``most_words`` words. A line that is found counts by itself; of the other runs found, the shortest and then the first
come first, and none that overlaps one before is taken. A run goes by the number of its first line. Its features are its words and pairs of neighbouring words, each counted once. A
multinomial logistic regression with an L1 penalty, fitted on the driver from the templates below and on paragraphs of a
bounded sample of documents, gives a family or ``unknown``; a temperature, fitted on rows held out, calibrates
its probabilities. Predictions below ``threshold`` are unknown; notices of other families are examples of unknown too. A
prediction is confirmed if the pairs of one of its family's templates that are in the paragraph make up ``least_pairs`` of
the template, pairs weighed by how few families have them, and one of them is in no other family. Paragraphs without any gate
word are not scored: of each template, the pairs without a gate word weigh too little to confirm it, so that this hides nothing.

Defined results: a null or empty text has no paragraphs; repeated rows are scanned alike, each on its own; without
documents to sample the written negatives alone are the unknown class; of equally probable families the first by name counts; texts of
any length are scanned whole; an empty table gives no rows. Extra columns are never read. The sample of the fit has at most
``max_docs`` documents and ``max_paragraphs`` paragraphs of at most ``max_chars`` characters, longer ones left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = "[a-z0-9]+"

# fixed values: usual wordings of licence notices, by family
TEMPLATES = {
    "agpl": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "apache": [
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "bsd": [
        "SPDX-License-Identifier: BSD-3-Clause",
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ],
    "cc-by": [
        "SPDX-License-Identifier: CC-BY-4.0",
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-nc": [
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-sa": [
        "SPDX-License-Identifier: CC-BY-SA-4.0",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc0": [
        "SPDX-License-Identifier: CC0-1.0",
        "Released under the CC0 1.0 Universal Public Domain Dedication license.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "gpl": [
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GPL, version 2 or later.",
    ],
    "lgpl": [
        "SPDX-License-Identifier: LGPL-2.1-only",
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ],
    "mit": [
        "SPDX-License-Identifier: MIT",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ],
    "mpl": [
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
}
# fixed values: notices of families that are not told apart, and count as unknown
OTHERS = {
    "artistic": ["Released under the Artistic License 2.0.", "SPDX-License-Identifier: Artistic-2.0"],
    "boost": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"],
    "cc-by-nc-nd": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "cc-by-nc-sa": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "eupl": ["Licensed under the European Union Public Licence, version 1.2.", "SPDX-License-Identifier: EUPL-1.2"],
    "proprietary": ["This software is licensed under the terms of a commercial license agreement.", "Released under a proprietary license; redistribution is not permitted."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
    "zlib": ["Released under the zlib License.", "This software is provided as-is, without any express or implied warranty. SPDX-License-Identifier: Zlib"],
}
# fixed values: paragraphs about other things that share words with the templates
NEGATIVES = [
    "He renewed his driving license last week and paid the fee.",
    "A fishing license is sold at the shop near the lake.",
    "The license of the restaurant was revoked by the city.",
    "The software asks for a license key when it starts.",
    "She is a licensed nurse and works at the public hospital.",
    "All rights reserved. No part of this book may be copied without permission.",
    "Copyright of the photographs lies with the museum.",
    "MIT researchers released the results of their work under some pressure.",
    "The Apache helicopter was seen by the public on the ground.",
    "Permission to enter the building is granted by the guard.",
    "Redistribution of income is a matter of the general election.",
    "This program is shown on television at eight, version after version.",
    "The library is free and open to the public.",
    "Terms of use and conditions of sale may change without notice.",
]


@dataclass(frozen=True)
class Rules:
    threshold: float = 0.6
    least_pairs: float = 0.5  # share of a template's pairs, by weight, that confirms
    most_words: int = 100  # of joined lines without the last; the longest template has 42
    max_docs: int = 300  # documents whose paragraphs are sampled as unknown
    max_paragraphs: int = 5000
    max_chars: int = 20_000  # of a sampled paragraph
    copies: int = 24  # changed copies of each template
    rounds: int = 300
    penalty: float = 2e-4
    seed: int = 3


@dataclass
class Model:
    families: list[str]  # unknown first
    weights: dict[str, list[float]]
    bias: list[float]
    temperature: float
    gates: list[str]
    pairs: dict[str, list[list[str]]] = field(default_factory=dict)
    least_pairs: float = 1.0  # what the gates are safe for
    weight: dict[str, float] = field(default_factory=dict)  # of each pair: how few families have it
    own: dict[str, list[str]] = field(default_factory=dict)  # pairs that no other family has

    def gate(self, rules: Rules) -> str:
        """A pattern that every paragraph in lower case has which these rules could confirm."""
        if "" in self.gates or rules.least_pairs < self.least_pairs:
            return ""
        return f"(?<![a-z0-9])(?:{'|'.join(self.gates)})(?![a-z0-9])"


def words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def grams(own: list[str]) -> list[str]:
    return list(dict.fromkeys([*own, *(f"{a} {b}" for a, b in zip(own, own[1:], strict=False))]))


# ---------------------------------------------------------------- fit
def _examples(negatives: list[list[str]], templates: dict[str, list[str]], rules: Rules) -> list[tuple[list[str], str]]:
    """Templates with words dropped, cut short, or with other words around them."""
    draw = np.random.Generator(np.random.PCG64(rules.seed))
    pool = [w for n in negatives for w in n] or ["word"]
    out = []
    for family, texts in templates.items():
        for text in texts:
            own = words(text)
            out.append((own, family))
            for _ in range(rules.copies):
                kept = [w for w in own if draw.random() > 0.04]
                if len(kept) > 12 and draw.random() < 0.5:
                    cut = int(draw.integers(10, len(kept)))
                    kept = kept[:cut] if draw.random() < 0.5 else kept[-cut:]
                around = [[pool[int(i)] for i in draw.integers(0, len(pool), int(draw.integers(0, 12)))] for _ in range(2)]
                out.append((around[0] + kept + around[1], family))
    return out


def _pair_weights() -> tuple[dict[str, list[list[str]]], dict[str, float], dict[str, list[str]]]:
    """Pairs of each family's templates, the weight of each pair, and each family's pairs that no other family has."""
    pairs_of = lambda texts: [list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))) for w in map(words, texts)]
    pairs = {f: pairs_of(texts) for f, texts in TEMPLATES.items()}
    every = pairs | {f"other {f}": pairs_of(texts) for f, texts in OTHERS.items()}
    count = Counter(p for texts in every.values() for p in {p for t in texts for p in t})
    weight = {p: round(math.log(len(every) / n) + 0.1, 6) for p, n in count.items()}
    return pairs, weight, {f: sorted({p for t in texts for p in t if count[p] == 1}) for f, texts in pairs.items()}


def _gates(templates: list[list[str]], weight: dict[str, float], negatives: list[list[str]], least: float) -> list[str]:
    """Words, rare in the sampled paragraphs, such that less than the share ``least`` of each template's weight is in pairs without any of them."""
    common = Counter(w for n in negatives for w in set(n))
    left, gates = [list(t) for t in templates], []
    total = lambda own: sum(weight[p] for p in own)
    while True:
        still = [own for own, t in zip(left, templates, strict=True) if total(own) >= least * total(t) * (1 - 1e-9)]
        if not still:
            return gates
        gain = Counter()
        for own in still:
            for pair in own:
                for w in set(pair.split(" ")):
                    gain[w] += weight[pair]
        if not gain:
            return [""]
        gates.append(max(sorted(gain), key=lambda w: gain[w] / (1 + common[w])))
        left = [[pair for pair in own if gates[-1] not in pair.split(" ")] for own in left]


def train(sample: list[str], rules: Rules = Rules()) -> Model:
    """sample: paragraphs of documents, without licences as far as the words license and copyright tell."""
    other = [words(p) for p in sample if not re.search(r"licen[cs]|copyright", p.lower())][: rules.max_paragraphs]
    hard = [words(p) for p in NEGATIVES]
    examples = _examples(hard + other, TEMPLATES, rules) + [(w, "unknown") for w, _ in _examples(hard + other, OTHERS, rules)] + [(w, "unknown") for w in other if w] + [(w, "unknown") for w in hard for _ in range(rules.copies)]
    families = ["unknown", *TEMPLATES]
    vocabulary = sorted({g for texts in [*TEMPLATES.values(), *OTHERS.values()] for t in texts for g in grams(words(t))})
    number = {g: k for k, g in enumerate(vocabulary)}
    x = np.zeros((len(examples), len(vocabulary)), np.float32)
    for k, (own, _) in enumerate(examples):
        x[k, [number[g] for g in grams(own) if g in number]] = 1
    y = np.array([families.index(f) for _, f in examples])
    onehot = np.eye(len(families), dtype=np.float32)[y]
    share = 1 / np.bincount(y, minlength=len(families))[y]
    held = np.arange(len(y)) % 5 == 4
    weight = (np.where(held, 0, share) / share[~held].sum())[:, None]
    w, b = np.zeros((len(vocabulary), len(families))), np.zeros(len(families))

    def soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    step = 4.0
    for _ in range(rules.rounds):  # proximal gradient
        error = (soft(x @ w + b) - onehot) * weight
        w -= step * (x.T @ error)
        b -= step * error.sum(0)
        w = np.sign(w) * np.maximum(np.abs(w) - step * rules.penalty, 0)
    z = x[held] @ w + b
    grid = np.geomspace(0.1, 10, 41)
    fit = [-np.log(np.maximum(soft(z / t)[np.arange(len(z)), y[held]], 1e-12)).mean() + 1e-3 * abs(np.log(t)) for t in grid]
    used = {g: [round(float(v), 6) for v in w[k]] for g, k in number.items() if w[k].any()}
    pairs, weighed, own = _pair_weights()
    gates = _gates([t for v in pairs.values() for t in v], weighed, other, rules.least_pairs)
    return Model(families, used, [round(float(v), 6) for v in b], float(grid[int(np.argmin(fit))]), gates, pairs, rules.least_pairs, weighed, own)


def fit(docs: DataFrame, rules: Rules = Rules()) -> Model:
    """Fit on the paragraphs of at most max_docs documents, which a hash of doc_id picks."""
    ids = docs.where("doc_id is not null").select(F.col("doc_id").alias("__id")).orderBy(F.xxhash64("__id"), "__id").limit(rules.max_docs).distinct()
    # at most max_docs ids: a bounded broadcast
    rows = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("__id")).select(F.explode(F.split("text", "\n", -1)).alias("p")).where(F.length("p").between(1, rules.max_chars))
    return train([r.p for r in rows.orderBy(F.xxhash64("p"), "p").limit(rules.max_paragraphs).collect()], rules)


# ---------------------------------------------------------------- score
def _array(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def score(paragraph: Column, model: Model, rules: Rules) -> Column:
    """family, probability and share of a template's pairs of one paragraph."""
    weights = F.map_from_arrays(F.array(*map(F.lit, model.weights)), F.array(*(_array(v) for v in model.weights.values())))
    own = F.regexp_extract_all(F.lower(paragraph), F.lit(f"({WORD})"), F.lit(1))
    pairs = F.array_distinct(F.zip_with(F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0))), F.slice(own, 2, F.greatest(F.size(own) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))
    known = F.filter(F.concat(F.array_distinct(own), pairs), lambda g: F.map_contains_key(weights, g))
    total = F.aggregate(known, _array(model.bias), lambda acc, g: F.zip_with(acc, F.element_at(weights, g), lambda a, b: a + b))
    total = F.transform(total, lambda z: z / F.lit(model.temperature))
    names = F.array(*map(F.lit, model.families))

    def decided(z: Column) -> Column:
        top = F.array_max(z)
        p = F.lit(1.0) / F.aggregate(z, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
        return F.struct(F.when(p >= rules.threshold, F.element_at(names, F.array_position(z, top).cast("int"))).otherwise("unknown").alias("family"), p.alias("probability"))

    def confirmed(d: Column) -> Column:
        kinds = F.map_from_arrays(F.array(*map(F.lit, model.pairs)), F.array(*(F.array(*(F.array(*map(F.lit, t)) for t in texts)) for texts in model.pairs.values())))
        mine = F.map_from_arrays(F.array(*map(F.lit, model.own)), F.array(*(F.array(*map(F.lit, own)) for own in model.own.values())))
        used = sorted({p for texts in model.pairs.values() for t in texts for p in t})
        weight = F.map_from_arrays(F.array(*map(F.lit, used)), _array([model.weight[p] for p in used]))
        total = lambda own: F.aggregate(own, F.lit(0.0), lambda acc, p: acc + F.element_at(weight, p))
        shares = F.transform(F.coalesce(F.element_at(kinds, d["family"]), F.array().cast("array<array<string>>")), lambda t: total(F.array_intersect(t, pairs)) / total(t))
        told = F.arrays_overlap(F.element_at(mine, d["family"]), pairs)
        share = F.when(told, F.coalesce(F.array_max(shares), F.lit(0.0))).otherwise(0.0)
        return F.struct(d["family"].alias("family"), d["probability"].alias("probability"), share.alias("share"))

    once = F.transform(F.array(total), decided)
    return F.element_at(F.transform(once, confirmed), 1)


def _pairs(paragraph: Column) -> Column:
    own = F.regexp_extract_all(F.lower(paragraph), F.lit(f"({WORD})"), F.lit(1))
    return F.zip_with(F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0))), F.slice(own, 2, F.greatest(F.size(own) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))


def _runs(rules: Rules) -> Column:
    """(n, first) of the runs of n > 1 lines, from 1, that may hold a notice: with a gate word, and no line that is found or has no words."""
    lines = F.size("__lines")

    def fits(first: Column, n: Column) -> Column:
        own = F.slice("__words", first, n)
        short = F.aggregate(F.slice("__words", first, n - 1), F.lit(0), lambda a, c: a + c) < rules.most_words
        return short & F.forall(own, lambda c: c > 0) & F.exists(F.slice("__gated", first, n), lambda g: g)

    def of(first: Column) -> Column:
        sizes = F.sequence(F.lit(2), F.least(lines - first + 1, F.lit(rules.most_words + 1)))
        return F.transform(F.filter(sizes, lambda n: fits(first, n)), lambda n: F.struct(n.alias("n"), first.alias("first")))

    near = F.filter(F.sequence(F.lit(1), lines - 1), lambda k: F.exists(F.slice("__gated", k, rules.most_words + 1), lambda g: g))
    return F.when(lines > 1, F.flatten(F.transform(near, of))).otherwise(F.array().cast("array<struct<n: int, first: int>>"))


def _fewest(template: list[str], model: Model, least: float) -> int:
    """How many pairs of a template reach the least share of its weight."""
    weight = sorted((model.weight[p] for p in template), reverse=True)
    return 1 + int(np.sum(np.cumsum(weight) < least * sum(weight) * (1 - 1e-9)))


def scan(docs: DataFrame, model: Model, rules: Rules = Rules()) -> DataFrame:
    """Per row of docs: doc_id and found, its licence paragraphs as (paragraph, family, probability, share, text). No shuffle, no Python."""
    gate = model.gate(rules)
    kind = "paragraph: bigint, family: string, probability: double, share: double, text: string"

    def row(number: Column, n: Column, text: Column) -> Column:
        return F.struct(number.cast("bigint").alias("paragraph"), n.cast("int").alias("n"), score(text, model, rules).alias("got"), text.alias("text"))

    def kept(scored: Column) -> Column:
        flat = F.transform(scored, lambda s: F.struct(s["n"].alias("n"), s["paragraph"].alias("paragraph"), s["got"]["family"].alias("family"), s["got"]["probability"].alias("probability"), s["got"]["share"].alias("share"), s["text"].alias("text")))
        return F.filter(flat, lambda s: (s["family"] != "unknown") & (s["share"] >= rules.least_pairs * (1 - 1e-9)))

    # a run has the least share of a template only if it has as many pairs as the heaviest that make it up
    known = F.array(*(F.lit(p) for p in sorted({p for v in model.pairs.values() for t in v for p in t})))
    fewest = min((_fewest(t, model, rules.least_pairs) for v in model.pairs.values() for t in v), default=0)

    rows = docs.select("doc_id", F.when(F.lower("text").rlike(gate), F.split("text", "\n", -1)).otherwise(F.array().cast("array<string>")).alias("__lines"))
    rows = rows.withColumn("__gated", F.transform("__lines", lambda p: F.lower(p).rlike(gate)))
    gated = F.filter(F.transform("__lines", lambda p, k: F.struct(k.alias("paragraph"), p.alias("text"))), lambda s: F.lower(s["text"]).rlike(gate))
    rows = rows.withColumn("__found", kept(F.transform(gated, lambda s: row(s["paragraph"], F.lit(1), s["text"]))))
    rows = rows.withColumn("__taken", F.transform("__found", lambda f: f["paragraph"]))
    rows = rows.withColumn("__words", F.transform("__lines", lambda p, k: F.when(F.array_contains("__taken", k.cast("bigint")), 0).otherwise(F.regexp_count(F.lower(p), F.lit(WORD)))))
    rows = rows.withColumn("__runs", F.transform(_runs(rules), lambda x: F.struct(x["n"].alias("n"), x["first"].alias("first"), F.array_join(F.slice("__lines", x["first"], x["n"]), "\n").alias("text"))))
    likely = F.filter("__runs", lambda x: F.size(F.array_intersect(known, _pairs(x["text"]))) >= fewest)
    rows = rows.withColumn("__joined", F.array_sort(kept(F.transform(likely, lambda x: row(x["first"] - 1, x["n"], x["text"])))))

    def apart(a: Column, b: Column) -> Column:
        return (a["paragraph"] + a["n"] <= b["paragraph"]) | (b["paragraph"] + b["n"] <= a["paragraph"])

    chosen = F.aggregate("__joined", F.col("__found"), lambda acc, x: F.when(F.forall(acc, lambda y: apart(x, y)), F.concat(acc, F.array(x))).otherwise(acc))
    found = F.transform(chosen, lambda s: F.struct(*(s[k].alias(k) for k in ("paragraph", "family", "probability", "share", "text"))))
    return rows.select("doc_id", F.array_sort(found).cast(f"array<struct<{kind}>>").alias("found"))


def report(docs: DataFrame, model: Model, rules: Rules = Rules()) -> DataFrame:
    """Per row of docs: doc_id, n_found, families (sorted, comma-joined), paragraphs (number:family), least probability."""
    own = scan(docs, model, rules)
    return own.select(
        "doc_id",
        F.size("found").cast("bigint").alias("n_found"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda s: s["family"]))), ",").alias("families"),
        F.array_join(F.transform("found", lambda s: F.concat(s["paragraph"].cast("string"), F.lit(":"), s["family"])), ",").alias("paragraphs"),
        F.array_min(F.transform("found", lambda s: s["probability"])).alias("least_probability"),
    )
