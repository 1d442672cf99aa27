import math

import pytest
from conftest import ODD, SF

from pointsim.llm import licenses as L

RULES = L.Rules()


@pytest.fixture(scope="module")
def model(docs):
    return L.fit(docs)


def plain(text, model):
    """(paragraph, family) of a text, a paragraph at a time."""
    out = []
    for k, p in enumerate((text or "").split("\n")):
        own = L.words(p)
        z = list(model.bias)
        for g in L.grams(own):
            z = [a + b for a, b in zip(z, model.weights.get(g, [0] * len(z)))]
        z = [a / model.temperature for a in z]
        p_top = 1 / sum(math.exp(v - max(z)) for v in z)
        family = model.families[z.index(max(z))]
        pairs = {f"{a} {b}" for a, b in zip(own, own[1:])}
        weigh = lambda own: sum(model.weight[p] for p in own)
        share = max((weigh(pairs & set(t)) / weigh(set(t)) for t in model.pairs.get(family, [])), default=0) * bool(pairs & set(model.own.get(family, [])))
        if p_top >= RULES.threshold and family != "unknown" and share >= RULES.least_pairs:
            out.append(f"{k}:{family}")
    return ",".join(out)


def test_against_plain_version(docs, rows, odd, model):
    for df, own in ((docs, rows), (odd, ODD)):
        got = sorted((r.doc_id is None, r.doc_id or 0, r.paragraphs, r.n_found) for r in L.report(df, model).collect())
        assert got == sorted((d is None, d or 0, x := plain(t, model), x.count(":")) for d, t in own)
    assert L.report(odd.limit(0), model).count() == 0


WANT = {
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "This work is licensed under the GNU General Public License, version 3.": "gpl",
    "Licensed under the Apache License, Version 2.0.": "apache",
    "Released under the MIT License.": "mit",
}


def test_families_held_out(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    want = {d.doc_id: ",".join(sorted({f for t, f in WANT.items() if any(t in p for p in d.text.split("\n"))})) for d in docs}
    got = {r.doc_id: r.families for r in L.report(spark.createDataFrame(docs), model).collect()}
    assert got == want and sum(map(bool, want.values())) > 10


def test_other_wordings(spark, model):
    texts = [
        ("This file is licensed under the Apache License, Version 2.0, as all others are.", "apache"),
        ("Words before it. This program is licensed under the GNU Lesser General Public License, version 2.1.", "lgpl"),
        ("this work is LICENSED under a creative commons attribution-sharealike 4.0 international license", "cc-by-sa"),
        ("The dog license of the town costs money.", ""),
        ("He was a licensed pilot, with permission to fly.", ""),
        ("MIT opened its doors and the license office closed.", ""),
    ]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "doc_id long, text string")
    assert [r.families for r in sorted(L.report(df, model).collect(), key=lambda r: r.doc_id)] == [f for _, f in texts]


def test_model_without_documents(odd):
    model = L.fit(odd.limit(0))
    assert plain("Released under the MIT License.", model) == "0:mit"


def test_no_python_in_plan(docs, model):
    plan = L.report(docs, model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan and SF


def test_no_gate_hides_a_notice(spark, model):
    texts = [("Released under the MIT Licence.", "mit"), ("Released under the GPL, version 2 or later", "gpl")]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "doc_id long, text string")
    assert [r.families for r in sorted(L.report(df, model).collect(), key=lambda r: r.doc_id)] == [f for _, f in texts]
    gates = set(model.gates)
    for t in (t for v in model.pairs.values() for t in v):
        assert sum(model.weight[pair] for pair in t if not gates & set(pair.split(" "))) < RULES.least_pairs * sum(model.weight[pair] for pair in t)


def test_no_fragment_is_lost(spark, model):
    """All runs of a template's words: what the classifier and the template say, without any gate, is what is found."""
    texts = []
    for templates in L.TEMPLATES.values():
        for t in templates:
            w = t.split(" ")
            texts += [" ".join(w[a:b]) for a in range(0, len(w), 3) for b in range(a + 2, len(w) + 1, 2)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.paragraphs for r in L.report(df, model).collect()}
    assert got == {k: plain(t, model) for k, t in enumerate(texts)} and sum(map(bool, got.values())) > 200
    (row,) = L.report(spark.createDataFrame([(1, "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License")], "doc_id long, text string"), model).collect()
    assert row.families == "agpl"


LEFT_OUT = [
    "Licensed under the ISC License.", "Released under the ISC License.", "Released under the Eclipse Public License.", "Licensed under the Eclipse Public License, version 2.0.",
    "SPDX-License-Identifier: ISC", "SPDX-License-Identifier: EPL-2.0", "Licensed under the SIL Open Font License, Version 1.1.", "Released under the Python Software Foundation License.",
    "Licensed under the Common Development and Distribution License, version 1.0.", "Licensed under the Microsoft Public License.", "Released under the Zope Public License, version 2.1.",
    "Licensed under CC BY-ND 4.0.", "Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
]


def test_other_families_are_unknown_and_identifiers_are_found(spark, model):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(LEFT_OUT)], "doc_id long, text string")
    assert [r.families for r in L.report(df, model).collect()] == [""] * len(LEFT_OUT)
    ids = {"MIT": "mit", "Apache-2.0": "apache", "GPL-3.0-or-later": "gpl", "LGPL-2.1-only": "lgpl", "AGPL-3.0-or-later": "agpl", "BSD-3-Clause": "bsd", "MPL-2.0": "mpl", "CC0-1.0": "cc0", "CC-BY-4.0": "cc-by", "CC-BY-SA-4.0": "cc-by-sa", "CC-BY-NC-4.0": "cc-by-nc"}
    df = spark.createDataFrame([(k, f"/* SPDX-License-Identifier: {i} */") for k, i in enumerate(ids)], "doc_id long, text string")
    assert [r.families for r in sorted(L.report(df, model).collect(), key=lambda r: r.doc_id)] == list(ids.values())


MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software."""
GPL = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 */"""


def test_wrapped_notices(spark, model):
    texts = [(MIT, "mit"), (GPL, "gpl"), ("Intro of it.\nLicensed under the Apache\nLicense, Version 2.0.\nMore.", "apache"), ("Licensed under the Apache\n\nand other\nthings", "")]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = sorted(L.scan(df, model).collect(), key=lambda r: r.doc_id)
    assert [",".join(sorted({f.family for f in r.found})) for r in got] == [f for _, f in texts]
    for r, (t, _) in zip(got, texts, strict=True):
        assert all(t.split("\n")[f.paragraph :][: f.text.count("\n") + 1] == f.text.split("\n") for f in r.found)
