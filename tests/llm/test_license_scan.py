import math
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import license_scan as ls

LINES = {
    "mit": "Released under the MIT License.",
    "apache": "Licensed under the Apache License, Version 2.0.",
    "gpl": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
}


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def model(documents):
    return ls.LicenseModel.fit(documents)


def test_fixture_licenses_are_found_and_nothing_else(documents, model):
    got = {r.doc_id: r for r in ls.scan(documents, model).collect()}
    expected = {}
    for r in documents.collect():
        expected[r.doc_id] = ",".join(sorted({f for f, line in LINES.items() if line.rstrip(".") in r.text}))
    assert sum(map(bool, expected.values())) >= 3
    assert {d: r.families for d, r in got.items()} == expected


def test_templates_between_other_words(spark, model):
    rows = [(k, f"erst thnt of the inon {line} and ther onen\nplain words", f) for k, (f, line) in enumerate(LINES.items())]
    rows += [(10, None, ""), (11, "", ""), (12, "she lost her licence to drive", ""), (None, LINES["mit"], "mit"), (1, "no", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, family string").withColumn("key", F.lit(0))
    got = ls.scan(docs, model).collect()
    assert sorted((r.doc_id or -1, r.families) for r in got) == sorted((r[0] or -1, r[2]) for r in rows)
    assert ls.scan(docs.limit(0), model).count() == 0


def test_other_licenses_are_not_confirmed(spark, model):
    docs = spark.createDataFrame([(1, "Licensed under the Fair Example License, edition 7.")], "doc_id long, text string")
    row = ls.scan(docs, model).first()
    assert row.families == ""


def test_wrapped_notices(spark, model):
    notices = {
        "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met",
        "gpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License",
        "mit": "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation files",
    }
    rows, expected = [], {}
    for k, (family, notice) in enumerate(notices.items()):
        narrow = " ".join(notice.split()).split(" ")
        narrow = "\n".join("# " + " ".join(narrow[at : at + 4]) for at in range(0, len(narrow), 4))
        before = " ".join(f"onen{x}" for x in range(37 + k))
        for n, text in enumerate((notice, narrow, f"{before}\n{notice}\nerst thnt", f"{before}\n\n{narrow}\n\nerst thnt")):
            rows.append((10 * k + n, text))
            expected[10 * k + n] = (family, 1)
    got = ls.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert {r.doc_id: (r.families, r.n_confirmed) for r in got} == expected


#: One-line notices and paragraphs of licences that no template is made of.
STRANGE = [
    "Licensed under the Fair Example License, edition 7.",
    "Licensed under the Eclipse Public License, version 1.0",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Licensed under the Common Public License version 1.0",
    "This file is distributed under the University of Illinois Open Source License. See LICENSE.TXT for details.",
    "Released under the Python Software Foundation License.",
    "This software is licensed under the Sleepycat License.",
    "Released under the Beerware License.",
    "Licensed under the Open Software License version 3.0",
    "Distributed under the Boost Software License, Version 1.0.",
    *[text for n, texts in enumerate(ls.FOREIGN.values()) for text in texts if n % 2],  # held back from the training
]


NEAR = {
    "Licensed under CC BY-NC-SA 4.0.": "cc-by-nc-sa",
    "Licensed under CC BY-NC-ND 4.0.": "cc-by-nc-nd",
    "Licensed under CC BY-ND 4.0.": "cc-by-nd",
    "Licensed under CC BY-SA 4.0.": "cc-by-sa",
    "Licensed under CC BY 4.0.": "cc-by",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 International License.": "cc-by-nc-sa",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.": "cc-by-nd",
    "Apache License, Version 1.1": "apache",
    "LGPL v2.1": "lgpl",
    "BSD 2-Clause": "bsd",
    "This library is licensed under the GNU Lesser General Public License": "lgpl",
    "This work is licensed under the GNU Affero General Public License": "agpl",
}


def test_near_licenses_are_told_apart(spark, model):
    got = {r.doc_id: r for r in ls.scan(spark.createDataFrame(list(enumerate(NEAR)), "doc_id long, text string"), model).collect()}
    wrong = {t: got[k].families for k, (t, f) in enumerate(NEAR.items()) if got[k].families != f}
    assert not wrong
    # Conditions that no family's templates have are never confirmed as a freer licence.
    odd = ["Licensed under CC BY-SA-NC 4.0 NoDerivs.", "Licensed under CC BY 4.0 NonCommercial."]
    got = ls.scan(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), model).collect()
    assert not {"cc-by", "cc-by-sa"} & {f for r in got for f in r.families.split(",")}


def test_prose_is_no_licence(spark, model):
    prose = ["You may not use the lift in case of fire, except with permission of the porter.", "The leaflets are free, and you can redistribute them with or without modification of the text."]
    got = ls.scan(spark.createDataFrame(list(enumerate(prose)), "doc_id long, text string"), model).collect()
    assert [(r.families, r.n_confirmed) for r in got] == [("", 0)] * 2


def test_foreign_licenses_are_unknown(spark, model):
    docs = spark.createDataFrame(list(enumerate(STRANGE)), "doc_id long, text string")
    got = {r.doc_id: r for r in ls.scan(docs, model).collect()}
    assert not {k: r.families for k, r in got.items() if r.families}
    found = [k for k, r in got.items() if r.n_unknown + r.n_unconfirmed]
    unknown = [k for k, r in got.items() if r.n_unknown]
    assert len(found) >= 0.9 * len(STRANGE), sorted(set(got) - set(found))
    assert len(unknown) >= 0.8 * len(STRANGE), sorted(set(got) - set(unknown))


def test_versions_and_parts_of_notices(spark, model):
    rows = [(1, "GNU General Public License version 2", "gpl"), (2, ls.TEMPLATES["mit"][-1], "mit"), (3, ls.TEMPLATES["bsd"][2], "bsd")]
    got = {r.doc_id: r.families for r in ls.scan(spark.createDataFrame(rows, "doc_id long, text string, f string"), model).collect()}
    assert got == {k: f for k, _, f in rows}
    part = spark.createDataFrame([(1, "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED")], "doc_id long, text string")
    row = ls.scan(part, model).first()
    assert row.n_unconfirmed + row.n_unknown == 1 and row.families == "", row


def test_scores_equal_those_of_the_printed_weights(spark, documents, model):
    """Every line of the fixtures and of the strange notices, scored by plain Python."""
    vocabulary = {g: k for k, g in enumerate(model.vectors.vocabulary)}
    weights, intercepts = model.classifier.coefficientMatrix.toArray(), model.classifier.interceptVector.toArray()
    rows = [(r.doc_id, r.text) for r in documents.collect()] + [(10_000 + k, t) for k, t in enumerate(STRANGE)]
    expected = {}
    for d, text in rows:
        for block, paragraph in enumerate(re.split(r"\n(?:[^\w\n]*\n)+", text or "")):
            lines = paragraph.split("\n")
            for k, line in enumerate(lines):
                words = re.findall(r"[^\W_]+", line.lower())
                grams = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
                scores = intercepts.copy()
                for g in grams:
                    if g in vocabulary:
                        scores += weights[:, vocabulary[g]]
                best = int(scores.argmax())
                if best:
                    p = math.exp(scores[best]) / sum(map(math.exp, scores))
                    name = model.names[best] if p >= model.least else ls.UNKNOWN
                    pairs = {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}
                    shares = [(len(pairs & own) / len(own), len(own)) for own in map(ls._pairs, ls.TEMPLATES.get(model.names[best], []))]
                    near = max((s if n >= ls.SHORT else float(s == 1) for s, n in shares), default=0)
                    family = model.names[best]
                    own = {w for t in ls.TEMPLATES.get(family, []) for w in ls._word_list(t)}
                    changed = family.startswith("cc-") and bool(set(words) & (set(ls.CHANGING) - own))
                    expected[d, block, k] = (name, round(p, 6), near >= ls.CONFIRM and name != ls.UNKNOWN and not changed, round(near, 6))
    found = model.findings(spark.createDataFrame(rows, "doc_id long, text string")).where("NOT window").collect()
    got = {(r.doc_id, r.block, r.line_no): (r.family, round(r.score, 6), r.confirmed, round(r.overlap, 6)) for r in found}
    assert got == expected and len(got) > 20


def test_very_long_and_repeated_rows(spark, model):
    long = "erst thnt " * 200_000
    rows = [(1, f"{long}\n\n{LINES['mit']}\n\n{long}"), (1, "plain"), (1, "plain"), (2, "\n".join([LINES["apache"]] * 50))]
    got = sorted((r.doc_id, r.families, r.n_confirmed) for r in ls.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect())
    assert got == [(1, "", 0), (1, "", 0), (1, "mit", 1), (2, "apache", 50)]
