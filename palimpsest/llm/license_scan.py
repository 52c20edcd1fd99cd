"""Licence scans: a trained paragraph classifier, confirmed by template comparison.

Paragraphs reach to the next line without a word. Their lines are scored one by one, as may be whole
pages; where a paragraph has several lines, so are overlapping windows over its joined words, of
twice the words of the longest template, so that a notice wrapped anywhere lies whole in one of them.
The classifier is a sparse multinomial logistic regression (elastic net) on word n-grams of licence
paragraphs, one to three words long; n-grams of nothing but words that sampled plain paragraphs hold
are no features. It is trained on bounded, generated data: paragraphs of the families with words left
out, between words of sampled paragraphs of the corpus; paragraphs of other licences, as the class
``unknown``; and sampled paragraphs themselves, as the class ``none``. Licences that took no part in
the training calibrate the rest: a family has to be more probable than nearly all of those foreign
paragraphs make it, or else the paragraph is of an unknown licence, too. A prediction counts as
confirmed if the paragraph holds enough of the word pairs of one of the family's templates. Windows
only count if they are confirmed, once a paragraph and family, and only where no line of the paragraph
is confirmed by itself; lines of that family are then pieces of the notice and not counted as
unconfirmed ones.

Everything runs as DataFrame functions and JVM transformers: no Python on the executors. A paragraph
without any word that sets a feature apart from plain text has no feature, and is of the class ``none``
by the intercepts alone; such paragraphs are not scored. Nothing is shuffled but findings.

Defined cases: a null text, or one without a licence paragraph, gives no findings, empty families
and zeros; rows that repeat an id are kept apart by their text, and equal ones share one result; a
null id is kept; of equally probable classes the first in order counts; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.sampling import hashed_sample
from palimpsest.session import stored

# Notices and paragraphs of public licences, by family.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Apache License, Version 2.0",
        "Apache License, Version 1.1",
        "SPDX-License-Identifier: Apache-2.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU General Public License version 2",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License",
        "Licensed under the LGPL v2.1",
        "LGPL v2.1",
        "LGPL v3",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "agpl": [
        "This work is licensed under the GNU Affero General Public License",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Released under the BSD 2-Clause License.",
        "BSD 3-Clause",
        "BSD 2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-nd": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ],
    "cc-by-nc-sa": [
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc-nd": [
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    ],
    "public-domain": [
        "This work is dedicated to the public domain under CC0 1.0.",
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "proprietary": [
        "Copyright. All rights reserved. No part may be reproduced without written permission.",
        "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
    ],
}
# Other public licences. Every second one takes no part in the training and calibrates it.
FOREIGN = {
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.",
    ],
    "postgresql": [
        "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
        "Released under the PostgreSQL License.",
    ],
    "eclipse": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License which accompanies this distribution.",
        "Licensed under the Eclipse Public License, version 2.0",
    ],
    "common-development": [
        "The contents of this file are subject to the terms of the Common Development and Distribution License. You may not use this file except in compliance with the License.",
        "Licensed under the Common Development and Distribution License, version 1.0",
    ],
    "zlib": [
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
        "Released under the zlib License.",
    ],
    "boost": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
    ],
    "european-union": [
        "Licensed under the EUPL, version 1.2 or, as soon as they will be approved by the European Commission, subsequent versions of the EUPL",
        "SPDX-License-Identifier: EUPL-1.2",
    ],
    "academic": [
        "Licensed under the Academic Free License version 3.0",
        "SPDX-License-Identifier: AFL-3.0",
    ],
    "artistic": [
        "This library is free software; you can redistribute it and/or modify it under the same terms as Perl itself.",
        "Licensed under the Artistic License 2.0.",
    ],
    "open-font": [
        "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
        "Released under the Open Font License.",
    ],
    "fair": [
        "Usage of the works is permitted provided that this instrument is retained with the works, so that any entity that uses the works is notified of this instrument.",
        "Licensed under the Fair License.",
    ],
    "microsoft-public": [
        "This license governs use of the accompanying software. If you use the software, you accept this license. If you do not accept the license, do not use the software.",
        "Licensed under the Microsoft Public License.",
    ],
}
# Words that make another licence of a notice that does not have them in its templates.
CHANGING = "nc noncommercial nd noderivatives noderivs sa sharealike".split()
# Prose with the words of licences that is none.
PROSE = [
    "The shop must redistribute the leaflets among the villages, with or without a modification of the covers.",
    "She lost her driving licence and the permission to use the road.",
    "The public library is free for any person who lives in the county.",
    "Copying the poem by hand, he used no software and no other source.",
    "A warranty of two years comes with the kettle, in black or white form.",
    "The general asked the public for its contributions to the foundation.",
    "All conditions of the race were met, and the following day it rained.",
    "He wrote to the authors and holders of the prize without any claim to it.",
    "The commons were open to sheep and to whoever came to share them alike.",
    "The version of the story that they published was subject to some doubt.",
]
PLAIN, UNKNOWN = "none", "unknown"
#: Bounds: documents sampled for plain paragraphs, and variants of each template.
SAMPLE_DOCUMENTS = 600
VARIANTS = 60
#: Words of the parts of long templates that are trained on.
PART = 9
#: A template is confirmed with so large a share of its word pairs; one of fewer than SHORT pairs with all of them.
CONFIRM, SHORT = 0.75, 6
#: Share of the families' own paragraphs that the threshold may cost at least and at most, and of
#: foreign ones that it has to leave to the unknown class where the latter allows it.
DOUBT, MOST_DOUBT, FOREIGN_SHARE = 0.02, 0.1, 0.95
WORD = r"[\p{L}\p{N}]+"
#: Between paragraphs: one or more lines without a word.
BLANK = r"\n(?:[^\p{L}\p{N}\n]*+\n)++"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _runs(words: Column, n: int) -> Column:
    last = F.size(words) - (n - 1)
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda k: F.array_join(F.slice(words, k, n), " "))


def _grams(words: Column) -> Column:
    return F.concat(words, _runs(words, 2), _runs(words, 3))


def _templates(spark: SparkSession) -> DataFrame:
    """family (the foreign ones: unknown), nth, words, and whether the paragraph is held back from training."""
    rows = [(family, k, text, False) for family, texts in TEMPLATES.items() for k, text in enumerate(texts)]
    rows += [(UNKNOWN, 100 * n + k, text, n % 2 == 1) for n, texts in enumerate(FOREIGN.values()) for k, text in enumerate(texts)]
    return spark.createDataFrame(rows, "family string, nth int, text string, held boolean").select(
        "family", "nth", "held", _words(F.col("text")).alias("words")
    )


def _training(templates: DataFrame, plain: DataFrame, n_plain: int, salt: int) -> DataFrame:
    """family, words: variants of templates between plain words, and plain paragraphs."""
    pick = lambda *cols: F.pmod(F.xxhash64(F.lit(salt), *cols), F.lit(max(n_plain, 1)))
    variant = templates.select("*", F.explode(F.sequence(F.lit(1), F.lit(VARIANTS))).alias("v"))
    drop = lambda w, k: (F.col("v") % 3 == 0) | (F.pmod(F.xxhash64(F.lit(salt), F.col("v"), k, w), F.lit(12)) > 0)
    variant = variant.withColumn("words", F.filter("words", drop)).withColumn("at", pick("family", "nth", "v"))
    # Some of the long paragraphs only in part, as texts quote them.
    start = F.pmod(F.xxhash64(F.lit(salt), "v", "nth"), F.greatest(F.size("words") - PART, F.lit(1))) + 1
    part = F.slice("words", start.cast("int"), F.lit(PART))
    variant = variant.withColumn("words", F.when((F.size("words") > 2 * PART) & (F.col("v") % 5 == 4), part).otherwise(F.col("words")))
    met = variant.join(plain.select("at", F.col("words").alias("around")), "at", "left")
    around = F.coalesce("around", F.array().cast("array<string>"))
    half = (F.col("v") % 4 > 1).cast("int") * F.least(F.size(around), F.lit(40))
    cut = F.when(half > 0, F.pmod(F.xxhash64(F.lit(salt), "v"), half)).otherwise(0).cast("int")
    mixed = F.concat(F.slice(around, F.lit(1), cut), F.col("words"), F.slice(around, cut + 1, half - cut))
    return met.select("family", mixed.alias("words")).unionByName(plain.select(F.lit(PLAIN).alias("family"), "words"))


class LicenseModel:
    """``cues``: the words that set features apart from plain text; ``least``: what a family's probability has to reach."""

    def __init__(self, vectors: CountVectorizerModel, classifier: LogisticRegressionModel, names: list[str], cues: list[str], least: float):
        self.vectors, self.classifier, self.names, self.cues, self.least = vectors, classifier, names, cues, least

    @classmethod
    def fit(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LicenseModel:
        spark = docs.sparkSession
        templates = _templates(spark).cache()
        known = templates.where("NOT held")
        grams = [r.g for r in known.select(F.explode(F.array_distinct(_grams(F.col("words")))).alias("g")).distinct().orderBy("g").collect()]
        single = [g for g in grams if " " not in g]
        some = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text IS NOT NULL")
        some = hashed_sample(some, SAMPLE_DOCUMENTS, "doc_id").select(F.explode(F.split("text", "\n")).alias("line"))
        # Words that tell of a licence in any family keep a sampled paragraph out of the plain ones.
        telling = F.lit("licen[cs]e|copyright|warrant|redistribut|public domain|all rights|creative commons|spdx")
        prose = spark.createDataFrame([(t,) for t in PROSE], "line string")
        plain = some.where(~F.regexp_like(F.lower("line"), telling)).select("line").unionByName(prose)
        plain = plain.select(_words(F.col("line")).alias("words"), F.xxhash64("line").alias("h"), F.col("line").isin(PROSE).alias("prose"))
        plain = stored(plain.where("size(words) > 0").dropDuplicates(["h"]), "plain-paragraphs")
        n_plain = plain.count()
        order = F.expr("row_number() OVER (ORDER BY h) - 1")  # over the bounded sample
        plain = stored(plain.withColumn("at", order.cast("long")), "plain-numbered")
        # Plain words tell nothing; nor do those of one or two letters.
        common = {r.w for r in plain.where("NOT prose").select(F.explode("words").alias("w")).where(F.col("w").isin(single)).distinct().collect()}
        cues = [w for w in single if w not in common and len(w) > 1]
        vocabulary = [g for g in grams if not set(cues).isdisjoint(g.split(" "))]
        names = [PLAIN, *TEMPLATES, UNKNOWN]
        label = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("family")) - 1
        rows = lambda of, salt: _training(of, plain, n_plain, salt).select(
            label.cast("double").alias("label"), _grams(F.col("words")).alias("grams")
        )
        vectors = CountVectorizerModel.from_vocabulary(vocabulary, "grams", "features")
        learner = LogisticRegression(family="multinomial", regParam=0.002, elasticNetParam=0.5, maxIter=60)
        train = vectors.transform(stored(rows(known, 1), "license-training")).select("label", "features").coalesce(1).cache()  # bounded rows: one task an iteration
        classifier = learner.fit(train)
        train.unpersist()
        intercepts = classifier.interceptVector.toArray()
        if intercepts.argmax() != 0:  # else paragraphs without a feature would have to be scored
            raise RuntimeError("the plain class does not lead by its intercept")
        # Own paragraphs anew, and foreign ones that were held back, by the probability of their (best) family.
        held = classifier.transform(vectors.transform(rows(templates.where((F.col("family") != UNKNOWN) | F.col("held")), 2))).where("label > 0")
        p = vector_to_array("probability")
        last = len(names) - 1
        foreign = F.col("label") == last
        own = F.when(~foreign, F.get(p, F.col("label").cast("int")))
        taken = F.when(foreign, F.array_max(F.slice(p, 2, last - 1)))
        at = lambda c, share: F.percentile_approx(c, share, 10_000)
        few, many, other = held.agg(at(own, DOUBT), at(own, MOST_DOUBT), at(taken, FOREIGN_SHARE)).first()
        templates.unpersist()
        return cls(vectors, classifier, names, cues, min(max(few or 0.5, other or 0.0), many or 0.5))

    def findings(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """One row per line or window of a licence: doc_id, key, block (number of the paragraph), window,
        line_no (number in the paragraph), family, score, confirmed, overlap."""
        text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
        blocks = docs.select(
            F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.posexplode(F.split(text, BLANK)).alias("block", "paragraph")
        )
        cues = F.array(*[F.lit(w) for w in self.cues])
        blocks = blocks.withColumn("joined", _words(F.col("paragraph"))).where(F.arrays_overlap("joined", cues))
        parts = blocks.select("doc_id", "key", "block", F.inline(_parts(F.split("paragraph", "\n"), F.col("joined"))))
        worded = parts.where(F.arrays_overlap("words", cues))
        scored = self.classifier.transform(self.vectors.transform(worded.withColumn("grams", _grams(F.col("words")))))
        scored = scored.withColumn("p", vector_to_array("probability")).where("prediction > 0")
        names = F.array(*[F.lit(x) for x in self.names])
        best = F.get(names, F.col("prediction").cast("int"))
        score = F.get("p", F.col("prediction").cast("int"))
        pairs = F.array_distinct(_runs(F.col("words"), 2))
        # The templates are a fixed, small table and go along as literals.
        overlaps = [
            F.when(best == family, _share(F.size(F.array_intersect(pairs, F.split(F.lit("|".join(sorted(own))), r"\|"))), len(own)))
            for family, texts in TEMPLATES.items()
            for own in (_pairs(t) for t in texts)
        ]
        overlap = F.coalesce(F.greatest(*overlaps), F.lit(0.0))
        changed = {family: sorted(set(CHANGING) - {w for t in texts for w in _word_list(t)}) for family, texts in TEMPLATES.items() if family.startswith("cc-")}
        other = F.coalesce(*[F.when(best == family, F.arrays_overlap("words", F.array(*[F.lit(w) for w in own]))) for family, own in changed.items() if own], F.lit(False))
        return scored.select(
            "doc_id",
            "key",
            "block",
            "window",
            "line_no",
            F.when(score >= self.least, best).otherwise(UNKNOWN).alias("family"),
            score.alias("score"),
            ((overlap >= CONFIRM) & (score >= self.least) & ~other).alias("confirmed"),
            overlap.alias("overlap"),
        )


def _share(common: Column, pairs: int) -> Column:
    """Share of a template's pairs; of a short template, all or nothing."""
    return common / pairs if pairs >= SHORT else (common == pairs).cast("double")


def _parts(lines: Column, joined: Column) -> Column:
    """window, line_no, words of each line, and of the windows over the words of several lines."""
    step = max(len(_word_list(t)) for texts in TEMPLATES.values() for t in texts)
    part = lambda window, k, words: F.struct(F.lit(window).alias("window"), k.alias("line_no"), words.alias("words"))
    single = F.transform(lines, lambda line, k: part(False, k, _words(line)))
    last = F.greatest(F.ceil(F.size(joined) / step).cast("int") - 2, F.lit(0))
    windows = F.transform(F.sequence(F.lit(0), last), lambda k: part(True, k, F.slice(joined, k * step + 1, 2 * step)))
    return F.when(F.size(lines) > 1, F.concat(single, windows)).otherwise(single)


def _word_list(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def _pairs(text: str) -> set[str]:
    own = _word_list(text)
    return {f"{a} {b}" for a, b in zip(own, own[1:], strict=False)}


def scan(docs: DataFrame, model: LicenseModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, families (confirmed, sorted), n_confirmed, n_unconfirmed, n_unknown."""
    found = (model or LicenseModel.fit(docs, id_col, text_col)).findings(docs, id_col, text_col)
    row = (F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "block", "family", "window", "confirmed", "line_no")
    found = found.where("NOT window OR confirmed").select(*row).distinct()
    per = found.groupBy("_id", "_key", "block", "family").agg(
        F.count_if(F.expr("confirmed AND NOT window")).alias("lines"), F.count_if("window").alias("windows"), F.count_if(~F.col("confirmed")).alias("rest")
    )
    per = per.groupBy("_id", "_key").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("lines") + F.col("windows") > 0, F.col("family")))), ",").alias("families"),
        F.sum(F.greatest("lines", F.least("windows", F.lit(1)))).alias("n_confirmed"),
        F.sum(F.when((F.col("family") != UNKNOWN) & ((F.col("lines") > 0) | (F.col("windows") == 0)), F.col("rest")).otherwise(0)).alias("n_unconfirmed"),
        F.sum(F.when(F.col("family") == UNKNOWN, F.col("rest")).otherwise(0)).alias("n_unknown"),
    )
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    every = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"))
    met = every.join(per, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    counts = ("n_confirmed", "n_unconfirmed", "n_unknown")
    return met.select("doc_id", F.coalesce("families", F.lit("")).alias("families"), *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
