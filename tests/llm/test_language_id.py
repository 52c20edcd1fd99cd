import string
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from palimpsest.llm import language_id as li
from palimpsest.llm import sketch, words


def test_ngrams_stay_within_their_text():
    texts = ["abc", None, "", "d", "ab", "xyzé", "c"]
    (first, last, orders), = li.ngrams(texts)
    assert (first, last) == (0, len(texts))
    for order, (h, bounds) in enumerate(orders, 1):
        assert np.diff(bounds).tolist() == [max(len(t or "") - order + 1, 0) for t in texts]
        for k, t in enumerate(texts):
            (_, _, alone), = li.ngrams([t])
            assert alone[order - 1][0].tolist() == h[bounds[k] : bounds[k + 1]].tolist()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = li.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    right = sum(r.lang_pred == r.lang for r in got)
    assert len(got) > 30 and right >= 0.9 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows(spark):
    rows = [(k, f"the cat and the dog {k}", "en") for k in range(20)] + [(k, f"der hund und die katze {k}", "de") for k in range(20, 40)]
    rows += [(50, None, "en"), (51, "", None), (52, "12 34 !!", "de"), (None, "the cat", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    got = {r.doc_id: r for r in li.identify(docs).collect()}
    assert len(got) == len(rows)
    assert [got[k].lang_pred for k in (50, 51, 52)] == ["und"] * 3
    assert li.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in li.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def plain_ngram(points, order):
    mask = (1 << 64) - 1
    h = points[0] * int(li._TURN[0]) & mask
    for k in range(1, order):
        h = ((h ^ (h >> 29)) * int(li._TURN[k]) + points[k]) & mask
    return int(words.mix(np.array([(h + order) & mask], np.uint64))[0] >> np.uint64(64 - li.BITS))


def plain_counts(text):
    points = [ord(c) if ord(c) > 127 or c in string.ascii_letters else 48 if c.isdigit() else 32 for c in (text or "").lower()]
    return Counter(plain_ngram(points[k : k + n], n) for n in (1, 2, 3) for k in range(len(points) - n + 1))


def test_scores_equal_plain_counts():
    rng = np.random.default_rng(4)
    table = rng.normal(size=(1 << li.BITS, 3)).astype(np.float32)
    texts = ["Der Hund, 12 Katzen!", "é", "", None, "ab", "Ünï 漢字 x", "long " * 200_000]
    got = li._logits(texts, table)
    for k, text in enumerate(texts):
        n = plain_counts(text[:20_000] if text and len(text) > 20_000 else text)
        plain = sum((c * table[h].astype(float) for h, c in n.items()), np.zeros(3)) / max(sum(n.values()), 1) * li.SCALE
        assert np.allclose(got[k], plain, atol=0.02 if text and len(text) > 20_000 else 1e-3)


def test_document_frequencies(spark):
    texts = ["der hund", "der", "", None, "the dog", "der hund"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    n = Counter(h for t in texts for h in set(plain_counts(t)))
    expected = np.zeros(1 << li.BITS, np.int64)
    expected[list(n)] = list(n.values())
    assert (sketch.hash_counts(frame, li._grouped, li.BITS) == expected).all()


def test_temperature_lowers_the_loss_on_documents_not_seen(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang IS NOT NULL AND text <> ''")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = li.LanguageModel.fit(docs.where(fold != 2))
    held = docs.where(fold == 2).select("text", "lang").collect()
    logits = li._logits([r.text for r in held], model.table)
    true = np.array([model.names.index(r.lang) for r in held])

    def loss(temperature):
        z = logits / temperature
        z = z - z.max(axis=1, keepdims=True)
        return -np.mean(z[np.arange(len(true)), true] - np.log(np.exp(z).sum(axis=1)))

    assert len(held) > 150 and (logits.argmax(axis=1) == true).mean() >= 0.98
    assert loss(model.temperature) <= loss(1.0) + 1e-6 or loss(model.temperature) < 0.02
    assert loss(model.temperature) < 0.5 * loss(20.0)
