import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import toxicity as tx


@pytest.fixture(scope="module")
def scored(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    return tx.score_documents(docs, labels).join(labels, "doc_id", "left").join(docs, "doc_id").cache()


def test_held_out_labels_are_ranked(scored):
    rows = scored.where("held_out AND toxic IS NOT NULL").collect()
    toxic = np.array([r.score for r in rows if r.toxic])
    clean = np.array([r.score for r in rows if not r.toxic])
    auc = np.mean([(t > clean).mean() + (t == clean).mean() / 2 for t in toxic])
    assert len(toxic) >= 5 and auc > 0.85


def test_documents_of_insults_are_caught_and_plain_ones_left(scored):
    named = F.regexp_count(F.lower("text"), F.lit(r"\b(idiot|moron|stupid|scum|loser|worthless|pathetic)\b"))
    rows = scored.withColumn("named", named).where("lang = 'en'").collect()
    caught = [r.predicted for r in rows if r.named >= 2]
    assert len(caught) >= 10 and np.mean(caught) > 0.95
    plain = [r.predicted for r in rows if not r.named and r.toxic == 0]
    assert np.mean(plain) < 0.03
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_label_model_finds_accuracies_and_dependence():
    rng = np.random.default_rng(0)
    n, y = 200_000, None
    y = rng.random(n) < 0.1
    rate = np.where(y[:, None], 0.7, 0.03) * np.ones(tx.VOTERS)
    bits = rng.random((n, tx.VOTERS)) < rate
    bits[:, 5] = np.where(rng.random(n) < 0.9, bits[:, 4], bits[:, 5])  # a voter that follows another
    patterns, counts = np.unique(bits @ (1 << np.arange(tx.VOTERS)), return_counts=True)
    model = tx.LabelModel(patterns, counts.astype(float), 0.1)
    assert np.abs(model.accuracies()[1][:4] - 0.7).max() < 0.05
    assert np.abs(model.accuracies()[0] - 0.03).max() < 0.02
    assert model.parent[5] == 4 or model.parent[4] == 5


def test_odd_rows(spark):
    rows = [(k, "you idiot, stupid scum" if k % 4 == 0 else f"a plain text {k}", 1) for k in range(40)]
    rows += [(100, None, 1), (101, "", 2), (None, "you idiot, stupid scum", 3), (1, "a plain text 1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(40)] + [(777, 1), (3, None)], "doc_id long, toxic int")
    got = tx.score_documents(docs, labels).collect()
    assert len(got) == len(rows)
    assert [r.predicted for r in got if r.doc_id in (100, 101)] == [0, 0]
    assert [r.predicted for r in got if r.doc_id is None] == [1]
    assert tx.score_documents(docs.limit(0), labels).count() == 0
    assert tx.score_documents(docs, labels.limit(0)).count() == len(rows)
    kept = tx.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 11


def plain_label_model(patterns, counts, prior, steps):
    """The same model voter by voter: posteriors of all combinations of votes."""
    voters = range(tx.VOTERS)
    vote = lambda p, j: int(p) >> j & 1
    q = {p: min(0.98, max(0.02, sum(vote(p, j) for j in (0, 1, 2, 3, 4, 5, 11)) / 4)) for p in patterns}
    for _ in range(steps):
        weight = {(y, p): n * (q[p] if y else 1 - q[p]) for p, n in zip(patterns, counts, strict=True) for y in (0, 1)}
        total = [sum(w for (y, _), w in weight.items() if y == k) for k in (0, 1)]
        joint, one = {}, {}
        for y in (0, 1):
            for i in voters:
                for j in voters:
                    for a in (0, 1):
                        for b in (0, 1):
                            n = sum(weight[y, p] for p in patterns if vote(p, i) == a and vote(p, j) == b)
                            joint[y, i, j, a, b] = (n + 0.25) / (total[y] + 1)
            for j in voters:
                own = [joint[y, j, j, a, a] for a in (0, 1)]
                for a in (0, 1):
                    one[y, j, a] = own[a] / sum(own)
        share = [t / max(sum(total), 1.0) for t in total]
        gain = lambda i, j: sum(share[y] * joint[y, i, j, a, b] * math.log(joint[y, i, j, a, b] / (one[y, i, a] * one[y, j, b])) for y in (0, 1) for a in (0, 1) for b in (0, 1))  # noqa: B023, E731
        parent = {0: None}
        while len(parent) < tx.VOTERS:
            i, j = max(((i, j) for i in parent for j in voters if j not in parent), key=lambda e: gain(*e))
            parent[j] = i

        def posterior(p):
            score = []
            for y in (0, 1):
                s = math.log(prior if y else 1 - prior)
                for j, i in parent.items():
                    if i is None:
                        s += math.log(one[y, j, vote(p, j)])
                    else:
                        a, b = vote(p, i), vote(p, j)
                        s += math.log(joint[y, i, j, a, b] / (joint[y, i, j, a, 0] + joint[y, i, j, a, 1]))
                score.append(s)
            return 1 / (1 + math.exp(min(35, max(-35, score[0] - score[1]))))

        q = {p: posterior(p) for p in patterns}
    return parent, posterior


def test_label_model_equals_a_plain_one():
    rng = np.random.default_rng(1)
    toxic = rng.random(3000) < 0.2
    bits = rng.random((3000, tx.VOTERS)) < np.where(toxic[:, None], rng.random(tx.VOTERS) * 0.8, 0.05)
    bits[:, 7] = np.where(rng.random(3000) < 0.8, bits[:, 6], bits[:, 7])
    patterns, counts = np.unique(bits @ (1 << np.arange(tx.VOTERS)), return_counts=True)
    patterns, counts = patterns[counts > 4], counts[counts > 4]
    model = tx.LabelModel(patterns, counts.astype(float), 0.2, steps=3)
    parent, posterior = plain_label_model(patterns.tolist(), counts.tolist(), 0.2, 3)
    assert model.parent == parent
    every = np.arange(0, 1 << tx.VOTERS, 7)
    assert np.allclose(model.posterior(every), [posterior(p) for p in every], atol=1e-9)


def test_scores_and_votes_equal_plain_counts(spark):
    rng = random.Random(2)
    words = ["idiot", "Idiots", "stupid", "haus", "of", "a", "Straße", "scum", "scummy", "plain", "STUPIDITY", "vermin!"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 60]))) + rng.choice(["", "!!!", " 12 34"]) for _ in range(120)] + ["idiot " * 300_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int("stupid" in t.lower() and "idiot" in t.lower())) for k, t in enumerate(texts)], "doc_id long, toxic int")
    model = tx.fit_outside_fold(docs, labels)
    got = {r.doc_id: r.score for r in model.score(docs).collect()}

    def stems(word):
        data = np.frombuffer(word, np.uint8)
        return [int(c[0]) for c in tx.stems(data, np.array([0, len(data)]))[0] if c[0] >= 0]

    known = {w: stems(w) for t in texts for w in set(re.findall(rb"[A-Za-z\x80-\xff]+", t.encode()))}
    for k, text in enumerate(texts):
        found = Counter(re.findall(rb"[A-Za-z\x80-\xff]+", text.encode()))
        n = Counter()
        for w, times in found.items():
            for s in known[w]:
                n[s] += times
        total = model.weights[-1] + sum(model.weights[s] * math.log2(1 + c) for s, c in n.items())
        assert abs(got[k] - 1 / (1 + math.exp(-min(35, max(-35, total))))) < 1e-4
        data = np.frombuffer(text.encode(), np.uint8)
        told = int(tx.votes(model.table, data, np.array([0, len(data)]))[0])
        hit = {w.lower() for w in found if any(model.table[s] > 0 for s in known[w])}
        assert [told >> 6 & 1, told >> 7 & 1] == [len(hit) >= 2, len(hit) >= 4]
        for voter in range(6):
            assert told >> voter & 1 == any(model.table[s] >> voter & 1 for w in found for s in known[w])
