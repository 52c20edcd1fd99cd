import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.llm import importance as im

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute(rows, target, percent=5, least=20):
    bucket = lambda run: zlib.crc32(run.encode()) % 10000
    found = [(i, *runs(t)) for i, t in rows]
    s = Counter(bucket(f) for _, _, own in found for f in own)
    t = Counter(bucket(f) for text in target for f in runs(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
    out = []
    for i, n, own in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in own)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    long_enough = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, row in enumerate(long_enough[: percent * len(long_enough) // 100], 1):
        row[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aB1é漢 -\n\x00", max_size=40), max_size=5), st.integers(1, 7), st.integers(1, 9))
def test_features_are_runs_of_words_whatever_the_slices(texts, words, slice_bytes):
    old = im.WORDS, im.SLICE
    im.WORDS, im.SLICE = words, slice_bytes
    try:
        got = Counter()
        for _, owner, bucket in im.features((t.encode() for t in texts), 1 << 31):
            got.update(zip(owner.tolist(), bucket.tolist(), strict=True))
    finally:
        im.WORDS, im.SLICE = old
    assert got == Counter((k, zlib.crc32(f.encode()) % (1 << 31)) for k, t in enumerate(texts) for f in runs(t)[1])


def test_shifted_crcs_join_strings_of_any_length():
    rng = random.Random(1)
    for n in (0, 1, 63, 64, 65, 100, 5000, 100_000):
        a, b = rng.randbytes(9), rng.randbytes(n)
        assert im.shifted(np.array([zlib.crc32(a)], np.uint32), np.array([n]))[0] ^ zlib.crc32(b) == zlib.crc32(a + b)


@pytest.mark.parametrize("accuracy", [10_000, 3])
def test_resampling_equals_brute_force(spark, accuracy, monkeypatch):
    monkeypatch.setattr(im, "SKETCH", accuracy)
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdé1") for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    text = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    rows = [(k, text(rng.randrange(0, 60))) for k in range(400)]
    rows += [(1, rows[1][1]), (2, text(30)), (None, text(40)), (None, None), (500, None), (501, ""), (502, "?!"), (503, text(200_000)), (504, "x" * 70_000 + " " + text(50))]
    target = [*(text(30) for _ in range(5)), None, ""]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit(1), "position": F.lit(2), "_range": F.lit(3)}).repartition(5)
    goal = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = im.resample(docs, goal)
    assert rows_of(got) == brute(rows, target)
    assert rows_of(im.resample(docs, goal.limit(0), percent=50)) == brute(rows, [], 50)


def test_ties_at_the_cutoff_go_by_id_and_features(spark):
    schema = "doc_id long, n_features long, score long, row long"
    rows = [(k // 3, k % 3, 7, k) for k in range(300)]
    table = spark.createDataFrame(rows, schema).repartition(4)
    for k in (1, 2, 150, 299, 300):
        drawn, _ = im.draw(table, k, 300, ["doc_id", "n_features", "row"])
        assert [(r.doc_id, r.n_features) for r in drawn.orderBy("rank").collect()] == [(a, b) for a, b, _, _ in rows[:k]]
        assert [r["rank"] for r in drawn.orderBy("rank").collect()] == list(range(1, k + 1))


def test_brackets_widen_until_the_counts_agree(spark):
    scores = [(k * k,) for k in range(1000)]
    table = spark.createDataFrame(scores, "score long").repartition(3)
    for k in (1, 10, 500, 1000):
        for accuracy in (1, 4, 100, 10_000):
            low, high, above = im.bracket(table, "score", k, 1000, accuracy)
            assert low <= scores[1000 - k][0] <= high and above == sum(s > high for (s,) in scores)


def test_nothing_to_draw(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert rows_of(im.resample(docs, docs.limit(0))) == brute([(1, "a b"), (2, None)], [])
    assert im.resample(docs.limit(0), docs).count() == 0
