import random

import numpy as np
import pytest

from palimpsest.llm import ngram_join


def brute(rows, width, percent):
    sets = {}
    for i, text in rows:
        seq = (text or "").encode().lower().split()
        s = {tuple(seq[k : k + width]) for k in range(max(1, len(seq) - width + 1))} if seq else set()
        sets.setdefault(i, []).append(s)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = {i: 0 for i in sets}
    flat = [(i, s) for i, group in sets.items() for s in group]
    for k, (i, a) in enumerate(flat):
        for j, b in flat[:k]:
            if i != j and a and b and 100 * len(a & b) >= percent * len(a | b):
                links[i] += 1
                links[j] += 1
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in sets}, {i: len(group[0]) for i, group in sets.items()}, links


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 4, 12, 60, 150]))] for _ in range(n // 8)]
    rows = []
    for i in range(n):
        seq = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4])):
            seq[rng.randrange(len(seq))] = rng.choice(vocabulary)
        if rng.random() < 0.2:
            seq += [rng.choice(vocabulary) for _ in range(3)]
        rows.append((i * 7 % (n * 7), rng.choice([" ", "\n", "\t "]).join(seq)))
    return rows + [(10**6, None), (10**6 + 1, ""), (10**6 + 2, " \n"), (10**6 + 3, "w1"), (10**6 + 4, "W1")]


@pytest.mark.parametrize("parts", [2_000_000, 400])
def test_components_and_links_equal_brute_force(spark, parts):
    rows = texts(5, 320)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in ngram_join.ngram_jaccard_join(docs, 4, 85, group_shingles=parts).collect()}
    component, size, links = brute(rows, 4, 85)
    assert len(got) == len(rows)
    assert {i: r.component_id for i, r in got.items()} == component
    assert {i: r.n_shingles for i, r in got.items()} == size
    assert {i: r.n_links for i, r in got.items()} == links


def test_overlaps_derived_from_pivots_are_exact():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 10**6, 200).astype(np.uint64))
    sets = []
    for _ in range(150):
        s = base.copy()
        s[rng.integers(0, len(s), 9)] = rng.integers(10**6, 10**7, 9)
        sets.append(np.unique(s))
    sets.sort(key=len)
    sizes = np.array([len(s) for s in sets])
    for x, row, low in ngram_join._Group(80)._overlaps(sets, sizes):
        for k, y in enumerate(range(low, x)):
            assert row[k] == len(np.intersect1d(sets[x], sets[y]))


def test_empty_and_odd_tables(spark):
    schema = "text string, doc_id long, rep string, n int"
    assert ngram_join.ngram_jaccard_join(spark.createDataFrame([], schema)).count() == 0
    rows = [("a b c d e f", 1, "x", 1), ("a b c d e f", 1, "x", 1), ("a b c d e f", None, "y", 2), (None, None, None, None)]
    got = ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 0), (1, 1), (1, 1)]
    kept = ngram_join.first_of_each_group(spark.createDataFrame(rows, schema))
    assert kept.columns == ["text", "doc_id", "rep", "n"] and kept.count() == 4


def test_one_row_of_each_group_stays_whatever_the_columns_are_called(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(3, text, 1, "a"), (5, text + " more", 2, "b"), (3, text, 3, "c"), (None, text, 4, "d"), (7, None, 5, "e"), (8, "x " * 9, 6, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id long, kept string")
    got = ngram_join.first_of_each_group(docs)
    assert got.columns == docs.columns
    assert sorted(r._id for r in got.collect()) == [1, 3, 4, 5, 6]
