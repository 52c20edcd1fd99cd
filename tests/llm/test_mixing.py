import random
from fractions import Fraction

from pyspark.sql import functions as F

from palimpsest.llm import mixing


def targets(sizes, weights=(5, 2, 1), passes=3):
    """Targets by resharing the excess until nothing is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, left, open_ = {}, Fraction(sum(sizes.values())), set(names)
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        full = {s for s in open_ if level * weight[s] > passes * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = Fraction(passes * sizes[s])
            left -= out[s]
        open_ -= full


def plain_sainte_lague(votes, seats):
    won = [0] * len(votes)
    for _ in range(seats):
        k = max(range(len(votes)), key=lambda i: (Fraction(votes[i], 2 * won[i] + 1), -i))
        won[k] += 1
    return won


def test_quotas_go_by_highest_quotients(spark):
    rng = random.Random(2)
    rows, expected = [], {}
    for g in range(25):
        votes = [rng.choice([1, 7, 50, 1000]) * rng.randrange(1, 60) for _ in range(rng.randrange(1, 14))]
        seats = rng.choice([0, 1, 3, 20, 300])
        for k, won in enumerate(plain_sainte_lague(votes, seats)):
            expected[g, k] = won
        rows += [(g, k, v, seats) for k, v in enumerate(votes)]
    parties = spark.createDataFrame(rows, "g long, k long, votes long, seats long")
    got = {(r.g, r.k): r.quota for r in mixing.sainte_lague(parties, ["g"], "k", "votes", "seats").collect()}
    assert got == expected


def check(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit("x"), "block": F.lit(1)})
    got = mixing.mix(docs.repartition(3), **options).collect()
    assert len(got) == len(rows)
    size = {}
    for _, text, source in rows:
        size[source] = size.get(source, 0) + len((text or "").encode().split())
    expected, taken = targets(size), {}
    for r in got:
        assert r.source_size == size[r.source]
        assert abs(r.target - expected[r.source]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in expected.items():
        assert abs(taken[s] - t) <= max(2, 0.03 * t), (s, taken[s], float(t))
    again = mixing.mix(docs.repartition(5), **options).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix(spark):
    rng = random.Random(4)
    rows = [(k, "w " * rng.choice([0, 1, 9, 80, 700]), rng.choice(["a", "a", "a", "b", "é", "c", None])) for k in range(400)]
    rows += [(1000, None, "tiny"), (1001, "one two three", "tiny"), (None, "x y", None)]
    check(spark, rows)
    check(spark, rows, shard_words=2000, block_words=16)


def test_small_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs).count() == 0
    row = mixing.mix(spark.createDataFrame([(1, "", "a")], docs.schema)).first()
    assert (row.taken, row.target, row.source_size) == (0, 0.0, 0)
    row = mixing.mix(spark.createDataFrame([(1, "a b", "a")], docs.schema)).first()
    assert (row.taken, row.target, row.source_size) == (2, 2.0, 2)


def test_documents_keep_their_columns_whatever_their_names_and_ids(spark):
    rng = random.Random(12)
    rows = [(1, "w " * 50, "a", "x", 1), (1, "w " * 2, "a", "y", 2), (1, "w " * 2, "a", "y", 2), (None, "w w", None, "z", 3), (2, None, "a", "u", 4), (3, " ", "b", "v", 5)]
    rows += [(k, "w " * rng.randrange(90), rng.choice("abc"), "t", k) for k in range(10, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, taken string, _id long")
    got = mixing.mixed_documents(docs.repartition(3)).collect()
    assert mixing.mixed_documents(docs).columns == ["doc_id", "text", "source", "_id", "size", "source_size", "target", "taken"]
    assert all(r.size == len(r.text.split()) and 0 < r.taken <= 3 * r.size for r in got)
    plain = mixing.mix(docs).where("taken > 0").collect()
    key = lambda r: (str(r.doc_id), r.size, r.source_size, r.target, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, plain))
    assert sorted(map(key, mixing.mixed_documents(docs.repartition(2)).collect())) == sorted(map(key, got))
    assert mixing.mixed_documents(docs.limit(0)).count() == 0
