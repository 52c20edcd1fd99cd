"""The helpers that the operators share."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from palimpsest.llm import columns, graph, linear, sampling, sketch


def test_components_equal_a_union_find(spark):
    rng = random.Random(1)
    for n, m in ((200, 150), (30, 0)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        edges += [(500 + k, 501 + k) for k in range(40)] + [(900, 900), (900, 901), (901, 900), (1000, 2000)] + [(3000, 3001 + k) for k in range(50)] if m else []
        parent = {}

        def find(x, parent=parent):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in edges:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
        linked = {x for a, b in edges if a != b for x in (a, b)}
        frame = spark.createDataFrame(edges + [(None, 1), (1, None)], "a long, b long").repartition(3)
        got = [tuple(r) for r in graph.components(frame).select("node", "component").collect()]
        assert sorted(got) == sorted((x, find(x)) for x in linked)


def test_counters_add_up(spark):
    rng = np.random.default_rng(2)
    values = rng.integers(0, 2**63, 5000) // 2**40 * 2**40
    values = np.concatenate([values, np.full(70_000, values[0])])
    frame = spark.createDataFrame([(int(v),) for v in values], "v long").repartition(3)
    hashes = lambda batch: [batch.column(0).to_numpy().astype(np.uint64)]
    expected = np.bincount((values.astype(np.uint64) >> np.uint64(48)).astype(np.int64), minlength=1 << 16)
    assert (sketch.hash_counts(frame, hashes, 16) == expected).all()
    assert (sketch.hash_counts(frame, hashes, 16, sketch.cut(np.uint8)) == np.minimum(expected, 255)).all()
    assert (sketch.hash_counts(frame, hashes, 16, sketch.magnitude) == sketch.magnitude(expected)).all()
    assert not sketch.hash_counts(frame.limit(0), hashes, 16).any()


def test_magnitudes_keep_the_order():
    counts = np.unique(np.concatenate([np.arange(300), 2 ** np.arange(40), 3 ** np.arange(25)])).astype(np.uint64)
    told = sketch.magnitude(counts).astype(int)
    assert (np.diff(told) >= 0).all() and told[:9].tolist() == list(range(9)) and told[-1] == 255


def test_samples_are_the_same_on_every_run(spark):
    rows = spark.range(5000).withColumn("x", F.lit(1))
    some = {r.id for r in sampling.hashed_sample(rows, 500, "id").collect()}
    assert 350 < len(some) < 650
    assert some == {r.id for r in sampling.hashed_sample(rows.repartition(7), 500, "id").collect()}
    assert sampling.hashed_sample(rows, 5000, "id").count() == 5000 and sampling.hashed_sample(rows.limit(0), 5, "id").count() == 0


def plain_ftrl(examples, dim, classes, alpha, beta, l1, l2, epochs, start):
    """FTRL-proximal, one weight at a time."""
    z, n = np.zeros((dim, classes)), np.zeros((dim, classes))

    def weight(i, k):
        if abs(z[i, k]) <= l1:
            return 0.0
        return -(z[i, k] - np.sign(z[i, k]) * l1) / ((beta + n[i, k] ** 0.5) / alpha + l2)

    for i in range(dim):
        for k in range(classes):
            z[i, k] -= start[i, k] * (beta / alpha + l2) + np.sign(start[i, k]) * l1
    for _ in range(epochs):
        for features, values, target in examples:
            w = {(i, k): weight(i, k) for i in features for k in range(classes)}
            scores = [sum(v * w[i, k] for i, v in zip(features, values, strict=True)) for k in range(classes)]
            if classes == 1:
                p = [1 / (1 + np.exp(-scores[0]))]
            else:
                e = np.exp(np.array(scores) - max(scores))
                p = e / e.sum()
            for i, v in zip(features, values, strict=True):
                for k in range(classes):
                    g = v * (p[k] - target[k])
                    sigma = ((n[i, k] + g * g) ** 0.5 - n[i, k] ** 0.5) / alpha
                    z[i, k] += g - sigma * w[i, k]
                    n[i, k] += g * g
    return np.array([[weight(i, k) for k in range(classes)] for i in range(dim)])


def test_ftrl_equals_a_plain_one():
    rng = np.random.default_rng(3)
    for classes in (1, 3):
        examples = []
        for _ in range(40):
            features = rng.choice(12, 5, replace=False)
            target = np.eye(classes)[rng.integers(classes)] if classes > 1 else np.array([float(rng.integers(2))])
            examples.append((features, rng.random(5) * 2, target))
        model = linear.Ftrl(12, classes, alpha=0.4, beta=1.0, l1=1.5, l2=0.2)
        for start in (np.zeros((12, classes)), rng.normal(size=(12, classes))):
            got = model.fit(examples, 3, start)
            assert np.allclose(got, plain_ftrl(examples, 12, classes, 0.4, 1.0, 1.5, 0.2, 3, start))
            assert (got == 0).any()


def test_training_averages_the_tasks_by_their_rows(spark):
    rows = [(k, k % 3) for k in range(50)]
    frame = spark.createDataFrame(rows, "ord long, x int")
    model = linear.Ftrl(3, 1, l1=0.1)

    def examples(batch):
        for x in batch.column(1).to_pylist():
            yield np.array([x]), np.ones(1), np.array([float(x > 0)])

    got = linear.train(frame, model, examples, tasks=4, rounds=2, epochs=1)
    dealt = frame.repartition(4, F.pmod("ord", F.lit(4))).select("ord", F.spark_partition_id().alias("task")).collect()
    task_of = {r.ord: r.task for r in dealt}
    assert len(set(task_of.values())) > 1
    weights = np.zeros((3, 1))
    for _ in range(2):
        parts = []
        for task in set(task_of.values()):
            own = [e for k, x in rows if task_of[k] == task for e in examples(pa.record_batch({"ord": [k], "x": [x]}))]
            parts.append((len(own), model.fit(own, 1, weights.astype(np.float32).astype(float))))
        weights = sum(n * w for n, w in parts) / 50
    assert np.allclose(got, weights, atol=1e-6)
    assert not linear.train(frame.limit(0), model, examples).any()


def test_names_never_clash(spark):
    docs = spark.createDataFrame([(1, 2, 3)], "a int, Removed int, _removed int")
    assert columns.unused(docs, "removed") == "__removed" and columns.unused(docs, "b") == "b"
    assert columns.numbered(docs).columns == ["c0", "c1", "c2"]


def test_samples_hold_rare_classes(spark):
    rows = spark.range(6000).withColumn("c", F.when(F.col("id") < 30, "rare").when(F.col("id") < 200, "few").otherwise("many"))
    counts = {"rare": 30, "few": 170, "many": 5800}
    got = {r.c: r["count"] for r in sampling.hashed_sample_by_class(rows, 600, 60, "c", counts, "id").groupBy("c").count().collect()}
    assert got["rare"] == 30 and 40 < got["few"] < 85 and 480 < got["many"] < 680
    assert sampling.hashed_sample_by_class(rows, 9000, 60, "c", counts, "id").count() == 6000
    assert sampling.hashed_sample_by_class(rows, 600, 60, "c", {"rare": 30}, "id").count() == 30
