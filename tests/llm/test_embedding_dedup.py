import inspect
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import embedding_dedup as ed


def brute(rows, threshold=0.93):
    """By row: links, by id: components."""
    n = len(rows)
    usable = [v is not None and i is not None and lab is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v, lab in rows]
    links = [[] for _ in range(n)]
    for p in range(n):
        for q in range(p):
            (_, a, la), (_, b, lb) = rows[p], rows[q]
            if usable[p] and usable[q] and la == lb and len(a) == len(b):
                x, y = (np.array(v, float) / np.abs(v).max() for v in (a, b))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[p].append(q)
                    links[q].append(p)
    label = {i: i for i, _, _ in rows if i is not None}
    changed = True
    while changed:
        changed = False
        for p in range(n):
            for q in links[p]:
                low = min(label[rows[p][0]], label[rows[q][0]])
                for i in (rows[p][0], rows[q][0]):
                    changed |= label[i] != low
                    label[i] = low
    return sorted(((i, len(own), label.get(i), i is None or label[i] == i) for (i, _, _), own in zip(rows, links, strict=True)), key=repr)


def clusters(rng, dim, n, spread, labels=3):
    centres = rng.standard_normal((max(n // 6, 1), dim))
    out = []
    for k in range(n):
        v = centres[rng.integers(len(centres))] * rng.uniform(0.1, 9) + spread * rng.standard_normal(dim)
        out.append((k, [float(np.float32(x)) for x in v], int(rng.integers(labels))))
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize(("dim", "part"), [(64, 4096), (64, 7), (3, 10), (100, 4096), (1, 4096)])
def test_links_and_components_equal_brute_force(spark, dim, part):
    rows = clusters(np.random.default_rng(dim), dim, 150, 0.25 if dim > 1 else 1.0)
    rows += [(500 + k, rows[0][1], rows[0][2]) for k in range(20)]  # copies
    table = spark.createDataFrame(rows, SCHEMA).withColumns({"rep": F.lit(1), "cls": F.lit(2), "n": F.lit("x")}).repartition(4)
    assert rows_of(ed.near_duplicates(table, part=part)) == brute(rows)


def test_defined_cases(spark):
    v = [1.0, 2.0, 3.0]
    rows = [
        (1, v, 1), (2, v, 1), (2, [-5.0, 1.0, 0.0], 1), (3, [-5.0, 1.0, 0.1], 1), (4, v, None), (5, v, None), (6, None, 1), (7, [], 1),
        (8, [0.0, 0.0, 0.0], 1), (9, [0.0, 0.0, 0.0], 1), (10, [1.0, None, 3.0], 1), (11, [1.0, float("nan"), 3.0], 1), (12, [1.0, float("inf"), 3.0], 1),
        (13, [1.0, 2.0], 1), (14, [2.0, 4.0], 1), (None, v, 1), (None, v, 1), (15, [1e30, 2e30, 3e30], 1), (16, [1e-30, 2e-30, 3e-30], 1), (17, [-0.0, 1.0, 0.0], 2), (18, [0.0, 1.0, 0.0], 2),
    ]
    table = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(ed.near_duplicates(table)) == brute(rows)
    assert ed.near_duplicates(table.limit(0)).count() == 0


def test_bands_reach_their_recall(spark):
    """With sending classes at little cost, even small labels are banded; what is found is right, and enough."""
    rows = clusters(np.random.default_rng(7), 64, 900, 0.24, labels=1)
    bits, n_bands = ed.bands(900, 64, 0.93, 0.98, 20)
    assert bits > 3 and n_bands > 3
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r.vec_id: r.n_links for r in ed.near_duplicates(table, sent=20, part=50).collect()}
    want = {i: n for i, n, _, _ in brute(rows)}
    assert all(got[i] <= want[i] for i in want)
    assert sum(got.values()) >= 0.97 * sum(want.values()) > 1000


def test_estimates_are_unbiased_and_their_bound_holds():
    rng = np.random.default_rng(3)
    a = ed.unit_vectors(rng.standard_normal((2000, 64)))
    b = ed.unit_vectors(a + 0.045 * rng.standard_normal((2000, 64)))
    true = (a * b).sum(axis=1)
    x, y = ed.Codes.of(a), ed.Codes.of(b)
    off = np.diag(x.estimates(y)) - true
    assert abs(off.mean()) < 0.004
    high = true >= 0.93
    spread = np.diag(x.spread(y, 0.93))[high]
    assert high.sum() > 200 and 0.5 < off[high].std() / spread.mean() < 1.1
    assert np.diag(x.candidates(y, 0.93))[high].all()
    far = ed.Codes.of(ed.unit_vectors(rng.standard_normal((2000, 64))))
    assert x.candidates(far, 0.93).mean() < 0.001


def test_codes_are_read_as_they_were_packed():
    codes = ed.Codes.of(ed.unit_vectors(np.random.default_rng(1).standard_normal((9, 70))))
    again = ed.Codes.read(codes.packed(), codes.factor, codes.low, codes.step)
    assert (again.signs == codes.signs).all() and (again.levels == codes.levels).all()


def test_a_large_block_is_dealt_to_pairs_of_parts(spark):
    rng = random.Random(1)
    rows = [(k, [1.0 + rng.random() / 100, 1.0, rng.random() / 100], 1) for k in range(300)]  # all are near
    got = ed.near_duplicates(spark.createDataFrame(rows, SCHEMA), part=40).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(299, 0)}


def test_who_meets_whom_does_not_depend_on_the_size_of_a_label():
    """However large its label is said to be, a class goes to one block, which all others of the label share."""
    units = ed.unit_vectors(np.random.default_rng(5).standard_normal((40, 64)))
    defaults = inspect.signature(ed.near_duplicates).parameters
    for n in (40, 10**5, 10**9):
        columns = [pa.array(np.arange(40)), pa.array(np.ones(40, np.int64)), pa.array(np.full(40, 64)), pa.array(np.full(40, n)), pa.array(units.tolist())]
        batch = pa.record_batch(columns, ["cls", "label", "dim", "n", "vector"])
        out = list(ed._codes(0.93, defaults["recall"].default, defaults["sent"].default)(iter([batch])))
        assert sum(len(b) for b in out) == 40 and {x for b in out for x in b.column("bits").to_pylist()} == {0}
