"""The pipeline against plain versions of its stages, each on what the stage before it kept."""

import numpy as np
import pytest

from pyspark.sql import functions as F

import corpus_pipeline as cp
from palimpsest.llm import toxicity
from palimpsest.llm.line_dedup import Units

SF = "/root/testdata/sf0.001"


def shingles(text, width=5):
    seq = (text or "").encode().lower().split()
    return {tuple(seq[k : k + width]) for k in range(max(1, len(seq) - width + 1))} if seq else set()


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [{r.doc_id: r for r in docs.collect()}]
    columns = docs.columns
    for name, stage in cp.STAGES:
        docs = cp.stored(stage(spark, docs, SF), "test-stage")
        if name != cp.STAGES[-1][0]:
            assert docs.columns == columns
        out.append({r.doc_id: r for r in docs.collect()})
    return out


def test_toxic_documents_go_and_no_others(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bad = {r.doc_id for r in toxicity.score_documents(docs, labels).where("predicted = 1").collect()}
    assert set(stages[1]) == set(stages[0]) - bad and bad
    assert all(stages[1][d] == stages[0][d] for d in stages[1])


def plain_dedup(texts):
    """Texts in order, without the runs of lines of 20 words that an earlier one holds."""
    seen, out = set(), []
    for text in texts:
        raw = (text or "").encode()
        u = Units(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 6)
        size, own, gone = u.n_words.tolist(), set(), set()
        last = len(size) - (1 if size and size[-1] < 6 else 0)
        for k in range(last):
            end = k
            while end < last and sum(size[k:end]) < 20:
                end += 1
            if sum(size[k:end]) >= 20:
                run = tuple(u.hashes[k:end].tolist())
                own.add(run)
                if run in seen:
                    gone |= set(range(k, end))
        seen |= own
        edges = [0, *u.starts[1:].tolist(), len(raw)]
        left = b"".join(raw[edges[k] : edges[k + 1]] for k in range(len(size)) if k not in gone)
        out.append(left.decode() if gone else text)
    return out


def test_repeated_passages_go_from_later_documents(stages):
    before, after = stages[1], stages[2]
    ids = sorted(before)
    for d, left in zip(ids, plain_dedup([before[d].text for d in ids]), strict=True):
        if left == before[d].text or left.split():
            assert after[d].text == left and after[d].n_chars == len(left)
        else:  # all of it was seen before
            assert d not in after
    assert len(after) < len(before) and sum(after[d].text != before[d].text for d in after) > 3


def test_one_of_each_similar_group_stays(stages):
    sets = {d: shingles(r.text) for d, r in stages[2].items()}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    assert set(stages[3]) == {d for d in ids if find(d) == d}


def test_contaminated_documents_go(spark, stages):
    items = [shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {d for d, r in stages[3].items() if any(100 * len(i & shingles(r.text)) >= 80 * len(i) for i in items)}
    assert set(stages[4]) == set(stages[3]) - bad


def test_the_mix_takes_near_its_targets(stages):
    taken, target = {}, {}
    for r in stages[5].values():
        assert 0 < r.taken <= 3 * r.size and r.size == len(r.text.encode().split())
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    for s in target:
        assert abs(taken[s] - target[s]) <= max(2, 0.05 * target[s])


def test_run_equals_the_stages(spark, stages):
    got = {r.doc_id: r for r in cp.run(spark, SF).collect()}
    assert got == stages[5]
    assert cp.ORACLE_SQL is None


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = cp.stored(stage(spark, docs, SF), "test-empty")
    assert docs.count() == 0


def test_stages_pass_columns_of_any_name_nulls_and_repeated_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = docs.withColumns({k: F.lit(k) for k in ("_id", "rep", "kept", "grp", "_removed", "removed_words", "taken", "c0", "entries")})
    odd = odd.unionByName(odd.limit(3)).unionByName(odd.limit(1).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit(None).cast("string"), "source": F.lit(None).cast("string")}))
    odd = odd.unionByName(odd.limit(1).withColumn("text", F.lit("")))
    now = odd
    for name, stage in cp.STAGES:
        now = cp.stored(stage(spark, now, SF), "test-odd")
        if name != cp.STAGES[-1][0]:
            assert now.columns == odd.columns
    assert set(odd.columns) - {"taken"} < set(now.columns) and 0 < now.count() <= odd.count()
    assert all(r.rep == "rep" and r.c0 == "c0" and isinstance(r.taken, int) for r in now.collect())
