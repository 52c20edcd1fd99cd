import hashlib
import random

import pytest

from palimpsest.llm import exact_dedup as ed


def brute(rows):
    groups = {}
    for i, text in rows:
        key = "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")
        groups.setdefault(key, []).append((i, text or ""))
    out = {}
    for key, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0]))[0]
        for i, _ in members:
            out[i] = (keep, len(members), i == keep, hashlib.sha256(key.encode()).hexdigest())
    return out


def test_one_batch_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice(["", None, "a b", "ab", "a\tb\n", "é é", "éé", "a b", "x" * 1000])) for k in rng.sample(range(1000), 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("x", "digest").repartition(4)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in ed.exact_dedup(docs).collect()}
    assert got == brute(rows)


def test_batches_share_an_index(spark, tmp_path):
    schema = "doc_id long, text string, digest int, n_points int"
    first = spark.createDataFrame([(5, "a b", 1, 1), (6, "c", 1, 1)], schema)
    second = spark.createDataFrame([(1, "a  b", 2, 2), (2, "d", 2, 2), (3, "d", 2, 2), (None, "e", 2, 2), (None, "d", 2, 2)], schema)
    path = str(tmp_path / "index")
    ed.DigestIndex(spark, path, 4).append(first)
    again = ed.DigestIndex(spark, path, 4)  # another session would attach to the same folder
    got = sorted((r.doc_id or -1, r.keep_id or -1, r.kept, r.group_size) for r in again.append(second).collect())
    assert got == [(-1, -1, True, 1), (-1, 2, False, 3), (1, 5, False, 1), (2, 2, True, 3), (3, 2, False, 3)]
    assert again.rows().count() == 4
    assert "Exchange" not in again.rows().groupBy("digest").count()._jdf.queryExecution().sparkPlan().toString()
    assert again.append(first.limit(0)).count() == 0


def test_sessions_with_other_settings_use_the_index_as_it_was_made(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = [(k, f"text {k}") for k in range(200)]
    ed.DigestIndex(spark, path, 8).append(spark.createDataFrame(rows, "doc_id long, text string"))
    copies = spark.createDataFrame([(1000 + k, t) for k, t in rows], "doc_id long, text string")
    for buckets in (4, 16, None):
        index = ed.DigestIndex(spark, path, buckets)
        assert index.buckets == 8
        assert {(r.doc_id, r.keep_id, r.kept) for r in index.append(copies).collect()} == {(1000 + k, k, False) for k in range(200)}
        assert index.rows().count() == 200
        index.close()
    small = ed.DigestIndex(spark, path).compacted(str(tmp_path / "other"))
    assert small.rows().count() == 200 and small.buckets == 8
    assert len(list((tmp_path / "other").glob("part-*"))) <= 8
    (tmp_path / "index-buckets").rename(tmp_path / "gone")
    with pytest.raises(ValueError):
        ed.DigestIndex(spark, path, 8)


def test_repeated_rows_very_long_texts_and_empty_tables(spark):
    long = "a b " * 500_000
    rows = [(4, long), (4, long), (2, long.replace(" ", "")), (9, long + " "), (7, None), (7, ""), (8, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in ed.exact_dedup(docs).collect())
    assert got == [(2, 9, 4, False), (4, 9, 4, False), (4, 9, 4, False), (7, 8, 3, False), (7, 8, 3, False), (8, 8, 3, True), (9, 9, 4, True)]
    assert ed.exact_dedup(docs.limit(0)).count() == 0
