"""Benchmark decontamination: size-partitioned MinHash containment search, then exact containment.

Test items are short and documents may be thousands of times longer, so the Jaccard value of a pair
says nothing; what counts is how much of the item a document contains. Items are partitioned by
their number of shingles. Each item is sketched by its m least shingle hashes (bottom-m MinHash),
where m is at least ``least_sketch`` and more than the share of shingles that a match may lack, so
a document that contains enough of the item holds at least one hash of the sketch: the search
misses nothing. For each partition, documents are probed only with shingle hashes up to the
partition's greatest sketch hash, which thins the probes for partitions of long items. Every
candidate is then verified over the whole document by exact shingle containment.

The documents are read once for each block of items and never shuffled. A block is limited by its
shingles, whatever the size of the benchmark; its sketch tables are what is broadcast.

Defined cases: an item of fewer words than the shingle width is searched as one run of all its
words; an item without words, or a document without, matches nothing; repeated items and documents
give repeated matches; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import words
from palimpsest.session import ship, stored

#: Item shingles searched in one pass over the documents, and so the bound on what is broadcast.
BLOCK_SHINGLES = 2_000_000
TABLE_BITS = 20


def item_sets(items: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """item_id, width (less than ``width`` for shorter items), n and hashes of every item with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = words.string_column(batch.column(1))
            ids, widths, sets = [], [], []
            for row, item in enumerate(batch.column(0).to_pylist()):
                own, bounds = words.word_hashes(data, offsets[row : row + 2])
                if len(own):
                    w = min(width, len(own))
                    ids.append(item)
                    widths.append(w)
                    sets.append(np.unique(words.shingle_hashes(own, bounds, w)[0]).view(np.int64).tolist())
            yield pa.record_batch(
                {
                    "item_id": pa.array(ids, pa.int64()),
                    "width": pa.array(widths, pa.int32()),
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "hashes": pa.array(sets, pa.list_(pa.int64())),
                }
            )

    some = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return some.mapInArrow(run, "item_id long, width int, n long, hashes array<long>")


class _Partition:
    """Items of one shingle width and one size class: sketch table and whole sets."""

    def __init__(self, rows: list[tuple[int, np.ndarray]], percent: int, least_sketch: int):
        self.ids = [item for item, _ in rows]
        self.sets = [np.sort(hashes.view(np.uint64)) for _, hashes in rows]
        sketches = [s[: max(least_sketch, len(s) - -(-percent * len(s) // 100) + 1)] for s in self.sets]
        hashes = np.concatenate(sketches)
        owners = np.repeat(np.arange(len(rows)), [len(s) for s in sketches])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owners = hashes[order], owners[order]
        self.limit = self.hashes[-1]
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self.hashes & np.uint64((1 << TABLE_BITS) - 1)] = True

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of the hashes that belong to a sketch."""
        at = np.flatnonzero(self.table[hashes & np.uint64((1 << TABLE_BITS) - 1)] & (hashes <= self.limit))
        found = np.searchsorted(self.hashes, hashes[at])
        return at[self.hashes[found] == hashes[at]]

    def candidates(self, hashes: np.ndarray) -> np.ndarray:
        left, right = (np.searchsorted(self.hashes, hashes, side) for side in ("left", "right"))
        return np.unique(np.concatenate([self.owners[a:b] for a, b in zip(left, right, strict=True)]))


def _matches(partitions, texts: pa.Array, percent: int) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, its shingles, those shared) of every item that a text contains."""
    by_width: dict[int, list[_Partition]] = {}
    for (w, _), p in partitions.items():
        by_width.setdefault(w, []).append(p)
    data, offsets = words.string_column(texts)
    for first, last in words.slices(offsets):
        own, bounds = words.word_hashes(data, offsets[first : last + 1])
        for w, group in by_width.items():
            hashes, at = words.shingle_hashes(own, bounds, w)
            for p in group:
                hits = p.hits(hashes)
                rows = np.searchsorted(at, hits, "right") - 1
                for row in np.unique(rows):
                    if bounds[row + 1] - bounds[row] < w:
                        continue
                    text = np.unique(hashes[at[row] : at[row + 1]])
                    for k in p.candidates(np.unique(hashes[hits[rows == row]])):
                        n = len(p.sets[k])
                        shared = len(np.intersect1d(p.sets[k], text, assume_unique=True))
                        if shared * 100 >= percent * n:
                            yield int(first + row), p.ids[k], n, shared


def _search(partitions, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out = [(ids[row], *match) for row, *match in _matches(partitions.value, batch.column(1), percent)]
            columns = zip(*out, strict=True) if out else ((), (), (), ())
            names = ("doc_id", "item_id", "n_item", "n_shared")
            yield pa.record_batch({c: pa.array(v, pa.int64()) for c, v in zip(names, columns, strict=True)})

    return run


def _clean(partitions, percent: int, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[row for row, *_ in _matches(partitions.value, batch.column(text_at), percent)]] = False
            yield batch.filter(pa.array(keep))

    return run


def _blocks(items: DataFrame, width: int, percent: int, least_sketch: int, id_col: str, text_col: str) -> Iterator[dict]:
    """The items' partitions, a block of at most BLOCK_SHINGLES or so at a time."""
    sets = stored(item_sets(items, width, id_col, text_col), "items")
    total = sets.agg(F.sum("n")).first()[0] or 0
    blocks = -(-total // BLOCK_SHINGLES)
    for block in range(blocks):
        by_partition: dict[tuple[int, int], list] = {}
        rows = sets.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toArrow()  # as large as a block
        for item, width_, n, hashes in zip(*rows.columns, strict=True):
            key = (width_.as_py(), n.as_py().bit_length())
            by_partition.setdefault(key, []).append((item.as_py(), hashes.values.to_numpy(zero_copy_only=False)))
        if by_partition:
            yield {k: _Partition(rows, percent, least_sketch) for k, rows in by_partition.items()}


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    width: int = 5,
    percent: int = 80,
    least_sketch: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Return doc_id, item_id, n_item, n_shared, containment for every item that a document contains
    to ``percent`` or more of its shingles."""
    ship(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, item_id long, n_item long, n_shared long"
    found = [
        texts.mapInArrow(_search(context.broadcast(block), percent), schema)
        for block in _blocks(items, width, percent, least_sketch, item_id_col, item_text_col)
    ]
    matches = reduce(DataFrame.unionByName, found or [docs.sparkSession.createDataFrame([], schema)])
    return matches.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def without_contaminated(
    docs: DataFrame,
    items: DataFrame,
    width: int = 5,
    percent: int = 80,
    least_sketch: int = 8,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The documents that contain no test item, all columns as they were; nothing is shuffled."""
    ship(docs.sparkSession)
    at, kept = docs.columns.index(text_col), docs
    for block in _blocks(items, width, percent, least_sketch, item_id_col, item_text_col):
        kept = kept.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(block), percent, at), docs.schema)
    return kept


ORACLE = r"""
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
t AS (
  SELECT kind, id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS v
  FROM w),
s AS (
  SELECT DISTINCT kind, id, unnest(list_transform(range(1, len(v) - 3), lambda k: array_to_string(v[k:k + 4], ' '))) AS g
  FROM t WHERE len(v) >= 5),
n AS (SELECT id, count(*) AS n_item FROM s WHERE kind = 'i' GROUP BY id),
m AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared
  FROM s d JOIN s i ON d.g = i.g AND d.kind = 'd' AND i.kind = 'i' GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
FROM m JOIN n ON n.id = m.item_id WHERE n_shared * 100 >= 80 * n_item
"""
