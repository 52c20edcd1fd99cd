"""Exact Jaccard self-join on sets of word n-grams, with set-relation skipping.

1. Documents with the same set form one class, so copies are never paired with one another.
2. Shingles are put in one global order, rare ones first, as estimated by fixed-size counters over
   all shingles of all documents (by the counters' magnitude, in a byte each). Two sets that are similar enough share at least ``least_shared``
   shingles within the short prefixes that the threshold leaves them.
3. The prefix lists are sorted by (shingle, size) over all tasks, by range, so that no list has to
   fit in one task. A list of a few sets counts one shared shingle for each pair of them, and pairs
   with enough are candidates. In a longer list, or one on a task border, neighbours whose sizes
   allow a link are tied to the first of their run: one row a list entry, never pairs. What hangs
   together so is a candidate group. Every link lies within one: either all its shared prefix
   shingles are in short lists, and it is counted, or one is not, and it is tied.
4. Each group is joined exactly, over its members' whole sets. Index lists hold members by size, in
   blocks that are skipped when their sizes rule out a link; the overlaps of a set are derived from
   those of a similar set computed before, by way of only those lists in which the two differ. A
   group above a size limit is cut in parts, and each pair of parts is a task of its own.
5. Links (a spanning forest a task) are closed to components.

Defined cases: a null or blank text has an empty set and no links; a text of fewer words than the
n-gram width has its whole sequence as its one shingle; rows that repeat an id are united under it;
a null id is linked with nothing; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import sketch, words
from palimpsest.llm.columns import numbered
from palimpsest.llm.graph import components
from palimpsest.session import ship, stored

#: Shingles that one task joins in memory; larger groups are cut.
GROUP_SHINGLES = 2_000_000
BLOCK_SETS = 4096
PIVOTS = 4
#: Lists of at most so many sets are counted by pair, 28 at most.
SHORT_LIST = 8
ORDER_BITS = 23


def least_shared(n):
    """How many prefix shingles a link shares with a set of n shingles, which lengthens its prefix by as many."""
    return 1 + n // 50


def _profiles(width: int, percent: int, counts):
    """mapInArrow function: id, size, two checksums of the set and its prefix in the global order."""
    shift = np.uint64(64 - int(np.log2(len(counts.value))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counts.value
        for batch in batches:
            n, one, two, prefix = [], [], [], []
            for _, s in words.shingle_sets(batch.column(1), width):
                n.append(len(s))
                one.append(words.mix(s).sum(dtype=np.uint64))
                two.append(words.mix(s ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64))
                order = np.argsort(count[s >> shift], kind="stable")
                prefix.append(s[order[: len(s) - -(-percent * len(s) // 100) + least_shared(len(s))]])
            at = np.cumsum([0, *map(len, prefix)])
            flat = np.concatenate(prefix) if prefix else np.zeros(0, np.uint64)
            yield pa.record_batch(
                {
                    "doc_id": batch.column(0),
                    "n": pa.array(n, pa.int64()),
                    "one": pa.array(np.array(one, np.uint64).view(np.int64)),
                    "two": pa.array(np.array(two, np.uint64).view(np.int64)),
                    "prefix": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.view(np.int64))),
                }
            )

    return run


def _ties(percent: int):
    """mapInArrow function over rows sorted by (token, n, rep): candidate pairs and ties.

    Returns (kind, token, n, a, b): kind 1 is a pair a, b with one shared shingle, ``n`` of which it
    needs; kind 2 ties a to b. The lists on the task's borders are tied, and their rows at the
    border returned as kind 0, to tie them to what lies beyond it.
    """

    def rows(kind, token, n, a, b) -> pa.RecordBatch:
        columns = np.broadcast_arrays(np.int64(kind), token, n, a, b)
        return pa.record_batch([pa.array(np.array(c, np.int64)) for c in columns], ["kind", "token", "n", "a", "b"])

    def lists(t, n, r, first: bool, last: bool) -> Iterator[pa.RecordBatch]:
        """All lists of these rows; the first and the last one may go on beyond them."""
        begins = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        size = np.diff([*begins, len(t)])
        short = size <= SHORT_LIST
        short[0] &= not first
        short[-1] &= not last
        short = np.repeat(short, size)
        for d in range(1, SHORT_LIST):
            k = np.flatnonzero((t[d:] == t[:-d]) & short[d:] & (n[:-d] * 100 >= percent * n[d:]) & (r[d:] != r[:-d]))
            if len(k):
                low, high = np.minimum(r[k], r[k + d]), np.maximum(r[k], r[k + d])
                yield rows(1, 0, least_shared(n[k]), low, high)
        new = np.concatenate([[True], (t[1:] != t[:-1]) | (n[:-1] * 100 < percent * n[1:])])
        heads = np.repeat(r[new], np.diff([*np.flatnonzero(new), len(t)]))
        tied = ~short & (heads != r)
        if tied.any():
            pairs = np.unique(np.stack([r[tied], heads[tied]]), axis=1)
            yield rows(2, 0, 0, pairs[0], pairs[1])
        if first:
            yield rows(0, t[:1], n[:1], r[:1], r[:1])
        if last:
            yield rows(0, t[-1:], n[-1:], r[-1:], r[-1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = [np.zeros(0, np.int64)] * 3, True
        for batch in batches:
            held = [np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held)]
            whole = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if whole:  # all but the last list
                yield from lists(*(h[:whole] for h in held), first, False)
                held, first = [h[whole:] for h in held], False
        if len(held[0]):
            yield from lists(*held, first, True)

    return run


def _candidate_edges(prefixes: DataFrame, percent: int) -> DataFrame:
    ties = prefixes.repartitionByRange("token", "n", "rep").sortWithinPartitions("token", "n", "rep")
    ties = ties.mapInArrow(_ties(percent), "kind long, token long, n long, a long, b long")
    # Each pair once, with its count; ties once; the two border rows a task stay as they are.
    ties = ties.groupBy("kind", "token", "a", "b", "n").agg(F.count(F.lit(1)).alias("shared"))
    ties = stored(ties, "ties")
    edges = ties.where("kind = 2 OR kind = 1 AND shared >= n").select("a", "b")
    # Tied in order within each token.
    border = ties.where("kind = 0").groupBy("token").agg(F.array_sort(F.collect_set(F.struct("n", "a"))).alias("rows"))
    border = border.where(F.size("rows") > 1).select(
        F.explode(F.arrays_zip(F.slice("rows", 1, F.size("rows") - 1).alias("x"), F.slice("rows", 2, F.size("rows") - 1).alias("y"))).alias("p")
    )
    border = border.where(F.col("p.x.n") * 100 >= percent * F.col("p.y.n")).select(
        F.col("p.x.a").alias("a"), F.col("p.y.a").alias("b")
    )
    return edges.unionByName(border)


class _Group:
    """Exact join of one candidate group (or of two parts of one)."""

    def __init__(self, percent: int):
        self.percent = percent

    def links(self, ids, sides, copies, sets, across: bool) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Edges of a spanning forest of the links, and how many documents each set links to.

        Only links between the two sides count if ``across``.
        """
        sizes = np.array([len(s) for s in sets])
        order = np.lexsort((ids, sizes))
        ids, sides, copies, sizes = ids[order], sides[order], copies[order], sizes[order]
        sets = [sets[k] for k in order]
        m, edges, linked_to, label = len(ids), [], np.zeros(len(ids), np.int64), np.arange(len(ids))
        for x, row, low in self._overlaps(sets, sizes):
            near = row * 100 >= self.percent * (sizes[low : x] + sizes[x] - row)
            near &= ids[low:x] != ids[x]
            if across:
                near &= sides[low:x] != sides[x]
            y = np.flatnonzero(near) + low
            if not len(y):
                continue
            linked_to[x] += copies[y].sum()
            linked_to[y] += copies[x]
            parts = np.unique(label[y])
            edges += [(ids[x], ids[p]) for p in parts]
            label[x] = parts[0]
            if len(parts) > 1:
                label[np.isin(label, parts[1:])] = parts[0]
        back = np.empty(m, np.int64)
        back[order] = linked_to
        return edges, back

    def _overlaps(self, sets, sizes) -> Iterator[tuple[int, np.ndarray, int]]:
        """For each set x, its overlaps with sets low..x-1, the only ones whose sizes allow a link."""
        m = len(sets)
        if m == 2:
            yield 1, np.array([len(np.intersect1d(*sets, assume_unique=True))]), 0
            return
        tokens, local = np.unique(np.concatenate(sets), return_inverse=True)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        owner = np.repeat(np.arange(m), sizes)
        by_token = np.argsort(local, kind="stable")
        lists = owner[by_token]
        place = local[by_token] * m + lists  # sorted: by shingle, then by size
        ends = np.searchsorted(place, np.arange(1, len(tokens) + 1) * m)
        shared = np.diff(ends, prepend=0) > 1
        block, starts, lengths = -1, ends, ends
        pivots: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for x in range(1, m):
            low = int(np.searchsorted(sizes, -(-self.percent * sizes[x] // 100)))
            if low >= x:
                continue
            if low // BLOCK_SETS != block:  # sets of the blocks before are too small from here on
                block = low // BLOCK_SETS
                starts = np.searchsorted(place, np.arange(len(tokens)) * m + block * BLOCK_SETS)
                lengths = ends - starts
            own = local[bounds[x] : bounds[x + 1]]
            own = own[shared[own]]
            best, cheapest = None, int(lengths[own].sum()) // 2
            for member, theirs, base in pivots:
                plus = own[~member[own]]
                if 2 * (len(own) - len(plus)) > len(theirs):
                    minus = np.setdiff1d(theirs, own, assume_unique=True)
                    cost = int(lengths[plus].sum() + lengths[minus].sum())
                    if cost < cheapest:
                        best, cheapest = (base, plus, minus), cost
            if best is None:
                row = np.bincount(self._entries(lists, starts, lengths, own), minlength=m)
                member = np.zeros(len(tokens), bool)
                member[own] = True
                pivots = [(member, own, row), *pivots[: PIVOTS - 1]]
            else:
                base, plus, minus = best
                row = base + np.bincount(self._entries(lists, starts, lengths, plus), minlength=m)
                row -= np.bincount(self._entries(lists, starts, lengths, minus), minlength=m)
            yield x, row[low:x], low

    @staticmethod
    def _entries(lists, starts, lengths, tokens) -> np.ndarray:
        n = lengths[tokens]
        total = int(n.sum())
        if not total:
            return np.zeros(0, np.int64)
        ends = np.cumsum(n)
        return lists[np.repeat(starts[tokens] - (ends - n), n) + np.arange(total)]


def _join_groups(width: int, percent: int):
    """mapInArrow function over rows (grp, i, j, side, rep, copies, text) sorted by group."""
    group = _Group(percent)

    def flush(key, rows) -> tuple[list, list]:
        seen, kept = set(), []
        for side, rep, copies, s in rows:
            mark = (rep, s.tobytes())
            if mark not in seen and len(s):
                seen.add(mark)
                kept.append((side, rep, copies, s))
        if len(kept) < 2:
            return [], []
        sides, ids, copies = (np.array([k[i] for k in kept], np.int64) for i in range(3))
        edges, linked = group.links(ids, sides, copies, [k[3] for k in kept], key[1] != key[2])
        return edges, [(i, n) for i, n in zip(ids, linked, strict=True) if n]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            grp, i, j, side, rep, copies = (batch.column(k).to_pylist() for k in range(6))
            for row, s in words.shingle_sets(batch.column(6), width):
                if (grp[row], i[row], j[row]) != key:
                    edges, linked = flush(key, rows)
                    out += [(a, b, 0) for a, b in edges] + [(a, a, n) for a, n in linked]
                    key, rows = (grp[row], i[row], j[row]), []
                rows.append((side[row], rep[row], copies[row], s))
            if out:
                yield _edge_batch(out)
        edges, linked = flush(key, rows)
        if edges:
            yield _edge_batch([(a, b, 0) for a, b in edges] + [(a, a, n) for a, n in linked])

    return run


def _edge_batch(rows) -> pa.RecordBatch:
    a, b, n = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    return pa.record_batch({"a": pa.array(a), "b": pa.array(b), "links": pa.array(n)})


def _keep_ids(bits: int, counts):
    """mapInArrow function: only rows whose id may be one of the counted ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present = counts.value > 0
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(present[words.mix(ids.astype(np.uint64)) >> np.uint64(64 - bits)]))

    return run


def ngram_jaccard_join(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_shingles: int = GROUP_SHINGLES,
) -> DataFrame:
    """Return doc_id, n_shingles, component_id, class_id, class_size and n_links per document.

    Two documents link when 100 * |intersection| >= percent * |union|. class_id is the least id
    with the same set; n_links counts the other documents that a document links to.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = sketch.hash_counts(
        texts.select("text"),
        lambda batch: (s for _, s in words.shingle_sets(batch.column(0), width)),
        ORDER_BITS,
        sketch.magnitude,
    )
    order = spark.sparkContext.broadcast(counts)
    profiles = texts.mapInArrow(
        _profiles(width, percent, order), "doc_id long, n long, one long, two long, prefix array<long>"
    )
    profiles = stored(profiles, "profiles")
    order.destroy()
    keys = ["n", "one", "two"]
    classes = profiles.where("n > 0 AND doc_id IS NOT NULL").groupBy(*keys).agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")
    )
    members = profiles.join(classes, keys, "left").select(
        "doc_id",
        "n",
        F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep"),
        F.when(F.col("doc_id").isNotNull(), F.col("copies")).alias("copies"),
        F.when(F.col("doc_id") == F.col("rep"), F.col("prefix")).alias("prefix"),
    )
    members = stored(members, "members")
    reps = members.where("doc_id = rep")
    prefixes = reps.select(F.explode("prefix").alias("token"), "n", "rep")
    groups = components(_candidate_edges(prefixes, percent))
    groups = stored(groups.join(reps.groupBy("rep").agg(F.max("n").alias("n"), F.max("copies").alias("copies")), F.col("node") == F.col("rep")).drop("node"), "groups")
    sizes = groups.groupBy("component").agg(F.ceil(F.sum("n") / group_shingles).alias("parts"))
    dealt = groups.join(sizes, "component").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        F.col("component").alias("grp"),
        F.least("part", "other").alias("i"),
        F.greatest("part", "other").alias("j"),
        F.col("part").alias("side"),
        "rep",
        "copies",
    )
    bits = 21
    wanted = spark.sparkContext.broadcast(
        sketch.hash_counts(
            groups.select("rep"),
            lambda batch: [words.mix(batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64))],
            bits,
            sketch.cut(np.uint8),
        )
    )
    some = texts.mapInArrow(_keep_ids(bits, wanted), "doc_id long, text string")
    joined = (
        some.join(dealt, F.col("doc_id") == F.col("rep"))
        .select("grp", "i", "j", "side", "rep", "copies", "text")
        .repartition("grp", "i", "j")
        .sortWithinPartitions("grp", "i", "j", "rep")
    )
    links = stored(joined.mapInArrow(_join_groups(width, percent), "a long, b long, links long"), "links")
    wanted.destroy()
    labels = components(links.where("links = 0").select("a", "b"))
    degree = links.where("links > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    known = labels.withColumnRenamed("node", "rep").join(degree, "rep", "left")
    return members.drop("prefix").join(known, "rep", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "rep", "doc_id").alias("component_id"),
        F.coalesce("rep", "doc_id").alias("class_id"),
        F.coalesce("copies", F.lit(1)).alias("class_size"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
    )


def first_of_each_group(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Of each component of near-duplicates, the document with the least id, all columns as they were.

    Rows that repeat that id stay with it, and so do rows without an id.
    """
    joined = ngram_jaccard_join(docs, width, percent)
    keep = joined.where("doc_id = component_id OR doc_id IS NULL").select(F.col("doc_id").alias("kept")).distinct()
    own = numbered(docs)
    key = F.col(own.columns[docs.columns.index("doc_id")]).cast("long")
    return own.join(keep, key.eqNullSafe(F.col("kept")), "left_semi").toDF(*docs.columns)


#: The query with four words and 85 percent; equal sets are told by their listed shingles.
ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS v
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(v) = 0 THEN [] WHEN len(v) < 4 THEN [array_to_string(v, ' ')]
    ELSE list_transform(range(1, len(v) - 2), lambda k: array_to_string(v[k:k + 3], ' ')) END) AS g
  FROM t),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS same FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * o >= 85 * (nx.n + ny.n - o)),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
least_of AS (SELECT x, min(y) AS y FROM reach GROUP BY 1),
degree AS (SELECT x, count(*) AS n_links FROM links GROUP BY 1),
classes AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY same) AS class_id, count(*) OVER (PARTITION BY same) AS class_size FROM n)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) AS component_id,
       coalesce(c.class_id, d.doc_id) AS class_id, coalesce(c.class_size, 1) AS class_size, coalesce(e.n_links, 0) AS n_links
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least_of m ON m.x = d.doc_id LEFT JOIN degree e ON e.x = d.doc_id
     LEFT JOIN classes c ON c.doc_id = d.doc_id
"""
