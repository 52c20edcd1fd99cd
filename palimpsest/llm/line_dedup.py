"""Line deduplication by pairwise alignment.

1. Texts are cut at line ends and, as lines may be whole pages, at sentence ends; long sentences are
   cut at words that their hashes pick, the same ones wherever the sentence occurs. Pieces of fewer
   than ``least_line_words`` words are too common to tell documents apart and go with the next piece.
   A line is such a unit of words; its hash ignores white space and the case of A-Z.
2. A passage begins at each line and takes as many lines as make ``least_block_words`` words. Any
   block of so many words that two documents have in common consists of passages that both hold.
   Passage hashes are sorted by (hash, document, position) over all tasks, by range, so that no
   passage has to fit in one task. Each passage that several documents hold is owned by the first of
   them: one row for each passage of a document, so a passage in a third of all documents makes a row
   a document, not all pairs. Lines that are frequent on their own tie no documents and cut no block.
   The hash of such a passage is the rare line hash: a block that two documents share makes a pair of
   the later one and each passage's owner, and what the owner lacks of it has an owner of its own. To
   pair it with further holders would find nothing more, since a passage goes once, whoever holds it.
3. Each (document, owner) pair is aligned by patience diff: passages that are unique in both anchor
   the alignment, the longest increasing run of them is kept, and it grows to neighbours at the same
   distance. (Where a pair has no passage unique in both, all occurrences stand in, a document's nth
   one with the owner's nth.) What moved is aligned next, in blocks, the longest first. Each line is
   aligned once: a passage that would align some line a second time, elsewhere in the owner, is left.
4. The lines of aligned passages go from the later document, that with the greater id. So a document
   loses just those runs of whole lines of ``least_block_words`` words that its alignment with an
   earlier one keeps; tests hold this against a patience diff of all pairs.

Texts are shuffled once, by document. Defined cases: a null or empty text stays as it is; of rows
that repeat an id, equal texts are one document and different ones are ordered by their hash; a null
id comes last; an empty table gives an empty result; other columns are returned as they were, but a
column named like the counter that is added is replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm import words
from palimpsest.session import ship, stored

_LAST = 2**63 - 1
#: Sentences above so many words are cut after every 16th word or so, as the words' hashes have it.
LONG_WORDS = 32


class Units:
    """The lines of some texts: hashes, words, where they start (bytes, from the first text on), and
    each text's bounds in them. A line reaches to the next one."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, least_words: int):
        own, bounds, begin, end = words.word_hashes(data, offsets, places=True)
        n = len(own)
        text, at = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        if not n:
            self.hashes, self.n_words, self.starts = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            self.bounds, self.text_starts = np.zeros(len(offsets), np.int64), at
            return
        last = np.zeros(n, bool)
        last[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = True
        final = last.copy()
        last |= np.isin(text[end - 1], np.frombuffer(b".!?", np.uint8))
        lines = np.concatenate([[0], np.cumsum(text == 10)])
        last[:-1] |= lines[begin[1:]] > lines[end[:-1]]
        size = np.diff(np.flatnonzero(last), prepend=-1)
        last |= np.repeat(size > LONG_WORDS, size) & (own & np.uint64(15) == 0)
        pieces = np.flatnonzero(last)
        size = np.diff(pieces, prepend=-1)
        ends = pieces[(size >= least_words) | final[pieces]]
        firsts = np.concatenate([[0], ends[:-1] + 1])
        forth, back = words.powers(n + 1)
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * forth[:n])])
            hashes = words.mix((total[ends + 1] - total[firsts]) * back[firsts])
        self.hashes, self.n_words, self.starts = hashes.view(np.int64), ends + 1 - firsts, begin[firsts]
        self.bounds, self.text_starts = np.searchsorted(firsts, bounds), at


def passages(u: Units, least_line_words: int, least_block_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of lines of at least ``least_block_words`` words, the shortest from each line on: their
    first lines, the lines after them, and hashes."""
    n = len(u.hashes)
    total = np.concatenate([[0], np.cumsum(u.n_words)])
    sizes = np.diff(u.bounds)
    limit = u.bounds[1:].copy()
    full = np.flatnonzero(sizes)
    limit[full] -= u.n_words[limit[full] - 1] < least_line_words  # a text's last line may be too short
    end = np.searchsorted(total, total[:-1] + least_block_words)
    first = np.flatnonzero(end <= np.repeat(limit, sizes))
    end = end[first]
    forth, back = words.powers(n + 1)
    with np.errstate(over="ignore"):
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(u.hashes.view(np.uint64) * forth[:n])])
        hashes = words.mix((run[end] - run[first]) * back[first])
    return first, end, hashes.view(np.int64)


def _passages(least_line_words: int, least_block_words: int):
    """mapInArrow function over (id, row, text): hash, id, row and position of every passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            data, offsets = words.string_column(batch.column(2))
            for first, last in words.slices(offsets):
                u = Units(data, offsets[first : last + 1], least_line_words)
                k, _, hashes = passages(u, least_line_words, least_block_words)
                owner = np.repeat(np.arange(first, last), np.diff(u.bounds))[k]
                pos = (k - u.bounds[owner - first]).astype(np.int32)
                yield pa.record_batch({"h": pa.array(hashes), "id": pa.array(ids[owner]), "row": pa.array(rows[owner]), "pos": pa.array(pos)})

    return run


_SHARED = "kind int, h long, id long, row long, pos int, o_id long, o_row long, o_pos int, o_once boolean"


def _owners() -> object:
    """mapInArrow function over passages sorted by (h, id, row, pos): every one but its owner's own,
    with the owner (kind 1). A document's nth occurrence of a passage meets the owner's nth one, or its
    last.

    The first list of a task may have begun before it: its passages are returned without an owner
    (kind 2), and what the first of that and of the last list holds of it as a possible owner (kind 0).
    """

    def rows(kind, h, i, r, p, o=None) -> pa.RecordBatch:
        n = len(p)
        o = o or (np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int32), np.zeros(n, bool))
        columns = [np.full(n, kind, np.int32), *(np.broadcast_to(x, n) for x in (h, i, r)), p, *o]
        return pa.record_batch([pa.array(c) for c in columns], [c.split()[0] for c in _SHARED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of the list at hand: hash, owner, the owner's positions; the last document, and its occurrences so far.
        h0, owner, places, last, seen, in_first = None, (0, 0), np.zeros(0, np.int32), None, 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            h, i, r, p = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            n = len(h)
            new = np.concatenate([[h0 is None or h0 != h[0]], h[1:] != h[:-1]])
            begins = new | np.concatenate([[last != (i[0], r[0])], (i[1:] != i[:-1]) | (r[1:] != r[:-1])])
            heads = np.flatnonzero(new)
            goes_on = not new[0]  # list 0 is the one at hand, whose owner's positions precede this batch's
            held = places if goes_on else places[:0]
            nth = np.arange(n) - np.maximum.accumulate(np.where(begins, np.arange(n), 0))
            if not begins[0]:
                nth[: np.flatnonzero(begins)[0] if begins.any() else n] += seen
            of = np.cumsum(new) - (not goes_on)
            o_id, o_row = (np.concatenate([np.array([one] if goes_on else [], np.int64), x[heads]])[of] for one, x in zip(owner, (i, r), strict=True))
            own = (i == o_id) & (r == o_row)
            size = np.bincount(of, own, of[-1] + 1).astype(np.int64)
            start = heads + len(held)
            if goes_on:
                size[0] += len(held)
                start = np.concatenate([[0], start])
            all_places = np.concatenate([held, p])
            o_pos = all_places[start[of] + np.minimum(nth, size[of] - 1)]
            if in_first and h0 is not None and not goes_on:  # the first list ended with the last batch
                yield rows(0, h0, *owner, places)
                in_first = False
            unsure = (of == 0) & in_first
            if in_first:
                yield rows(2, h[unsure], i[unsure], r[unsure], p[unsure])
                if of[-1]:
                    yield rows(0, h[0], o_id[0], o_row[0], all_places[: size[0]])
                    in_first = False
            later = ~unsure & ~own
            if later.any():
                yield rows(1, h[later], i[later], r[later], p[later], (o_id[later], o_row[later], o_pos[later], size[of[later]] == 1))
            h0, owner, last, seen = h[-1], (o_id[-1], o_row[-1]), (i[-1], r[-1]), int(nth[-1]) + 1
            places = all_places[start[-1] : start[-1] + size[-1]]
        if h0 is not None:
            yield rows(0, h0, *owner, places)

    return run


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for k, v in enumerate(values):
        j = bisect_left(tops, v)
        back[k] = at[j - 1] if j else -1
        if j == len(tops):
            tops.append(v)
            at.append(k)
        else:
            tops[j], at[j] = v, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def aligned(once: dict[int, bool], ends: dict[int, int], entries: list[tuple[int, int, bool]]) -> list[int]:
    """Positions of the passages of a document that its alignment with one owner keeps.

    ``once``: which passages are unique in the document; ``ends``: the lines after them; ``entries``: (pos,
    owner's pos, unique in the owner). Passages that are unique in both, and in the same order, anchor
    the alignment, from which it grows to their neighbours at the same distance. What moved is aligned
    next, by blocks of neighbours at the same distance, the longest first. A line is aligned once: a
    passage some of whose lines are aligned with other lines of the owner is not.
    """
    found = {pos: o_pos for pos, o_pos, _ in entries}
    lines: dict[int, int] = {}  # to the distance between a line and the owner's line that it is aligned with
    kept: set[int] = set()

    def take(pos: int) -> bool:
        own = range(pos, ends[pos])
        if pos in kept or any(lines.get(k, found[pos] - pos) != found[pos] - pos for k in own):
            return False
        lines.update(dict.fromkeys(own, found[pos] - pos))
        kept.add(pos)
        return True

    order = sorted(entries)
    anchors = [e for e in order if e[2] and once[e[0]]] or order
    for k in increasing([e[1] for e in anchors]):
        pos = anchors[k][0]
        if take(pos):
            for step in (1, -1):
                near = pos + step
                while found.get(near) == found[pos] + near - pos and take(near):
                    near += step
    blocks: list[list[int]] = []
    for pos, o_pos, _ in order:
        if pos not in kept:
            if blocks and blocks[-1][-1] == pos - 1 and found[pos - 1] == o_pos - 1:
                blocks[-1].append(pos)
            else:
                blocks.append([pos])
    for block in sorted(blocks, key=lambda b: (-len(b), b[0])):
        for pos in block:
            take(pos)
    return sorted(kept)


def _cut(text: bytes, entries: list, least_line_words: int, least_block_words: int) -> tuple[bytes, int]:
    u = Units(np.frombuffer(text, np.uint8), np.array([0, len(text)]), least_line_words)
    first, end, hashes = passages(u, least_line_words, least_block_words)
    _, back, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    once = dict(zip(first.tolist(), (counts[back] == 1).tolist(), strict=True))
    ends = dict(zip(first.tolist(), end.tolist(), strict=True))
    by_owner: dict[tuple[int, int], dict] = {}
    for e in entries:
        by_owner.setdefault((e["o_id"], e["o_row"]), {})[e["pos"]] = (e["pos"], e["o_pos"], e["o_once"])
    gone = np.zeros(len(u.hashes), bool)
    for owner in sorted(by_owner):
        for pos in aligned(once, ends, list(by_owner[owner].values())):
            gone[pos : ends[pos]] = True
    if not gone.any():
        return text, 0
    edges = [0, *u.starts[1:].tolist(), len(text)]  # what precedes the first word goes with it
    left = b"".join(text[edges[k] : edges[k + 1]] for k in np.flatnonzero(~gone))
    return left, int(u.n_words[gone].sum())


def _apply(text_at: int, n_columns: int, least_line_words: int, least_block_words: int):
    """mapInArrow function over (the document's columns, entries)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, entries = batch.column(text_at), batch.column(n_columns)
            removed = np.zeros(batch.num_rows, np.int64)
            changed: dict[int, str] = {}
            for row in np.flatnonzero(entries.is_valid().to_numpy(zero_copy_only=False)):
                text = texts[int(row)].as_py()
                if text:
                    left, n = _cut(text.encode(), entries[int(row)].as_py(), least_line_words, least_block_words)
                    if n:
                        changed[int(row)], removed[row] = left.decode(), n
            if changed:
                values = texts.to_pylist()
                for row, text in changed.items():
                    values[row] = text
                texts = pa.array(values, texts.type)
            columns = [texts if k == text_at else batch.column(k) for k in range(n_columns)]
            yield pa.record_batch([*columns, pa.array(removed)], [*batch.schema.names[:n_columns], "_removed"])

    return run


def line_dedup(
    docs: DataFrame,
    least_block_words: int = 20,
    least_line_words: int = 6,
    id_col: str = "doc_id",
    text_col: str = "text",
    removed_col: str = "removed_words",
) -> DataFrame:
    """``docs`` without the blocks of lines that earlier documents hold, and the words removed."""
    ship(docs.sparkSession)
    docs = docs.drop(removed_col)
    names = docs.columns
    plain = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)]
    text_at = names.index(text_col)
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LAST)).alias("_id")
    row = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("_row")
    keyed = docs.select(*plain, key, row)

    texts = docs.select(key, row, F.col(f"`{text_col}`").cast("string").alias("text"))
    found = texts.mapInArrow(_passages(least_line_words, least_block_words), "h long, id long, row long, pos int")
    found = stored(found, "passage-hashes")
    order = ("h", "id", "row", "pos")
    shared = stored(found.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_owners(), _SHARED), "shared-passages")
    # At most two possible owners and one list a task; how they meet is left to the optimizer.
    border = shared.where("kind = 0").groupBy("h", "id", "row").agg(F.array_sort(F.collect_set("pos")).alias("places"))
    border = border.groupBy("h").agg(F.min(F.struct("id", "row", "places")).alias("o"))
    nth = F.row_number().over(Window.partitionBy("h", "id", "row").orderBy("pos"))
    unsure = shared.where("kind = 2").select("h", "id", "row", "pos").withColumn("nth", nth).join(border, "h")
    unsure = unsure.where("struct(id, row) <> struct(o.id, o.row)").select(
        "id", "row", "pos", F.col("o.id").alias("o_id"), F.col("o.row").alias("o_row"),
        F.element_at("o.places", F.least("nth", F.size("o.places"))).alias("o_pos"), (F.size("o.places") == 1).alias("o_once"),
    )
    sure = shared.where("kind = 1").select("id", "row", "pos", "o_id", "o_row", "o_pos", "o_once")
    entry = F.struct("pos", "o_id", "o_row", "o_pos", "o_once")
    entries = sure.unionByName(unsure).groupBy("id", "row").agg(F.collect_list(entry).alias("entries"))
    met = keyed.join(entries, (F.col("_id") == F.col("id")) & (F.col("_row") == F.col("row")), "left")
    met = met.select(*[f"c{k}" for k in range(len(names))], "entries")
    schema = T.StructType(
        [T.StructField(f"c{k}", f.dataType, True) for k, f in enumerate(docs.schema.fields)]
        + [T.StructField("_removed", T.LongType())]
    )
    cut = met.mapInArrow(_apply(text_at, len(names), least_line_words, least_block_words), schema)
    return cut.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)], F.col("_removed").alias(removed_col))
