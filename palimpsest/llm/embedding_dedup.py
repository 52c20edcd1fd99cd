"""Near-duplicate vectors by cosine within a label, found through randomised-rotation binary codes.

1. Equal vectors of a label are one class, so copies are never compared with one another.
2. A fixed random rotation turns each class's unit vector; the signs of what comes out are its code, a
   bit a dimension. Stored with it are a correction factor (the code's inner product with its own
   vector) and the rotated vector in four bits a dimension. Dividing the inner product of one vector's
   code and the other's four bits by the factor estimates their cosine without bias, and the spread of
   the error is known; a pair whose estimate lies more than ``SPREADS`` spreads below the threshold is
   out. All other pairs are computed again from the vectors, in double precision.
3. Who meets whom: all classes of a label and of equal length are one block, however many there are, so
   what is found does not depend on the size of the input. A block above ``PART`` classes is cut in
   parts, and each pair of parts is a task of its own, whatever the size of the block: the work of a
   label is the square of its classes, spread over as many tasks.
   A caller who would rather lose some pairs than search large labels in full says what it costs to
   send a class to a block (``sent``, in comparisons). Then classes meet if their codes agree in all of
   ``bits`` places of one of ``bands`` choices of places, which are as many as ``recall`` needs; a pair
   that meets more than once counts at its first band, as the codes themselves tell.
4. A block's task reads codes only and names the classes with a pair to compute again; these alone
   bring their vectors to a second task a block, which returns links per class and a spanning forest of
   its links, never pairs. The forests are closed to components.

Only the bound on the error can miss a pair, with a chance of about one in a million. For bands, sizes of
labels are counted in 2**16 slots, which is what is broadcast; labels that share a slot get the bands of
their sum.

Defined cases: a vector that is null, empty or zero, or holds a null or a number that is not finite,
links with nothing, nor does one without a label or id; vectors of different lengths have no cosine;
rows that repeat an id count as vectors of their own and are in one component; a null id has a null
component and stays; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.graph import components
from palimpsest.session import ship, stored

THRESHOLD = 0.93
#: Share of the pairs just at the threshold that meet in some band, where bands are asked for.
RECALL = 0.98
#: Spreads of the estimate's error that a pair may lie below the threshold and still be computed again.
SPREADS = 5.0
#: Classes that one task compares with as many others, and classes of which it holds the estimates at a time.
PART, ROWS = 4096, 512
#: What it costs to send a class to a block, in comparisons.
SENT = 1000
SLOTS = 1 << 16
LEVELS = 15
_SEED = 20240613


@cache
def rotation(size: int) -> np.ndarray:
    """A random rotation of so many dimensions, the same everywhere."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(_SEED)).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def code_size(dimensions: int) -> int:
    return -(-dimensions // 64) * 64


@cache
def bands(n: int, size: int, threshold: float, recall: float, sent: int = SENT) -> tuple[int, int]:
    """How many places of the code a band compares, and how many bands there are, for a label of n
    classes: what makes sending classes and comparing codes cost least in all."""
    turned = math.acos(threshold) / math.pi  # of the places, this share differs at the threshold
    differ = [math.comb(size, h) * turned**h * (1 - turned) ** (size - h) for h in range(size + 1)]
    best = (float(n + sent), 0, 1)
    for bits in range(1, min(size, 31)):
        meet = [math.comb(size - h, bits) / math.comb(size, bits) for h in range(size + 1)]
        missed = lambda k, meet=meet: sum(d * (1 - m) ** k for d, m in zip(differ, meet, strict=True))
        low, high = 1, 1 << 12
        while low < high:
            low, high = (low, (low + high) // 2) if missed((low + high) // 2) <= 1 - recall else ((low + high) // 2 + 1, high)
        if missed(low) <= 1 - recall:
            best = min(best, (low * (n / 2**bits + sent), bits, low))
    return best[1], best[2]


def choice_of(n: int, size: int, threshold: float, recall: float, sent: int | None) -> tuple[int, int]:
    """The places and bands of a label: one band that all classes share, unless bands are asked for."""
    return (0, 1) if sent is None else bands(n, size, threshold, recall, sent)


@cache
def places(size: int, bits: int, n_bands: int) -> np.ndarray:
    """The places of the code that each band compares."""
    rng = np.random.Generator(np.random.PCG64(_SEED + 1))
    return np.stack([np.sort(rng.choice(size, bits, replace=False)) for _ in range(n_bands)]) if bits else np.zeros((1, 0), np.int64)


def keys(signs: np.ndarray, band: np.ndarray) -> np.ndarray:
    """The bits of codes at a band's places, as one number each."""
    return signs[:, band].astype(np.int64) @ (1 << np.arange(len(band), dtype=np.int64))


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


class Codes:
    """Codes of some unit vectors of the same length, with what the estimates need."""

    def __init__(self, signs: np.ndarray, factor: np.ndarray, low: np.ndarray, step: np.ndarray, levels: np.ndarray):
        self.signs, self.factor, self.low, self.step, self.levels = signs, factor, low, step, levels

    @classmethod
    def of(cls, units: np.ndarray) -> Codes:
        size = code_size(units.shape[1])
        turned = units @ rotation(size)[: units.shape[1]]
        low = turned.min(axis=1).astype(np.float32)
        step = ((turned.max(axis=1) - low) / LEVELS).astype(np.float32)
        levels = np.clip(np.rint((turned - low[:, None]) / np.maximum(step, 1e-30)[:, None]), 0, LEVELS).astype(np.uint8)
        factor = (np.abs(turned).sum(axis=1) / math.sqrt(size)).astype(np.float32)
        return cls(turned > 0, factor, low, step, levels)

    def __getitem__(self, at) -> Codes:
        return Codes(self.signs[at], self.factor[at], self.low[at], self.step[at], self.levels[at])

    def packed(self) -> list[bytes]:
        """Bits, then pairs of levels, a row each."""
        rows = np.concatenate([np.packbits(self.signs, axis=1), self.levels[:, ::2] << 4 | self.levels[:, 1::2]], axis=1)
        return [row.tobytes() for row in rows]

    @classmethod
    def read(cls, packed: list[bytes], factor, low, step) -> Codes:
        rows = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)
        bits, pairs = rows[:, : rows.shape[1] // 5], rows[:, rows.shape[1] // 5 :]
        levels = np.stack([pairs >> 4, pairs & 15], axis=2).reshape(len(rows), -1)
        return cls(np.unpackbits(bits, axis=1).astype(bool), factor, low, step, levels)

    def estimates(self, other: Codes) -> np.ndarray:
        """Estimated cosines: of the codes of these with the four-bit vectors of the others."""
        signs = np.where(self.signs, np.float32(1), np.float32(-1))
        near = other.levels * other.step[:, None] + other.low[:, None]
        return (signs @ near.T) / (self.factor * np.float32(math.sqrt(signs.shape[1])))[:, None]

    def spread(self, other: Codes, threshold: float) -> np.ndarray:
        """Spread of the error of these estimates, for pairs at the threshold or above: by the code, and by
        the rounding to four bits."""
        square = np.minimum(self.factor**2, 1)
        own = (1 - threshold**2) * (1 - square) / square / max(self.signs.shape[1] - 1, 1)
        return np.sqrt(own[:, None] + (other.step**2)[None, :] / 12 / square[:, None])

    def candidates(self, other: Codes, threshold: float) -> np.ndarray:
        """Which pairs may reach the threshold."""
        return self.estimates(other) + np.float32(SPREADS) * self.spread(other, threshold) >= threshold


def first_meeting(a: Codes, b: Codes, at: np.ndarray, bt: np.ndarray, band: int, choice: np.ndarray) -> np.ndarray:
    """Whether the pairs (at, bt) meet in no band before this one."""
    new = np.ones(len(at), bool)
    for earlier in choice[:band]:
        new &= keys(a.signs, earlier)[at] != keys(b.signs, earlier)[bt]
    return new


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _codes(threshold: float, recall: float, sent: int | None):
    """mapInArrow function over (cls, label, dim, slot_size, vector): a row for each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, label, dim, slot_size = (_numbers(batch.column(k)) for k in range(4))
            flat = batch.column(4).flatten().to_numpy(zero_copy_only=False).astype(float)
            starts = np.cumsum(dim) - dim
            for d, n in {*zip(dim.tolist(), slot_size.tolist(), strict=True)}:
                rows = np.flatnonzero((dim == d) & (slot_size == n))
                codes = Codes.of(unit_vectors(flat[starts[rows][:, None] + np.arange(d)]))
                bits, n_bands = choice_of(n, code_size(d), threshold, recall, sent)
                packed = pa.array(codes.packed(), pa.binary())
                for k, band in enumerate(places(code_size(d), bits, n_bands)):
                    yield pa.record_batch(
                        {
                            "label": label[rows], "dim": dim[rows], "n": slot_size[rows], "band": np.full(len(rows), k), "bits": keys(codes.signs, band),
                            "cls": cls[rows], "packed": packed, "factor": codes.factor, "low": codes.low, "step": codes.step,
                        }
                    )

    return run


#: What tells blocks apart (n is the label's size in its slot, if the bands depend on it), and tasks.
BLOCK = ["label", "dim", "n", "band", "bits"]
TASK = [*BLOCK, "i", "j"]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[pa.Array]]]:
    """Rows sorted by TASK, whose columns come first: each task's key and its other columns, whole."""
    held: list[pa.RecordBatch] = []
    key = None

    def whole():
        table = pa.Table.from_batches(held)
        return [c.combine_chunks() for c in table.columns[len(TASK) :]]

    for batch in batches:
        if not len(batch):
            continue
        columns = [_numbers(batch.column(k)) for k in range(len(TASK))]
        change = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        at = [0, *(np.flatnonzero(change) + 1).tolist(), len(batch)]
        for first, last in zip(at, at[1:], strict=False):
            own = tuple(int(c[first]) for c in columns)
            if own != key and held:
                yield key, whole()
                held = []
            key = own
            held.append(batch.slice(first, last - first))
    if held:
        yield key, whole()


def _pairs(codes: Codes, side: np.ndarray, key: tuple, threshold: float, recall: float, sent: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of a task that may reach the threshold and meet here first, some rows at a
    time. ``side``: the part of each class; between two parts only pairs across count."""
    _, dim, n, band, _, i, j = key
    choice = places(code_size(dim), *choice_of(n, code_size(dim), threshold, recall, sent))
    left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
    other = codes[right]
    for first in range(0, len(left), ROWS):
        some = left[first : first + ROWS]
        near = codes[some].candidates(other, threshold)
        if i == j:
            near &= right[None, :] > some[:, None]
        a, b = np.nonzero(near)
        if len(a):
            a, b = some[a], right[b]
            new = first_meeting(codes, codes, a, b, band, choice)
            yield a[new], b[new]


def _named(threshold: float, recall: float, sent: int | None):
    """mapInArrow function over a block's codes: the classes that have a pair to compute again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, (side, cls, packed, factor, low, step) in _groups(batches):
            side, cls = _numbers(side), _numbers(cls)
            codes = Codes.read(packed.to_pylist(), _numbers(factor), _numbers(low), _numbers(step))
            named = np.zeros(len(cls), bool)
            for a, b in _pairs(codes, side, key, threshold, recall, sent):
                named[a] = named[b] = True
            rows = np.flatnonzero(named)
            if len(rows):
                whole = [np.full(len(rows), k) for k in key]
                yield pa.record_batch([pa.array(c) for c in (*whole, side[rows], cls[rows])], [*TASK, "side", "cls"])

    return run


def _linked(threshold: float, recall: float, sent: int | None):
    """mapInArrow function over a block's named classes (side, cls, rep, copies, vector): rows (cls, a, b,
    links) with a class's links, or with a link a, b of the spanning forest and no class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, (side, cls, rep, copies, vector) in _groups(batches):
            side, cls, rep, copies = map(_numbers, (side, cls, rep, copies))
            units = unit_vectors(vector.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(cls), -1))
            links, label, forest = np.zeros(len(cls), np.int64), np.arange(len(cls)), []
            for a, b in _pairs(Codes.of(units), side, key, threshold, recall, sent):
                for first in range(0, len(a), 1 << 16):
                    x, y = a[first : first + (1 << 16)], b[first : first + (1 << 16)]
                    good = np.einsum("ij,ij->i", units[x], units[y]) >= threshold
                    x, y = x[good], y[good]
                    links += np.bincount(x, copies[y], len(cls)).astype(np.int64) + np.bincount(y, copies[x], len(cls)).astype(np.int64)
                    fresh = label[x] != label[y]
                    for p, q in zip(x[fresh].tolist(), y[fresh].tolist(), strict=True):
                        if label[p] != label[q]:
                            forest.append((rep[p], rep[q]))
                            label[label == label[q]] = label[p]
            rows = np.flatnonzero(links)
            if len(rows):
                ends = np.array(forest, np.int64).T
                none = pa.nulls(len(rows), pa.int64())
                yield pa.record_batch([pa.array(cls[rows]), none, none, pa.array(links[rows])], ["cls", "a", "b", "links"])
                none = pa.nulls(len(forest), pa.int64())
                yield pa.record_batch([none, pa.array(ends[0]), pa.array(ends[1]), none], ["cls", "a", "b", "links"])

    return run


def _valid(label: Column, vector: Column) -> Column:
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return label.isNotNull() & (F.size(vector) > 0) & F.forall(vector, number) & F.exists(vector, lambda x: x != 0)


def _by_task(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*TASK, *columns).repartition(*TASK).sortWithinPartitions(*TASK, "cls")


def near_duplicates(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    part: int = PART,
    sent: int | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """vec_id, n_links (other vectors of the label with a cosine of ``threshold`` or more), component_id
    (least id reachable by links) and kept (whether it is the vector's own) of every vector."""
    ship(vectors.sparkSession)
    vector = F.col(f"`{vector_col}`")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("long").alias("label"), vector.alias("vector"))
    # Equal vectors share 128 bits of hashes; -0.0 and 0.0 are equal only in the cosine.
    rows = rows.withColumn("valid", F.coalesce(F.col("vec_id").isNotNull() & _valid(F.col("label"), F.col("vector")), F.lit(False)))
    mark = lambda seed: F.when(F.col("valid"), F.xxhash64(F.lit(seed), "label", "vector"))
    rows = rows.withColumns({"one": mark(1), "two": mark(2)})
    classes = rows.where("valid").groupBy("one", "two").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector")
    )
    classes = stored(classes.withColumn("cls", F.monotonically_increasing_id()).withColumn("dim", F.size("vector").cast("long")), "vector-classes")
    slot = F.pmod(F.xxhash64("label", "dim"), F.lit(SLOTS))
    sized = classes.withColumn("n", F.lit(0).cast("long"))
    if sent is not None:
        sizes = classes.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
        sized = classes.withColumn("slot", slot).join(F.broadcast(sizes), "slot")
    sized = sized.select("cls", "label", "dim", "n", "vector")
    coded = sized.mapInArrow(_codes(threshold, recall, sent), "label long, dim long, n long, band long, bits long, cls long, packed binary, factor float, low float, step float")
    coded = stored(coded, "vector-codes")
    large = coded.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > part)
    dealt = coded.join(large, BLOCK, "left").withColumn("parts", F.coalesce(F.ceil(F.col("members") / part), F.lit(1)))
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64("cls"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")})
    schema = ", ".join(f"{c} long" for c in [*TASK, "side", "cls"])
    named = _by_task(dealt, ["side", "cls", "packed", "factor", "low", "step"]).mapInArrow(_named(threshold, recall, sent), schema)
    met = stored(named, "vector-candidates").join(classes.select("cls", "rep", "copies", "vector"), "cls")
    links = _by_task(met, ["side", "cls", "rep", "copies", "vector"]).mapInArrow(_linked(threshold, recall, sent), "cls long, a long, b long, links long")
    links = stored(links, "vector-links")
    degree = links.where("cls IS NOT NULL").groupBy("cls").agg(F.sum("links").alias("links"))
    # An id on several rows ties their classes.
    repeated = rows.where("valid").groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id")
    known = classes.select("one", "two", "cls", "rep", "copies")
    ties = rows.where("valid").join(repeated, "vec_id", "left_semi").join(known, ["one", "two"]).select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    component = components(links.where("cls IS NULL").select("a", "b").unionByName(ties.where("a <> b").distinct()))
    known = known.join(degree, "cls", "left").join(component, F.col("rep") == F.col("node"), "left")
    known = known.select("one", "two", "copies", "links", F.coalesce("component", "rep").alias("component"))
    found = rows.select("vec_id", "one", "two").join(known, ["one", "two"], "left")
    found = found.select(
        "vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")
    )
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


#: The query: all pairs of a label, closed to components.
ORACLE = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
least_of AS (SELECT x, min(y) AS y FROM reach GROUP BY 1),
degree AS (SELECT x, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(y, vec_id)) AS component_id, least(vec_id, coalesce(y, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN degree ON degree.x = vec_id LEFT JOIN least_of ON least_of.x = vec_id
"""
