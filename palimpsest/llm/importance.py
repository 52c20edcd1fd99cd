"""Resampling towards a target distribution by importance weights over hashed word n-grams.

1. Features of a text are its runs of one to three words, in buckets by CRC-32. One pass counts them per
   bucket over all documents and over all target texts; a bucket's gain is the log of the smoothed ratio
   of its shares, a table of fixed size.
2. A second pass looks each document's buckets up in that array; the sum is its weight. With Gumbel noise
   from the id's hash added, the highest scores are a sample without replacement by weight.
3. The cutoff: a quantile sketch of the scores gives a bracket around it. Rows outside the bracket are
   counted exactly; if the counts put the cutoff elsewhere the bracket is widened, up to the whole range.
   Only what lies in the bracket is sorted, by ranges over all tasks, to find the last row that is drawn.
4. What is drawn is numbered in order, by ranges as well; the other rows are not sorted at all.

The CRC of a run of words comes from those of its words by the linear rule for joined strings, so a
word is read once.

Defined cases: a null text, and one without words, has no feature, weight 0 and no more chance than its
noise, and is too short to be drawn; a null id is hashed as an empty string and comes last of equal
scores; rows that repeat an id share their noise, and of equal scores the one with fewer features is
first; texts of any length are read whole, a million bytes at a time; without documents long enough
nothing is drawn; no documents give an empty result; without target texts, what is common weighs less; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.review import numbered
from palimpsest.session import ship, stored

BUCKETS = 10_000
LEAST_WORDS, PERCENT = 20, 5
#: One over the relative error of the sketch, and the first half-width of the bracket, in these errors.
SKETCH, HALF_WIDTH = 10_000, 2
#: Bytes of a text that are split at a time, and words of which features are made at a time.
SLICE, WORDS = 1 << 20, 1 << 17
_SPACED = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
_DIRECT = 64


# --- CRC-32 of joined strings ------------------------------------------------------------------


@cache
def _shifts() -> tuple[np.ndarray, np.ndarray]:
    """What n zero bytes make of each byte of a CRC: for n up to _DIRECT, and for powers of two."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    one = lambda c: table[c & 255] ^ (c >> 8)
    direct = [np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]]
    for _ in range(_DIRECT):
        direct.append(one(direct[-1]))
    doubled = [direct[1]]
    for _ in range(31):
        doubled.append(_apply(doubled[-1], doubled[-1]))
    return np.stack(direct), np.stack(doubled)


def _apply(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    return tables[0][c & 255] ^ tables[1][c >> 8 & 255] ^ tables[2][c >> 16 & 255] ^ tables[3][c >> 24]


def shifted(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRCs once n zero bytes follow."""
    direct, doubled = _shifts()
    m = np.minimum(n, _DIRECT)
    out = direct[m, 0, c & 255] ^ direct[m, 1, c >> 8 & 255] ^ direct[m, 2, c >> 16 & 255] ^ direct[m, 3, c >> 24]
    for at in np.flatnonzero(n > _DIRECT):
        for k in range(32):
            if int(n[at] - _DIRECT) >> k & 1:
                out[at] = _apply(doubled[k], out[at : at + 1])[0]
    return out


# --- features ----------------------------------------------------------------------------------


def _words(text: bytes) -> Iterator[list[bytes]]:
    text = text.translate(_SPACED)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + SLICE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def features(texts: Iterator[bytes], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(owners of the words, owners and buckets of the features) of numbered texts, many at a time."""
    owner, crc, size, old, held = [], [], [], 0, 0

    def flush():
        nonlocal owner, crc, size, old, held
        o, c, n = np.concatenate(owner), np.concatenate(crc), np.concatenate(size)
        spaced = shifted(np.full(len(c), crc32(b" "), np.uint32), n) ^ c
        two = shifted(c[:-1], n[1:] + 1) ^ spaced[1:]
        three = shifted(two[:-1], n[2:] + 1) ^ spaced[2:]
        of, found = [o[old:]], [c[old:]]
        for k, joined in ((1, two), (2, three)):
            same = np.flatnonzero(o[k:] == o[:-k])
            same = same[same + k >= old]
            of.append(o[k:][same])
            found.append(joined[same])
        out = o[old:], np.concatenate(of), (np.concatenate(found) % np.uint32(buckets)).astype(np.int64)
        owner, crc, size, old, held = [o[-2:]], [c[-2:]], [n[-2:]], min(2, len(o)), 0
        return out

    for row, text in enumerate(texts):
        for words in _words(text):
            if words:
                owner.append(np.full(len(words), row))
                crc.append(np.fromiter(map(crc32, words), np.uint32, len(words)))
                size.append(np.fromiter(map(len, words), np.int64, len(words)))
                held += len(words)
                if held >= WORDS:
                    yield flush()
    if held:
        yield flush()


def _texts(column: pa.Array) -> Iterator[bytes]:
    return ((t.as_buffer().to_pybytes() if t.is_valid else b"") for t in column)


def _counts(buckets: int):
    """mapInArrow function over (side, text): a task's features by side and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            side = batch.column(0).to_numpy()
            for _, owner, bucket in features(_texts(batch.column(1)), buckets):
                total += np.bincount(side[owner] * buckets + bucket, minlength=2 * buckets).reshape(2, -1)
        side, bucket = np.nonzero(total)
        yield pa.record_batch([pa.array(side, pa.int32()), pa.array(bucket, pa.int32()), pa.array(total[side, bucket])], ["side", "bucket", "n"])

    return run


def bucket_counts(docs: DataFrame, target: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket, of the documents and of the target texts; the driver gets one row a bucket and side."""
    ship(docs.sparkSession)
    text = F.col(f"`{text_col}`").cast("string").alias("text")
    both = docs.select(F.lit(0).alias("side"), text).unionByName(target.select(F.lit(1).alias("side"), text))
    counts = both.mapInArrow(_counts(buckets), "side int, bucket int, n long").groupBy("side", "bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((2, buckets), np.int64)
    total[counts["side"].to_numpy(), counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    return total


def gains(counts: np.ndarray) -> np.ndarray:
    """A thousand times the log of how much more often a bucket occurs in the target, rounded down."""
    buckets = counts.shape[1]
    all_s, all_t = (float(total + buckets) for total in counts.sum(axis=1).tolist())
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_s / ((s + 1.0) * all_t))) for s, t in counts.T.tolist()], np.int64)


def noise(h: int) -> int:
    """Gumbel noise in thousandths, of a 32-bit hash."""
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scores(gain: np.ndarray):
    """mapInArrow function over (doc_id, h, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n, weight = (np.zeros(len(batch), np.int64) for _ in range(3))
            for of_words, owner, bucket in features(_texts(batch.column(2)), len(gain)):
                words += np.bincount(of_words, minlength=len(batch))
                n += np.bincount(owner, minlength=len(batch))
                np.add.at(weight, owner, gain[bucket])
            score = weight + np.array([noise(h) for h in batch.column(1).to_pylist()], np.int64)
            yield pa.record_batch({"doc_id": batch.column(0), "n_words": words, "n_features": n, "weight": weight, "score": score})

    return run


def scored(docs: DataFrame, gain: np.ndarray, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document."""
    ship(docs.sparkSession)
    doc_id = F.col(f"`{id_col}`").cast("long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    rows = docs.select(doc_id.alias("doc_id"), h.alias("h"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(_scores(gain), "doc_id long, n_words long, n_features long, weight long, score long")


# --- the draw ----------------------------------------------------------------------------------


def bracket(rows: DataFrame, score: str, k: int, n: int, accuracy: int = SKETCH) -> tuple[int, int, int]:
    """Two scores between which the k-th highest of n lies, and how many rows lie above both."""
    width = HALF_WIDTH / accuracy
    while True:
        at = 1 - k / n
        ends = F.lit([max(at - width, 0.0), min(at + width, 1.0)])
        low, high = rows.agg(F.percentile_approx(score, ends, F.lit(accuracy))).head()[0]
        if width >= 1:
            low, high = rows.agg(F.min(score), F.max(score)).head()
        above, within = rows.agg(F.count_if(F.col(score) > high), F.count_if(F.col(score).between(low, high))).head()
        if above < k <= above + within:
            return low, high, above
        width *= 8


def draw(rows: DataFrame, k: int, n: int, order: list[str], accuracy: int = SKETCH) -> tuple[DataFrame, Column]:
    """The first k of n rows by descending score and then ``order``, which tells all rows apart, with
    their rank; and the condition that they meet. ``rows`` are read several times."""
    if not k:
        return rows.limit(0).withColumn("rank", F.lit(None).cast("long")), F.lit(False)
    low, high, above = bracket(rows, "score", k, n, accuracy)
    names = ["_behind", *order]
    keyed = rows.withColumn("_behind", -F.col("score"))
    last = numbered(keyed.where(F.col("score").between(low, high)).select(*names), [F.col(c) for c in names]).where(F.col("position") == k - above).head()
    mark = lambda own: F.struct(*[own(c).alias(c) for c in names])
    behind = lambda c: -F.col("score") if c == "_behind" else F.col(c)
    drawn = mark(behind) <= mark(lambda c: F.lit(last[c]).cast(keyed.schema[c].dataType))
    ranked = numbered(keyed.where(drawn), [F.col(c) for c in names], "rank").drop("_behind")
    return ranked, drawn


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = 42,
    buckets: int = BUCKETS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; ``percent`` of those with enough
    words are drawn, the others' rank is null."""
    gain = gains(bucket_counts(docs, target, text_col, buckets))
    kept = scored(docs, gain, seed, id_col, text_col).withColumns(
        {"unknown": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0)), "row": F.monotonically_increasing_id()}
    )
    kept = stored(kept, "importance-scores")
    long_enough = F.col("n_words") >= least_words
    n = kept.where(long_enough).count()
    ranked, drawn = draw(kept.where(long_enough), n * percent // 100, n, ["unknown", "id", "n_features", "row"])
    columns = ["doc_id", "n_features", "weight", "score"]
    rest = kept.where(~(long_enough & drawn)).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*columns, "rank").unionByName(rest)


#: The query; CRC-32 is a fold over the bytes of each different run of words.
ORACLE = r"""
WITH RECURSIVE step AS (
  SELECT b AS byte, b AS c, 0 AS k FROM range(256) r(b)
  UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
tab AS (SELECT list(c ORDER BY byte) AS t FROM step WHERE k = 8),
words AS (
  SELECT side, id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark)),
runs AS (
  SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f
  FROM words),
counted AS (SELECT side, id, f, count(*) AS n FROM runs GROUP BY ALL),
hexes AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counted)),
crcs AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM hexes, tab),
placed AS (SELECT side, id, bucket, n FROM counted JOIN crcs USING (f)),
per AS (
  SELECT b AS bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t
  FROM range(10000) r(b) LEFT JOIN placed ON bucket = b GROUP BY 1),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM per) + 10000) / ((s + 1) * ((SELECT sum(t) FROM per) + 10000))))::BIGINT AS g FROM per),
weights AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS weight FROM placed JOIN gain USING (bucket) WHERE side = 0 GROUP BY 1),
scores AS (
  SELECT id AS doc_id, len(w) >= 20 AS long_enough, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (id) WHERE side = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY long_enough ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY long_enough) AS n FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN long_enough AND place <= n * 5 // 100 THEN place END AS rank FROM ranked
"""
