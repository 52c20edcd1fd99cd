"""Toxicity by weak supervision.

1. Stems (whole words, and their first three to eight bytes) are hashed. From a bounded sample of
   labelled training rows, stems that toxic rows hold and clean rows hardly do are dealt to
   lexicons; together with a fixed seed lexicon and patterns of writing they make twelve voters.
2. All documents are put to the vote. How often each of the at most 2**12 combinations of votes
   occurs is counted in Spark; a generative model with a latent class estimates from these counts
   each voter's accuracy, and its dependence on another voter given the class, as a tree of greatest
   conditional mutual information (expectation-maximisation, the tree anew in every round).
3. The model's posteriors label a bounded sample of training documents, on which a sparse logistic
   regression over hashed stems is trained. It scores every whole text.

Labels are used for mining lexicons and for the prior share of toxic documents; label, language,
source and id are no inputs of a score. Defined cases: a null or empty text has no stems and gets
the regression's intercept; labels of unknown ids count for nothing, of repeated ids as toxic if one
of them is; a score of exactly one half counts as toxic; rows that repeat an id are scored each; a
null id is scored and belongs to no fold; without labels the seed lexicon and patterns vote alone; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import words
from palimpsest.llm.linear import Example, Ftrl, train
from palimpsest.llm.sampling import hashed_sample
from palimpsest.session import ship, stored

# Common English insults.
SEED_LEXICON = (
    "clown disgusting dumb filth fool garbage idiot loser moron pathetic scum stupid trash ugly vermin worthless"
).split()

BITS = 20
PREFIXES = range(3, 9)
#: Bounds on the labelled rows that lexicons are mined from, and on the documents of the fit.
LEXICON_ROWS = 16_000
FIT_ROWS = 16_000
#: A mined stem occurs in so many toxic rows and so large a part of them all, and of the rows that
#: hold it so large a share is toxic.
LEAST_ROWS, LEAST_PART, LEAST_SHARE = 4, 0.01, 0.75
LEXICON_STEMS = 4_000
VOTERS = 12
THRESHOLD = 0.5
#: Lasso penalty of the regression, times the root of its rows.
L1 = 0.11

_OTHER = np.ones(256, bool)
_OTHER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_KIND = np.arange(1, 12, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def stems(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashed stems of all words (letters only): whole words, then prefixes of 3..8 bytes, -1 where
    a word is shorter; and each text's bounds in the words."""
    hashes, bounds = words.word_hashes(data, offsets, _OTHER, prefixes=[0, *PREFIXES])
    out = []
    for k, h in enumerate(hashes):
        at = (words.mix(h ^ _KIND[k]) >> np.uint64(64 - BITS)).astype(np.int64)
        out.append(np.where(h == 0, -1, at))
    return out, bounds


def _stem(word: str) -> int:
    data, offsets = words.string_column(pa.array([word]))
    return int(stems(data, offsets)[0][0][0])


def _sparse(columns: list[np.ndarray], bounds: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, distinct stems per row, and log2(1 + occurrences), of stems that ``keep`` (a table by stem) wants."""
    rows, found = [], []
    for at in columns:
        k = np.flatnonzero((at >= 0) & keep[at])
        rows.append(np.searchsorted(bounds, k, "right") - 1)
        found.append(at[k])
    pairs, n = np.unique((np.concatenate(rows) << BITS) | np.concatenate(found), return_counts=True)
    return pairs >> BITS, pairs & ((1 << BITS) - 1), np.log2(1 + n)


def mine(texts: DataFrame, toxic_texts: int) -> list[tuple[int, int]]:
    """Stems for lexicons from (text, toxic) rows, no text twice, the most telling first: (stem, kind)."""
    least = max(LEAST_ROWS, LEAST_PART * toxic_texts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 1 << BITS), np.int32)
        kind = np.zeros(1 << BITS, np.int8)
        everything = np.ones(1 << BITS, bool)
        for batch in batches:
            toxic = np.array(batch.column(1).to_pylist())
            data, offsets = words.string_column(batch.column(0))
            for first, last in words.slices(offsets):
                columns, bounds = stems(data, offsets[first : last + 1])
                for k, at in enumerate(columns):
                    kind[at[at >= 0]] = k
                rows, at, _ = _sparse(columns, bounds, everything)
                for label in (0, 1):
                    n[label] += np.bincount(at[toxic[first + rows] == label], minlength=1 << BITS).astype(np.int32)
        at = np.flatnonzero(n.any(axis=0))
        yield pa.record_batch(
            {"stem": pa.array(at, pa.int64()), "kind": pa.array(kind[at], pa.int32()), "clean": pa.array(n[0][at], pa.int64()), "toxic": pa.array(n[1][at], pa.int64())}
        )

    counted = texts.mapInArrow(count, "stem long, kind int, clean long, toxic long").groupBy("stem")
    counted = counted.agg(F.max("kind").alias("kind"), F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    telling = counted.where((F.col("toxic") >= least) & (F.col("toxic") >= LEAST_SHARE * (F.col("toxic") + F.col("clean"))))
    score = F.log((F.col("toxic") + 0.5) / (F.col("clean") + 0.5)) * F.sqrt("toxic")
    return [(r.stem, r.kind) for r in telling.orderBy(score.desc(), "stem").limit(LEXICON_STEMS).collect()]


def lexicons(mined: list[tuple[int, int]]) -> np.ndarray:
    """Bits of voters by stem: 0 seed; 1-2 mined words, dealt in turn; 3-5 short, middle and long prefixes."""
    table = np.zeros(1 << BITS, np.int32)
    for word in SEED_LEXICON:
        table[_stem(word)] |= 1
    for k, (stem, kind) in enumerate(mined):
        table[stem] |= 1 << ((1 + k % 2) if kind == 0 else 3 if kind <= 2 else 4 if kind <= 4 else 5)
    return table


def votes(table: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text the voters that call it toxic, as bits."""
    columns, bounds = stems(data, offsets)
    n, out = len(offsets) - 1, np.zeros(len(offsets) - 1, np.int64)
    rows, at, _ = _sparse(columns, bounds, table > 0)
    for bit in range(6):
        out[rows[table[at] >> bit & 1 == 1]] |= 1 << bit
    # A word may hit by several of its stems; what counts is how many different words hit.
    hit = np.zeros(len(columns[0]), bool)
    for c in columns:
        hit |= (c >= 0) & (table[c] > 0)
    k = np.flatnonzero(hit)
    different = np.unique(((np.searchsorted(bounds, k, "right") - 1) << BITS) | columns[0][k]) >> BITS
    hits = np.bincount(different, minlength=n)
    size = np.maximum(np.diff(bounds), 1)
    out |= (hits >= 2).astype(np.int64) << 6
    out |= (hits >= 4).astype(np.int64) << 7
    out |= (hits >= np.maximum(1, 0.01 * size)).astype(np.int64) << 8
    text = data[offsets[0] : offsets[-1]]
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets - offsets[0]])
    upper, lower = total((text >= 65) & (text <= 90)), total((text >= 97) & (text <= 122))
    marks = total(text == 33)
    out |= (upper > lower).astype(np.int64) << 9
    out |= ((marks >= 3) & (marks * 50 >= size)).astype(np.int64) << 10
    seed_hits = np.bincount(rows[table[at] & 1 == 1], minlength=n)
    out |= (seed_hits >= 2).astype(np.int64) << 11
    return out


class LabelModel:
    """Latent class with tree-shaped dependences between binary voters within each class."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, prior: float, steps: int = 40):
        bits = (patterns[:, None] >> np.arange(VOTERS)) & 1
        # A start that only says: the more lexicons agree, the likelier toxic.
        lexical = bits[:, [0, 1, 2, 3, 4, 5, 11]].sum(axis=1)
        q = np.clip(lexical / 4, 0.02, 0.98)
        self.prior = prior
        for _ in range(steps):
            weight = np.stack([counts * (1 - q), counts * q])
            self._estimate(bits, weight)
            q = self.posterior(patterns)

    def _estimate(self, bits: np.ndarray, weight: np.ndarray) -> None:
        total = weight.sum(axis=1)
        both = np.empty((2, VOTERS, VOTERS, 2, 2))
        for y in (0, 1):
            for a in (0, 1):
                for b in (0, 1):
                    both[y, :, :, a, b] = (weight[y][:, None] * (bits == a)).T @ (bits == b)
        p = (both + 0.25) / (total[:, None, None, None, None] + 1)
        one = np.einsum("yjjaa->yja", p)
        one = one / one.sum(axis=2, keepdims=True)
        gain = p * np.log(p / (one[:, :, None, :, None] * one[:, None, :, None, :]))
        share = total / max(total.sum(), 1.0)
        information = (share[:, None, None, None, None] * gain).sum(axis=(0, 3, 4))
        self.order, self.parent = [0], {0: None}
        while len(self.order) < VOTERS:  # a maximum spanning tree
            rest = [j for j in range(VOTERS) if j not in self.parent]
            i, j = max(((i, j) for i in self.order for j in rest), key=lambda e: information[e])
            self.parent[j] = i
            self.order.append(j)
        self.log_one = np.log(one)
        self.log_given = np.log(p / p.sum(axis=4, keepdims=True))  # [y, parent, child, value of parent, of child]

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        bits = (patterns[:, None] >> np.arange(VOTERS)) & 1
        score = np.log([1 - self.prior, self.prior])[:, None] * np.ones(len(patterns))
        for y in (0, 1):
            for j in self.order:
                i = self.parent[j]
                score[y] += self.log_one[y, j, bits[:, j]] if i is None else self.log_given[y, i, j, bits[:, i], bits[:, j]]
        return 1 / (1 + np.exp(np.clip(score[0] - score[1], -35, 35)))

    def accuracies(self) -> np.ndarray:
        """P(vote | class), by class and voter."""
        return np.exp(self.log_one[:, :, 1])


def _vote_batches(table, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = words.string_column(batch.column(text_at))
            parts = [votes(table.value, data, offsets[a : b + 1]) for a, b in words.slices(offsets)]
            found = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            yield pa.record_batch({"pattern": pa.array(found)})

    return run


def _fit_examples(table: np.ndarray, posterior: np.ndarray):
    everything = np.ones(1 << BITS, bool)

    def run(batch: pa.RecordBatch) -> Iterator[Example]:
        data, offsets = words.string_column(batch.column(0))
        for first, last in words.slices(offsets):
            q = posterior[votes(table, data, offsets[first : last + 1])]
            columns, bounds = stems(data, offsets[first : last + 1])
            rows, at, values = _sparse(columns, bounds, everything)
            ends = np.searchsorted(rows, np.arange(last - first + 1))
            for row in range(last - first):
                features = np.append(at[ends[row] : ends[row + 1]], 1 << BITS)  # the last one is the intercept
                yield features, np.append(values[ends[row] : ends[row + 1]], 1.0), q[row : row + 1]

    return run


def _scores(w: np.ndarray, texts: pa.Array) -> np.ndarray:
    data, offsets = words.string_column(texts)
    out = np.full(len(texts), float(w[-1]))
    for first, last in words.slices(offsets):
        columns, bounds = stems(data, offsets[first : last + 1])
        rows, at, values = _sparse(columns, bounds, w[:-1] != 0)
        out[first:last] += np.bincount(rows, w[at] * values, last - first)
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


class ToxicityModel:
    def __init__(self, weights: np.ndarray, label_model: LabelModel, table: np.ndarray):
        self.weights, self.label_model, self.table = weights, label_model, table

    @classmethod
    def fit(cls, docs: DataFrame, train_docs: DataFrame, labels: DataFrame) -> ToxicityModel:
        """``docs``: all (doc_id, text) rows, for the votes; ``train_docs``: those that the classifier
        may learn from; ``labels``: (doc_id, toxic) rows that may be looked at."""
        spark = docs.sparkSession
        # Repeated labels count as toxic if one of them is.
        known = labels.where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        known = hashed_sample(known, LEXICON_ROWS, "doc_id").drop("ord").limit(2 * LEXICON_ROWS)  # two numbers a row: a proven bound for the broadcast
        # Copies of a text are one row, else a mislabelled text with copies would pass for evidence.
        seen = train_docs.join(F.broadcast(known), "doc_id").groupBy("text").agg(
            F.max("toxic").alias("toxic"), F.sum("toxic").alias("n_toxic"), F.count(F.lit(1)).alias("n")
        )
        seen = stored(seen, "toxicity-labelled")
        told = seen.agg((F.sum("n_toxic") / F.sum("n")).alias("share"), F.count_if(F.col("toxic") == 1).alias("texts")).first()
        share = told.share
        table = lexicons(mine(seen.select("text", "toxic"), told.texts))
        shared = spark.sparkContext.broadcast(table)
        ballots = docs.select("text").mapInArrow(_vote_batches(shared, 0), "pattern long").groupBy("pattern").count()
        rows = sorted((r.pattern, r["count"]) for r in ballots.collect())  # at most 2**VOTERS rows
        shared.destroy()
        patterns, counts = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(1, np.int64),) * 2
        prior = min(0.5, max(0.01, 0.05 if share is None else share))
        model = LabelModel(patterns, counts.astype(float), prior)
        posterior = model.posterior(np.arange(1 << VOTERS))
        sample = hashed_sample(train_docs.where("doc_id IS NOT NULL"), FIT_ROWS, "doc_id").select("text", "ord")
        sample = stored(sample, "toxicity-sample")
        # What chance adds up to grows as the root of the rows.
        penalty = L1 * sample.count() ** 0.5
        learner = Ftrl((1 << BITS) + 1, 1, alpha=0.3, l1=penalty, l2=1.0, intercept=1 << BITS)
        weights = train(sample, learner, _fit_examples(table, posterior))
        return cls(weights[:, 0].astype(np.float32), model, table)

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, score for every row of (doc_id, text)."""
        shared = docs.sparkSession.sparkContext.broadcast(self.weights)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.record_batch({"doc_id": batch.column(0), "score": pa.array(_scores(shared.value, batch.column(1)))})

        return docs.mapInArrow(run, "doc_id long, score double")

    def keep(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """The rows that are not predicted toxic, all columns as they were; nothing is shuffled."""
        shared = docs.sparkSession.sparkContext.broadcast(self.weights)
        at = docs.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(_scores(shared.value, batch.column(at)) < THRESHOLD))

        return docs.mapInArrow(run, docs.schema)


def fit_outside_fold(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out_fold: int = 0) -> ToxicityModel:
    """A model that has not seen the labels, nor fitted the documents, of one fold of crc32(doc_id)."""
    ship(docs.sparkSession)
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds, F.lit(-1))
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return ToxicityModel.fit(some, some.where(fold != held_out_fold), labels.where(fold != held_out_fold))


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out_fold: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of the held-out fold of crc32(doc_id) are not read."""
    model = fit_outside_fold(docs, labels, folds, held_out_fold)
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds, F.lit(-1))
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return model.score(some).select(
        "doc_id",
        (fold == held_out_fold).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, all columns as they were."""
    return fit_outside_fold(docs, labels).keep(docs)
