"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Characters are lower-cased code points, digits one symbol and other ASCII signs another; n-grams of
one to three characters are hashed to a fixed table. Term frequencies are shares of a document's
n-grams; inverse document frequencies come from all training documents. The model is trained by
FTRL-proximal with an elastic net on a bounded sample of the training documents, then calibrated by
one temperature on another bounded sample of them; rare languages have a least number of rows in
both. Prediction reads the whole of every text.

Defined cases: a null text or one without a letter gets ``und`` with score 0; of equally probable
languages the first by name counts; rows that repeat an id
are predicted each; an empty table gives an empty result; if no document has a language to learn,
every prediction is ``und``; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import sketch, words
from palimpsest.llm.linear import Example, Ftrl, train
from palimpsest.llm.sampling import hashed_sample_by_class
from palimpsest.session import ship, stored

ORDERS = 3
BITS = 16
#: Bounds on the labelled rows that the fit and the calibration see.
SAMPLE_ROWS = 12_000
CALIBRATION_ROWS = 4_000
#: Of every language the sample holds so many rows at least, if there are so many.
LEAST_ROWS = 400
UNKNOWN = "und"
SCALE = 30.0  # shares of n-grams are small numbers

_SIGNS = np.arange(128, dtype=np.uint32)
_SIGNS[[c for c in range(128) if not chr(c).isalnum()]] = 32
_SIGNS[48:58] = 48
_TURN = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _rows(texts: list[str | None], size: int = 400_000) -> Iterator[tuple[int, int]]:
    row = 0
    while row < len(texts):
        end, total = row, 0
        while end < len(texts) and (end == row or total < size):
            total += len(texts[end] or "")
            end += 1
        yield row, end
        row = end


def ngrams(texts: list[str | None]) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """For ranges of texts: for each order, the hashed n-grams and each text's bounds in them."""
    for first, last in _rows(texts):
        some = [(t or "").lower() for t in texts[first:last]]
        points = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.where(points < 128, _SIGNS[np.minimum(points, 127)], points).astype(np.uint64)
        lengths = np.array([len(t) for t in some])
        out = []
        for order in range(1, ORDERS + 1):
            counts = np.maximum(lengths - order + 1, 0)
            bounds = np.concatenate([[0], np.cumsum(counts)])
            if len(points) >= order:
                with np.errstate(over="ignore"):
                    h = points[: len(points) - order + 1] * _TURN[0]
                    for k in range(1, order):
                        h = (h ^ (h >> np.uint64(29))) * _TURN[k] + points[k : len(points) - order + 1 + k]
                    h = words.mix(h + np.uint64(order)) >> np.uint64(64 - BITS)
                inside = np.ones(len(h), bool)
                ends = np.cumsum(lengths)
                for k in range(1, order):  # n-grams that would reach into the next text
                    at = ends - k
                    inside[at[(at >= 0) & (at < len(h)) & (lengths >= k)]] = False
                if order == 3:
                    tiny = np.flatnonzero(lengths == 1)
                    starts = ends - lengths
                    inside[starts[tiny][starts[tiny] < len(h)]] = False
                h = h[inside].astype(np.int64)
            else:
                h = np.zeros(0, np.int64)
            out.append((h[: bounds[-1]], bounds))
        yield first, last, out


def _presence(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Every n-gram of every text once, shifted to where the counters look."""
    for first, last, orders in ngrams(batch.column(0).to_pylist()):
        for row in range(last - first):
            seen = np.zeros(1 << BITS, bool)
            for h, bounds in orders:
                seen[h[bounds[row] : bounds[row + 1]]] = True
            yield np.flatnonzero(seen).astype(np.uint64) << np.uint64(64 - BITS)


def _grouped(batch: pa.RecordBatch, rows: int = 64) -> Iterator[np.ndarray]:
    some: list[np.ndarray] = []
    for values in _presence(batch):
        some.append(values)
        if len(some) == rows:
            yield np.concatenate(some)
            some = []
    if some:
        yield np.concatenate(some)


def _examples(idf: np.ndarray, text_at: int, label_at: int, classes: int):
    def run(batch: pa.RecordBatch) -> Iterator[Example]:
        labels = batch.column(label_at).to_pylist()
        for first, last, orders in ngrams(batch.column(text_at).to_pylist()):
            for row in range(last - first):
                h = np.concatenate([h[b[row] : b[row + 1]] for h, b in orders])
                if len(h):
                    at, n = np.unique(h, return_counts=True)
                    target = np.zeros(classes)
                    target[labels[first + row]] = 1
                    yield at, n / len(h) * idf[at] * SCALE, target

    return run


def _logits(texts: list[str | None], table: np.ndarray) -> np.ndarray:
    """``table``: weights times idf, by n-gram and class."""
    out = np.zeros((len(texts), table.shape[1]))
    for first, last, orders in ngrams(texts):
        total = np.zeros((last - first, table.shape[1]))
        n = np.zeros(last - first)
        for h, bounds in orders:
            counts = np.diff(bounds)
            full = np.flatnonzero(counts)
            if len(full):
                for k in range(table.shape[1]):
                    total[full, k] += np.add.reduceat(table[:, k][h], bounds[:-1][full])
                n += counts
        out[first:last] = total / np.maximum(n, 1)[:, None] * SCALE
    return out


class LanguageModel:
    def __init__(self, names: list[str], table: np.ndarray, temperature: float):
        self.names, self.table, self.temperature = names, table, temperature

    @classmethod
    def fit(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
        """Learn from all rows of ``docs``, which are training rows, that have a language and a text."""
        spark = docs.sparkSession
        known = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(
            F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
        )
        sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}  # one row a language
        names = sorted(sizes)
        if not names:
            return cls([], np.zeros((1 << BITS, 0), np.float32), 1.0)
        counts = sketch.hash_counts(known.select("text"), _grouped, BITS)
        total = sum(sizes.values())
        idf = np.log((1 + total) / (1 + counts.astype(float))) + 0.1
        label = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("lang")) - 1
        rows = hashed_sample_by_class(known.withColumn("label", label.cast("int")), SAMPLE_ROWS + CALIBRATION_ROWS, LEAST_ROWS, "lang", sizes, "doc_id")
        rows = rows.drop("doc_id", "lang")
        share = CALIBRATION_ROWS / (SAMPLE_ROWS + CALIBRATION_ROWS)
        rows = stored(rows.withColumn("_fold", F.pmod(F.xxhash64("ord"), F.lit(1000)) < int(1000 * share)), "language-sample")
        model = Ftrl(1 << BITS, len(names), alpha=0.5, l1=0.05, l2=0.01)
        weights = train(rows.where("NOT _fold").select("text", "label", "ord"), model, _examples(idf, 0, 1, len(names)))
        table = (weights * idf[:, None]).astype(np.float32)
        shared = spark.sparkContext.broadcast(table)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = _logits(batch.column(0).to_pylist(), shared.value)
                yield pa.record_batch({"label": batch.column(1), "logits": pa.array(out.tolist(), pa.list_(pa.float64()))})

        held = rows.where("_fold").select("text", "label").mapInArrow(score, "label int, logits array<double>").collect()
        if not held:
            return cls(names, table, 1.0)
        logits, labels = np.array([r.logits for r in held]), np.array([r.label for r in held])

        def loss(temperature: float) -> float:
            if len(names) < 2:
                return 0.0
            p = np.maximum(model.probabilities(logits / temperature), 1e-12)
            doubt = 1 / (len(labels) + 2)  # else a sample without errors would ask for certainty
            true = np.log(p[np.arange(len(labels)), labels])
            return -((1 - doubt) * true + doubt * np.log(p).mean(axis=1)).mean()

        return cls(names, table, float(min(np.geomspace(0.02, 20, 121), key=loss)))

    def predict(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, lang_pred, score."""
        model = docs.sparkSession.sparkContext.broadcast((self.names, self.table, self.temperature))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, table, temperature = model.value
            softmax = Ftrl(1, max(2, len(names))).probabilities
            for batch in batches:
                texts = batch.column(1).to_pylist()
                letters = np.array([any(map(str.isalpha, t or "")) for t in texts], bool)
                preds, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if names and len(texts):
                    p = softmax(_logits(texts, table) / temperature)
                    best = p.argmax(axis=1)
                    preds = [names[k] if ok else UNKNOWN for k, ok in zip(best, letters, strict=True)]
                    scores = np.where(letters, p.max(axis=1), 0.0)
                yield pa.record_batch({"doc_id": batch.column(0), "lang_pred": pa.array(preds), "score": pa.array(scores)})

        some = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        return some.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 4, held_out_fold: int = 2) -> DataFrame:
    """Fit on the documents outside one fold of crc32(doc_id) and predict all: doc_id, held_out,
    lang_pred, score."""
    ship(docs.sparkSession)
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds, F.lit(-1))
    model = LanguageModel.fit(docs.where(fold != held_out_fold))
    return model.predict(docs).select(
        "doc_id", (fold == held_out_fold).alias("held_out"), "lang_pred", "score"
    )
