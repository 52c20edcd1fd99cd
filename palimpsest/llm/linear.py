"""Sparse linear classifiers trained by follow-the-regularised-leader inside Spark tasks.

The training rows are a bounded sample. They are dealt to a few tasks by hash; each task runs
FTRL-proximal with an elastic net over its rows in a fixed order, and the weights are averaged over
the tasks (iterative parameter mixing), which start the next round from the average.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Example = tuple[np.ndarray, np.ndarray, np.ndarray]  # features, values, target by class


@dataclass(frozen=True)
class Ftrl:
    """FTRL-proximal with per-coordinate rates; one class means a logistic, more a softmax output."""

    dim: int
    classes: int
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1.0
    l2: float = 1.0
    intercept: int | None = None  # a feature without the l1 penalty

    def weights(self, z: np.ndarray, n: np.ndarray, l1: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z) * l1 - z
        return np.where(np.abs(z) <= l1, 0.0, shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        if self.classes == 1:
            return 1 / (1 + np.exp(-np.clip(scores, -35, 35)))
        e = np.exp(scores - scores.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def fit(self, examples: list[Example], epochs: int, start: np.ndarray | None = None) -> np.ndarray:
        n = np.zeros((self.dim, self.classes))
        z = np.zeros((self.dim, self.classes))
        l1 = np.full((self.dim, 1), self.l1)
        if self.intercept is not None:
            l1[self.intercept] = 0.0
        if start is not None:
            z -= start * (self.beta / self.alpha + self.l2) + np.sign(start) * l1
        for _ in range(epochs):
            for features, values, target in examples:
                zs, ns = z[features], n[features]
                w = self.weights(zs, ns, l1[features])
                error = self.probabilities(values @ w) - target
                g = values[:, None] * error[None, :]
                more = ns + g * g
                z[features] = zs + g - (np.sqrt(more) - np.sqrt(ns)) / self.alpha * w
                n[features] = more
        return self.weights(z, n, l1)


def train(
    sample: DataFrame,
    model: Ftrl,
    examples: Callable[[pa.RecordBatch], Iterator[Example]],
    tasks: int = 4,
    rounds: int = 2,
    epochs: int = 2,
) -> np.ndarray:
    """Weights (dim x classes). ``sample`` has a long column ``ord`` that fixes the order of its rows.

    Rows of which ``examples`` makes nothing count for nothing; without any row all weights are 0.
    """
    context = sample.sparkSession.sparkContext
    dealt = sample.repartition(tasks, F.pmod(F.col("ord"), F.lit(tasks))).sortWithinPartitions("ord").cache()
    weights, total = np.zeros((model.dim, model.classes)), None
    for _ in range(rounds):
        start = context.broadcast(weights.astype(np.float32))

        def fit(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            own = [e for batch in batches for e in examples(batch)]
            if own:
                w = model.fit(own, epochs, start.value.astype(float))
                at, kind = np.nonzero(w)
                yield pa.record_batch(
                    {"f": pa.array(at, pa.int64()), "k": pa.array(kind, pa.int64()), "w": pa.array(w[at, kind]), "rows": pa.array(np.full(len(at), len(own)), pa.int64())}
                )

        parts = dealt.mapInArrow(fit, "f long, k long, w double, rows long")
        mixed = parts.groupBy("f", "k").agg(F.sum(F.col("w") * F.col("rows")).alias("w")).toArrow()  # at most dim * classes rows
        total = dealt.count() if total is None else total
        weights = np.zeros((model.dim, model.classes))
        weights[mixed["f"].to_numpy(), mixed["k"].to_numpy()] = mixed["w"].to_numpy() / max(total, 1)
        start.destroy()
    dealt.unpersist()
    return weights
