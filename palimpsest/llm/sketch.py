"""Fixed-size counters over hashes of all rows, built on the executors and small enough to broadcast."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK = 1 << 15


def cut(kind: type) -> Callable[[np.ndarray], np.ndarray]:
    """Counts as they are, cut at the greatest value of ``kind``."""
    return lambda counts: np.minimum(counts, np.iinfo(kind).max).astype(kind)


def magnitude(counts: np.ndarray) -> np.ndarray:
    """Counts by their order alone, in a byte each: exact up to 8, and eight steps an octave above."""
    large = np.round(8 * np.log2(np.maximum(counts, 8).astype(float) / 8)) + 8
    return np.where(counts <= 8, counts, np.minimum(large, 255)).astype(np.uint8)


def hash_counts(
    df: DataFrame,
    hashes: Callable[[pa.RecordBatch], Iterable[np.ndarray]],
    bits: int = 21,
    finish: Callable[[np.ndarray], np.ndarray] = cut(np.uint32),
) -> np.ndarray:
    """How many of the 64-bit hashes of all rows fall into each of 2**bits counters, as ``finish``
    returns the sums.

    Each task counts its own rows; the counters are summed over the tasks in chunks, each chunk in
    one stream with one chunk in memory. What reaches the driver has a fixed size at any input.
    """
    shift = np.uint64(64 - bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for values in hashes(batch):
                np.add.at(total, (values >> shift).astype(np.int64), np.uint32(1))
        if total.any():
            narrow = total.max() < 1 << 16
            own = total.astype(np.uint16) if narrow else total
            yield pa.record_batch(
                {
                    "chunk": pa.array(range(len(own) // CHUNK), pa.int32()),
                    "counts": pa.array([c.tobytes() for c in own.reshape(-1, CHUNK)], pa.binary()),
                }
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = sums.setdefault(chunk, np.zeros(CHUNK, np.uint64))
                own += np.frombuffer(counts, np.uint16 if len(counts) == 2 * CHUNK else np.uint32)
        for chunk, own in sums.items():
            yield pa.record_batch({"chunk": pa.array([chunk], pa.int32()), "counts": pa.array([finish(own).tobytes()], pa.binary())})

    schema = "chunk int, counts binary"
    parts = df.mapInArrow(count, schema).repartition("chunk").mapInArrow(add, schema).toArrow()
    none = finish(np.zeros(1, np.uint64))
    out = np.zeros(1 << bits, none.dtype)
    for chunk, counts in zip(parts.column(0), parts.column(1), strict=True):
        at = chunk.as_py() * CHUNK
        out[at : at + CHUNK] = np.frombuffer(counts.as_py(), none.dtype)
    return out
