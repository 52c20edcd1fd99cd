"""Bounded samples of rows, chosen by hash, for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hashed_sample(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """About ``rows`` rows (all, if there are no more), the same on every run, plus their hash ``ord``.

    Rows are kept by the hash of ``keys`` alone, where they lie, without a shuffle or a sort.
    """
    total = df.count()
    hashed = df.withColumn("ord", F.xxhash64(*keys))
    if total <= rows:
        return hashed
    return hashed.where(F.col("ord") < int((rows / total - 0.5) * 2**64))


def hashed_sample_by_class(df: DataFrame, rows: int, least: int, label: str, counts: dict[str, int], *keys: str) -> DataFrame:
    """``hashed_sample`` with about ``least`` rows of every class (all, if there are no more), however
    rare it is. ``counts``: the rows of each class of ``label``; rows of other classes go."""
    total = sum(counts.values())
    share = {c: min(1.0, max(rows / max(total, 1), least / n)) for c, n in counts.items()}
    most = F.coalesce(*[F.when(F.col(label) == c, F.lit(min(int((x - 0.5) * 2**64), 2**63 - 1))) for c, x in sorted(share.items())], F.lit(-(2**63)))
    return df.withColumn("ord", F.xxhash64(*keys)).where((F.col("ord") < most) | ((F.col("ord") == most) & (most == 2**63 - 1)))
