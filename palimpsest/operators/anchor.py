"""Anchoring of model findings to submitted lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def anchor_text(findings: DataFrame, lines: DataFrame, source: str = "doc_id") -> DataFrame:
    """Findings whose exact text occurs, case and all, in the line that they name; the rest go."""
    near = lines.select(F.col(source).alias("_s"), F.col("line_id").alias("_l"), F.col("text").alias("line_text"))
    met = findings.join(near, (F.col(source) == F.col("_s")) & (F.col("line_id") == F.col("_l")))
    return met.where((F.length("exact_text") > 0) & F.col("line_text").contains(F.col("exact_text"))).drop("_s", "_l")


def rejected_counts(findings: DataFrame, anchored: DataFrame, source: str = "doc_id") -> DataFrame:
    """extracted, anchored and rejected findings per source."""
    given = findings.groupBy(source).agg(F.count(F.lit(1)).alias("extracted"))
    kept = anchored.groupBy(source).agg(F.count(F.lit(1)).alias("anchored"))
    met = given.join(kept, source, "left").withColumn("anchored", F.coalesce("anchored", F.lit(0)))
    return met.withColumn("rejected", F.col("extracted") - F.col("anchored"))


def anchor_audio(findings: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk-relative ranges moved to the source's timeline, cut to the chunk; empty ones go."""
    met = findings.join(chunks, ["session_id", "chunk"])
    start = F.col("chunk_start") + F.greatest("start", F.lit(0.0))
    end = F.col("chunk_start") + F.least("end", "chunk_duration")
    return met.withColumn("start_time", start).withColumn("end_time", end).where("end_time > start_time")
