"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from palimpsest.session import stored


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step; edges are (a, b) with a > b."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").select(
        F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")
    )
    return small.distinct()


def _kept(edges: DataFrame, label: str) -> tuple[DataFrame, dict]:
    """The edges, written, and a fingerprint that is observed while they are."""
    seen = Observation()
    mark = (F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
    return stored(edges.observe(seen, *mark), label), seen.get


def components(edges: DataFrame) -> DataFrame:
    """Label the nodes of ``edges`` (long columns a, b, in any order) with their component's least node.

    Returns node, component for every node that has an edge to another one; a node with very many
    edges is pre-aggregated on the map side. Each step is written to the shared folder; the last one
    changes nothing. (A task that is run twice may be observed twice; that costs one more step.)
    Defined cases: loops and repeated edges count once, an edge with a null joins nothing, and an
    empty table has no components.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, mark = _kept(now, "edges")
    last = None
    while mark != last:
        last = mark
        now, mark = _kept(_stars(now), "stars")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
