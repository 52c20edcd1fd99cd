"""Pattern detectors: the pluggable stand-in for a model that names personal data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (entity type, pattern, most characters, confidence); patterns read alike in Java and RE2.
DETECTORS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 254, 0.95),
    ("phone", r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}", 30, 0.9),
    ("financial", r"[0-9]{13,}", 16, 0.75),
    ("online_identifier", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", 15, 0.8),
)


#: What a match cannot do without, where looking for it is much cheaper than the pattern.
NEEDS = {"email": "@"}


def _matches(kind: str, pattern: str, most: int) -> Column:
    found = F.filter(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda m: F.length(m) <= most)
    return F.when(F.col("text").contains(NEEDS[kind]), found) if kind in NEEDS else found


def detect(lines: DataFrame) -> DataFrame:
    """finding_id, doc_id, line_no, line_id, entity_type, nth, exact_text, confidence per match."""
    found = F.array(
        *[
            F.struct(
                F.lit(rank).alias("rank"),
                F.lit(kind).alias("entity_type"),
                F.lit(confidence).alias("confidence"),
                _matches(kind, pattern, most).alias("matches"),
            )
            for rank, (kind, pattern, most, confidence) in enumerate(DETECTORS)
        ]
    )
    each = lines.select("doc_id", "line_no", "line_id", F.explode(found).alias("d")).where("size(d.matches) > 0")
    each = each.select("doc_id", "line_no", "line_id", "d.rank", "d.entity_type", "d.confidence", F.posexplode("d.matches").alias("nth", "exact_text"))
    return each.select(
        F.format_string("f%08d-%06d-%d-%04d", F.col("doc_id"), F.col("line_no"), F.col("rank"), F.col("nth")).alias("finding_id"),
        "doc_id",
        "line_no",
        "line_id",
        "entity_type",
        "nth",
        "exact_text",
        "confidence",
    )
