"""Sinks: redacted texts, partition overwrites, audit rows as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_redacted(lines: DataFrame, path: str, source: str = "doc_id") -> None:
    """One text a source, its lines in order, in a folder by source."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "redacted")))
    texts = lines.groupBy(source).agg(F.array_join(F.transform(ordered, lambda x: x["redacted"]), "\n").alias("value"))
    texts.write.mode("overwrite").partitionBy(source).text(path)


def overwrite_sessions(rows: DataFrame, path: str, session: str) -> None:
    """Replace only the sessions that occur in ``rows``."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(session).parquet(path)


def write_audit(events: DataFrame, path: str) -> None:
    events.select(F.to_json(F.struct(*sorted(events.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)
