"""Names of columns that cannot clash with those of a caller's table."""

from __future__ import annotations

from pyspark.sql import DataFrame


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns called c0, c1 and so on, whatever their names."""
    return docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])


def unused(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it a name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
