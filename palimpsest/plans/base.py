"""Rows that several query plans start from, in Spark and in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import detect as D
from palimpsest.operators import lines as L
from palimpsest.operators import policy as P
from palimpsest.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a plan under its name, with its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def source_lines(spark: SparkSession, d: str) -> DataFrame:
    return L.source_lines(table(spark, d, "documents"))


def found(spark: SparkSession, d: str) -> DataFrame:
    return D.detect(source_lines(spark, d))


def layers(spark: SparkSession, d: str, policy: str = "gdpr") -> DataFrame:
    """Detections with the policy's effects and stand-ins for what a reviewer decides."""
    rows = P.resolve(found(spark, d), policy, F.col("entity_type"), F.lit("document"), spark)
    mark = (F.col("doc_id") + F.col("line_no") + F.col("nth")) % 5
    return rows.select(
        "*",
        F.concat(F.lit("l"), F.substring("finding_id", 2, 100)).alias("layer_id"),
        F.when(mark == 0, "needs_review").when(mark == 1, "preserved").otherwise("confirmed").alias("review_decision"),
        (F.col("doc_id") % 11 != 0).alias("enabled"),
        F.when(F.col("doc_id") % 7 == 0, F.lit("Someone")).when(F.col("doc_id") % 7 == 1, F.lit("  ")).alias("custom_text"),
    )


LINES = """lines AS (
  SELECT doc_id, pos AS line_no, 't' || pos AS line_id, text
  FROM (SELECT doc_id, unnest(range(1, len(v) + 1)) AS pos, unnest(v) AS text
        FROM (SELECT doc_id, string_split(text, chr(10)) AS v FROM documents))
  WHERE regexp_matches(text, '[^\\s]'))"""

FOUND = (
    LINES
    + """, hits AS ("""
    + " UNION ALL ".join(
        f"SELECT doc_id, line_no, line_id, text AS line, {rank} AS rank, '{kind}' AS entity_type, {confidence} AS confidence, "
        f"list_filter(regexp_extract_all(text, '{pattern}'), lambda m: length(m) <= {most}) AS ms FROM lines"
        for rank, (kind, pattern, most, confidence) in enumerate(D.DETECTORS)
    )
    + """), found AS (
  SELECT printf('f%08d-%06d-%d-%04d', doc_id, line_no, rank, nth) AS finding_id, *
  FROM (SELECT doc_id, line_no, line_id, line, rank, entity_type, confidence::DOUBLE AS confidence,
               unnest(range(0, len(ms))) AS nth, unnest(ms) AS exact_text FROM hits))"""
)


def rules_sql(policy: str) -> str:
    rows = ", ".join("(" + ", ".join("NULL" if v == "" else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in P.POLICIES[policy])
    return f"rules({', '.join(P.COLUMNS)}) AS (VALUES {rows})"


LAYERS = (
    FOUND
    + ", "
    + rules_sql("gdpr")
    + """, layers AS (
  SELECT f.*, 'l' || substr(finding_id, 2) AS layer_id,
         split_part(coalesce(r.document, 'redact/box'), '/', 1) AS action,
         split_part(coalesce(r.document, 'redact/box'), '/', 2) AS effect,
         CASE (doc_id + line_no + nth) % 5 WHEN 0 THEN 'needs_review' WHEN 1 THEN 'preserved' ELSE 'confirmed' END AS review_decision,
         doc_id % 11 <> 0 AS enabled,
         CASE doc_id % 7 WHEN 0 THEN 'Someone' WHEN 1 THEN '  ' END AS custom_text
  FROM found f LEFT JOIN rules r ON r.entity_type = f.entity_type)"""
)

MASK = """CASE
  WHEN contains({x}, '@') THEN
    left(split_part({x}, '@', 1), 1) || repeat('*', greatest(length(split_part({x}, '@', 1)) - 1, 1)) || substr({x}, instr({x}, '@'))
  WHEN length(regexp_replace({x}, '[^0-9]', '', 'g')) >= 5 THEN
    array_to_string(list_transform(range(1, length({x}) + 1), lambda i:
      CASE WHEN regexp_matches({x}[i], '^[0-9]$') AND length(regexp_replace(substr({x}, i + 1), '[^0-9]', '', 'g')) >= 4
           THEN '*' ELSE {x}[i] END), '')
  ELSE
    array_to_string(list_transform(range(1, length({x}) + 1), lambda i:
      CASE WHEN contains('@.-_+/() ', {x}[i]) OR i = 1 OR contains('@.-_+/() ', {x}[i - 1]) THEN {x}[i] ELSE '*' END), '')
END"""
