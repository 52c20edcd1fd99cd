"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest, with one row per distinct text. Its number
of buckets is written beside it, so that any session, whatever its settings, attaches to it rightly.
A batch is reduced to one row per digest (map-side combined, so a text that makes up a third of all
rows costs one row per task), the new digests are found by a sort-merge anti-join with the index,
which shuffles the batch alone, and they are appended. Appends leave several files a bucket, so Spark
sorts a bucket as it reads it; ``compacted`` writes an index anew, with one file a bucket.

A whole table is two batches, the texts of more code points first: the second one meets a filled
index, and as of equal texts the longest stays, the first batch's rows are the ones to stay.

Defined cases: a null text counts as empty; texts are equal when identical without the characters
space and U+0009 to U+000D; of equal texts in a batch the one with the most code points stays, then
the smallest id; a text that the index holds already is dropped in favour of the indexed document;
rows that repeat an id and its text share one decision; a null id loses to any other and is kept
only if every document of its group has none; an empty batch gives an empty result. Columns of the
batch other than id and text are neither read nor returned, so their names cannot clash.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.session import scratch_dir, stored

WHITE_SPACE = r"[\x20\x09-\x0D]+"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, code points and the SHA-256 of its text without white space."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.length(text).cast("long").alias("n_points"),
        F.unhex(F.sha2(F.regexp_replace(text, WHITE_SPACE, ""), 256)).alias("digest"),
    )


class DigestIndex:
    """A bucketed table of digests. ``path`` outlives the session; the table's name need not.

    ``buckets`` counts for a new index only: an old one keeps the number that it was made with.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = (path or f"{scratch_dir(spark)}/digest-index-{uuid.uuid4().hex}").rstrip("/")
        self.buckets = self._made_with()
        if self.buckets is None:
            self.buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
            spark.createDataFrame([(self.buckets,)], "buckets int").coalesce(1).write.parquet(f"{self.path}-buckets")
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, n_points BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def _made_with(self) -> int | None:
        """The number of buckets of an index that lies here already."""
        if not self._holds(f"{self.path}-buckets"):
            if self._holds(self.path):
                raise ValueError(f"{self.path} holds data, but not the number of its buckets")
            return None
        return self.spark.read.schema("buckets int").parquet(f"{self.path}-buckets").first().buckets

    def _holds(self, path: str) -> bool:
        try:
            return bool(self.spark.read.parquet(path).columns)
        except AnalysisException:  # no such folder, or nothing in it
            return False

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, seen: DataFrame) -> None:
        """Append the digests of (doc_id, n_points, digest) rows that the index does not hold."""
        best = F.max(F.struct("n_points", (-F.col("doc_id")).alias("negated"))).alias("best")
        fresh = (
            seen.groupBy("digest").agg(best)
            .join(self.rows().hint("merge"), "digest", "left_anti")
            .select("digest", (-F.col("best.negated")).alias("keep_id"), F.col("best.n_points").alias("n_points"))
            .repartition(self.buckets, "digest")
            .sortWithinPartitions("digest")
        )
        fresh.write.insertInto(self.name)

    def decisions(self, seen: DataFrame) -> DataFrame:
        """doc_id, keep_id, group_size, kept, text_sha256 of rows whose digests the index holds."""
        groups = seen.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
        keepers = groups.join(self.rows().select("digest", "keep_id").hint("merge"), "digest")
        # Both sides are shuffled by digest, so a digest that fills a third of the rows is split at run time.
        return seen.join(keepers, "digest").select(
            "doc_id",
            "keep_id",
            "group_size",
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )

    def append(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Add the new texts of a batch; return its decisions, with group sizes within the batch."""
        seen = stored(digests(docs, id_col, text_col), "digests")
        self.add(seen)
        return self.decisions(seen)

    def compacted(self, path: str) -> DigestIndex:
        """The same index in another folder, with one file a bucket."""
        new = DigestIndex(self.spark, path, self.buckets)
        self.rows().repartition(new.buckets, "digest").sortWithinPartitions("digest").write.insertInto(new.name)
        return new

    def close(self) -> None:
        """Forget the table; the folder stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deduplicate a whole table by way of a new index, in two batches."""
    spark = docs.sparkSession
    seen = stored(digests(docs, id_col, text_col), "digests")
    middle = seen.agg(F.percentile_approx("n_points", 0.5)).first()[0] or 0  # any value would do
    index = DigestIndex(spark)
    index.add(seen.where(F.col("n_points") >= middle))
    index.add(seen.where(F.col("n_points") < middle))
    return index.decisions(seen)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""
