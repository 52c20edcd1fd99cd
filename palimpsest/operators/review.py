"""Hydrated review rows, gates, edits and table maintenance as plain old rows + edits -> new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import stored


def hydrate(findings: DataFrame, layers: DataFrame, key: str) -> DataFrame:
    """Findings with their layer, if any; what lacks one is for ``integrity_violations`` to report."""
    return findings.join(layers, key, "left")


def integrity_violations(findings: DataFrame, layers: DataFrame, key: str, session: str) -> DataFrame:
    """Findings without a layer, with several, or with one of another session; layers without a finding."""
    per = layers.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(session).alias("_low"), F.max(session).alias("_high"))
    met = findings.select(key, session).join(per, key, "full").select(
        key,
        F.when(F.col(session).isNull(), "orphan_layer")
        .when(F.col("n").isNull(), "missing_layer")
        .when(F.col("n") > 1, "several_layers")
        .when((F.col(session) != F.col("_low")) | (F.col(session) != F.col("_high")), "cross_session")
        .alias("reason"),
    )
    return met.where("reason IS NOT NULL")


def pending_gate(layers: DataFrame, session: str) -> DataFrame:
    """Per session: pending layers whatever their effect, the first of them, and whether output may go out."""
    pending = F.col("review_decision") == "needs_review"
    return layers.groupBy(session).agg(
        F.count_if(pending).alias("n_pending"),
        F.min(F.when(pending, F.col("layer_id"))).alias("first_pending"),
        (F.count_if(pending) == 0).alias("ready"),
    )


def render_selection(layers: DataFrame) -> DataFrame:
    return layers.where((F.col("review_decision") == "confirmed") & F.col("enabled") & (F.col("action") != "preserve"))


def fold_edits(edits: DataFrame, key: str, fields: list[str], order: str) -> DataFrame:
    """Of each key the last value that was set for each field."""
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in fields]
    return edits.groupBy(key).agg(F.count(F.lit(1)).alias("n_edits"), *last)


def latest(rows: DataFrame, key: str, order: list[Column], keep: int = 1) -> DataFrame:
    """The first ``keep`` rows of each key in the given order, with their rank."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("rank", nth).where(F.col("rank") <= keep)


def upsert(base: DataFrame, changes: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Base rows, replaced or joined by the latest change of their key."""
    newest = latest(changes, key, order).drop("rank").select(*base.columns)
    return base.join(newest.select(key), key, "left_anti").select(*base.columns).unionByName(newest)


def patch(base: DataFrame, patches: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """Base rows with the patch's allowed columns where they are set."""
    given = patches.select(key, *[F.col(c).alias(f"_{c}") for c in allowed])
    met = base.join(given, key, "left")
    return met.select(*[F.coalesce(f"_{c}", c).alias(c) if c in allowed else F.col(c) for c in base.columns])


def replace_session(base: DataFrame, new: DataFrame, session: str) -> DataFrame:
    """All rows of the new rows' sessions are replaced by the new ones."""
    return base.join(new.select(session).distinct(), session, "left_anti").select(*base.columns).unionByName(new.select(*base.columns))


def purge(table: DataFrame, purges: DataFrame, session: str) -> DataFrame:
    """Rows of sessions that are not on the purge list."""
    return table.join(purges.select(session).distinct(), session, "left_anti")


def overlap_violations(ranges: DataFrame, key: list[str], start: str, end: str, tie: str) -> DataFrame:
    """Ranges that begin before the one before them in their block ends."""
    before = F.lag(end).over(Window.partitionBy(*key).orderBy(start, end, tie))
    return ranges.withColumn("previous_end", before).where(F.col("previous_end") > F.col(start))


def session_layers(findings: DataFrame, layers: DataFrame, key: str, order: list[str]) -> DataFrame:
    """All layers as each session lists them: hydrated rows of which the finding or the layer is the
    session's, so that a layer of another session shows; numbered by ``order``."""
    met = findings.join(layers.withColumnRenamed("session", "layer_session"), key, "left")
    both = F.array_distinct(F.array_compact(F.array("session", "layer_session")))
    each = met.withColumn("session", F.explode(both))
    return each.withColumn("position", F.row_number().over(Window.partitionBy("session").orderBy(*order)))


def numbered(rows: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Add each row's place in the whole table's order. Rows are numbered within ranges, whose numbers
    begin after those of the ranges before them; no task sees more than its range."""
    spark = rows.sparkSession
    dealt = stored(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = sorted((r["_range"], r["n"]) for r in dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect())  # one row a partition
    before = [(k, sum(n for _, n in sizes[:nth])) for nth, (k, _) in enumerate(sizes)]
    offsets = F.broadcast(spark.createDataFrame(before, "_range int, _before long"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_nth", within).join(offsets, "_range").select(*rows.columns, (F.col("_before") + F.col("_nth")).alias(name))


def save_layers(findings: DataFrame, layers: DataFrame, saves: DataFrame, key: str, session: str, fields: list[str]) -> DataFrame:
    """Per save: how many findings and layers it meets by key and session, whether it was carried out
    (one of each), and the layer's fields after it."""
    rows = lambda side, name: side.groupBy(key, session).agg(F.count(F.lit(1)).alias(name))
    old = layers.groupBy(key, session).agg(F.count(F.lit(1)).alias("layer_rows"), *[F.first(c).alias(f"_{c}") for c in fields])
    met = saves.join(rows(findings, "finding_rows"), [key, session], "left").join(old, [key, session], "left")
    met = met.fillna(0, ["finding_rows", "layer_rows"])
    good = (F.col("finding_rows") == 1) & (F.col("layer_rows") == 1)
    return met.select(key, session, "finding_rows", "layer_rows", good.alias("saved"), *[F.when(good, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in fields])


def replace_measurements(current: DataFrame, new: DataFrame, key: str, identity: list[str], measures: list[str]) -> DataFrame:
    """Rows with new measurements where the identity is the same; a row whose identity would change is
    kept as it was and marked as refused."""
    given = new.select(key, *[F.col(c).alias(f"_{c}") for c in identity + measures], F.lit(True).alias("_given"))
    met = current.join(given, key, "left")
    same = F.coalesce("_given", F.lit(False))
    for c in identity:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return met.select(
        key, *identity, *[F.when(same, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in measures], (F.col("_given").isNotNull() & ~same).alias("refused")
    )


def transaction_events(changes: DataFrame, transaction: str, order: list[str], failed: Column) -> DataFrame:
    """Audit rows of transactions that were committed: one a change, numbered in order. Of a transaction
    with a failed change nothing is recorded."""
    whole = Window.partitionBy(transaction)
    kept = changes.withColumn("_failed", F.max(failed).over(whole)).where("NOT _failed").drop("_failed")
    return kept.withColumn("seq", F.row_number().over(whole.orderBy(*order)))


def optimistic_replace(base: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Contents replaced by those (key, expected, content) who knew the hash of what is there; the
    others are conflicts and change nothing."""
    met = base.join(wanted, key, "left")
    good = F.coalesce(F.col("expected") == F.col("content_hash"), F.lit(False))
    return met.select(
        key, F.when(good, F.sha2("content", 256)).otherwise(F.col("content_hash")).alias("content_hash"), (F.col("expected").isNotNull() & ~good).alias("conflict")
    )
