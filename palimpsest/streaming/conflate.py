"""Conflation of event streams, and windowed counts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.session import scratch_dir


def conflate(events: DataFrame, key: str, terminal: Column, seq: Column, columns: list[str]) -> DataFrame:
    """Per key the event that a slow reader sees: the newest, but a terminal one is never displaced by
    progress. Works on batches and, with state per key, on streams."""
    rank = F.struct(terminal.cast("int").alias("t"), seq.alias("s"))
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("n_events"), *[F.max_by(c, rank).alias(c) for c in columns])


def windowed_counts(events: DataFrame, ts: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts per event-time window; rows later than the watermark are dropped by the stream."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count(F.lit(1)).alias("n_events"))


def run_once(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that is there now; its result as a table in the shared folder.

    In complete mode each micro-batch replaces the result, in append mode it adds to it.
    """
    spark = stream.sparkSession
    base = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/out")

    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(put)
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def fan_out_once(stream: DataFrame, subscribers: dict[str, Callable[[DataFrame], DataFrame]]) -> dict[str, DataFrame]:
    """Hand every micro-batch of a stream to all subscribers, each of which keeps what it makes of it in
    a table of its own. A batch that is run again after a failure replaces what it had written."""
    spark = stream.sparkSession
    base = f"{scratch_dir(spark)}/fan-out-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        for name, own in subscribers.items():
            own(kept).write.mode("overwrite").parquet(f"{base}/{name}/batch={number}")
        kept.unpersist()

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return {name: spark.read.parquet(f"{base}/{name}").drop("batch") for name in subscribers}
