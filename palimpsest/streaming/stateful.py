"""Streams with state of their own per key: hash chains that go on, and queues of one place."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palimpsest.operators.audit import halves
from palimpsest.session import scratch_dir, ship


def chained(events: DataFrame, session: str = "session_id") -> DataFrame:
    """A stream's events with previous_hash and event_hash, as ``audit.build_chain`` makes them of a table.

    The state of a session is its last hash and seq, so the chain goes on over micro-batches and
    restarts. Within a micro-batch a session's events are put in order; over micro-batches they have to
    come in order, and an event that is not behind the last one fails the stream.
    """
    ship(events.sparkSession)
    fields = [c for c in events.columns if c != session]
    before, after = halves(F.struct(*fields, F.col(session).cast("string").alias("session_id")))
    rows = events.select(session, *fields, before.alias("_before"), after.alias("_after"))

    def go_on(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(frames)).sort_values("seq")
        last, seq = state.get if state.exists else (None, None)
        if seq is not None and own["seq"].iloc[0] <= seq:
            raise ValueError(f"an event of session {key[0]} came after a later one")
        previous, hashes = [], []
        for head, tail in zip(own["_before"], own["_after"], strict=True):
            previous.append(last)
            last = hashlib.sha256((head + (f'"{last}"' if last else "null") + tail).encode()).hexdigest()
            hashes.append(last)
        state.update((last, int(own["seq"].iloc[-1])))
        yield own[[session, *fields]].assign(previous_hash=previous, event_hash=hashes)

    out = T.StructType([*(events.schema[c] for c in (session, *fields)), T.StructField("previous_hash", T.StringType()), T.StructField("event_hash", T.StringType())])
    return rows.groupBy(session).applyInPandasWithState(go_on, out, "last string, seq long", "append", GroupStateTimeout.NoTimeout)


QUEUE = "item string, terminal boolean, closed boolean, waiting boolean"


class Slot:
    """A queue of one place: the newest item replaces the one that waits, but progress does not replace a
    terminal one, and closing replaces either. Who asks an empty queue gets the next item."""

    def __init__(self, item: str | None = None, terminal: bool = False, closed: bool = False, waiting: bool = False):
        self.item, self.terminal, self.closed, self.waiting = item, terminal, closed, waiting

    def apply(self, op: str, item: str | None, terminal: bool) -> tuple[str, str | None] | None:
        """What is handed out upon an operation: ("item", it), ("closed", None) or nothing."""
        if op == "publish" and not self.closed:
            if self.waiting:
                self.waiting = False
                return "item", item
            if self.item is None or terminal or not self.terminal:
                self.item, self.terminal = item, terminal
        elif op == "close" and not self.closed:
            told = self.waiting
            self.item, self.terminal, self.closed, self.waiting = None, False, True, False
            return ("closed", None) if told else None
        elif op == "drain":
            if self.closed:
                return "closed", None
            if self.item is not None:
                item, self.item, self.terminal = self.item, None, False
                return "item", item
            self.waiting = True
        return None


def queues(operations: DataFrame, subscriber: str, late: str = "1 hour", keep_ms: int = 3_600_000) -> DataFrame:
    """subscriber, seq, told, item: what each subscriber is handed out, by the operation that led to it.

    ``operations``: subscriber, ts, seq, op (publish, drain or close), item, terminal. The state is what waits in
    the subscriber's place. A closed subscriber's state goes ``keep_ms`` after it was closed in event
    time; an operation that comes later opens a new queue.
    """
    ship(operations.sparkSession)

    def go_on(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        slot = Slot(*state.get) if state.exists else Slot()
        own = pd.concat(list(frames)).sort_values("seq")
        out = []
        for seq, op, item, terminal in own[["seq", "op", "item", "terminal"]].itertuples(index=False):
            told = slot.apply(op, item, bool(terminal))
            if told:
                out.append((key[0], seq, *told))
        state.update((slot.item, slot.terminal, slot.closed, slot.waiting))
        if slot.closed:
            until = int(own["ts"].max().timestamp() * 1000) + keep_ms
            state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[subscriber, "seq", "told", "item"])

    rows = operations.select(subscriber, F.col("ts").cast("timestamp").alias("ts"), "seq", "op", "item", "terminal").withWatermark("ts", late)
    out = T.StructType([operations.schema[subscriber], T.StructField("seq", T.LongType()), T.StructField("told", T.StringType()), T.StructField("item", T.StringType())])
    return rows.groupBy(subscriber).applyInPandasWithState(go_on, out, QUEUE, "append", GroupStateTimeout.EventTimeTimeout)


def run_in_parts(parts: list[DataFrame], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream in append mode makes of tables that arrive one after another. It is stopped after each
    and started again from its checkpoint; a micro-batch that is run twice replaces what it had written."""
    spark = parts[0].sparkSession
    base = f"{scratch_dir(spark)}/parts-{uuid.uuid4().hex}"
    made = None
    for part in parts:
        part.write.mode("append").parquet(f"{base}/in")
        made = make(spark.readStream.schema(part.schema).parquet(f"{base}/in"))
        put = lambda batch, number: batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")
        query = made.writeStream.foreachBatch(put).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{base}/out").select(*made.columns)
