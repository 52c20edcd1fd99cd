"""Hash-chained audit events: building, verifying, reading."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import variant

ENVELOPE = ("actor_id", "actor_type", "created_at", "event_id", "event_type", "payload", "previous_hash", "session_id")


def canonical_json(columns: dict[str, Column]) -> Column:
    """Keys sorted, no spaces, nulls kept; for strings, integers and nested objects of such."""
    fields = [columns[k].alias(k) for k in sorted(columns)]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def _envelope(event: Column, previous: Column) -> Column:
    """An event as canonical JSON. The payload is JSON already and goes in as it is."""
    text = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1), F.lit("null"))
    parts = []
    for k in ENVELOPE:
        value = event["payload"] if k == "payload" else text(previous) if k == "previous_hash" else text(event[k])
        parts += [F.lit(("," if parts else "{") + f'"{k}":'), value]
    return F.concat(*parts, F.lit("}"))


def _link(event: Column, previous: Column) -> Column:
    return F.sha2(_envelope(event, previous), 256)


def halves(event: Column) -> tuple[Column, Column]:
    """An event's envelope before and after the previous hash."""
    none = F.lit(None).cast("string")
    whole = _envelope(event, none)
    mark = '"previous_hash":null'
    at = F.length(F.substring_index(whole, mark, -1))  # the session's id alone stands behind it
    return F.left(whole, F.length(whole) - at - len("null")), F.right(whole, at)


def build_chain(events: DataFrame, session: str = "session_id") -> DataFrame:
    """Add previous_hash and event_hash along seq within each session.

    A hash needs the one before, so a session is read in order, in one stream that carries nothing but
    the last hash; sessions are independent, and none has to fit in memory.
    """
    fields = [c for c in events.columns if c != session]
    row = F.struct(*fields, F.col(session).cast("string").alias("session_id"))
    before, after = halves(row)
    dealt = events.select(session, *fields, before.alias("_before"), after.alias("_after")).repartition(session).sortWithinPartitions(session, "seq")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = None, None
        for batch in batches:
            previous, hashes = [], []
            sessions, first, second = (batch.column(c).to_pylist() for c in (session, "_before", "_after"))
            for key, head, tail in zip(sessions, first, second, strict=True):
                if own != (key,):
                    own, last = (key,), None
                previous.append(last)
                last = hashlib.sha256((head + (f'"{last}"' if last else "null") + tail).encode()).hexdigest()
                hashes.append(last)
            kept = [batch.column(c) for c in (session, *fields)]
            yield pa.record_batch([*kept, pa.array(previous, pa.string()), pa.array(hashes, pa.string())], [session, *fields, "previous_hash", "event_hash"])

    types = [events.schema[c] for c in (session, *fields)]
    schema = T.StructType([*types, T.StructField("previous_hash", T.StringType()), T.StructField("event_hash", T.StringType())])
    return dealt.mapInArrow(chain, schema)


def verify_chain(chain: DataFrame, session: str = "session_id") -> DataFrame:
    """Per event: does it name the hash before it, and is its own hash right. Events are checked
    independently of each other."""
    along = Window.partitionBy(session).orderBy("seq")
    names = [c for c in chain.columns if c != session]
    event = F.struct(*[F.col(c) for c in names], F.col(session).cast("string").alias("session_id"))
    return chain.select(
        session,
        "seq",
        F.col("previous_hash").eqNullSafe(F.lag("event_hash").over(along)).alias("linked"),
        (F.col("event_hash") == _link(event, F.col("previous_hash"))).alias("intact"),
    )


def prefix_through(chain: DataFrame, boundary: Column, session: str = "session_id") -> DataFrame:
    """Events of each session up to the one whose hash is the boundary; none where it is missing."""
    last = F.max(F.when(F.col("event_hash") == boundary, F.col("seq"))).over(Window.partitionBy(session))
    return chain.withColumn("_last", last).where("seq <= _last").drop("_last")


def last_hash(chain: DataFrame, session: str = "session_id") -> DataFrame:
    return chain.groupBy(session).agg(F.count(F.lit(1)).alias("event_count"), F.max_by("event_hash", "seq").alias("last_hash"))


def forbidden_keys(payloads: DataFrame, payload: str, forbidden: list[str]) -> DataFrame:
    """Add ``forbidden_key``: the first of the keys found at any depth of the JSON, null if none."""
    found = F.array_intersect(variant.keys(F.col(payload)), F.array(*[F.lit(k) for k in forbidden]))
    return payloads.withColumn("forbidden_key", F.array_min(found))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 of a text in UTF-8, in lowercase hex: two digests, each over the padded key first."""
    padded = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in padded)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def signed(manifests: DataFrame, manifest: str, key: bytes) -> DataFrame:
    """Add manifest_sha256 and signature: HMAC-SHA256 over the manifest, which holds its own digest."""
    out = manifests.withColumn("manifest_sha256", F.sha2(manifest, 256))
    with_digest = F.concat(F.regexp_replace(manifest, r"\}$", ""), F.lit(',"sha256":"'), F.col("manifest_sha256"), F.lit('"}'))
    return out.withColumn("signature", hmac_sha256(key, with_digest))
