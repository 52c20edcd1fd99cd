"""Projections that decide what a reader may see, and small decision tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import safe_filename
from palimpsest.operators.policy import rules
from palimpsest.sources.formats import stored_name


def safe_entity_type(rows: DataFrame, entity: str, policy: str) -> DataFrame:
    """Add ``safe_type``: the entity type if the policy knows it, else unknown."""
    known = F.broadcast(rules(rows.sparkSession, policy).select(F.col("entity_type").alias("_known")))  # a fixed table
    met = rows.join(known, F.col(entity) == F.col("_known"), "left")
    return met.withColumn("safe_type", F.coalesce("_known", F.lit("unknown"))).drop("_known")


def audit_projection(layers: DataFrame) -> Column:
    """JSON of a layer without any content: who, what and where, and a colour only for boxes."""
    colour = F.when(F.col("effect") == "box", F.col("fill_color"))
    fields = [
        F.col("layer_id"), F.col("entity_type"), F.col("action"), F.col("effect"), colour.alias("fill_color"),
        F.struct("line_id", F.col("start"), F.col("end")).alias("target"),
    ]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def audit_target(kind: Column, fields: dict[str, Column]) -> Column:
    """A target as an audit may show it, whatever its kind: where it is, and nothing of what it says."""
    own = {
        "document": ("kind", "line_id", "start", "end"),
        "image": ("kind", "page", "x", "y", "width", "height", "rotation_degrees"),
        "audio": ("kind", "start_time", "end_time"),
    }
    given = fields | {"kind": kind}
    told = [F.when(kind == k, F.to_json(F.struct(*[given[c].alias(c) for c in names]), {"ignoreNullFields": "false"})) for k, names in own.items()]
    return F.coalesce(*told)


def prompt_route(kind: Column, layout: Column) -> Column:
    """Which prompt a source gets: text for text and word-processing documents, image for fixed ones."""
    return F.when(kind == "audio", "audio").when((kind == "image") | (layout == "fixed"), "image").otherwise("text")


def status_after(status: Column, outcome: Column) -> Column:
    """Status of a session after an analysis; one that was ready for review stays so if it fails."""
    failed = F.when(outcome == "failed", "error").when(outcome == "cancelled", "cancelled")
    return F.when(outcome == "completed", "review_ready").when(status == "review_ready", "review_ready").otherwise(failed)


def target_reason(t: dict[str, Column]) -> Column:
    """Why a reviewer's target does not fit its source, the first reason that holds; null if it does.

    ``t``: source_kind, layout, page_count, duration; target_kind, surface, page, locator, end_time;
    and what look-ups say: occurrence_targetable, line_holds_text, locator_valid (null: not found).
    """
    yes = lambda c: F.coalesce(t[c], F.lit(False))
    document, layout, surface = t["source_kind"] == "document", t["layout"], t["surface"]
    on_page, on_picture = document & (layout == "fixed") & (surface == "page"), document & (layout == "word_processing") & (surface == "picture")
    image = (
        F.when((t["source_kind"] == "image") & (surface == "file"), F.lit(None).cast("string"))
        .when(on_page, F.when(t["page"] > t["page_count"], "pdf_page_out_of_range"))
        .when(on_picture, F.when(~yes("occurrence_targetable"), "docx_picture_target_invalid"))
        .otherwise("image_surface_mismatch")
    )
    text = (
        F.when(layout == "fixed", "pdf_requires_visual_target")
        .when(t["locator"] != F.when(layout == "text", "text").otherwise("docx"), "source_format_mismatch")
        .when((layout == "text") & ~yes("line_holds_text"), "exact_text_not_found")
        .when((layout == "word_processing") & ~yes("locator_valid"), "invalid_docx_text_target")
    )
    return (
        F.when(t["target_kind"] == "image", image)
        .when(t["target_kind"] != t["source_kind"], "kind_mismatch")
        .when(t["target_kind"] == "document", text)
        .when(t["end_time"] > t["duration"], "range_beyond_end")
    )


def descriptor(sha256: Column, name: Column, size: Column) -> Column:
    return F.struct(sha256.alias("sha256"), stored_name(sha256, safe_filename(name)).alias("stored_as"), size.alias("bytes"))


def fan_out(findings: DataFrame, members: DataFrame, group: str) -> DataFrame:
    """Findings of a distinct source for each of its occurrences, with an id of their own."""
    met = findings.join(members.select(group, "occurrence"), group)
    return met.withColumn("finding_id", F.concat_ws("@", "finding_id", "occurrence"))


def duration_ms(began: Column, ended: Column) -> Column:
    """Whole milliseconds between two times in seconds, half even, never negative."""
    return F.greatest(F.bround((ended - began) * 1000, 0).cast("long"), F.lit(0).cast("long"))


def progress(done: Column, total: Column, share: float = 0.45) -> Column:
    return 0.15 + share * done / F.greatest(total, F.lit(1))


def without_debug(logs: DataFrame, debug: list[str]) -> DataFrame:
    """Logs without their debug columns, and whether there was anything in them."""
    some = F.coalesce(*[F.col(c) for c in debug]).isNotNull()
    kept = [c for c in logs.columns if c not in debug]
    return logs.select(*kept, some.alias("scrubbed"), *[F.lit(None).cast("string").alias(c) for c in debug])


def attachment_log(kind: Column, size: Column, sha256: Column) -> Column:
    """An attachment as a log shows it: JSON with sorted keys, without contents; null for none."""
    omitted = [size.alias("byte_length"), F.lit(True).alias("omitted_from_log"), sha256.alias("sha256")]
    picture = F.struct(*omitted, F.lit("data:image/jpeg;base64,<omitted>").alias("url"))
    sound = F.struct(omitted[0], F.lit("<omitted>").alias("data"), F.lit("wav").alias("format"), *omitted[1:])
    return F.when(kind == "image", F.to_json(F.struct(picture.alias("image_url"), F.lit("image_url").alias("type")))).when(
        kind == "audio", F.to_json(F.struct(sound.alias("input_audio"), F.lit("input_audio").alias("type")))
    )


def picture_rejects(groups: DataFrame, session: str) -> DataFrame:
    """Accepted and rejected findings over groups of equal pictures (n, findings, rejects, placed)."""
    taken = F.col("findings") * F.col("placed")
    return groups.groupBy(session).agg(
        F.sum(taken).alias("accepted"), F.sum(F.col("rejects") + F.col("findings") * F.col("n") - taken).alias("rejected"), F.count(F.lit(1)).alias("n_calls")
    )


def aspect_distance(width: Column, height: Column, other_width: Column, other_height: Column) -> Column:
    """How far another picture's aspect ratio is from the expected one, as a share of that."""
    expected = width / height
    return F.abs(expected - other_width / other_height) / expected


def read_target(raw: Column, stored_kind: Column, schema: str) -> Column:
    """A stored target; null if it cannot be read or is of another kind than is stored beside it."""
    whole = F.json_object_keys(raw).isNotNull()
    target = F.from_json(raw, schema, {"mode": "PERMISSIVE"})
    return F.when(whole & (target["kind"] == stored_kind), target)
