"""From a model's response to findings: finding the JSON, mending it, checking each item."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import variant as V
from palimpsest.schemas import DATA_SUBJECT_CONTEXTS, POLICY_KEYS

#: Strings and brackets of a JSON text; a string that never ends reaches to the end.
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\Z)|[][{}]', re.S)
_DECODER = json.JSONDecoder()


def _candidates(text: str) -> Iterator[int]:
    """Where objects open that lie in no other one. A closing bracket of the wrong kind ends them all."""
    at = text.find("{")
    while at >= 0:
        yield at
        due, end = "", len(text)
        for token in _TOKEN.finditer(text, at):
            mark = token[0]
            if mark in "{[":
                due += "}" if mark == "{" else "]"
            elif mark in "}]":
                due = due[:-1] if due[-1] == mark else ""
                if not due:
                    end = token.end()
                    break
        at = text.find("{", end)


def _settled(text: str) -> bool:
    """Whether strings and brackets close in the text, but for one brace at most that opens last."""
    marks = "".join(t for t in _TOKEN.findall(text) if len(t) == 1 or not t.endswith('"'))
    while (less := marks.replace("{}", "").replace("[]", "")) != marks:
        marks = less
    return marks in ("", "{")


def _decoded(text: str):
    """The value at the start of a text, or None. The decoder tells where it missed what: before a
    closing bracket one brace may be added, and one at the end."""
    mended = closed = False
    while True:
        try:
            value, end = _DECODER.raw_decode(text)
        except json.JSONDecodeError as error:
            at = error.pos
            if at >= len(text) and not closed:
                text, closed = text + "}", True
            elif text[at : at + 1] == "]" and not (mended or closed):
                text, mended = f"{text[:at]}}}{text[at:]}", True
            else:
                return None
        else:
            return value if not mended or _settled(text[end:]) else None


def first_object(text: str | None) -> str | None:
    """The first JSON object that stands in a text, as canonical JSON; null if there is none.

    Fences around the whole text go; an object within one that cannot be read is none of its own.
    """
    text = (text or "").strip()
    if text.startswith("```"):
        text = re.sub(r"\n[^\S\n]*```\s*\Z", "", text.partition("\n")[2])
    for at in _candidates(text):
        value = _decoded(text[at:])
        if isinstance(value, dict):
            return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return None


@F.pandas_udf(T.StringType())
def json_object(values: pd.Series) -> pd.Series:
    return values.map(first_object)


def items(responses: DataFrame, key: str, raw: str, kind: str = "text") -> DataFrame:
    """One row per item of ``findings``: key, pos, item fields, reject (a reason, or null).

    ``kind``: text items name a line and its text, image items a region, audio items a range.

    A response without a list of findings, or with a policy-owned key in any item, fails whole: one
    row with pos -1. Fields are checked by their JSON types: labels are strings; types, descriptions and
    reasons strings or null; contexts of the known ones; a confidence and the ends of a range numbers, or
    what spells them; a line and its text any value that is not empty, as text.
    """
    lists = responses.select(key, F.try_variant_get(V.parsed(F.col(raw)), "$.findings", "array<variant>").alias("f"))
    owned = F.exists("f", lambda x: reduce(lambda a, b: a | b, [V.member(x, k).isNotNull() for k in POLICY_KEYS]))
    lists = lists.withColumn("failed", F.when(F.col("f").isNull(), "no_findings").when(owned, "policy_key"))
    one = F.array(F.lit(None).cast("variant"))
    each = lists.select(key, "failed", F.posexplode_outer(F.when(F.col("failed").isNotNull(), one).otherwise(F.col("f"))).alias("pos", "i"))
    each = each.where("pos IS NOT NULL")
    of_kind = {"image": ["target_region"], "audio": ["audio_range"], "text": ["line_id", "exact_text"]}[kind]
    each = V.with_members(each, "i", ["entity_type", "data_subject_context", "label", "confidence", "description", "reason", *of_kind])
    own = lambda name: (F.col(f"v_{name}"), F.col(f"k_{name}"))
    # A missing type is unknown; one that is null stays null.
    default = lambda name, value: F.when((F.col(f"k_{name}") == "missing") & F.col("failed").isNull(), value).otherwise(V.text(*own(name)))
    values = {"entity_type": default("entity_type", "unknown"), "data_subject_context": default("data_subject_context", "unknown"), "label": default("label", "")}
    values |= {name: V.text(*own(name)) for name in ("description", "reason")} | {"confidence": V.as_number(*own("confidence"))}
    if kind == "image":
        each = V.with_members(each, "v_target_region", ["x", "y", "width", "height"])
        values["region"] = F.when(F.col("k_target_region") == "object", clamp_region(*[V.as_number(*own(n)) for n in ("x", "y", "width", "height")]))
    elif kind == "audio":
        each = V.with_members(each, "v_audio_range", ["start_time", "end_time"])
        values |= {n: F.when(F.col("k_audio_range") == "object", V.as_number(*own(n))) for n in ("start_time", "end_time")}
    else:
        values |= {n: F.when(F.col("failed").isNull(), V.shown(*own(n))) for n in ("line_id", "exact_text")}
    each = each.withColumn("k_i", V.kind(F.col("i"))).withColumns(values)
    optional = lambda name: F.col(f"k_{name}").isin("missing", "null", "string")
    bad = {
        "not_an_object": F.col("k_i") != "object",
        "confidence": ~F.col("k_confidence").isin("missing", "null") & ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)),
        "entity_type": ~optional("entity_type"),
        "data_subject_context": ~F.coalesce(F.col("data_subject_context").isin(*DATA_SUBJECT_CONTEXTS), F.lit(False)),
        "label": F.col("label").isNull(),
        "description": ~optional("description"),
        "reason": ~optional("reason"),
    }
    if kind == "image":
        bad["target_region"], target = F.col("region").isNull(), ["region"]
    elif kind == "audio":
        good = (F.col("start_time") >= 0) & (F.col("end_time") > F.col("start_time")) & ~F.isnan("end_time")
        bad["audio_range"], target = ~F.coalesce(good, F.lit(False)), ["start_time", "end_time"]
    else:
        bad, target = bad | {n: F.col(n) == "" for n in ("line_id", "exact_text")}, ["line_id", "exact_text"]
    reject = reduce(lambda c, b: c.when(b[1], b[0]), bad.items(), F.when(F.col("failed").isNotNull(), F.col("failed")))
    return each.select(
        key,
        F.when(F.col("failed").isNotNull(), -1).otherwise(F.col("pos")).alias("pos"),
        "entity_type",
        F.when(~F.isnan("confidence"), F.col("confidence")).alias("confidence"),
        *target,
        reject.alias("reject"),
        "label", "data_subject_context", "description", "reason",
    )


def parse_outcomes(responses: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Per response: parse_status, and how many items were parsed and rejected (null if it failed)."""
    per = found.groupBy(key).agg(
        F.max(F.col("pos") < 0).alias("failed"), F.count_if(F.col("reject").isNull()).alias("parsed"), F.count_if(F.col("reject").isNotNull()).alias("rejected")
    )
    met = responses.select(key).join(per, key, "left")
    ok = ~F.coalesce("failed", F.lit(False))
    count = lambda c: F.when(ok, F.coalesce(c, F.lit(0)))
    return met.select(
        key, F.when(ok, "succeeded").otherwise("failed").alias("parse_status"), count("parsed").alias("parsed_findings"), count("rejected").alias("rejected_findings")
    )


def unit(value: Column, default: float) -> Column:
    return F.least(F.greatest(F.coalesce(value.try_cast("double"), F.lit(default)), F.lit(0.0)), F.lit(1.0))


def clamp_region(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Region cut to the unit square; null if nothing is left."""
    cx, cy = unit(x, 0.0), unit(y, 0.0)
    w, h = F.least(unit(width, 0.1), 1 - cx), F.least(unit(height, 0.1), 1 - cy)
    return F.when((w > 0) & (h > 0), F.struct(cx.alias("x"), cy.alias("y"), w.alias("width"), h.alias("height")))


def pixel_box(region: Column, width: Column, height: Column) -> Column:
    """Pixels of a region, rounded half even and cut to the image; null if empty."""
    edge = lambda v, size: F.least(F.greatest(F.rint(v * size).cast("long"), F.lit(0)), size)
    left, top = edge(region["x"], width), edge(region["y"], height)
    right, bottom = edge(region["x"] + region["width"], width), edge(region["y"] + region["height"], height)
    box = F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"))
    return F.when((right > left) & (bottom > top), box)
