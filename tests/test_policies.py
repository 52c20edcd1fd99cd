import json

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import blocks
from palimpsest.sources import policies

GOOD = {
    "defaults": {
        "effects": {
            "document": {"action": "redact", "effect": "box"},
            "image": {"action": "redact", "effect": "blur"},
            "audio": {"action": "redact", "effect": "bleep"},
        }
    },
    "rules": [{"entity_type": "email", "effects": {"document": {"action": "mask", "effect": "partial_mask"}}}, {"entity_type": "face"}],
}


def test_load(spark, tmp_path):
    (tmp_path / "policy.json").write_text(json.dumps(GOOD))
    policy = policies.load(spark, str(tmp_path / "policy.json"))
    assert policies.content_hash(policy) == policies.content_hash(json.loads(json.dumps(GOOD, sort_keys=True)))
    rows = {(r.entity_type, r.kind): (r.action, r.effect) for r in policies.effect_rows(spark, policy).collect()}
    assert rows[None, "image"] == ("redact", "blur") and rows["email", "document"] == ("mask", "partial_mask") and len(rows) == 4


@pytest.mark.parametrize(
    "change",
    [
        lambda t: t.replace('"rules"', '"defaults"'),
        lambda t: t.replace('"audio"', '"video"'),
        lambda t: t.replace("bleep", "blur"),
        lambda t: t.replace('"face"', '"email"'),
        lambda t: t[:-1],
    ],
)
def test_bad_policies_are_refused(change):
    with pytest.raises(policies.PolicyError):
        policies.parse(change(json.dumps(GOOD)))


def test_ranges_are_replaced_from_the_end(spark):
    frame = spark.createDataFrame([("b1", "aé😀 b c"), ("b2", "x"), ("b3", None)], "block_id string, text string")
    ranges = [("b1", 1, 3, "é😀", "[1]"), ("b1", 4, 5, "b", "[22]"), ("b1", 6, 7, "z", "[3]")]
    ranges = spark.createDataFrame(ranges, 'block_id string, start long, end long, exact_text string, replacement string')
    got = {r.block_id: (r.rendered, r.n_stale) for r in blocks.replace_ranges(frame, ranges, "block_id").collect()}
    assert got == {"b1": ("a[1] [22] c", 1), "b2": ("x", 0), "b3": (None, 0)}
    good = [F.lit(x) for x in (1, 1, 1, 1, 1, 1, None, "rId1", "image/PNG")]
    told = lambda **changed: [changed.get(f"a{k}", c) for k, c in enumerate(good)]
    cases = {
        "unsupported_drawing_type": told(a0=F.lit(0)), "unsupported_picture_container": told(a5=F.lit(2)), "external_image": told(a6=F.lit("x"), a7=F.lit("")),
        "missing_image_relationship": told(a8=F.lit(None).cast("string")), "relationship_is_not_an_image": told(a8=F.lit("")), "unsupported_image_format": told(a8=F.lit("image/x-emf")),
    }
    row = frame.select(*[blocks.unsupported_reason(*c).alias(k) for k, c in cases.items()], blocks.unsupported_reason(*good).alias("none")).first()
    assert row.asDict() == {k: k for k in cases} | {"none": None}


def test_a_range_goes_from_all_its_leaves(spark):
    leaves = spark.createDataFrame([("b", 0, "Hé"), ("b", 1, "llo "), ("b", 2, "wor"), ("b", 3, "ld"), ("c", 0, "x")], "key string, nth int, text string")
    ranges = spark.createDataFrame([("b", 1, 8, "[X]")], "key string, start long, end long, replacement string")
    got = {(r.key, r.nth): r.rendered for r in blocks.replace_in_leaves(leaves, ranges, "key").collect()}
    assert got == {("b", 0): "H[X]", ("b", 1): "", ("b", 2): "r", ("b", 3): "ld", ("c", 0): "x"}
