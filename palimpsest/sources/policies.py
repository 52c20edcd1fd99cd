"""Policies from files: small JSON documents, checked on the driver and spread as a fixed table."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.schemas import EFFECT_MATRIX, SOURCE_KINDS

#: A policy is a document of a few dozen rules; a larger file is refused.
MAX_BYTES = 1 << 20


class PolicyError(ValueError):
    pass


def _once(pairs):
    out = dict(pairs)
    if len(out) != len(pairs):
        raise PolicyError("a key occurs twice")
    return out


def parse(text: str) -> dict:
    """Check a policy: no key twice, defaults for every kind, known effects, entity types unique."""
    try:
        policy = json.loads(text, object_pairs_hook=_once)
    except json.JSONDecodeError as e:
        raise PolicyError(str(e)) from e
    effects = policy.get("defaults", {}).get("effects", {})
    if set(effects) != set(SOURCE_KINDS):
        raise PolicyError("defaults need an effect for every kind")
    names = [r.get("entity_type") for r in policy.get("rules", [])]
    if len(set(names)) != len(names) or not all(isinstance(n, str) and n for n in names):
        raise PolicyError("entity types must be given and differ")
    for rule in [{"effects": effects}, *policy.get("rules", [])]:
        for kind, pair in rule.get("effects", {}).items():
            if (kind, pair.get("action"), pair.get("effect")) not in EFFECT_MATRIX:
                raise PolicyError(f"{kind} does not support {pair}")
    return policy


def content_hash(policy: dict) -> str:
    text = json.dumps(policy, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return hashlib.sha256(text.encode()).hexdigest()


def load(spark: SparkSession, path: str) -> dict:
    """Read a policy through Spark, so that any store will do."""
    file = spark.read.format("binaryFile").load(path).where(F.col("length") <= MAX_BYTES).select("content").first()
    if file is None:
        raise PolicyError("no such policy, or too large")
    return parse(bytes(file.content).decode())


def effect_rows(spark: SparkSession, policy: dict) -> DataFrame:
    """entity_type (null: defaults), kind, action, effect."""
    rules = [{"entity_type": None, "effects": policy["defaults"]["effects"]}, *policy["rules"]]
    rows = [(r["entity_type"], k, p["action"], p["effect"]) for r in rules for k, p in sorted(r.get("effects", {}).items())]
    return spark.createDataFrame(rows, "entity_type string, kind string, action string, effect string")
