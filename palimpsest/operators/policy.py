"""Declarative policies as small tables, and how findings meet them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.schemas import EFFECT_MATRIX

# Fixed values: (entity type, display name, category, special category, risk, document, image, audio);
# blank falls back to the defaults, the pair of a kind as a unit.
DEFAULTS = ("", "", "unknown", "none", "medium", "redact/box", "redact/box", "redact/bleep")
GDPR = (
    ("face", "Face", "personal_data", "", "medium", "", "redact/blur", ""),
    ("minor_face", "Minor's face", "personal_data", "", "high", "", "redact/blur", ""),
    ("name", "Personal name", "personal_data", "", "high", "pseudonymize/token_replace", "", ""),
    ("email", "Email address", "personal_data", "", "high", "mask/partial_mask", "", ""),
    ("phone", "Phone number", "personal_data", "", "high", "mask/partial_mask", "", ""),
    ("address", "Address", "personal_data", "", "high", "", "", ""),
    ("id_number", "Identification number", "personal_data", "", "high", "", "", ""),
    ("financial", "Financial information", "personal_data", "", "high", "", "", ""),
    ("health_data", "Health data", "special_category", "health_data", "critical", "", "", ""),
    ("not_personal_data", "Not personal data", "not_personal_data", "", "low", "preserve/none", "preserve/none", "preserve/none"),
)
CCPA = (
    ("face", "Face", "personal_data", "", "medium", "", "redact/blur", ""),
    ("minor_face", "Minor's face", "personal_data", "", "critical", "", "redact/blur", ""),
    ("name", "Personal name", "personal_data", "", "high", "pseudonymize/token_replace", "", ""),
    ("email", "Email address", "personal_data", "", "high", "mask/partial_mask", "", ""),
    ("phone", "Phone number", "personal_data", "", "high", "mask/partial_mask", "", ""),
    ("address", "Postal address", "personal_data", "", "high", "", "", ""),
    ("government_id", "Government identifier", "personal_data", "", "critical", "", "", ""),
    ("financial", "Financial information", "personal_data", "", "critical", "", "", ""),
    ("account_credentials", "Account credentials", "personal_data", "", "critical", "", "", ""),
    ("online_identifier", "Online identifier", "personal_data", "", "high", "", "", ""),
    ("precise_geolocation", "Precise geolocation", "personal_data", "", "critical", "", "", ""),
    ("biometric", "Biometric identifier", "special_category", "biometric_identification", "critical", "", "", ""),
    ("health_data", "Health information", "special_category", "health_data", "critical", "", "", ""),
    ("racial_or_ethnic_origin", "Racial or ethnic origin", "special_category", "racial_or_ethnic_origin", "critical", "", "", ""),
    ("religious_belief", "Religious belief", "special_category", "religious_or_philosophical_belief", "critical", "", "", ""),
    ("minor_data", "Minor's personal information", "personal_data", "", "critical", "", "", ""),
    ("not_personal_data", "Not personal information", "not_personal_data", "", "low", "preserve/none", "preserve/none", "preserve/none"),
)
POLICIES = {"gdpr": GDPR, "ccpa-cpra": CCPA}
COLUMNS = ("entity_type", "display_name", "category", "special", "risk", "document", "image", "audio")


def rules(spark: SparkSession, policy: str) -> DataFrame:
    rows = [tuple(v or None for v in rule) for rule in POLICIES[policy]]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in COLUMNS))


def resolve(findings: DataFrame, policy: str, entity: Column, kind: Column, spark: SparkSession) -> DataFrame:
    """Add privacy_category, special_category_type, privacy_risk, action and effect.

    The rule table is a fixed dimension of some dozen rows, hence the broadcast.
    """
    own = rules(spark, policy).select(*[F.col(c).alias(f"_{c}") for c in COLUMNS])
    met = findings.withColumn("_entity", entity).withColumn("_kind", kind).join(
        F.broadcast(own), F.col("_entity") == F.col("_entity_type"), "left"
    )
    default = dict(zip(COLUMNS, DEFAULTS, strict=True))
    pair = lambda k: F.coalesce(F.col(f"_{k}"), F.lit(default[k]))
    effect = F.when(F.col("_kind") == "image", pair("image")).when(F.col("_kind") == "audio", pair("audio")).otherwise(pair("document"))
    return met.select(
        *findings.columns,
        F.coalesce("_category", F.lit(default["category"])).alias("privacy_category"),
        F.coalesce("_special", F.lit(default["special"])).alias("special_category_type"),
        F.coalesce("_risk", F.lit(default["risk"])).alias("privacy_risk"),
        F.substring_index(effect, "/", 1).alias("action"),
        F.substring_index(effect, "/", -1).alias("effect"),
    )


def effect_matrix(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(EFFECT_MATRIX), "kind string, action string, effect string")


def layer_violations(layers: DataFrame, spark: SparkSession) -> DataFrame:
    """Layers with an effect that their kind and action do not allow, or a text that they must not have."""
    allowed = F.broadcast(effect_matrix(spark)).withColumn("_ok", F.lit(True))
    met = layers.join(allowed, ["kind", "action", "effect"], "left")
    reason = (
        F.when((F.col("action") == "preserve") != (F.col("effect") == "none"), "preserve_uses_none")
        .when((F.col("action") == "pseudonymize") != (F.col("effect") == "token_replace"), "pseudonymize_uses_token")
        .when(F.col("custom_text").isNotNull() & (F.col("effect") != "token_replace"), "custom_text_needs_token")
        .when(F.col("_ok").isNull(), "unsupported_effect")
    )
    return met.withColumn("reason", reason).where("reason IS NOT NULL").drop("_ok")


def reclassify(layers: DataFrame, action: Column, effect: Column) -> DataFrame:
    """Apply a newly resolved pair: a reviewer's own effect stays, texts only stay with tokens."""
    keep = F.col("effect_source") == "reviewer"
    out = layers.withColumn("action", F.when(keep, F.col("action")).otherwise(action))
    out = out.withColumn("effect", F.when(keep, F.col("effect")).otherwise(effect))
    return out.withColumn("custom_text", F.when(F.col("effect") == "token_replace", F.col("custom_text")))


def unknown_types(edits: DataFrame, entity: str, policy: str) -> DataFrame:
    """Edits with a type that is neither unknown nor one of the policy's."""
    known = rules(edits.sparkSession, policy).select(F.col("entity_type").alias(entity))
    return edits.where(F.col(entity) != "unknown").join(F.broadcast(known), entity, "left_anti")  # a fixed table


def documents(spark: SparkSession, policy: str) -> DataFrame:
    """entity_type and the rule as JSON, without what it leaves to the defaults."""
    own = rules(spark, policy)
    pair = lambda k: F.when(F.col(k).isNotNull(), F.struct(F.substring_index(k, "/", 1).alias("action"), F.substring_index(k, "/", -1).alias("effect")))
    some = F.coalesce("document", "image", "audio").isNotNull()
    effects = F.when(some, F.struct(*[pair(k).alias(k) for k in ("document", "image", "audio")]))
    fields = ("display_name", F.col("category").alias("privacy_category"), F.col("special").alias("special_category_type"), F.col("risk").alias("privacy_risk"), effects.alias("effects"))
    return own.select("entity_type", F.to_json(F.struct(*fields)).alias("document"))


def snapshot_reason(snapshot: Column, sha256: Column, identity: Column, schema: str) -> Column:
    """Why a stored snapshot is not to be used: its digest, its form or its id; null if it is.

    ``schema``: its fields, sorted; a snapshot is canonical if writing what was read gives it back.
    """
    read = F.from_json(snapshot, schema)
    return (
        F.when(F.sha2(snapshot, 256) != sha256, "hash")
        .when(~F.coalesce(F.to_json(read, {"ignoreNullFields": "false"}) == snapshot, F.lit(False)), "not_canonical")
        .when(read["id"] != identity, "identity")
    )
