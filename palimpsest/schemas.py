"""Column types and value domains of the review tables."""

from __future__ import annotations

# Domains.
SOURCE_KINDS = ("document", "image", "audio")
SESSION_STATUSES = ("uploaded", "review_ready", "error", "cancelled")
PRIVACY_CATEGORIES = ("not_personal_data", "personal_data", "special_category", "unknown")
PRIVACY_RISKS = ("low", "medium", "high", "critical")
DATA_SUBJECT_CONTEXTS = ("adult", "minor", "unknown")
REVIEW_DECISIONS = ("needs_review", "confirmed", "preserved")
ACTIONS = ("redact", "mask", "pseudonymize", "preserve")
EFFECTS = ("box", "blur", "pixelate", "partial_mask", "token_replace", "bleep", "mute", "none")

# Effects allowed by (kind, action).
EFFECT_MATRIX = (
    ("image", "redact", "box"),
    ("image", "redact", "blur"),
    ("image", "redact", "pixelate"),
    ("image", "preserve", "none"),
    ("document", "redact", "box"),
    ("document", "mask", "partial_mask"),
    ("document", "pseudonymize", "token_replace"),
    ("document", "preserve", "none"),
    ("audio", "redact", "mute"),
    ("audio", "redact", "bleep"),
    ("audio", "preserve", "none"),
)

# Keys that audit payloads must not hold, and those that model items must not.
CONTENT_KEYS = (
    "custom_text description exact_text filename reason request_payload response_content reviewer_note "
    "stored_filename text"
).split()
POLICY_KEYS = "privacy_category special_category_type privacy_risk action effect".split()

TARGET = (
    "struct<line_id: string, exact_text: string, page: int, occurrence_id: string, x: double, y: double, "
    "width: double, height: double, rotation_degrees: double, start_time: double, end_time: double>"
)
FINDINGS = (
    f"session_id string, finding_id string, kind string, target {TARGET}, detected_entity_type string, "
    "reviewed_entity_type string, label string, detection_confidence double, privacy_category string, "
    "special_category_type string, privacy_risk string, data_subject_context string, origin string, "
    "review_decision string, edited boolean, created_at timestamp"
)
LAYERS = (
    "session_id string, layer_id string, finding_id string, action string, effect string, effect_source string, "
    "enabled boolean, fill_color string, custom_text string"
)
AUDIT_EVENTS = (
    "session_id string, seq long, event_id string, actor_id string, actor_type string, event_type string, "
    "payload string, previous_hash string, event_hash string, created_at string"
)
MODEL_LOGS = (
    "log_id string, session_id string, status string, page int, duration_ms long, actual_input_tokens long, "
    "actual_output_tokens long, reasoning_tokens long, total_tokens long"
)
