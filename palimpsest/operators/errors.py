"""The error catalogue, and what a client may be told."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Code, category, HTTP status; codes whose failure may pass are in RETRYABLE.
CATALOG = (
    ("request_validation_failed", "validation", 422),
    ("empty_update", "validation", 422),
    ("unsupported_upload_type", "validation", 415),
    ("file_too_large", "validation", 413),
    ("text_line_too_large", "validation", 422),
    ("unsafe_path", "validation", 400),
    ("no_models", "configuration", 409),
    ("model_not_found", "validation", 404),
    ("model_store_invalid", "configuration", 500),
    ("active_model_not_set", "configuration", 409),
    ("active_instruction_set_not_set", "configuration", 409),
    ("settings_store_invalid", "configuration", 500),
    ("model_endpoint_not_configured", "configuration", 409),
    ("token_count_failed", "transport", 502),
    ("model_input_limit_exceeded", "configuration", 422),
    ("model_output_limit_exceeded", "configuration", 409),
    ("model_context_limit_exceeded", "configuration", 422),
    ("vision_not_supported", "configuration", 409),
    ("audio_not_supported", "configuration", 409),
    ("pdf_dependency_missing", "configuration", 503),
    ("docx_processor_missing", "configuration", 503),
    ("docx_processor_busy", "processing", 503),
    ("docx_unsupported_feature", "validation", 422),
    ("docx_processing_failed", "processing", 500),
    ("document_converter_missing", "configuration", 503),
    ("document_conversion_failed", "processing", 500),
    ("ffmpeg_unavailable", "configuration", 503),
    ("prompt_missing", "configuration", 500),
    ("unsupported_prompt_kind", "configuration", 501),
    ("instruction_set_not_found", "configuration", 404),
    ("invalid_instruction_set", "configuration", 422),
    ("instruction_set_exists", "conflict", 409),
    ("instruction_set_conflict", "conflict", 409),
    ("instruction_set_not_locked", "conflict", 409),
    ("instruction_set_integrity_error", "storage", 500),
    ("session_not_found", "validation", 404),
    ("session_file_missing", "storage", 500),
    ("source_integrity_error", "storage", 500),
    ("analysis_already_running", "conflict", 409),
    ("provider_connection_failed", "transport", 502),
    ("provider_model_not_found", "transport", 502),
    ("provider_authentication_failed", "transport", 502),
    ("provider_rate_limited", "transport", 503),
    ("provider_request_invalid", "transport", 502),
    ("provider_response_invalid", "processing", 502),
    ("not_pdf_session", "validation", 422),
    ("pdf_page_out_of_range", "validation", 422),
    ("invalid_docx_text_target", "validation", 422),
    ("finding_not_found", "validation", 404),
    ("layer_not_found", "validation", 404),
    ("invalid_finding_update", "validation", 422),
    ("invalid_layer_update", "validation", 422),
    ("duplicate_finding_layer", "conflict", 409),
    ("invalid_action_effect", "validation", 422),
    ("output_missing", "validation", 404),
    ("output_state_changed", "conflict", 409),
    ("output_blocked_pending_review", "conflict", 409),
    ("audio_render_failed", "rendering", 500),
    ("export_missing", "export", 404),
    ("review_integrity_error", "storage", 500),
    ("internal_error", "internal", 500),
)
RETRYABLE = "token_count_failed docx_processor_busy provider_connection_failed provider_rate_limited output_state_changed".split()
# What each failure of a provider is reported as.
PROVIDER_CODES = {
    "authentication": "provider_authentication_failed",
    "connection": "provider_connection_failed",
    "rate_limit": "provider_rate_limited",
    "model_not_found": "provider_model_not_found",
    "request": "provider_request_invalid",
    "token_count": "token_count_failed",
}
# Fixed value: all that a session says of its failure.
PUBLIC_MESSAGE = "The operation failed. Review the session logs for details."


def catalog(spark: SparkSession) -> DataFrame:
    rows = [(code, category, code in RETRYABLE, status) for code, category, status in CATALOG]
    return spark.createDataFrame(rows, "code string, category string, retryable boolean, http_status int")


def described(rows: DataFrame, code: str) -> DataFrame:
    """Add category, retryable and http_status; a code that the catalogue lacks is an internal error."""
    known = F.broadcast(catalog(rows.sparkSession).withColumnRenamed("code", "_code"))  # a fixed table
    met = rows.join(known, F.col(code) == F.col("_code"), "left").drop("_code")
    last = next(r for r in CATALOG if r[0] == "internal_error")
    return met.fillna({"category": last[1], "retryable": False, "http_status": last[2]})


def provider_code(failure: Column) -> Column:
    """Error code of a provider's failure; null for one that is none."""
    return F.coalesce(*[F.when(failure == k, v) for k, v in PROVIDER_CODES.items()])


def public_message(message: Column) -> Column:
    """What a client is told of a stored message: that there is one, and nothing of it."""
    return F.when(message.isNotNull(), PUBLIC_MESSAGE)
