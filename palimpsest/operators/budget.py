"""Token estimates and admission of requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PROMPT_SLACK, PAYLOAD_SLACK = 32, 512


def estimated_tokens(system: Column, payload: Column) -> Column:
    return F.octet_length(system).cast("long") + F.octet_length(payload) + PROMPT_SLACK


def input_limit(max_input: Column, window: Column, max_output: Column) -> Column:
    """The strictest known limit on input tokens, null if none is known."""
    return F.least(max_input, window - F.coalesce(max_output, F.lit(0)))


def admission(tokens: Column, output: Column, max_input: Column, max_output: Column, window: Column) -> Column:
    """admitted, or the first limit that a request breaks: output, then input, then the window."""
    return (
        F.when(output > max_output, "output_limit")
        .when(tokens > max_input, "input_limit")
        .when(tokens + output > window, "context_window")
        .otherwise("admitted")
    )


def payload_byte_budget(limit: Column, prompt: Column) -> Column:
    return limit - F.octet_length(prompt) - PAYLOAD_SLACK


def is_configured(api_format: Column, base_url: Column, model: Column, api_key: Column, window: Column, max_output: Column) -> Column:
    """Whether a model has all that its wire format needs."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    return (
        F.when(api_format == "openai", has(base_url) & has(model) & window.isNotNull())
        .when(api_format == "anthropic", has(api_key) & has(model) & max_output.isNotNull())
        .otherwise(has(api_key) & has(model))
    )


def total_tokens(api_format: Column, told: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """What the provider tells; one format tells only the parts, which are added up."""
    return F.when(api_format == "anthropic", tokens_in + tokens_out).otherwise(told)


def counted_columns(tokens: Column, method: Column) -> list[Column]:
    """Input tokens in the column of the method by which they were counted."""
    return [F.when(method == "estimated", tokens).alias("estimated_input_tokens"), F.when(method == "provider", tokens).alias("provider_counted_input_tokens")]
