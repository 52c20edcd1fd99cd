"""What the physical plans must keep: pruned scans, pushed filters, no cross joins, no Python where none is needed."""

import re

import pytest

from palimpsest.plans import catalog

SF = "/root/testdata/sf0.001"
#: Queries that need Python on the executors.
PYTHON = {
    "audit_chain", "audit_chain_verify", "audit_prefix", "block_locators", "comparison_texts", "docx_locators", "export_bundles", "fuzzy_ratio",
    "last_hash", "locator_checks", "page_characters", "pdf_selections", "preview_matches", "response_repair",
}
STREAMS = {"streaming_chain", "subscriber_queues", "streaming_conflation", "streaming_daily_counts", "streaming_fan_out"}


def plan(spark, name):
    return catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - STREAMS))
def test_no_cross_joins_and_python_only_where_needed(spark, name):
    text = plan(spark, name)
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", text)
    assert bool(re.search("Python|Pandas|Arrow", text)) == (name in PYTHON)


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "hydrated_left_join")
    assert "l_extendedprice" not in text and "o_totalprice" not in text
    assert "EqualTo(l_returnflag,R)" in plan(spark, "finding_lookup")
    assert "snapshot" not in plan(spark, "instruction_references")
    text = plan(spark, "token_totals")
    assert re.search(r"ReadSchema: struct<conv_id:bigint,role:string,text:string>", text)
    assert "EqualTo(o_orderstatus,F)" in plan(spark, "replaced_sessions")


def test_policies_are_broadcast_and_sessions_shuffled_once(spark):
    assert "BroadcastHashJoin" in plan(spark, "policy_layers_gdpr")
    assert plan(spark, "interval_dedup").count("Exchange hashpartitioning") == 1
    assert plan(spark, "audit_chain").count("Exchange hashpartitioning") == 1
    assert plan(spark, "effect_sweep").count("Exchange hashpartitioning") <= 2
