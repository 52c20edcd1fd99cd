"""Queries over models and their logs: settings, budgets, diagnostics, snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import audit as A
from palimpsest.operators import budget as B
from palimpsest.operators import policy as P
from palimpsest.operators import projection as J
from palimpsest.plans.base import FOUND, found, query, rules_sql
from palimpsest.session import table


@query(
    """WITH m AS (SELECT event_id, ['openai', 'anthropic', 'google'][1 + event_id % 3] AS api_format, CASE WHEN event_id % 4 > 0 THEN 'http://x' ELSE '' END AS base_url, CASE WHEN event_id % 5 > 0 THEN 'm' END AS model,
        CASE WHEN event_id % 7 > 0 THEN 'k' ELSE '' END AS api_key, CASE WHEN event_id % 11 > 0 THEN 8000 END AS window_tokens, CASE WHEN event_id % 2 > 0 THEN 500 END AS max_output FROM events)
      SELECT event_id, api_format, coalesce(CASE api_format WHEN 'openai' THEN base_url <> '' AND model <> '' AND window_tokens IS NOT NULL WHEN 'anthropic' THEN api_key <> '' AND model <> '' AND max_output IS NOT NULL
        ELSE api_key <> '' AND model <> '' END, false) AS configured FROM m"""
)
def configured_models(spark, d):
    """Whether a model has all that its wire format needs."""
    e = F.col("event_id")
    api_format = F.get(F.array(F.lit("openai"), F.lit("anthropic"), F.lit("google")), (e % 3).cast("int"))
    told = B.is_configured(
        api_format, F.when(e % 4 > 0, "http://x").otherwise(""), F.when(e % 5 > 0, "m"), F.when(e % 7 > 0, "k").otherwise(""), F.when(e % 11 > 0, 8000), F.when(e % 2 > 0, 500)
    )
    return table(spark, d, "events").select("event_id", api_format.alias("api_format"), told.alias("configured"))


@query(
    """WITH t AS (SELECT conv_id, turn, strlen(text) AS input, turn * 10 AS output, ['openai', 'anthropic', 'google'][1 + conv_id % 3] AS api_format, CASE WHEN turn % 4 > 0 THEN strlen(text) + turn * 10 + 5 END AS told,
        conv_id % 2 = 0 AS counted FROM conversations)
      SELECT conv_id, turn, CASE WHEN api_format = 'anthropic' THEN input + output ELSE told END AS total_tokens, CASE WHEN NOT counted THEN input END AS estimated_input_tokens,
        CASE WHEN counted THEN input END AS provider_counted_input_tokens FROM t"""
)
def token_columns(spark, d):
    """Tokens in all, as a provider tells or as its format adds them up, and those of the input under
    the method by which they were counted."""
    size, output = F.octet_length("text"), F.col("turn") * 10
    api_format = F.get(F.array(F.lit("openai"), F.lit("anthropic"), F.lit("google")), (F.col("conv_id") % 3).cast("int"))
    method = F.when(F.col("conv_id") % 2 == 0, "provider").otherwise("estimated")
    total = B.total_tokens(api_format, F.when(F.col("turn") % 4 > 0, size + output + 5), size, output)
    return table(spark, d, "conversations").select("conv_id", "turn", total.alias("total_tokens"), *B.counted_columns(size, method))


@query(
    """WITH l AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text END AS request, CASE WHEN turn % 3 = 0 THEN text END AS response, CASE WHEN turn % 5 = 4 THEN 'x' END AS error FROM conversations)
       SELECT conv_id, turn, request IS NOT NULL OR response IS NOT NULL OR error IS NOT NULL AS scrubbed, NULL::VARCHAR AS debug_request, NULL::VARCHAR AS debug_response, NULL::VARCHAR AS debug_error FROM l"""
)
def scrubbed_logs(spark, d):
    """Logs as they are outside of development: nothing of what went to a model or came back."""
    only = lambda ok, c: F.when(ok, c)
    logs = table(spark, d, "conversations").select(
        "conv_id", "turn", only(F.col("turn") % 2 == 0, F.col("text")).alias("debug_request"), only(F.col("turn") % 3 == 0, F.col("text")).alias("debug_response"), only(F.col("turn") % 5 == 4, F.lit("x")).alias("debug_error")
    )
    return J.without_debug(logs, ["debug_request", "debug_response", "debug_error"])


@query(
    """WITH a AS (SELECT page_id, html, CASE page_id % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'audio' END AS kind FROM pages)
      SELECT page_id, CASE kind WHEN 'image' THEN '{"image_url":{"byte_length":' || strlen(html) || ',"omitted_from_log":true,"sha256":"' || sha256(html) || '","url":"data:image/jpeg;base64,<omitted>"},"type":"image_url"}'
        WHEN 'audio' THEN '{"input_audio":{"byte_length":' || strlen(html) || ',"data":"<omitted>","format":"wav","omitted_from_log":true,"sha256":"' || sha256(html) || '"},"type":"input_audio"}' END AS log_part FROM a"""
)
def attachment_logs(spark, d):
    """Requests' attachments as a log shows them: their size and digest, and no contents."""
    kind = F.when(F.col("page_id") % 3 == 0, "image").when(F.col("page_id") % 3 == 1, "audio")
    return table(spark, d, "pages").select("page_id", J.attachment_log(kind, F.octet_length("html"), F.sha2("html", 256)).alias("log_part"))


@query(
    """WITH p AS (SELECT l_orderkey, l_partkey % 6 AS sha, l_quantity::BIGINT % 4 AS findings, l_suppkey % 3 AS rejects, count(*) OVER (PARTITION BY l_orderkey, l_partkey % 6) AS group_size,
        row_number() OVER (PARTITION BY l_orderkey, l_partkey % 6 ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS nth, l_tax < 0.04 AS fits FROM lineitem),
      g AS (SELECT l_orderkey, sha, any_value(group_size) AS n, max(CASE WHEN nth = 1 THEN findings END) AS findings, max(CASE WHEN nth = 1 THEN rejects END) AS rejects, count(*) FILTER (fits) AS placed FROM p GROUP BY ALL)
      SELECT l_orderkey, sum(findings * placed)::BIGINT AS accepted, sum(rejects + findings * n - findings * placed)::BIGINT AS rejected, count(*) AS n_calls FROM g GROUP BY 1"""
)
def picture_rejects(spark, d):
    """One call for each distinct picture: its findings count for every occurrence, and those that no
    occurrence took are rejected, as are the call's own rejects."""
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", (F.col("l_partkey") % 6).alias("sha"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("nth"), (F.round("l_quantity").cast("long") % 4).alias("findings"),
        (F.col("l_suppkey") % 3).alias("rejects"), (F.col("l_tax") < 0.04).alias("fits"),
    )
    groups = rows.groupBy("l_orderkey", "sha").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("findings", "nth").alias("findings"), F.min_by("rejects", "nth").alias("rejects"), F.count_if("fits").alias("placed")
    )
    return J.picture_rejects(groups, "l_orderkey")


@query(
    """SELECT l_orderkey, l_linenumber, round((10 + l_partkey % 90) / (5 + l_suppkey % 40), 9) AS aspect_ratio,
      round(abs((10 + l_partkey % 90) / (5 + l_suppkey % 40) - (l_quantity + 1) / (l_linenumber + 2)) / ((10 + l_partkey % 90) / (5 + l_suppkey % 40)), 9) AS distance FROM lineitem"""
)
def aspect_ratios(spark, d):
    """Pictures' aspect ratios, and how far off those of the objects that might show them are."""
    w, h = 10 + F.col("l_partkey") % 90, 5 + F.col("l_suppkey") % 40
    distance = J.aspect_distance(w, h, F.col("l_quantity") + 1, F.col("l_linenumber") + 2)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(w / h, 9).alias("aspect_ratio"), F.round(distance, 9).alias("distance"))


@query(
    """WITH t AS (SELECT l_orderkey, l_linenumber, ['document', 'image', 'audio'][1 + l_partkey % 3] AS stored_kind, ['document', 'image', 'audio'][1 + CASE WHEN l_partkey % 9 = 4 THEN 2 ELSE l_partkey % 3 END] AS kind,
        l_suppkey % 13 = 0 AS broken, l_linenumber AS page FROM lineitem)
      SELECT l_orderkey, l_linenumber, NOT broken AND kind = stored_kind AS valid, CASE WHEN NOT broken AND kind = stored_kind THEN '{"kind":"' || kind || '","page":' || page || '}' END AS target FROM t"""
)
def target_round_trips(spark, d):
    """Stored targets read back: they must be whole, and of the kind that is stored beside them."""
    pick = lambda n: F.get(F.array(F.lit("document"), F.lit("image"), F.lit("audio")), n.cast("int"))
    kind = pick(F.when(F.col("l_partkey") % 9 == 4, 2).otherwise(F.col("l_partkey") % 3))
    whole = F.to_json(F.struct(kind.alias("kind"), F.col("l_linenumber").alias("page")))
    raw = F.when(F.col("l_suppkey") % 13 == 0, F.left(whole, F.length(whole) - 1)).otherwise(whole)
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", pick(F.col("l_partkey") % 3).alias("stored_kind"), raw.alias("target_json"))
    target = J.read_target(F.col("target_json"), F.col("stored_kind"), "kind string, page int")
    return rows.select("l_orderkey", "l_linenumber", target.isNotNull().alias("valid"), F.to_json(target).alias("target"))


@query(
    """WITH s AS (SELECT c_custkey, '{"id":"s' || CASE WHEN c_custkey % 13 = 0 THEN 0 ELSE c_custkey END || '","name":"' || c_name || '"}' AS canonical FROM customer),
      t AS (SELECT *, CASE WHEN c_custkey % 11 = 0 THEN replace(canonical, ',', ', ') ELSE canonical END AS snapshot FROM s)
      SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'hash' WHEN snapshot <> canonical THEN 'not_canonical' WHEN c_custkey % 13 = 0 AND c_custkey <> 0 THEN 'identity' END AS reason FROM t"""
)
def snapshot_checks(spark, d):
    """Snapshots of instruction sets against their stored digest, their canonical form and their id."""
    key = F.col("c_custkey")
    canonical = A.canonical_json({"id": F.concat(F.lit("s"), F.when(key % 13 == 0, 0).otherwise(key)), "name": F.col("c_name")})
    snapshot = F.when(key % 11 == 0, F.replace(canonical, F.lit(","), F.lit(", "))).otherwise(canonical)
    stored = F.when(key % 7 == 0, "other").otherwise(F.sha2(snapshot, 256))
    rows = table(spark, d, "customer").select("c_custkey", snapshot.alias("snapshot"), stored.alias("sha256"), F.concat(F.lit("s"), key).alias("id"))
    return rows.select("c_custkey", P.snapshot_reason(F.col("snapshot"), F.col("sha256"), F.col("id"), "id string, name string").alias("reason"))


@query(
    f"""WITH {FOUND}, {rules_sql('gdpr')}, u AS (SELECT entity_type, count(*) AS n_findings FROM found GROUP BY 1),
      e AS (SELECT *, [x FOR x IN [CASE WHEN document IS NOT NULL THEN '"document":{{"action":"' || split_part(document, '/', 1) || '","effect":"' || split_part(document, '/', 2) || '"}}' END,
          CASE WHEN image IS NOT NULL THEN '"image":{{"action":"' || split_part(image, '/', 1) || '","effect":"' || split_part(image, '/', 2) || '"}}' END,
          CASE WHEN audio IS NOT NULL THEN '"audio":{{"action":"' || split_part(audio, '/', 1) || '","effect":"' || split_part(audio, '/', 2) || '"}}' END] IF x IS NOT NULL] AS effects FROM rules)
      SELECT e.entity_type, coalesce(n_findings, 0) AS n_findings, '{{"display_name":"' || display_name || '"' || coalesce(',"privacy_category":"' || category || '"', '') || coalesce(',"special_category_type":"' || special || '"', '')
        || coalesce(',"privacy_risk":"' || risk || '"', '') || CASE WHEN len(effects) > 0 THEN ',"effects":{{' || array_to_string(effects, ',') || '}}' ELSE '' END || '}}' AS document
      FROM e LEFT JOIN u USING (entity_type)"""
)
def policy_documents(spark, d):
    """Rules of a policy as portable documents that leave out what is not set, and how often each is met."""
    used = found(spark, d).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))
    return P.documents(spark, "gdpr").join(used, "entity_type", "left").select("entity_type", F.coalesce("n", F.lit(0)).alias("n_findings"), "document")
