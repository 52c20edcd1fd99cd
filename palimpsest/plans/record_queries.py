"""Queries over records: review rows, audit chains, tokens, timelines, regions, matching, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators import audit as A
from palimpsest.operators import budget as B
from palimpsest.operators import extract as E
from palimpsest.operators import match as M
from palimpsest.operators import policy as P
from palimpsest.operators import review as V
from palimpsest.operators import timeline as T
from palimpsest.plans.base import FOUND, found, query
from palimpsest.session import scratch_dir, table
from palimpsest.sources import bundles as U
from palimpsest.sources import formats as S
from palimpsest.streaming import conflate as C
from palimpsest.streaming import stateful as Y

# --- review rows -----------------------------------------------------------------------------

_LAYER_ROWS = """l AS (
  SELECT l_orderkey, l_linenumber, ['document', 'image', 'audio'][1 + l_linenumber % 3] AS kind,
         ['redact', 'mask', 'pseudonymize', 'preserve'][1 + l_suppkey % 4] AS action,
         ['box', 'blur', 'pixelate', 'partial_mask', 'token_replace', 'bleep', 'mute', 'none'][1 + l_partkey % 8] AS effect,
         CASE WHEN l_orderkey % 5 = 0 THEN 'Someone' END AS custom_text,
         CASE WHEN l_partkey % 3 = 0 THEN 'reviewer' ELSE 'policy' END AS effect_source FROM lineitem)"""


def _layer_rows(spark, d):
    pick = lambda names, n: F.get(F.array(*[F.lit(x) for x in names.split()]), n.cast("int"))
    return table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        pick("document image audio", F.col("l_linenumber") % 3).alias("kind"),
        pick("redact mask pseudonymize preserve", F.col("l_suppkey") % 4).alias("action"),
        pick("box blur pixelate partial_mask token_replace bleep mute none", F.col("l_partkey") % 8).alias("effect"),
        F.when(F.col("l_orderkey") % 5 == 0, "Someone").alias("custom_text"),
        F.when(F.col("l_partkey") % 3 == 0, "reviewer").otherwise("policy").alias("effect_source"),
    )


@query(
    f"""WITH {_LAYER_ROWS}, m(kind, action, effect) AS (VALUES {', '.join(map(str, P.EFFECT_MATRIX))}),
    v AS (SELECT l.l_orderkey, l.l_linenumber, l.kind, l.action, l.effect,
      CASE WHEN (l.action = 'preserve') <> (l.effect = 'none') THEN 'preserve_uses_none'
           WHEN (l.action = 'pseudonymize') <> (l.effect = 'token_replace') THEN 'pseudonymize_uses_token'
           WHEN custom_text IS NOT NULL AND l.effect <> 'token_replace' THEN 'custom_text_needs_token'
           WHEN m.kind IS NULL THEN 'unsupported_effect' END AS reason
      FROM l LEFT JOIN m ON m.kind = l.kind AND m.action = l.action AND m.effect = l.effect)
    SELECT * FROM v WHERE reason IS NOT NULL"""
)
def effect_matrix_violations(spark, d):
    return P.layer_violations(_layer_rows(spark, d), spark).select("l_orderkey", "l_linenumber", "kind", "action", "effect", "reason")


@query(
    f"""WITH {_LAYER_ROWS} SELECT l_orderkey, l_linenumber,
      CASE WHEN effect_source = 'reviewer' THEN action ELSE 'redact' END AS action,
      CASE WHEN effect_source = 'reviewer' THEN effect ELSE 'box' END AS effect,
      CASE WHEN effect_source = 'reviewer' AND effect = 'token_replace' THEN custom_text END AS custom_text FROM l"""
)
def reclassified_layers(spark, d):
    rows = P.reclassify(_layer_rows(spark, d), F.lit("redact"), F.lit("box"))
    return rows.select("l_orderkey", "l_linenumber", "action", "effect", "custom_text")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, l_partkey, l_quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey")
def hydrated_left_join(spark, d):
    right = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_quantity")
    return V.hydrate(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), right, "o_orderkey")


@query(
    """WITH f AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 13 > 0 THEN o_orderkey % 50 END AS s FROM orders),
    p AS (SELECT k, count(*) AS n, min(s) AS lo, max(s) AS hi FROM (
      SELECT o_orderkey AS k, CASE WHEN o_custkey % 9 = 0 THEN -1 ELSE o_orderkey % 50 END AS s,
             unnest(range(CASE WHEN o_custkey % 7 = 0 THEN 0 WHEN o_custkey % 11 = 0 THEN 2 ELSE 1 END)) FROM orders) GROUP BY 1),
    v AS (SELECT coalesce(f.k, p.k) AS o_orderkey, CASE WHEN s IS NULL THEN 'orphan_layer' WHEN n IS NULL THEN 'missing_layer'
      WHEN n > 1 THEN 'several_layers' WHEN s <> lo OR s <> hi THEN 'cross_session' END AS reason FROM f FULL JOIN p ON f.k = p.k)
    SELECT * FROM v WHERE reason IS NOT NULL"""
)
def integrity_violations(spark, d):
    """One layer an order, but for some that have none, two, or one of another session."""
    orders, customer = table(spark, d, "orders"), F.col("o_custkey")
    findings = orders.select("o_orderkey", F.when(customer % 13 > 0, F.col("o_orderkey") % 50).alias("session"))
    session = F.when(customer % 9 == 0, F.lit(-1)).otherwise(F.col("o_orderkey") % 50)
    copies = F.when(customer % 7 == 0, F.lit(0)).when(customer % 11 == 0, F.lit(2)).otherwise(1)
    layers = orders.select("o_orderkey", session.alias("session"), F.explode(F.array_repeat(F.lit(0), copies)).alias("_copy")).drop("_copy")
    return V.integrity_violations(findings, layers, "o_orderkey", "session")


@query(
    """SELECT conv_id, count(*) FILTER (role = 'user') AS n_user, count(*) FILTER (role = 'assistant') AS n_assistant,
      arg_min(text, turn) FILTER (role = 'user') AS first_user, arg_min(text, turn) FILTER (role = 'assistant') AS first_assistant
      FROM conversations GROUP BY conv_id"""
)
def session_pivot(spark, d):
    rows = table(spark, d, "conversations").where("role IN ('user', 'assistant')")
    wide = rows.groupBy("conv_id").pivot("role", ["user", "assistant"]).agg(F.count(F.lit(1)).alias("n"), F.min_by("text", "turn").alias("first"))
    every = table(spark, d, "conversations").select("conv_id").distinct()
    return every.join(wide, "conv_id", "left").select(
        "conv_id",
        F.coalesce("user_n", F.lit(0)).alias("n_user"),
        F.coalesce("assistant_n", F.lit(0)).alias("n_assistant"),
        F.col("user_first").alias("first_user"),
        F.col("assistant_first").alias("first_assistant"),
    )


@query(
    """WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN event_type END AS reviewed,
        CASE WHEN event_id % 4 = 0 THEN value END AS confidence, CASE WHEN event_id % 7 = 0 THEN 'confirmed' END AS decision FROM events)
      SELECT user_id, count(*) AS n_edits, arg_max(reviewed, event_id) FILTER (reviewed IS NOT NULL) AS reviewed,
        arg_max(confidence, event_id) FILTER (confidence IS NOT NULL) AS confidence,
        arg_max(decision, event_id) FILTER (decision IS NOT NULL) AS decision FROM e GROUP BY 1"""
)
def review_edit_fold(spark, d):
    edits = table(spark, d, "events").select(
        "user_id",
        "event_id",
        F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("reviewed"),
        F.when(F.col("event_id") % 4 == 0, F.col("value")).alias("confidence"),
        F.when(F.col("event_id") % 7 == 0, "confirmed").alias("decision"),
    )
    return V.fold_edits(edits, "user_id", ["reviewed", "confidence", "decision"], "event_id")


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark, d):
    newest = F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id")).alias("e")
    return table(spark, d, "events").groupBy("user_id").agg(newest).select("user_id", "e.*")


@query(
    """SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events)
       WHERE rank <= 3"""
)
def keep_newest_three(spark, d):
    return V.latest(table(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 3).select("user_id", "event_id", "rank")


@query(
    """WITH c AS (SELECT o_custkey AS c_custkey, 'Renamed ' || o_orderkey AS c_name, o_totalprice AS c_acctbal,
               row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders WHERE o_orderkey % 4 = 0)
      SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM c)
      UNION ALL SELECT c_custkey, c_name, c_acctbal FROM c WHERE r = 1"""
)
def upserted_rows(spark, d):
    base = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    changes = table(spark, d, "orders").where("o_orderkey % 4 = 0").select(
        F.col("o_custkey").alias("c_custkey"), F.concat(F.lit("Renamed "), F.col("o_orderkey")).alias("c_name"),
        F.col("o_totalprice").alias("c_acctbal"), "o_orderkey",
    )
    return V.upsert(base, changes, "c_custkey", [F.desc("o_orderkey")])


@query(
    """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
       UNION ALL SELECT o_orderkey, 0, o_totalprice FROM orders WHERE o_orderstatus = 'F'"""
)
def replaced_sessions(spark, d):
    base = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    new = table(spark, d, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("l_orderkey"), F.lit(0).alias("l_linenumber"), F.col("o_totalprice").alias("l_quantity")
    )
    return V.replace_session(base, new, "l_orderkey")


@query("SELECT event_id, user_id, event_type FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 45)")
def purged_rows(spark, d):
    rows = table(spark, d, "events")
    return V.purge(rows, rows.where("event_type = 'error' AND value > 45"), "user_id").select("event_id", "user_id", "event_type")


@query(
    """SELECT c_custkey, coalesce(s_name, c_name) AS c_name, coalesce(s_acctbal, c_acctbal) AS c_acctbal, c_mktsegment
       FROM customer LEFT JOIN (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS s_name, s_acctbal FROM supplier) ON s_suppkey = c_custkey"""
)
def patched_rows(spark, d):
    patches = table(spark, d, "supplier").select(
        F.col("s_suppkey").cast("long").alias("c_custkey"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("c_name"), F.col("s_acctbal").alias("c_acctbal")
    )
    base = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return V.patch(base, patches, "c_custkey", ["c_name", "c_acctbal"])


# --- audit chains ----------------------------------------------------------------------------

_CHAIN = """e AS (
  SELECT user_id, event_id AS seq, 'e' || event_id AS event_id, 'u' || user_id AS actor_id, 'user' AS actor_type, event_type,
         replace(props, ' ', '') AS payload, 't' || event_id AS created_at, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
chain AS (
  SELECT e.*, NULL::VARCHAR AS previous_hash,
         sha256('{"actor_id":"' || actor_id || '","actor_type":"' || actor_type || '","created_at":"' || created_at || '","event_id":"' || event_id
           || '","event_type":"' || event_type || '","payload":' || payload || ',"previous_hash":null,"session_id":"' || user_id || '"}') AS event_hash
  FROM e WHERE k = 1
  UNION ALL
  SELECT e.*, c.event_hash,
         sha256('{"actor_id":"' || e.actor_id || '","actor_type":"' || e.actor_type || '","created_at":"' || e.created_at || '","event_id":"' || e.event_id
           || '","event_type":"' || e.event_type || '","payload":' || e.payload || ',"previous_hash":"' || c.event_hash || '","session_id":"' || e.user_id || '"}')
  FROM chain c JOIN e ON e.user_id = c.user_id AND e.k = c.k + 1)"""


def _audit_events(spark, d):
    return table(spark, d, "events").select(
        "user_id",
        F.col("event_id").alias("seq"),
        F.concat(F.lit("e"), "event_id").alias("event_id"),
        F.concat(F.lit("u"), "user_id").alias("actor_id"),
        F.lit("user").alias("actor_type"),
        "event_type",
        F.replace("props", F.lit(" "), F.lit("")).alias("payload"),
        F.concat(F.lit("t"), "event_id").alias("created_at"),
    )


def _chain(spark, d):
    return A.build_chain(_audit_events(spark, d), "user_id")


@query(f"WITH RECURSIVE {_CHAIN} SELECT user_id, seq, previous_hash, event_hash FROM chain")
def audit_chain(spark, d):
    return _chain(spark, d).select("user_id", "seq", "previous_hash", "event_hash")


@query(
    f"""WITH RECURSIVE {_CHAIN} SELECT user_id, seq, true AS linked, seq % 97 <> 0 AS intact FROM chain"""
)
def audit_chain_verify(spark, d):
    """Every 97th event was tampered with after it was hashed."""
    told = F.when(F.col("seq") % 97 == 0, F.lit("forged")).otherwise(F.col("event_type"))
    return A.verify_chain(_chain(spark, d).withColumn("event_type", told), "user_id")


@query(f"WITH RECURSIVE {_CHAIN} SELECT user_id, seq FROM chain WHERE k <= 5 AND (SELECT count(*) FROM e x WHERE x.user_id = chain.user_id) >= 5")
def audit_prefix(spark, d):
    """Events up to the fifth of each session, given by its hash."""
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("seq"))
    boundary = F.max(F.when(F.col("_k") == 5, F.col("event_hash"))).over(Window.partitionBy("user_id"))
    chain = _chain(spark, d).withColumn("_k", nth).withColumn("_b", boundary)
    return A.prefix_through(chain, F.col("_b"), "user_id").select("user_id", "seq")


@query(f"WITH RECURSIVE {_CHAIN} SELECT user_id, count(*) AS event_count, arg_max(event_hash, seq) AS last_hash FROM chain GROUP BY 1")
def last_hash(spark, d):
    return A.last_hash(_chain(spark, d), "user_id")


@query(
    """SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'filename' WHEN event_id % 6 = 3 THEN 'text' END AS forbidden_key FROM events"""
)
def content_bearing_keys(spark, d):
    from palimpsest.schemas import CONTENT_KEYS

    inner = F.when(F.col("event_id") % 6 == 0, '{"filename":1,"x":2}').when(F.col("event_id") % 6 == 3, '{"y":{"text":"a"}}').otherwise('{"z":[]}')
    payload = F.concat(F.lit('{"props":'), "props", F.lit(',"more":['), inner, F.lit("]}"))
    rows = table(spark, d, "events").select("event_id", payload.alias("payload"))
    return A.forbidden_keys(rows, "payload", CONTENT_KEYS).select("event_id", "forbidden_key")


def _pad(with_byte):
    """The key of the query, as it is hashed before a message, in hex."""
    return bytes(b ^ with_byte for b in b"palimpsest".ljust(64, b"\0")).hex()


@query(
    rf"""WITH m AS (SELECT user_id, '{{"last_event":' || max(event_id) || ',"n_events":' || count(*) || ',"session_id":"' || user_id || '"}}' AS manifest FROM events GROUP BY 1),
      h AS (SELECT *, sha256(manifest) AS manifest_sha256 FROM m),
      i AS (SELECT *, sha256(unhex('{_pad(0x36)}') || encode(manifest[:-2] || ',"sha256":"' || manifest_sha256 || '"}}')) AS inside FROM h)
      SELECT user_id, manifest, manifest_sha256, sha256(unhex('{_pad(0x5C)}') || unhex(inside)) AS signature FROM i"""
)
def signed_manifests(spark, d):
    per = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"), F.max("event_id").alias("last_event"))
    manifest = A.canonical_json({"last_event": F.col("last_event"), "n_events": F.col("n_events"), "session_id": F.col("user_id").cast("string")})
    return A.signed(per.withColumn("manifest", manifest), "manifest", b"palimpsest").select("user_id", "manifest", "manifest_sha256", "signature")


@query(
    f"""WITH RECURSIVE {_CHAIN}, b AS (SELECT user_id, count(*) AS n_events, arg_max(event_hash, seq) AS last_hash FROM chain GROUP BY 1)
      SELECT 'bundle-' || user_id || '.zip' AS name, 4::BIGINT AS n_files, true AS verified, n_events, last_hash, sha256(text) AS rendered_sha256 FROM b JOIN documents ON doc_id = user_id"""
)
def export_bundles(spark, d):
    """Bundles of all sessions with a text, written as ZIPs and read back."""
    chain = _chain(spark, d)
    snapshots = chain.select("user_id").distinct().withColumn("snapshot", F.lit('{"id":"gdpr"}'))
    texts = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("user_id"), F.concat(F.lit("doc-"), "doc_id", F.lit(".txt")).alias("filename"), F.col("text").alias("content"))
    path = f"{scratch_dir(spark)}/bundles-{uuid.uuid4().hex}"
    U.write_bundles(U.bundles(chain, snapshots, texts, "user_id", b"palimpsest"), path)
    content = lambda name: F.get(F.filter("files", lambda f: f["name"].rlike(name)), F.lit(0))["content"]
    events = F.json_array_length(content("^audit[.]json$").cast("string")).cast("long")
    return U.read_bundles(spark, path, b"palimpsest").select(
        "name", F.size("files").cast("long").alias("n_files"), "verified", events.alias("n_events"),
        F.get_json_object("manifest", "$.audit_boundary.last_event_hash").alias("last_hash"), F.sha2(content("^doc-"), 256).alias("rendered_sha256"),
    )


# --- tokens ----------------------------------------------------------------------------------

@query(
    """SELECT conv_id, count(*) AS n_turns, coalesce(sum(CASE WHEN role = 'user' THEN strlen(text) + 32 + 8 END), 0)::BIGINT AS input_tokens,
      coalesce(sum(CASE WHEN role = 'assistant' THEN strlen(text) + 32 + 8 END), 0)::BIGINT AS output_tokens FROM conversations GROUP BY 1"""
)
def token_totals(spark, d):
    tokens = B.estimated_tokens(F.lit("Review: "), F.col("text"))
    side = lambda role: F.sum(F.coalesce(F.when(F.col("role") == role, tokens), F.lit(0)))
    return table(spark, d, "conversations").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"), side("user").alias("input_tokens"), side("assistant").alias("output_tokens")
    )


_LIMITS = """t AS (SELECT conv_id, turn, strlen(text) + 40 AS tokens, 100 + turn * 50 AS output,
   CASE WHEN conv_id % 3 > 0 THEN 700 END AS max_input, CASE WHEN conv_id % 2 = 0 THEN 260 END AS max_output, CASE WHEN conv_id % 5 > 0 THEN 1200 END AS win FROM conversations)"""


@query(
    f"""WITH {_LIMITS} SELECT conv_id, turn, tokens, least(max_input, win - coalesce(max_output, 0)) AS input_limit,
      CASE WHEN output > max_output THEN 'output_limit' WHEN tokens > max_input THEN 'input_limit'
           WHEN tokens + output > win THEN 'context_window' ELSE 'admitted' END AS admission,
      least(max_input, win - coalesce(max_output, 0)) - 8 - 512 AS byte_budget FROM t"""
)
def token_admission(spark, d):
    rows = table(spark, d, "conversations").select(
        "conv_id",
        "turn",
        B.estimated_tokens(F.lit("Review: "), F.col("text")).alias("tokens"),
        (100 + F.col("turn") * 50).alias("output"),
        F.when(F.col("conv_id") % 3 > 0, 700).alias("max_input"),
        F.when(F.col("conv_id") % 2 == 0, 260).alias("max_output"),
        F.when(F.col("conv_id") % 5 > 0, 1200).alias("win"),
    )
    limit = B.input_limit(F.col("max_input"), F.col("win"), F.col("max_output"))
    told = B.admission(F.col("tokens"), F.col("output"), F.col("max_input"), F.col("max_output"), F.col("win"))
    return rows.select("conv_id", "turn", "tokens", limit.alias("input_limit"), told.alias("admission"), B.payload_byte_budget(limit, F.lit("Review: ")).alias("byte_budget"))


# --- responses and regions -------------------------------------------------------------------

@query(
    f"""WITH {FOUND}, r AS (SELECT DISTINCT doc_id FROM found),
    c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY finding_id) - 1 AS pos, count(*) OVER (PARTITION BY doc_id) AS n FROM found),
    i AS (SELECT doc_id, pos, CASE WHEN doc_id % 4 = 1 THEN NULL ELSE entity_type END AS entity_type,
             CASE WHEN pos % 3 = 1 THEN NULL ELSE confidence END AS confidence, CASE WHEN pos % 4 = 2 THEN '' ELSE line_id END AS line_id, exact_text,
             CASE WHEN pos % 3 = 1 THEN 'confidence' WHEN pos % 4 = 2 THEN 'line_id' END AS reject FROM c WHERE doc_id % 10 <> 7)
    SELECT * FROM i UNION ALL SELECT doc_id, -1, NULL, NULL, NULL, NULL, 'policy_key' FROM r WHERE doc_id % 10 = 7"""
)
def response_items(spark, d):
    """Responses made of the detections of a document, with items and whole responses to reject."""
    confidence = F.when(F.col("pos") % 3 == 1, F.lit('"high"')).otherwise(F.col("confidence").cast("string"))
    q = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    item = F.concat(
        F.lit('{"entity_type":'), F.when(F.col("doc_id") % 4 == 1, "null").otherwise(q(F.col("entity_type"))),
        F.lit(',"confidence":'), confidence,
        F.lit(',"line_id":'), F.when(F.col("pos") % 4 == 2, '""').otherwise(q(F.col("line_id"))),
        F.lit(',"exact_text":'), q(F.col("exact_text")),
        F.when(F.col("doc_id") % 10 == 7, ',"action":"redact"').otherwise(""), F.lit("}"),
    )
    return E.items(_responses(spark, d, item), "doc_id", "raw").select("doc_id", "pos", "entity_type", "confidence", "line_id", "exact_text", "reject")


# Members of an item in place of valid ones, and what must come of it: the column that differs
# and its value, or the reason why the item is rejected.
_TYPED = (
    ('"label":null', "reject", "label"),
    ('"label":7', "reject", "label"),
    ('"label":"x"', "label", "x"),
    ('"entity_type":7', "reject", "entity_type"),
    ('"entity_type":true', "reject", "entity_type"),
    ('"entity_type":null', "entity_type", None),
    ('"data_subject_context":"nonsense"', "reject", "data_subject_context"),
    ('"data_subject_context":null', "reject", "data_subject_context"),
    ('"data_subject_context":"minor"', "data_subject_context", "minor"),
    ('"confidence":true', "confidence", "1.0"),
    ('"confidence":" 5e-1 "', "confidence", "0.5"),
    ('"confidence":"nan"', "reject", "confidence"),
    ('"confidence":[]', "reject", "confidence"),
    ('"confidence":-0.1', "reject", "confidence"),
    ('"description":5', "reject", "description"),
    ('"reason":{}', "reject", "reason"),
    ('"reason":null', "reject", None),
    ('"line_id":7', "line_id", "7"),
    ('"line_id":true', "line_id", "True"),
    ('"line_id":0', "reject", "line_id"),
    ('"exact_text":false', "reject", "exact_text"),
    ('"exact_text":1.5', "exact_text", "1.5"),
)


@query(
    "WITH cases(k, field, due) AS (VALUES "
    + ", ".join(f"({k}, '{field}', {repr(value) if value is not None else 'NULL'})" for k, (_, field, value) in enumerate(_TYPED))
    + f"""), c AS (SELECT event_id, field, due, event_type FROM events JOIN cases ON k = event_id % {len(_TYPED)})
      SELECT event_id, CASE WHEN field = 'entity_type' THEN due WHEN field = 'reject' AND due = 'entity_type' THEN NULL ELSE event_type END AS entity_type,
        CASE WHEN field = 'confidence' THEN due::DOUBLE WHEN field = 'reject' AND due = 'confidence' THEN CASE WHEN event_id % {len(_TYPED)} = 13 THEN -0.1 END ELSE 0.25 END AS confidence,
        CASE WHEN field = 'line_id' THEN due WHEN field = 'reject' AND due = 'line_id' THEN '' ELSE 't1' END AS line_id,
        CASE WHEN field = 'exact_text' THEN due WHEN field = 'reject' AND due = 'exact_text' THEN '' ELSE 'a' END AS exact_text,
        CASE WHEN field = 'label' THEN due WHEN field = 'reject' AND due = 'label' THEN NULL ELSE '' END AS label,
        CASE WHEN field = 'data_subject_context' THEN due ELSE 'unknown' END AS data_subject_context,
        CASE WHEN field = 'reject' THEN due END AS reject
      FROM c WHERE NOT (field = 'reject' AND coalesce(due, '') = 'data_subject_context')
      UNION ALL SELECT event_id, event_type, 0.25, 't1', 'a', '', CASE WHEN event_id % {len(_TYPED)} = 6 THEN 'nonsense' END, 'data_subject_context' FROM c
      WHERE field = 'reject' AND due = 'data_subject_context'"""
)
def typed_items(spark, d):
    """Items with a member of another type or value than is due, one a response."""
    name = lambda m: m.partition(":")[0]
    valid = {'"entity_type"': F.to_json(F.array("event_type")), '"confidence"': F.lit("[0.25]"), '"line_id"': F.lit('["t1"]'), '"exact_text"': F.lit('["a"]')}
    k = F.col("event_id") % len(_TYPED)
    item = F.lit(None).cast("string")
    for n, (given, _, _) in enumerate(_TYPED):
        rest = [F.concat(F.lit(f"{m}:"), F.regexp_extract(v, r"^\[(.*)\]$", 1)) for m, v in valid.items() if m != name(given)]
        item = F.when(k == n, F.concat_ws(",", F.lit(given), *rest)).otherwise(item)
    rows = table(spark, d, "events").select("event_id", F.concat(F.lit('{"findings":[{'), item, F.lit("}]}")).alias("raw"))
    got = E.items(rows, "event_id", "raw")
    return got.select("event_id", "entity_type", "confidence", "line_id", "exact_text", "label", "data_subject_context", "reject")


def _responses(spark, d, item):
    """doc_id, raw: a response a document, with an item (made of doc_id and pos) for each detection."""
    rows = found(spark, d).withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("finding_id")) - 1)
    per = rows.select("doc_id", F.struct("pos", item.alias("item")).alias("i")).groupBy("doc_id").agg(F.array_sort(F.collect_list("i")).alias("i"))
    return per.select("doc_id", F.concat(F.lit('{"findings":['), F.array_join(F.transform("i", lambda x: x["item"]), ","), F.lit("]}")).alias("raw"))


@query(
    """SELECT event_id, '{"findings":[{"k":' || (CAST(json_extract(props, '$.k') AS INTEGER)) || ',"type":"' || event_type || '"}]}' AS object FROM events"""
)
def response_repair(spark, d):
    """Responses wrapped in prose and fences, and cut short: the object comes out whole."""
    k = F.get_json_object("props", "$.k")
    inner = F.concat(F.lit('{"type": "'), "event_type", F.lit('", "k": '), k)
    whole = F.concat(F.lit('{"findings": ['), inner, F.lit("}]}"))
    raw = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("Here it is {see below}:\n```json\n"), whole, F.lit("\n```\nDone.")))
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit('{"findings": ['), inner, F.lit("]}")))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit('{"findings": ['), inner, F.lit("}]")))
        .otherwise(whole)
    )
    return table(spark, d, "events").select("event_id", E.json_object(raw).alias("object"))


_REGION = """r AS (SELECT l_orderkey, l_linenumber, round(l_discount * 11, 4) AS x0, round(l_tax * 12, 4) AS y0,
    round(l_quantity / 40, 4) AS w0, CASE WHEN l_linenumber % 2 = 0 THEN round(l_quantity / 60, 4) END AS h0, l_quantity * 17 - 200 AS turn, 100 + l_partkey % 900 AS iw, 80 + l_suppkey * 7 AS ih FROM lineitem),
  u AS (SELECT *, least(greatest(x0, 0), 1) AS x, least(greatest(y0, 0), 1) AS y, least(greatest(w0, 0), 1) AS w1, least(greatest(coalesce(h0, 0.1), 0), 1) AS h1 FROM r),
  g AS (SELECT *, least(w1, 1 - x) AS w, least(h1, 1 - y) AS h FROM u)"""


def _regions(spark, d):
    """x, y, width, height per row. Generating them, rather than projecting, keeps the optimizer from
    repeating their expressions wherever a column is used."""
    region = E.clamp_region(
        F.round(F.col("l_discount") * 11, 4),
        F.round(F.col("l_tax") * 12, 4),
        F.round(F.col("l_quantity") / 40, 4),
        F.when(F.col("l_linenumber") % 2 == 0, F.round(F.col("l_quantity") / 60, 4)),
    )
    rows = table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_quantity") * 17 - 200).alias("turn"),
        (100 + F.col("l_partkey") % 900).alias("iw"),
        (80 + F.col("l_suppkey") * 7).alias("ih"),
        F.inline(F.array(region)),
    )
    return rows.where("x IS NOT NULL")


@query(
    f"""WITH {_REGION} SELECT l_orderkey, l_linenumber, round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS width, round(h, 6) AS height,
      (turn + 180) - 360 * floor((turn + 180) / 360) - 180 AS rotation FROM g WHERE w > 0 AND h > 0"""
)
def region_clamp(spark, d):
    side = [F.round(c, 6).alias(c) for c in ("x", "y", "width", "height")]
    return _regions(spark, d).select("l_orderkey", "l_linenumber", *side, X.normalise_rotation(F.col("turn")).alias("rotation"))


@query(
    f"""WITH {_REGION}, b AS (SELECT l_orderkey, l_linenumber, iw, ih,
        least(greatest(round_even(x * iw, 0)::BIGINT, 0), iw) AS box_left, least(greatest(round_even(y * ih, 0)::BIGINT, 0), ih) AS box_top,
        least(greatest(round_even((x + w) * iw, 0)::BIGINT, 0), iw) AS box_right, least(greatest(round_even((y + h) * ih, 0)::BIGINT, 0), ih) AS box_bottom
        FROM g WHERE w > 0 AND h > 0)
      SELECT l_orderkey, l_linenumber, box_left, box_top, box_right, box_bottom, greatest(1, iw // 12) AS small_width FROM b WHERE box_right > box_left AND box_bottom > box_top"""
)
def pixel_boxes(spark, d):
    box = E.pixel_box(F.struct("x", "y", "width", "height"), F.col("iw"), F.col("ih"))
    rows = _regions(spark, d).select("l_orderkey", "l_linenumber", "iw", F.inline(F.array(box))).where("`left` IS NOT NULL")
    edges = [F.col(f"`{c}`").alias(f"box_{c}") for c in ("left", "top", "right", "bottom")]
    return rows.select("l_orderkey", "l_linenumber", *edges, F.greatest(F.lit(1).cast("long"), F.expr("iw div 12")).alias("small_width"))


# --- timelines -------------------------------------------------------------------------------

_PLAN = """plan AS (
  SELECT doc_id, n_chars, unnest(range(0, greatest(0, ceil((n_chars - 300) / 298))::BIGINT + 1)) AS chunk FROM documents),
chunks AS (SELECT doc_id, n_chars, chunk, chunk * 298.0::DOUBLE AS chunk_start, least(300.0, n_chars - chunk * 298)::DOUBLE AS chunk_duration FROM plan)"""


@query(f"WITH {_PLAN} SELECT doc_id, chunk, chunk_start, chunk_duration FROM chunks")
def chunk_plan(spark, d):
    """Documents stand in for recordings, characters for seconds."""
    plan = T.chunk_plan(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars")
    return plan.select("doc_id", "chunk", "chunk_start", "chunk_duration")


@query(
    f"""WITH {_PLAN}, f AS (SELECT event_id, event_id % (SELECT max(doc_id) + 1 FROM documents) AS doc_id,
        CASE WHEN event_id % 2 = 0 THEN 0 ELSE event_id * 31 % 400 END AS chunk, (event_id * 7 % 3200) / 10.0::DOUBLE AS s,
        (event_id * 7 % 3200) / 10.0::DOUBLE + round(value) AS e FROM events),
      t AS (SELECT event_id, doc_id, chunk, chunk_start + greatest(s, 0.0) AS start_time, chunk_start + least(e, chunk_duration) AS end_time FROM f JOIN chunks USING (doc_id, chunk))
      SELECT event_id, doc_id, round(start_time, 3) AS start_time, round(end_time, 3) AS end_time FROM t WHERE end_time > start_time"""
)
def chunk_to_timeline(spark, d):
    from palimpsest.operators.anchor import anchor_audio

    plan = T.chunk_plan(table(spark, d, "documents").select(F.col("doc_id").alias("session_id"), "n_chars"), "n_chars")
    start = (F.col("event_id") * 7 % 3200) / F.lit(10.0)
    ids = table(spark, d, "documents").agg(F.max("doc_id") + 1).first()[0]
    chunk = F.when(F.col("event_id") % 2 == 0, F.lit(0)).otherwise(F.col("event_id") * 31 % 400)
    claims = table(spark, d, "events").select(
        "event_id", (F.col("event_id") % ids).alias("session_id"), chunk.cast("int").alias("chunk"),
        start.alias("start"), (start + F.round("value")).alias("end"),
    )
    rows = anchor_audio(claims, plan)
    return rows.select("event_id", F.col("session_id").alias("doc_id"), F.round("start_time", 3).alias("start_time"), F.round("end_time", 3).alias("end_time"))


_SPANS = """s AS (SELECT event_id, user_id, event_type, (event_id * 37 % 4000) / 8.0::DOUBLE AS start_time,
   (event_id * 37 % 4000) / 8.0::DOUBLE + 1 + event_id % 9 AS end_time, CASE WHEN event_id % 6 > 0 THEN (event_id % 10) / 10.0::DOUBLE END AS confidence FROM events)"""


def _spans(spark, d):
    start = (F.col("event_id") * 37 % 4000) / F.lit(8.0)
    return table(spark, d, "events").select(
        "event_id",
        "user_id",
        "event_type",
        start.alias("start_time"),
        (start + 1 + F.col("event_id") % 9).alias("end_time"),
        F.when(F.col("event_id") % 6 > 0, (F.col("event_id") % 10) / F.lit(10.0)).alias("confidence"),
    )


@query(
    f"""WITH {_SPANS}, l AS (SELECT *, lower(CASE WHEN event_id % 2 = 0 THEN 'Voice ' ELSE 'VOICE ' END || event_id % 3) AS label_key FROM s),
      m AS (SELECT *, max(end_time) OVER w AS reach, row_number() OVER (PARTITION BY user_id, event_type, label_key ORDER BY start_time, event_id) AS nth FROM l
        WINDOW w AS (PARTITION BY user_id, event_type, label_key ORDER BY start_time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      i AS (SELECT *, sum(CASE WHEN start_time <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, event_type, label_key ORDER BY start_time, event_id) AS island FROM m),
      b AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, label_key, island ORDER BY coalesce(confidence, -1) DESC, nth) AS best FROM i)
      SELECT user_id, event_type, label_key, min(start_time) AS start_time, max(end_time) AS end_time, count(*) AS n_merged,
             max(CASE WHEN best = 1 THEN event_id END) AS kept, max(CASE WHEN best = 1 THEN confidence END) AS confidence
      FROM b GROUP BY user_id, event_type, label_key, island"""
)
def interval_dedup(spark, d):
    """Spans merge within a type and a label, whatever the label's case."""
    label = F.concat(F.when(F.col("event_id") % 2 == 0, "Voice ").otherwise("VOICE "), F.col("event_id") % 3)
    spans = _spans(spark, d).withColumn("label_key", X.casefold(label))
    return T.merge_overlaps(spans, ["user_id", "event_type", "label_key"], ["event_id"]).drop("island")


_SWEEP = f"""{_SPANS}, z AS (SELECT user_id, CASE WHEN event_id % 3 = 0 THEN 'mute' ELSE 'bleep' END AS effect,
     greatest(start_time, 0) AS s, least(end_time, 480) AS e FROM s),
  c AS (SELECT * FROM z WHERE e > s),
  p AS (SELECT DISTINCT user_id, t0 FROM (SELECT user_id, s AS t0 FROM c UNION ALL SELECT user_id, e FROM c)),
  q AS (SELECT user_id, t0, lead(t0) OVER (PARTITION BY user_id ORDER BY t0) AS until FROM p),
  f AS (SELECT q.user_id, q.t0, q.until, max(CASE c.effect WHEN 'mute' THEN 2 ELSE 1 END) AS rank
        FROM q JOIN c ON c.user_id = q.user_id AND c.s < q.until AND c.e > q.t0 GROUP BY ALL),
  n AS (SELECT *, CASE WHEN lag(until) OVER w = t0 AND lag(rank) OVER w = rank THEN 0 ELSE 1 END AS new FROM f WINDOW w AS (PARTITION BY user_id ORDER BY t0)),
  o AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t0) AS run FROM n),
  sweep AS (SELECT user_id, CASE rank WHEN 2 THEN 'mute' ELSE 'bleep' END AS effect, min(t0) AS start_time, max(until) AS end_time FROM o GROUP BY user_id, run, rank)"""


def _sweep(spark, d):
    effect = F.when(F.col("event_id") % 3 == 0, "mute").otherwise("bleep")
    return T.effect_sweep(_spans(spark, d).withColumn("effect", effect), "user_id", F.lit(480.0))


@query(f"WITH {_SWEEP} SELECT user_id, effect, start_time, end_time FROM sweep")
def effect_sweep(spark, d):
    return _sweep(spark, d)


@query(
    f"""WITH {_SWEEP}, t AS (SELECT *, row_number() OVER (PARTITION BY user_id, effect ORDER BY start_time) - 1 AS k, end_time - start_time AS d FROM sweep),
      u AS (SELECT *, least(0.008, d / 2) AS fade FROM t)
      SELECT user_id, '[0:a:0]aformat=sample_fmts=fltp:sample_rates=48000:channel_layouts=stereo,'
          || string_agg(printf('volume=volume=0:enable=''between(t,%.6f,%.6f)''', start_time, end_time), ',' ORDER BY start_time) || '[base];'
          || coalesce(string_agg(printf('[%d:a]aformat=sample_fmts=fltp:channel_layouts=stereo,afade=t=in:st=0:d=%.6f,afade=t=out:st=%.6f:d=%.6f,volume=0.35,adelay=%d:all=1[bleep%d]',
               k + 1, fade, d - fade, fade, round_even(start_time * 1000, 0)::BIGINT, k), ';' ORDER BY start_time) FILTER (effect = 'bleep') || ';', '')
          || CASE WHEN count(*) FILTER (effect = 'bleep') = 0 THEN '[base]anull[aout]' ELSE '[base]' || string_agg(printf('[bleep%d]', k), '' ORDER BY start_time) FILTER (effect = 'bleep')
               || printf('amix=inputs=%d:duration=first:dropout_transition=0:normalize=0[aout]', count(*) FILTER (effect = 'bleep') + 1) END AS graph,
        coalesce(string_agg(printf('-f lavfi -i sine=frequency=1000:sample_rate=48000:duration=%.6f', d), ' ' ORDER BY start_time) FILTER (effect = 'bleep'), '') AS inputs
      FROM u GROUP BY 1"""
)
def filter_graph(spark, d):
    return T.filter_graph(_sweep(spark, d), "user_id")


@query(
    """WITH t AS (SELECT event_id, event_id * 977 % 100000000 AS ms FROM events)
       SELECT event_id, printf('%02d:%02d:%02d:%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS timecode, ms / 1000 AS seconds FROM t"""
)
def timecode_format(spark, d):
    rows = table(spark, d, "events").select("event_id", X.timecode((F.col("event_id") * 977 % 100_000_000) / 1000).alias("timecode"))
    return rows.withColumn("seconds", X.parse_timecode(F.col("timecode")))


# --- matching --------------------------------------------------------------------------------

_PAIRS = """pairs AS (SELECT a.vec_id // 16 AS session, a.vec_id AS left_id, b.vec_id AS right_id,
    round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))) / len(a.embedding), 9) AS distance
    FROM embeddings a JOIN embeddings b ON b.vec_id // 16 = a.vec_id // 16 WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1)"""


def _pairs(spark, d):
    """Sessions of sixteen vectors: the even ones are the pictures that are expected, the odd ones those
    that are found; all pairs of a session are candidates."""
    rows = table(spark, d, "embeddings").withColumn("session", F.floor(F.col("vec_id") / 16))
    left = rows.where("vec_id % 2 = 0").select("session", F.col("vec_id").alias("left_id"), F.col("embedding").alias("a"))
    right = rows.where("vec_id % 2 = 1").select("session", F.col("vec_id").alias("right_id"), F.col("embedding").alias("b"))
    met = left.join(right, "session")
    return met.select("session", "left_id", "right_id", F.round(M.signature_distance(F.col("a"), F.col("b")), 9).alias("distance"))


@query(f"WITH {_PAIRS} SELECT session, left_id, right_id, distance FROM pairs")
def signature_distance(spark, d):
    return _pairs(spark, d)


@query()
def greedy_assignment(spark, d):
    """Pictures with the objects that show them, and whether all of their session were found."""
    aspect = F.abs(F.col("left_id") % 7 - F.col("right_id") % 5) / 10
    pairs = _pairs(spark, d).withColumns({"aspect": aspect, "page": F.col("right_id") % 3})
    found = M.greedy_assignment(pairs, "session", 0.15, ("distance", "aspect", "left_id", "page", "right_id"))
    expected = pairs.select("session", "left_id").distinct().groupBy("session").agg(F.count(F.lit(1)).alias("n"))
    given = found.groupBy("session").agg(F.count(F.lit(1)).alias("n_found"))
    whole = given.join(expected, "session").select("session", (F.col("n") == F.col("n_found")).alias("complete"))
    return found.join(whole, "session").select("session", "left_id", "right_id", "complete")


@query(
    f"""WITH {_PAIRS}, r AS (SELECT left_id, right_id, round(1.6 - 6 * distance, 9) AS score, row_number() OVER (PARTITION BY left_id ORDER BY round(1.6 - 6 * distance, 9) DESC, right_id) AS rank,
        lead(round(1.6 - 6 * distance, 9)) OVER (PARTITION BY left_id ORDER BY round(1.6 - 6 * distance, 9) DESC, right_id) AS next FROM pairs)
      SELECT left_id, right_id, score FROM r WHERE rank = 1 AND score >= 0.7 AND (next IS NULL OR score - next >= 0.05)"""
)
def unique_best_margin(spark, d):
    scored = _pairs(spark, d).withColumn("score", F.round(1.6 - 6 * F.col("distance"), 9))
    return M.unique_best(scored, "left_id", "right_id").select("left_id", "right_id", "score")


@query()
def fuzzy_ratio(spark, d):
    """Each line of a conversation's turn against that of the same number in the next turn; a line
    that only one of them has counts 0."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.split(F.coalesce("text", F.lit("")), "\n").alias("a"))
    following = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    met = rows.join(following, ["conv_id", "turn"]).select("conv_id", "turn", F.posexplode(F.arrays_zip("a", "b")).alias("line_no", "pair"))
    return met.select("conv_id", "turn", (F.col("line_no") + 1).alias("line_no"), F.round(M.similarity("pair.a", "pair.b"), 9).alias("ratio"))


# --- files -----------------------------------------------------------------------------------

_SUFFIXES = "txt md pdf docx jpg wav exe TXT".split()
_TYPES = "text/plain text/markdown application/pdf image/jpeg audio/wav".split()


@query(
    "WITH dim(format, suffix, types, kind, layout) AS (VALUES "
    + ", ".join(f"('{f}', '{s}', {t.split()!r}, '{k}', {repr(y) if y else 'NULL'})" for f, ss, t, k, y in S.FORMATS for s in ss.split())
    + f"""), n AS (SELECT doc_id, source || '.' || {_SUFFIXES!r}[1 + doc_id % 8] AS name, {_TYPES!r}[1 + doc_id % 5] AS mime FROM documents)
      SELECT doc_id, name, mime, format, kind, layout FROM n LEFT JOIN dim ON suffix = lower(split_part(name, '.', 2)) AND list_contains(types, mime)"""
)
def format_resolution(spark, d):
    pick = lambda names, n: F.get(F.array(*[F.lit(x) for x in names]), n.cast("int"))
    files = table(spark, d, "documents").select(
        "doc_id", F.concat_ws(".", "source", pick(_SUFFIXES, F.col("doc_id") % 8)).alias("name"), pick(_TYPES, F.col("doc_id") % 5).alias("mime")
    )
    return S.resolve_format(files, "name", "mime")


@query(
    f"""WITH {FOUND}, c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY finding_id) - 1 AS pos FROM found),
    x AS (SELECT doc_id, pos, pos % 4 = 1 AS missing, least((pos * 37 + doc_id) % 100 / 80.0::DOUBLE, 1.0) AS x, CASE WHEN pos % 5 = 3 THEN 0.1 ELSE (pos + doc_id) % 9 / 10.0::DOUBLE END AS w FROM c),
    i AS (SELECT doc_id, pos, x, least(w, 1 - x) AS w, missing OR least(w, 1 - x) <= 0 AS bad FROM x)
    SELECT doc_id, pos, CASE WHEN NOT bad THEN round(x, 6) END AS x, CASE WHEN NOT bad THEN round(w, 6) END AS width, CASE WHEN bad THEN 'target_region' END AS reject FROM i"""
)
def image_response_items(spark, d):
    """Items of image responses: each needs a region of which something is left."""
    pos, doc = F.col("pos"), F.col("doc_id")
    x, w = (pos * 37 + doc) % 100 / F.lit(80.0), F.when(pos % 5 == 3, "null").otherwise(((pos + doc) % 9 / F.lit(10.0)).cast("string"))
    region = F.concat(F.lit('{"x":'), x.cast("string"), F.lit(',"y":0.2,"width":'), w, F.lit(',"height":"?"}'))
    item = F.concat(F.lit('{"entity_type":"face","target_region":'), F.when(pos % 4 == 1, '"none"').otherwise(region), F.lit("}"))
    got = E.items(_responses(spark, d, item), "doc_id", "raw", "image")
    return got.select("doc_id", "pos", F.round("region.x", 6).alias("x"), F.round("region.width", 6).alias("width"), "reject")


@query(
    f"""WITH {FOUND}, c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY finding_id) - 1 AS pos FROM found),
    i AS (SELECT doc_id, pos, CASE WHEN pos % 4 <> 1 THEN (pos % 7 - 1) / 2.0::DOUBLE END AS s, CASE WHEN pos % 4 <> 1 THEN doc_id % 5 / 2.0::DOUBLE END AS e FROM c)
    SELECT doc_id, pos, s AS start_time, e AS end_time, CASE WHEN s IS NULL OR s < 0 OR e <= s THEN 'audio_range' END AS reject FROM i"""
)
def audio_response_items(spark, d):
    """Items of audio responses: each needs a range that ends after it begins."""
    pos, doc = F.col("pos"), F.col("doc_id")
    bounds = F.concat(F.lit('{"start_time":'), ((pos % 7 - 1) / F.lit(2.0)).cast("string"), F.lit(',"end_time":'), (doc % 5 / F.lit(2.0)).cast("string"), F.lit("}"))
    item = F.concat(F.lit('{"entity_type":"voice","audio_range":'), F.when(pos % 4 == 1, "null").otherwise(bounds), F.lit("}"))
    return E.items(_responses(spark, d, item), "doc_id", "raw", "audio").select("doc_id", "pos", "start_time", "end_time", "reject")


@query(
    f"""WITH {FOUND}, c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY finding_id) - 1 AS pos FROM found),
    p AS (SELECT doc_id, count(*) FILTER (pos % 4 <> 1) AS good, count(*) FILTER (pos % 4 = 1) AS bad, doc_id % 6 = 5 AS failed FROM c GROUP BY 1)
    SELECT doc_id, CASE WHEN failed THEN 'failed' ELSE 'succeeded' END AS parse_status, CASE WHEN NOT failed THEN good END AS parsed_findings, CASE WHEN NOT failed THEN bad END AS rejected_findings,
      '{{"finish_reason":"stop","parse_status":"' || CASE WHEN failed THEN 'failed","parsed_finding_count":null,"rejected_finding_count":null'
        ELSE 'succeeded","parsed_finding_count":' || good || ',"rejected_finding_count":' || bad END || '}}' AS summary FROM p"""
)
def parse_results(spark, d):
    """What became of each response, and its stored summary with that written into it."""
    item = F.concat(F.lit('{"line_id":"'), F.when(F.col("pos") % 4 == 1, "").otherwise("t1"), F.lit('","exact_text":"x"'), F.when(F.col("doc_id") % 6 == 5, ',"action":"redact"').otherwise(""), F.lit("}"))
    responses = _responses(spark, d, item)
    per = E.parse_outcomes(responses, E.items(responses, "doc_id", "raw"), "doc_id")
    old = F.from_json(F.lit('{"finish_reason":"stop","parse_status":null}'), "finish_reason string, parse_status string, parsed_finding_count bigint, rejected_finding_count bigint")
    new = old.withField("parse_status", F.col("parse_status")).withField("parsed_finding_count", F.col("parsed_findings")).withField("rejected_finding_count", F.col("rejected_findings"))
    return per.withColumn("summary", F.to_json(new, {"ignoreNullFields": "false"}))


@query(
    """WITH e AS (SELECT l_orderkey, CASE WHEN l_partkey % 50 = 0 THEN '../' ELSE 'word/' END || (l_partkey % 40) AS name,
        (l_extendedprice * 900)::BIGINT AS size, (l_extendedprice * 900 / (1 + l_suppkey * 4))::BIGINT AS packed FROM lineitem),
      p AS (SELECT l_orderkey, count(*) AS n_entries, max(size) AS largest, sum(size)::BIGINT AS expanded, sum(packed)::BIGINT AS packed,
            bool_or(starts_with(name, '../')) AS unsafe, count(*) - count(DISTINCT lower(name)) AS duplicates FROM e GROUP BY 1)
      SELECT *, CASE WHEN n_entries > 2048 THEN 'too_many_entries' WHEN unsafe THEN 'unsafe_name' WHEN duplicates > 0 THEN 'duplicate_name'
        WHEN largest > 52428800 THEN 'entry_too_large' WHEN expanded > 209715200 THEN 'too_large' WHEN expanded > 200 * packed THEN 'ratio' END AS reason FROM p"""
)
def archive_admission(spark, d):
    size = F.round(F.col("l_extendedprice") * 900).cast("long")
    entries = table(spark, d, "lineitem").select(
        "l_orderkey",
        F.concat(F.when(F.col("l_partkey") % 50 == 0, "../").otherwise("word/"), F.col("l_partkey") % 40).alias("name"),
        size.alias("size"),
        F.round(F.col("l_extendedprice") * 900 / (1 + F.col("l_suppkey") * 4)).cast("long").alias("packed"),
    )
    return S.archive_admission(entries, "l_orderkey")


# --- streams ---------------------------------------------------------------------------------

_CONFLATED = """SELECT user_id, count(*) AS n_events, arg_max(event_id, (CASE WHEN event_type IN ('error', 'purchase') THEN 1 ELSE 0 END) * 1000000000 + event_id) AS event_id,
   arg_max(event_type, (CASE WHEN event_type IN ('error', 'purchase') THEN 1 ELSE 0 END) * 1000000000 + event_id) AS event_type FROM events GROUP BY 1"""


def _conflated(events):
    terminal = F.col("event_type").isin("error", "purchase")
    return C.conflate(events, "user_id", terminal, F.col("event_id"), ["event_id", "event_type"])


def _stream(spark, d):
    """The events as a stream of files."""
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")


@query(_CONFLATED)
def event_conflation(spark, d):
    return _conflated(table(spark, d, "events"))


def _thirds(rows, order, last):
    """The rows in three parts, one after another."""
    third = F.floor(F.col(order) * 3 / (last + 1))
    return [rows.where(third == k) for k in range(3)]


@query(f"WITH RECURSIVE {_CHAIN} SELECT user_id, seq, previous_hash, event_hash FROM chain")
def streaming_chain(spark, d):
    """The chain of a stream that gets its events in three parts and is started anew for each."""
    events = _audit_events(spark, d)
    last = events.agg(F.max("seq")).head()[0] or 1
    got = Y.run_in_parts(_thirds(events, "seq", last), lambda stream: Y.chained(stream, "user_id"))
    return got.select("user_id", "seq", "previous_hash", "event_hash")


@query(
    """WITH RECURSIVE o AS (SELECT user_id, event_id AS seq, CASE WHEN event_id % 61 = 0 THEN 'close' WHEN event_type = 'view' THEN 'drain' ELSE 'publish' END AS op,
        event_type || event_id AS item, event_type IN ('error', 'purchase') AS terminal, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
      s AS (
        SELECT user_id, 0::BIGINT AS k, 0::BIGINT AS seq, NULL::VARCHAR AS held, false AS firm, false AS closed, false AS waiting, NULL::VARCHAR AS told, NULL::VARCHAR AS item FROM (SELECT DISTINCT user_id FROM events)
        UNION ALL
        SELECT o.user_id, o.k, o.seq,
          CASE WHEN s.closed OR o.op = 'close' OR o.op = 'drain' THEN NULL WHEN s.waiting THEN s.held WHEN s.held IS NULL OR o.terminal OR NOT s.firm THEN o.item ELSE s.held END,
          CASE WHEN s.closed OR o.op = 'close' OR o.op = 'drain' THEN false WHEN s.waiting THEN s.firm WHEN s.held IS NULL OR o.terminal OR NOT s.firm THEN o.terminal ELSE s.firm END,
          s.closed OR o.op = 'close',
          CASE WHEN s.closed OR o.op IN ('close', 'publish') THEN false ELSE s.held IS NULL END,
          CASE WHEN s.closed THEN CASE WHEN o.op = 'drain' THEN 'closed' END WHEN o.op = 'close' THEN CASE WHEN s.waiting THEN 'closed' END
               WHEN o.op = 'publish' THEN CASE WHEN s.waiting THEN 'item' END WHEN s.held IS NOT NULL THEN 'item' END,
          CASE WHEN s.closed OR o.op = 'close' THEN NULL WHEN o.op = 'publish' THEN CASE WHEN s.waiting THEN o.item END ELSE s.held END
        FROM s JOIN o ON o.user_id = s.user_id AND o.k = s.k + 1)
      SELECT user_id, seq, told, item FROM s WHERE told IS NOT NULL"""
)
def subscriber_queues(spark, d):
    """Queues of one place over a stream in three parts: every event is published, asked for, or closes."""
    op = F.when(F.col("event_id") % 61 == 0, "close").when(F.col("event_type") == "view", "drain").otherwise("publish")
    rows = table(spark, d, "events").select(
        "user_id", "ts", F.col("event_id").alias("seq"), op.alias("op"), F.concat("event_type", "event_id").alias("item"), F.col("event_type").isin("error", "purchase").alias("terminal")
    )
    last = rows.agg(F.max("seq")).head()[0] or 1
    return Y.run_in_parts(_thirds(rows, "seq", last), lambda stream: Y.queues(stream, "user_id", "3650 days", 10**12))


@query(_CONFLATED)
def streaming_conflation(spark, d):
    return C.run_once(_conflated(_stream(spark, d)), "complete")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n_events FROM events GROUP BY ALL")
def streaming_daily_counts(spark, d):
    events = _stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = C.windowed_counts(events, "ts", "1 day", "1 hour", "event_type")
    day = F.date_format("window.start", "yyyy-MM-dd").alias("day")
    return C.run_once(counts.select(day, "event_type", "n_events"), "complete")


@query(
    """SELECT 'sessions' AS subscriber, user_id AS key, count(*) AS n FROM events WHERE event_type IN ('error', 'purchase') GROUP BY 2
       UNION ALL SELECT 'progress', event_id, 1 FROM events WHERE event_type NOT IN ('error', 'purchase')"""
)
def streaming_fan_out(spark, d):
    """One stream for two readers: one counts the terminal events of each session, one keeps the rest."""
    terminal = F.col("event_type").isin("error", "purchase")
    readers = {
        "sessions": lambda batch: batch.where(terminal).groupBy(F.col("user_id").alias("key")).agg(F.count(F.lit(1)).alias("n")),
        "progress": lambda batch: batch.where(~terminal).select(F.col("event_id").alias("key"), F.lit(1).cast("long").alias("n")),
    }
    got = C.fan_out_once(_stream(spark, d), readers)
    named = [frame.select(F.lit(name).alias("subscriber"), "key", "n") for name, frame in got.items()]
    return named[0].groupBy("subscriber", "key").agg(F.sum("n").alias("n")).unionByName(named[1])
