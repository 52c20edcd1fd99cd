"""Queries over sessions: records, listings, payloads, overlaps, occurrences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators import audit as A
from palimpsest.operators import errors as C
from palimpsest.operators import lines as L
from palimpsest.operators import review as V
from palimpsest.operators import timeline as T
from palimpsest.plans.base import FOUND, found, query
from palimpsest.plans.base import source_lines as _source_lines
from palimpsest.session import table


@query(
    """WITH e AS (SELECT event_id, user_id, (event_id * 37 % 4000) / 8.0::DOUBLE AS s, (event_id * 37 % 4000) / 8.0::DOUBLE + 1 + event_id % 9 AS e, event_type FROM events)
      SELECT a.user_id, a.event_id AS click, b.event_id AS error, greatest(a.s, b.s) AS starts, least(a.e, b.e) AS ends
      FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'error' AND a.s < b.e AND b.s < a.e"""
)
def overlapping_spans(spark, d):
    """Spans of one kind with those of another of the same session that overlap them."""
    start = (F.col("event_id") * 37 % 4000) / F.lit(8.0)
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", start.alias("s"), (start + 1 + F.col("event_id") % 9).alias("e"))
    side = lambda kind, p, name: rows.where(F.col("event_type") == kind).select(
        "user_id", F.col("event_id").alias(name), F.col("s").alias(f"{p}_start"), F.col("e").alias(f"{p}_end")
    )
    met = T.overlap_join(side("click", "l", "click"), side("error", "r", "error"), "user_id", 16.0)
    return met.select("user_id", "click", "error", F.greatest("l_start", "r_start").alias("starts"), F.least("l_end", "r_end").alias("ends"))


@query(
    """WITH k AS (SELECT *, ['document', 'image', 'audio'][1 + doc_id % 3] AS kind FROM documents)
      SELECT doc_id, kind, CASE WHEN kind = 'document' THEN len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) OR text = '' THEN 1 ELSE 0 END END AS line_count,
        CASE WHEN kind = 'document' THEN length(text) END AS character_count, CASE WHEN kind = 'image' THEN 100 + n_chars % 900 END AS width,
        CASE WHEN kind = 'image' THEN 80 + n_chars % 700 END AS height, CASE WHEN kind = 'audio' THEN n_chars / 10.0::DOUBLE END AS duration FROM k"""
)
def source_records(spark, d):
    """One wide row a source, with the measurements that its kind has."""
    docs = L.measurements(table(spark, d, "documents")).join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    docs = docs.withColumn("kind", F.get(F.array(F.lit("document"), F.lit("image"), F.lit("audio")), (F.col("doc_id") % 3).cast("int")))
    only = lambda kind, value, name: F.when(F.col("kind") == kind, value).alias(name)
    return docs.select(
        "doc_id",
        "kind",
        only("document", F.col("line_count"), "line_count"),
        only("document", F.col("character_count"), "character_count"),
        only("image", 100 + F.col("n_chars") % 900, "width"),
        only("image", 80 + F.col("n_chars") % 700, "height"),
        only("audio", F.col("n_chars") / F.lit(10.0), "duration"),
    )


@query(
    """WITH c AS (SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'assistant') AS answers, max(turn) AS last_turn FROM conversations GROUP BY 1),
      p AS (SELECT conv_id, '{"answers":' || answers || ',"last_turn":' || last_turn || ',"reason_code":null,"session_id":"s' || conv_id || '","turns":' || turns || '}' AS payload FROM c)
      SELECT conv_id, payload, sha256(payload || '|render-3') AS fingerprint FROM p"""
)
def audit_payloads(spark, d):
    """Counts of a session as canonical JSON, and the fingerprint of a rendering made from them."""
    per = table(spark, d, "conversations").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "assistant").alias("answers"), F.max("turn").alias("last_turn")
    )
    payload = A.canonical_json(
        {
            "turns": F.col("turns"), "answers": F.col("answers"), "last_turn": F.col("last_turn"),
            "session_id": F.concat(F.lit("s"), "conv_id"), "reason_code": F.lit(None).cast("string"),
        }
    )
    return per.select("conv_id", payload.alias("payload"), F.sha2(F.concat(payload, F.lit("|render-3")), 256).alias("fingerprint"))


@query(
    f"""WITH {FOUND}, p AS (SELECT *, (line_no - 1) // 40 + 1 AS page FROM found)
      SELECT finding_id, doc_id, page, exact_text, count(*) OVER (PARTITION BY doc_id, page, exact_text ORDER BY line_no RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS occurrence FROM p"""
)
def display_occurrences(spark, d):
    """How many findings with the same text lie on earlier lines of a finding's page; forty lines are one."""
    page = F.floor((F.col("line_no") - 1) / 40) + 1
    before = Window.partitionBy("doc_id", "page", "exact_text").orderBy("line_no").rangeBetween(Window.unboundedPreceding, -1)
    return found(spark, d).withColumn("page", page).select("finding_id", "doc_id", "page", "exact_text", F.count(F.lit(1)).over(before).alias("occurrence"))


@query(
    f"""WITH {FOUND}, o AS (SELECT finding_id, unnest(range(0, length(line) - length(exact_text) + 1)) AS at_, line, exact_text AS part FROM found)
      SELECT finding_id, count(*) AS n_starts, min(at_) AS first_start, max(at_) AS last_start FROM o WHERE substr(line, at_ + 1, length(part)) = part GROUP BY 1"""
)
def fragment_occurrences(spark, d):
    """Every place, overlapping ones too, where the text of a finding occurs in its line."""
    lines = _source_lines(spark, d).select("doc_id", "line_no", "text")
    rows = found(spark, d).join(lines, ["doc_id", "line_no"]).withColumn("starts", X.all_starts(F.col("text"), F.col("exact_text")))
    return rows.select(
        "finding_id", F.size("starts").cast("long").alias("n_starts"), F.array_min("starts").alias("first_start"), F.array_max("starts").alias("last_start")
    )


@query(
    """WITH s AS (SELECT user_id, min(event_id) AS created, max(event_id) AS updated, count(*) AS n FROM events GROUP BY 1)
      SELECT user_id, created, updated, row_number() OVER (ORDER BY updated DESC, created DESC) AS position FROM s"""
)
def session_listing(spark, d):
    """Sessions as a list shows them: the latest first."""
    per = table(spark, d, "events").groupBy("user_id").agg(F.min("event_id").alias("created"), F.max("event_id").alias("updated"))
    return V.numbered(per, [F.desc("updated"), F.desc("created")])


@query(
    """WITH a AS (SELECT l_orderkey, l_linenumber, l_discount AS x, l_tax AS y, l_discount + (l_partkey % 3) / 20000 AS x2, l_tax + (l_suppkey % 2) / 5000 AS y2,
        0.2 + (l_partkey % 4) / 30000 AS w2, 0.3 - (l_suppkey % 5) / 40000 AS h2,
        l_quantity AS r, l_quantity + 360 * (l_partkey % 2) + (l_suppkey % 3) / 250 AS r2 FROM lineitem)
      SELECT l_orderkey, l_linenumber, abs(x - x2) < 1e-4 AND abs(y - y2) < 1e-4 AND abs(0.2 - w2) < 1e-4 AND abs(0.3 - h2) < 1e-4 AND abs(r - r2) < 0.01 AS same_region FROM a"""
)
def region_matches(spark, d):
    """Regions that count as equal: within 1e-4 in their corner and sides, and a hundredth of a degree."""
    x2, y2 = F.col("l_discount") + (F.col("l_partkey") % 3) / 20000, F.col("l_tax") + (F.col("l_suppkey") % 2) / 5000
    turn = F.col("l_quantity") + 360 * (F.col("l_partkey") % 2) + (F.col("l_suppkey") % 3) / 250
    left = (F.col("l_discount"), F.col("l_tax"), F.lit(0.2), F.lit(0.3), F.col("l_quantity"))
    right = (x2, y2, 0.2 + (F.col("l_partkey") % 4) / 30000, 0.3 - (F.col("l_suppkey") % 5) / 40000, turn)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.regions_match(left, right).alias("same_region"))


@query(
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS x0, l_tax * 12 AS y0, l_discount * 10 - l_quantity / 60 AS x1, l_tax * 12 + l_suppkey % 7 / 5000 AS y1 FROM lineitem)
      SELECT l_orderkey, l_linenumber, round(least(greatest(least(x0, x1), 0), 0.99), 6) AS x, round(least(greatest(least(y0, y1), 0), 0.99), 6) AS y,
        round(least(greatest(abs(x1 - x0), 0.01), 1 - least(x0, x1)), 6) AS width, round(least(greatest(abs(y1 - y0), 0.01), 1 - least(y0, y1)), 6) AS height FROM p"""
)
def bounded_regions(spark, d):
    """Regions drawn from one point to another: within the picture, and of a least size."""
    x0, y0 = F.col("l_discount") * 10, F.col("l_tax") * 12
    region = X.drawn_region(x0, y0, x0 - F.col("l_quantity") / 60, y0 + F.col("l_suppkey") % 7 / 5000, 0.01)
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", region.alias("g"))
    return rows.select("l_orderkey", "l_linenumber", *[F.round(f"g.{c}", 6).alias(c) for c in ("x", "y", "width", "height")])


_CODES = [c for c, *_ in C.CATALOG]


@query(
    "WITH c(code, category, retryable, http_status) AS (VALUES "
    + ", ".join(f"('{c}', '{k}', {str(c in C.RETRYABLE).lower()}, {h})" for c, k, h in C.CATALOG)
    + f"""), o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 63 = 62 THEN 'no_such_code' ELSE {_CODES!r}[1 + o_orderkey % 63 % {len(_CODES)}] END AS code,
        CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority END AS stored FROM orders)
      SELECT o_orderkey, o.code, coalesce(category, 'internal') AS category, coalesce(retryable, false) AS retryable, coalesce(http_status, 500) AS http_status,
        CASE WHEN stored IS NOT NULL THEN '{C.PUBLIC_MESSAGE}' END AS message FROM o LEFT JOIN c ON c.code = o.code"""
)
def public_errors(spark, d):
    """Codes looked up in the catalogue, where an unknown one is an internal error, and masked messages."""
    k = F.col("o_orderkey") % 63
    code = F.when(k == 62, "no_such_code").otherwise(F.get(F.array(*[F.lit(c) for c in _CODES]), (k % len(_CODES)).cast("int")))
    message = C.public_message(F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")))
    rows = table(spark, d, "orders").select("o_orderkey", code.alias("code"), message.alias("message"))
    return C.described(rows, "code").select("o_orderkey", "code", "category", "retryable", "http_status", "message")


_FAILURES = [*C.PROVIDER_CODES, "none"]


@query(
    f"""WITH c(failure, code) AS (VALUES {', '.join(map(str, C.PROVIDER_CODES.items()))}), e AS (SELECT event_id, {_FAILURES!r}[1 + event_id % {len(_FAILURES)}] AS failure FROM events)
      SELECT event_id, e.failure, code FROM e LEFT JOIN c ON c.failure = e.failure"""
)
def provider_errors(spark, d):
    """Failures of a provider under the codes that the catalogue has for them."""
    failure = F.get(F.array(*[F.lit(x) for x in _FAILURES]), (F.col("event_id") % len(_FAILURES)).cast("int"))
    rows = table(spark, d, "events").select("event_id", failure.alias("failure"))
    return rows.withColumn("code", C.provider_code(F.col("failure")))
