"""Queries over stored sessions: listings, gates, integrity of what is written."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators import blocks as K
from palimpsest.operators import lines as L
from palimpsest.operators import policy as P
from palimpsest.operators import review as V
from palimpsest.plans.base import FOUND, LINES, found, query, rules_sql
from palimpsest.plans.base import source_lines as _source_lines
from palimpsest.schemas import FINDINGS
from palimpsest.session import table
from palimpsest.sources import formats as S


def _pick(names, n):
    return F.get(F.array(*[F.lit(x) for x in (names.split() if isinstance(names, str) else names)]), n.cast("int"))


# --- listings --------------------------------------------------------------------------------

@query(
    """WITH f AS (SELECT o_orderkey AS k, o_custkey % 40 AS session, o_orderdate AS created FROM orders),
    l AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 9 = 0 THEN 99 ELSE o_custkey % 40 END AS session, 'l' || o_orderkey AS layer_id FROM orders WHERE o_orderstatus <> 'P'),
    m AS (SELECT f.k, f.session AS fs, l.session AS ls, layer_id, created FROM f LEFT JOIN l ON l.k = f.k),
    b AS (SELECT fs AS session, * FROM m UNION ALL SELECT ls, * FROM m WHERE ls <> fs)
    SELECT session, k AS finding, layer_id, row_number() OVER (PARTITION BY session ORDER BY created, k) AS position FROM b"""
)
def review_listing(spark, d):
    """Layers as sessions list them, those that cross sessions in both."""
    orders = table(spark, d, "orders")
    findings = orders.select(F.col("o_orderkey").alias("finding"), (F.col("o_custkey") % 40).alias("session"), F.col("o_orderdate").alias("created"))
    session = F.when(F.col("o_custkey") % 9 == 0, F.lit(99)).otherwise(F.col("o_custkey") % 40)
    layers = orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("finding"), session.alias("session"), F.concat(F.lit("l"), "o_orderkey").alias("layer_id"))
    return V.session_layers(findings, layers, "finding", ["created", "finding"]).select("session", "finding", "layer_id", "position")


@query(
    """SELECT event_id, o.o_orderkey, o.o_orderstatus, l_partkey FROM events e JOIN orders o ON o.o_orderkey = e.event_id
       LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS l_partkey FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) l ON l_orderkey = o.o_orderkey"""
)
def finding_lookup(spark, d):
    """Single findings, asked for by id, with their layer if they have one."""
    asked = table(spark, d, "events").select("event_id", F.col("event_id").alias("o_orderkey"))
    layers = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_partkey").alias("l_partkey"))
    return V.hydrate(asked.join(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey"), layers, "o_orderkey")


@query(
    """SELECT o_orderkey, c_mktsegment AS set_id, sha256(c_name || c_acctbal) AS content_hash FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey"""
)
def instruction_references(spark, d):
    """Sessions with the identity of the instruction set that they are locked to, and not its contents."""
    locks = table(spark, d, "customer").where("c_acctbal > 0").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("set_id"), F.sha2(F.concat("c_name", F.col("c_acctbal").cast("string")), 256).alias("content_hash"), F.repeat("c_name", F.lit(100)).alias("snapshot")
    )
    met = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(locks, "o_custkey", "left")
    return met.select("o_orderkey", "set_id", "content_hash")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn % 2, turn DESC) AS position FROM conversations")
def model_log_listing(spark, d):
    """Logs of a session by their time and id; turns stand in for both."""
    along = Window.partitionBy("conv_id").orderBy(F.col("turn") % 2, F.desc("turn"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.row_number().over(along).alias("position"))


@query(f"WITH {LINES} SELECT doc_id, line_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_id) AS position FROM lines")
def textual_line_order(spark, d):
    """Lines as a store returns them that sorts ids as texts: t10 before t2."""
    return _source_lines(spark, d).select("doc_id", "line_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_id")).alias("position"))


@query(
    """WITH q AS (SELECT user_id, min(event_id) AS created, max(event_id) AS last FROM events WHERE event_type = 'error' GROUP BY 1),
    done AS (SELECT user_id, max(event_id) AS finished FROM events WHERE event_type = 'signup' GROUP BY 1),
    p AS (SELECT q.* FROM q LEFT JOIN done USING (user_id) WHERE finished IS NULL OR finished < last)
    SELECT user_id, created, row_number() OVER (ORDER BY created, user_id) AS position FROM p"""
)
def purge_queue(spark, d):
    """Sessions whose files have still to be purged, in the order in which that was asked for."""
    events = table(spark, d, "events")
    asked = events.where("event_type = 'error'").groupBy("user_id").agg(F.min("event_id").alias("created"), F.max("event_id").alias("last"))
    done = events.where("event_type = 'signup'").groupBy("user_id").agg(F.max("event_id").alias("finished"))
    left = asked.join(done, "user_id", "left").where("finished IS NULL OR finished < last").select("user_id", "created")
    return V.numbered(left, [F.asc("created"), F.asc("user_id")])


@query(
    """WITH t AS (SELECT user_id, max(CAST(json_extract(props, '$.k') AS INTEGER)) AS generation FROM events GROUP BY 1)
       SELECT event_id, e.user_id, event_type FROM events e JOIN t ON t.user_id = e.user_id AND t.generation = CAST(json_extract(props, '$.k') AS INTEGER) WHERE event_type IN ('error', 'purchase')"""
)
def terminal_events(spark, d):
    """What a client keeps: terminal events of the latest connection of its session."""
    rows = table(spark, d, "events").withColumn("generation", F.get_json_object("props", "$.k").cast("int"))
    latest = rows.groupBy("user_id").agg(F.max("generation").alias("generation"))
    return rows.where("event_type IN ('error', 'purchase')").join(latest, ["user_id", "generation"]).select("event_id", "user_id", "event_type")


# --- selection -------------------------------------------------------------------------------

@query(
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey AS layer, l_suppkey % 4 AS page, l_returnflag = 'N' AS enabled, l_linestatus = 'F' AS confirmed, l_partkey % 5 > 0 AS covers FROM lineitem)
       SELECT l_orderkey, page, layer, row_number() OVER (PARTITION BY l_orderkey, page ORDER BY layer, l_linenumber) AS position FROM l WHERE enabled AND confirmed AND covers AND page > 0"""
)
def surface_layers(spark, d):
    """Layers that are rendered on each page of a session, in the order of their ids."""
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey").alias("layer"), F.when(F.col("l_suppkey") % 4 > 0, F.struct((F.col("l_suppkey") % 4).alias("page"))).alias("surface"),
        (F.col("l_returnflag") == "N").alias("enabled"), F.when(F.col("l_linestatus") == "F", "confirmed").otherwise("needs_review").alias("review_decision"),
        F.when(F.col("l_partkey") % 5 > 0, "redact").otherwise("preserve").alias("action"),
    )
    chosen = V.render_selection(rows).where("surface IS NOT NULL")
    along = Window.partitionBy("l_orderkey", "surface").orderBy("layer", "l_linenumber")
    return chosen.select("l_orderkey", "surface.page", "layer", F.row_number().over(along).alias("position"))


@query(
    f"""WITH {FOUND}, {rules_sql('gdpr')}, e AS (SELECT finding_id, CASE doc_id % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'no_such_type' WHEN 2 THEN 'name' ELSE entity_type END AS edited FROM found)
      SELECT finding_id, edited FROM e WHERE edited <> 'unknown' AND edited NOT IN (SELECT entity_type FROM rules)"""
)
def entity_type_edits(spark, d):
    """Edits that give a finding a type which the policy does not have."""
    edited = F.when(F.col("doc_id") % 4 == 0, "unknown").when(F.col("doc_id") % 4 == 1, "no_such_type").when(F.col("doc_id") % 4 == 2, "name").otherwise(F.col("entity_type"))
    return P.unknown_types(found(spark, d).select("finding_id", edited.alias("edited")), "edited", "gdpr")


_IDS = ["gdpr", "ccpa-cpra", "Gdpr", "a--b", "-a", "a_b", "online_identifier", "x9_", "pic_" + "0f" * 32, "b_" + "a1" * 32, "b_" + "A1" * 32, ""]


@query(
    f"""WITH i AS (SELECT o_orderkey, {_IDS!r}[1 + o_orderkey % {len(_IDS)}] AS id FROM orders)
      SELECT o_orderkey, id, regexp_full_match(id, '[a-z0-9]+(?:-[a-z0-9]+)*') AS set_id, regexp_full_match(id, '[a-z0-9]+(?:_[a-z0-9]+)*') AS entity_type,
        regexp_full_match(id, 'pic_[0-9a-f]{{64}}') AS occurrence_id, regexp_full_match(id, 'b_[0-9a-f]{{64}}') AS block_id FROM i"""
)
def identifier_checks(spark, d):
    """Which kinds of identifier each of some texts could be."""
    rows = table(spark, d, "orders").select("o_orderkey", _pick(_IDS, F.col("o_orderkey") % len(_IDS)).alias("id"))
    return rows.select("o_orderkey", "id", *[X.matches_whole(F.col("id"), p).alias(k) for k, p in X.IDENTIFIERS.items()])


@query(f"WITH {FOUND} SELECT finding_id, CASE WHEN doc_id % 3 > 0 THEN line_no END AS line_no FROM found")
def line_numbers(spark, d):
    """The number that a line's id holds, null for ids of another form."""
    line_id = F.when(F.col("doc_id") % 3 > 0, F.col("line_id")).otherwise(F.concat(F.lit("l"), "line_no"))
    return found(spark, d).select("finding_id", X.line_number(line_id).alias("line_no"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS created_at FROM events")
def iso_timestamps(spark, d):
    """Times of events as a log writes them, in UTC."""
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("created_at"))


# --- files -----------------------------------------------------------------------------------

_KINDS = "WITH dim AS (SELECT DISTINCT * FROM (VALUES " + ", ".join(f"('{f}', '{k}')" for f, _, _, k, _ in S.FORMATS) + ") t(format, kind))"
_NAMES = [f for f, *_ in S.FORMATS] + ["exe"]


@query(
    _KINDS
    + f""", r AS (SELECT doc_id, {_NAMES!r}[1 + doc_id % {len(_NAMES)}] AS format, ['document', 'image', 'audio', 'video'][1 + doc_id % 5 % 4] AS kind FROM documents)
      SELECT doc_id, r.format, r.kind, dim.kind AS expected_kind FROM r LEFT JOIN dim ON dim.format = r.format WHERE dim.kind IS NULL OR dim.kind <> r.kind"""
)
def kind_format_violations(spark, d):
    """Stored files whose kind is not that of their format."""
    rows = table(spark, d, "documents").select("doc_id", _pick(_NAMES, F.col("doc_id") % len(_NAMES)).alias("format"), _pick("document image audio video", F.col("doc_id") % 5 % 4).alias("kind"))
    return S.kind_violations(rows, "format", "kind")


@query(
    _KINDS
    + f""", r AS (SELECT doc_id, {_NAMES!r}[1 + doc_id % {len(_NAMES) - 1}] AS source_format, {_NAMES!r}[1 + (doc_id + doc_id % 3) % {len(_NAMES) - 1}] AS rendered_format FROM documents)
      SELECT doc_id, s.kind AS source_kind, t.kind AS rendered_kind FROM r JOIN dim s ON s.format = source_format JOIN dim t ON t.format = rendered_format WHERE s.kind <> t.kind"""
)
def rendered_kinds(spark, d):
    """Rendered files of another kind than their source."""
    n = len(_NAMES) - 1
    rows = table(spark, d, "documents").select("doc_id", _pick(_NAMES, F.col("doc_id") % n).alias("source_format"), _pick(_NAMES, (F.col("doc_id") + F.col("doc_id") % 3) % n).alias("rendered_format"))
    kind = lambda c: S.kind_of(F.col(c))
    return rows.select("doc_id", kind("source_format").alias("source_kind"), kind("rendered_format").alias("rendered_kind")).where("source_kind <> rendered_kind")


_PARTS = [*S.ACTIVE_PARTS, "MainDocumentPart", "ImagePart", "StyleDefinitionsPart", "HeaderPart", "FooterPart", "CommentsPart"]


@query(
    f"""WITH p AS (SELECT l_orderkey, {_PARTS!r}[1 + CASE WHEN l_partkey % 9 = 0 THEN l_suppkey % 8 ELSE 8 + l_suppkey % 6 END] AS part, l_partkey % 37 = 0 AS external, l_extendedprice * 700 AS bytes FROM lineitem),
      g AS (SELECT l_orderkey, sum(bytes) > 52428800 AS large, bool_or(external) AS external, min(CASE WHEN part IN {tuple(S.ACTIVE_PARTS)!r} THEN part END) AS active FROM p GROUP BY 1)
      SELECT l_orderkey, CASE WHEN large THEN 'package_limit' WHEN external THEN 'external_relationship' WHEN active IS NOT NULL THEN 'active_content' END AS reason, active FROM g"""
)
def package_contents(spark, d):
    """Packages that are refused for their size, for what they load, or for what could run in them."""
    part = _pick(_PARTS, F.when(F.col("l_partkey") % 9 == 0, F.col("l_suppkey") % 8).otherwise(8 + F.col("l_suppkey") % 6))
    rows = table(spark, d, "lineitem").select("l_orderkey", part.alias("part"), (F.col("l_partkey") % 37 == 0).alias("external"), (F.col("l_extendedprice") * 700).alias("bytes"))
    return S.package_contents(rows, "l_orderkey")


@query(
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey % 3 > 0 AS targetable, CASE WHEN l_partkey % 5 > 0 THEN 'a.png' END AS asset, CASE WHEN l_partkey % 7 > 0 THEN 'sha' END AS sha,
        CASE WHEN l_suppkey % 6 > 0 THEN l_quantity END AS w, l_quantity AS h, CASE WHEN l_suppkey % 4 = 0 THEN 'external_image' END AS reason FROM lineitem)
      SELECT l_orderkey, l_linenumber, CASE WHEN targetable THEN 'incomplete_evidence' ELSE 'no_reason' END AS violation FROM p
      WHERE CASE WHEN targetable THEN asset IS NULL OR sha IS NULL OR w IS NULL OR h IS NULL OR reason IS NOT NULL ELSE reason IS NULL END"""
)
def picture_evidence(spark, d):
    """Pictures that count as targets without all that a target needs, or do not and say not why."""
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (part % 3 > 0).alias("targetable"), F.when(part % 5 > 0, "a.png").alias("asset"), F.when(part % 7 > 0, "sha").alias("sha"),
        F.when(supp % 6 > 0, F.col("l_quantity")).alias("w"), F.col("l_quantity").alias("h"), F.when(supp % 4 == 0, "external_image").alias("reason"),
    )
    return K.evidence_violations(rows, ["asset", "sha", "w", "h"]).select("l_orderkey", "l_linenumber", "violation")


@query(
    """WITH f AS (SELECT page_id, url, html, CASE page_id % 4 WHEN 0 THEN 'document' WHEN 1 THEN 'image' WHEN 2 THEN 'audio' ELSE 'document' END AS kind,
        ['txt', 'pdf', 'docx', 'md', 'MP3', 'weird', 'flac'][1 + page_id % 7] AS suffix FROM pages),
      n AS (SELECT page_id, sha256(html) AS sha256, CASE kind WHEN 'image' THEN 'png' WHEN 'audio' THEN CASE WHEN lower(suffix) IN ('aac', 'flac', 'm4a', 'mp3', 'mp4', 'ogg', 'opus', 'wav') THEN lower(suffix) ELSE 'wav' END ELSE suffix END AS output FROM f)
      SELECT page_id, 'redacted.' || output AS filename, sha256 || '.' || output AS stored_as, row_number() OVER (PARTITION BY sha256, output ORDER BY page_id) > 1 AS reused FROM n"""
)
def output_names(spark, d):
    """Rendered files: their names, where their contents put them, and whether that is there already."""
    suffix = _pick("txt pdf docx md MP3 weird flac", F.col("page_id") % 7)
    kind = F.when(F.col("page_id") % 4 == 1, "image").when(F.col("page_id") % 4 == 2, "audio").otherwise("document")
    rows = table(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("sha256"), S.output_format(kind, suffix).alias("output"))
    return S.finalised(rows, "page_id").select("page_id", F.concat(F.lit("redacted."), "output").alias("filename"), "stored_as", "reused")


@query(
    """SELECT page_id, sha256(html) AS sha256, CASE WHEN strlen(html) > 2000 THEN 'file_too_large' WHEN html = '' THEN 'empty' END AS reason FROM pages"""
)
def upload_admission(spark, d):
    """Uploads with their digest, and why they are refused; pages stand in for files."""
    pages = table(spark, d, "pages")
    return pages.select("page_id", F.sha2("html", 256).alias("sha256"), S.upload_reason(F.octet_length("html"), 2000).alias("reason"))


@query(
    """SELECT page_id, CASE WHEN page_id % 4 = 0 THEN coalesce(nullif(trim(regexp_replace(base, '(.)\\.[^.]*$', '\\1')), ''), nullif(trim(base), ''), 'Untitled review') ELSE trim('  Review of ' || page_id || ' ') END AS display_name
       FROM (SELECT page_id, regexp_extract(url, '([^/\\\\]*)$', 1) AS base FROM pages)"""
)
def renamed_sessions(spark, d):
    """New names of sessions; a blank one gives way to the title of the file."""
    given = F.when(F.col("page_id") % 4 == 0, "   ").otherwise(F.concat(F.lit("  Review of "), "page_id", F.lit(" ")))
    return table(spark, d, "pages").select("page_id", X.display_name(given, F.col("url")).alias("display_name"))


# --- writes ----------------------------------------------------------------------------------

@query(
    """WITH f AS (SELECT o_orderkey AS k, o_custkey % 20 AS s FROM orders), l AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 13 = 0 THEN 77 ELSE o_custkey % 20 END AS s, 'box' AS effect FROM orders WHERE o_orderstatus <> 'P'),
      w AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 17 = 0 THEN 78 ELSE o_custkey % 20 END AS s, 'blur' AS effect FROM orders)
      SELECT w.k AS finding, w.s AS session, (f.k IS NOT NULL)::BIGINT AS finding_rows, (l.k IS NOT NULL)::BIGINT AS layer_rows, f.k IS NOT NULL AND l.k IS NOT NULL AS saved,
        CASE WHEN f.k IS NOT NULL AND l.k IS NOT NULL THEN w.effect ELSE l.effect END AS effect
      FROM w LEFT JOIN f ON f.k = w.k AND f.s = w.s LEFT JOIN l ON l.k = w.k AND l.s = w.s"""
)
def saved_layers(spark, d):
    """Saves that have to meet one finding and one layer of their session, and what the layer is then."""
    orders, customer = table(spark, d, "orders"), F.col("o_custkey")
    key = F.col("o_orderkey").alias("finding")
    findings = orders.select(key, (customer % 20).alias("session"))
    layers = orders.where("o_orderstatus <> 'P'").select(key, F.when(customer % 13 == 0, 77).otherwise(customer % 20).alias("session"), F.lit("box").alias("effect"))
    saves = orders.select(key, F.when(customer % 17 == 0, 78).otherwise(customer % 20).alias("session"), F.lit("blur").alias("effect"))
    return V.save_layers(findings, layers, saves, "finding", "session", ["effect"])


@query(
    """WITH c AS (SELECT doc_id, sha256(text) AS sha256, 'txt' AS format, 0 AS line_count FROM documents),
      n AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'other' ELSE sha256(text) END AS sha256, CASE WHEN doc_id % 11 = 0 THEN 'md' ELSE 'txt' END AS format, n_chars AS line_count FROM documents WHERE lang IS NOT NULL)
      SELECT c.doc_id, c.sha256, c.format, CASE WHEN n.sha256 = c.sha256 AND n.format = c.format THEN n.line_count ELSE c.line_count END AS line_count,
        n.doc_id IS NOT NULL AND NOT (n.sha256 = c.sha256 AND n.format = c.format) AS refused FROM c LEFT JOIN n USING (doc_id)"""
)
def replaced_metadata(spark, d):
    """New measurements of sources; the file that they are of cannot change."""
    docs = table(spark, d, "documents")
    current = docs.select("doc_id", F.sha2("text", 256).alias("sha256"), F.lit("txt").alias("format"), F.lit(0).cast("long").alias("line_count"))
    new = docs.where("lang IS NOT NULL").select(
        "doc_id", F.when(F.col("doc_id") % 7 == 0, "other").otherwise(F.sha2("text", 256)).alias("sha256"), F.when(F.col("doc_id") % 11 == 0, "md").otherwise("txt").alias("format"), F.col("n_chars").cast("long").alias("line_count")
    )
    return V.replace_measurements(current, new, "doc_id", ["sha256", "format"], ["line_count"])


@query(
    """WITH c AS (SELECT o_custkey, o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey) > 450000 AS failed FROM orders)
       SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq, 'order_changed' AS event_type FROM c WHERE NOT failed"""
)
def transaction_events(spark, d):
    """Audit rows of committed changes: of a customer with a change that failed there are none."""
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    kept = V.transaction_events(rows, "o_custkey", ["o_orderkey"], F.col("o_totalprice") > 450_000)
    return kept.select("o_custkey", "o_orderkey", "seq", F.lit("order_changed").alias("event_type"))


@query(
    """WITH b AS (SELECT c_custkey, sha256(c_name) AS content_hash FROM customer),
      r AS (SELECT o_custkey AS c_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'stale' ELSE sha256(c_name) END AS expected, 'v' || o_orderkey AS content FROM orders JOIN customer ON c_custkey = o_custkey
            QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
      SELECT b.c_custkey, CASE WHEN r.expected = b.content_hash THEN sha256(r.content) ELSE b.content_hash END AS content_hash, coalesce(r.expected <> b.content_hash, false) AS conflict FROM b LEFT JOIN r USING (c_custkey)"""
)
def catalogue_replacements(spark, d):
    """Instruction sets replaced by whoever knew their latest contents; others meet a conflict."""
    base = table(spark, d, "customer").select("c_custkey", F.sha2("c_name", 256).alias("content_hash"))
    newest = V.latest(table(spark, d, "orders").withColumn("c_custkey", F.col("o_custkey").cast("long")), "c_custkey", [F.desc("o_orderkey")])
    expected = F.when(F.col("o_orderkey") % 3 == 0, "stale").otherwise(F.col("content_hash"))
    wanted = newest.select("c_custkey", "o_orderkey").join(base, "c_custkey").select("c_custkey", expected.alias("expected"), F.concat(F.lit("v"), "o_orderkey").alias("content"))
    return V.optimistic_replace(base, wanted, "c_custkey")


@query(
    f"""WITH {LINES}, b AS (SELECT doc_id, line_no, length(text) AS n FROM lines),
      leaves AS (SELECT l.doc_id, l.line_no, unnest(range(greatest(ceil(n / 20.0), 1)::BIGINT)) AS nth, l.text FROM lines l JOIN b USING (doc_id, line_no)),
      p AS (SELECT doc_id, line_no, nth, substr(text, nth * 20 + 1, 20) AS leaf, nth * 20 AS a, least(nth * 20 + 20, length(text)) AS z, length(text) // 3 AS s, length(text) // 3 + 25 AS e FROM leaves)
      SELECT doc_id, line_no, nth, CASE WHEN a < e AND z > s THEN left(leaf, greatest(s - a, 0)) || CASE WHEN nth = min(CASE WHEN a < e AND z > s THEN nth END) OVER (PARTITION BY doc_id, line_no) THEN '[X]' ELSE '' END
        || substr(leaf, least(e, z) - a + 1) ELSE leaf END AS rendered FROM p"""
)
def leaf_replacements(spark, d):
    """Blocks cut into runs of twenty characters, after a range over some of them was replaced."""
    lines = _source_lines(spark, d).withColumn("key", F.concat_ws("/", "doc_id", "line_no"))
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length("text") / 20), F.lit(1)).cast("int") - 1), lambda k: F.substring("text", k * 20 + 1, F.lit(20)))
    leaves = lines.select("key", "doc_id", "line_no", F.posexplode(runs).alias("nth", "text"))
    start = F.floor(F.length("text") / 3)
    ranges = lines.select("key", start.alias("start"), (start + 25).alias("end"), F.lit("[X]").alias("replacement"))
    return K.replace_in_leaves(leaves, ranges, "key").select("doc_id", "line_no", "nth", "rendered")


@query(
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_orderkey || '/' || l_suppkey % 3 AS block, l_partkey % 900 AS s, l_partkey % 900 + l_quantity::BIGINT - 2 AS e, 'x' || l_partkey AS exact,
        CASE WHEN l_suppkey % 11 = 0 THEN 'other' ELSE 'sha' END AS sha, CASE WHEN l_partkey % 13 = 0 THEN ' ' ELSE 'body' END AS story,
        CASE WHEN l_partkey % 17 = 0 THEN repeat('y', 513) WHEN l_partkey % 19 = 0 THEN 'a' || chr(9) || 'b' WHEN l_partkey % 23 = 0 THEN chr(128512) ELSE '[X]' END AS text FROM lineitem),
      v AS (SELECT *, lag(e) OVER (PARTITION BY block ORDER BY s, e, l_linenumber, exact, l_orderkey) AS before FROM r),
      c AS (SELECT l_orderkey, l_linenumber, exact, CASE WHEN sha <> 'sha' OR trim(story) = '' OR s < 0 OR e <= s THEN 'invalid_target' WHEN before > s THEN 'overlapping_targets'
        WHEN length(text) > 512 OR contains(text, chr(9)) OR contains(text, chr(128512)) THEN 'invalid_replacement' END AS reason FROM v)
      SELECT l_orderkey, l_linenumber, exact, reason FROM c WHERE reason IS NOT NULL"""
)
def render_violations(spark, d):
    """Ranges that must not be rendered: of another file, over one another, or with a text that cannot be."""
    part, start = F.col("l_partkey"), F.col("l_partkey") % 900
    text = F.when(part % 17 == 0, F.repeat(F.lit("y"), F.lit(513))).when(part % 19 == 0, "a\tb").when(part % 23 == 0, "\U0001f600").otherwise("[X]")
    ranges = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat_ws("/", "l_orderkey", F.col("l_suppkey") % 3).alias("block"), start.alias("start"), (start + F.round("l_quantity").cast("long") - 2).alias("end"),
        F.concat(F.lit("x"), "l_partkey").alias("exact_text"), F.when(F.col("l_suppkey") % 11 == 0, "other").otherwise("sha").alias("source_sha256"),
        F.when(part % 13 == 0, " ").otherwise("body").alias("story"), F.lit("/word/document.xml").alias("part"), text.alias("replacement"), F.lit("sha").alias("expected"),
        F.struct("l_linenumber", F.concat(F.lit("x"), "l_partkey"), "l_orderkey").alias("layer_id"),
    )
    return K.render_violations(ranges, "block", "expected").select("l_orderkey", "l_linenumber", F.col("exact_text").alias("exact"), "reason")


@query(
    f"""WITH {FOUND} SELECT finding_id, 's' || doc_id AS session_id, 'document' AS kind, entity_type AS detected_entity_type, NULL::VARCHAR AS reviewed_entity_type, confidence AS detection_confidence, line_id, exact_text,
      line_no % 2 = 0 AS edited FROM found"""
)
def finding_rows(spark, d):
    """Findings as rows of the store's types, written as JSON and read back."""
    target = F.struct("line_id", "exact_text")
    row = F.struct(
        "finding_id", F.concat(F.lit("s"), "doc_id").alias("session_id"), F.lit("document").alias("kind"), F.col("entity_type").alias("detected_entity_type"),
        F.col("confidence").alias("detection_confidence"), target.alias("target"), (F.col("line_no") % 2 == 0).alias("edited"),
    )
    read = found(spark, d).select(F.from_json(F.to_json(row), FINDINGS).alias("f"))
    return read.select("f.finding_id", "f.session_id", "f.kind", "f.detected_entity_type", "f.reviewed_entity_type", "f.detection_confidence", "f.target.line_id", "f.target.exact_text", "f.edited")
