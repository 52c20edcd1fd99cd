"""Queries over texts: lines, batches, detection, anchoring, masks, tokens, rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators import anchor as A
from palimpsest.operators import lines as L
from palimpsest.operators import match as M
from palimpsest.operators import policy as P
from palimpsest.operators import redact as R
from palimpsest.operators import review as V
from palimpsest.plans.base import FOUND, LAYERS, LINES, MASK, found, layers, query, rules_sql, source_lines as _source_lines
from palimpsest.session import table

BATCH_LIMIT = 4096


@query(f"WITH {LINES} SELECT doc_id, line_no, line_id, text FROM lines")
def source_lines(spark, d):
    return _source_lines(spark, d)


@query(
    """SELECT doc_id, len(regexp_split_to_array(text, '\\r\\n|\\r|\\n')) - CASE WHEN regexp_matches(text, '[\\r\\n]$') OR text = '' THEN 1 ELSE 0 END AS line_count,
       length(text) AS character_count, strlen(text) AS byte_count, sha256(text) AS sha256 FROM documents"""
)
def source_measurements(spark, d):
    return L.measurements(table(spark, d, "documents"))


@query(
    """WITH s AS (SELECT page_id, regexp_split_to_array(html, '\\r\\n|\\r|\\n') AS v FROM pages),
     r AS (SELECT page_id, unnest(range(0, len(v))) AS pos, trim(regexp_replace(unnest(v), '\\s+', ' ', 'g')) AS text FROM s),
     n AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS line_no, text FROM r WHERE text <> '')
     SELECT page_id, line_no, printf('l%04d', line_no) AS line_id, text FROM n"""
)
def page_lines(spark, d):
    return L.page_lines(table(spark, d, "pages"), "page_id", "html")


_BATCHES = f"""WITH RECURSIVE {LINES},
  c AS (SELECT doc_id, line_no, strlen(text) + {{extra}} AS cost, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM lines),
  bad AS (SELECT doc_id FROM c GROUP BY doc_id HAVING max(cost) > {BATCH_LIMIT}),
  w AS (
    SELECT doc_id, k, line_no, cost, 1 AS batch, cost AS used FROM c WHERE k = 1 AND doc_id NOT IN (SELECT doc_id FROM bad)
    UNION ALL
    SELECT c.doc_id, c.k, c.line_no, c.cost,
           CASE WHEN w.used + c.cost > {BATCH_LIMIT} THEN w.batch + 1 ELSE w.batch END,
           CASE WHEN w.used + c.cost > {BATCH_LIMIT} THEN c.cost ELSE w.used + c.cost END
    FROM w JOIN c ON c.doc_id = w.doc_id AND c.k = w.k + 1)
  SELECT doc_id, batch, min(line_no) AS first_line, max(line_no) AS last_line, count(*) AS n_lines, sum(cost)::BIGINT AS cost
  FROM w GROUP BY doc_id, batch
  UNION ALL
  SELECT doc_id, 0, min(line_no), max(line_no), count(*), max(cost)::BIGINT FROM c WHERE doc_id IN (SELECT doc_id FROM bad) GROUP BY doc_id"""


@query(_BATCHES.format(extra="1"))
def text_batches(spark, d):
    return L.text_batches(table(spark, d, "documents"), BATCH_LIMIT)


@query(
    """SELECT sha256(text) AS sha256, min(doc_id) AS first_doc, count(*) AS n_docs, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS doc_ids
       FROM documents GROUP BY 1"""
)
def source_hash_groups(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    ids = F.array_sort(F.collect_list("doc_id"))
    return docs.groupBy("sha256").agg(
        F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n_docs"), F.array_join(ids, ",").alias("doc_ids")
    )


@query(f"WITH {FOUND} SELECT finding_id, doc_id, line_no, line_id, entity_type, nth, exact_text, confidence FROM found")
def detect_entities(spark, d):
    return found(spark, d)


_CLAIMED = (
    FOUND
    + """, claimed AS (
  SELECT finding_id, doc_id, CASE WHEN (doc_id + line_no + nth) % 6 = 0 THEN 't' || (line_no + 1) ELSE line_id END AS line_id,
         entity_type, exact_text FROM found),
anchored AS (
  SELECT c.*, l.text AS line_text FROM claimed c JOIN lines l USING (doc_id, line_id) WHERE contains(l.text, c.exact_text))"""
)


def _claimed(spark, d):
    """Detections of which some name the line after their own, as a model might."""
    moved = (F.col("doc_id") + F.col("line_no") + F.col("nth")) % 6 == 0
    line_id = F.when(moved, F.concat(F.lit("t"), F.col("line_no") + 1)).otherwise(F.col("line_id"))
    return found(spark, d).select("finding_id", "doc_id", line_id.alias("line_id"), "entity_type", "exact_text")


@query(f"WITH {_CLAIMED} SELECT finding_id, doc_id, line_id, entity_type, exact_text, line_text FROM anchored")
def anchor_text(spark, d):
    return A.anchor_text(_claimed(spark, d), _source_lines(spark, d))


@query(
    f"""WITH {_CLAIMED}, g AS (SELECT doc_id, count(*) AS extracted FROM claimed GROUP BY 1),
    k AS (SELECT doc_id, count(*) AS anchored FROM anchored GROUP BY 1)
    SELECT doc_id, extracted, coalesce(anchored, 0) AS anchored, extracted - coalesce(anchored, 0) AS rejected FROM g LEFT JOIN k USING (doc_id)"""
)
def rejected_counts(spark, d):
    claimed = _claimed(spark, d)
    return A.rejected_counts(claimed, A.anchor_text(claimed, _source_lines(spark, d)))


@query(
    f"""WITH {_CLAIMED} SELECT finding_id,
      CASE WHEN instr(substr(line_text, instr(line_text, exact_text) + 1), exact_text) = 0 THEN instr(line_text, exact_text) - 1 END AS first_at,
      CASE WHEN instr(substr(line_text, instr(line_text, exact_text) + 1), exact_text) = 0
           THEN instr(line_text, exact_text) - 1 + length(exact_text) END AS end_at
      FROM anchored"""
)
def unique_offsets(spark, d):
    rows = A.anchor_text(_claimed(spark, d), _source_lines(spark, d))
    at = X.unique_offset(F.col("line_text"), F.col("exact_text"))
    return rows.select("finding_id", at.alias("first_at"), (at + F.length("exact_text")).alias("end_at"))


def _policy_sql(policy: str) -> str:
    return f"""WITH {FOUND}, {rules_sql(policy)},
  e AS (SELECT *, CASE doc_id % 9 WHEN 0 THEN '' WHEN 1 THEN 'name' END AS reviewed,
               CASE line_no % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'document' ELSE 'audio' END AS kind FROM found),
  x AS (SELECT *, coalesce(nullif(reviewed, ''), nullif(entity_type, ''), 'unknown') AS effective FROM e),
  p AS (SELECT x.*, r.category, r.special, r.risk,
               CASE kind WHEN 'image' THEN coalesce(r.image, 'redact/box') WHEN 'audio' THEN coalesce(r.audio, 'redact/bleep')
                         ELSE coalesce(r.document, 'redact/box') END AS pair
        FROM x LEFT JOIN rules r ON r.entity_type = x.effective)
  SELECT finding_id, effective, kind, coalesce(category, 'unknown') AS privacy_category, coalesce(special, 'none') AS special_category_type,
         coalesce(risk, 'medium') AS privacy_risk, split_part(pair, '/', 1) AS action, split_part(pair, '/', 2) AS effect FROM p"""


def _policy_layers(spark, d, policy):
    reviewed = F.when(F.col("doc_id") % 9 == 0, "").when(F.col("doc_id") % 9 == 1, "name")
    kind = F.when(F.col("line_no") % 3 == 0, "image").when(F.col("line_no") % 3 == 1, "document").otherwise("audio")
    rows = found(spark, d).select(
        "finding_id", X.effective_entity_type(reviewed, F.col("entity_type")).alias("effective"), kind.alias("kind")
    )
    return P.resolve(rows, policy, F.col("effective"), F.col("kind"), spark)


@query(_policy_sql("gdpr"))
def policy_layers_gdpr(spark, d):
    return _policy_layers(spark, d, "gdpr")


@query(_policy_sql("ccpa-cpra"))
def policy_layers_ccpa(spark, d):
    return _policy_layers(spark, d, "ccpa-cpra")


_MASKED = """names AS (
  SELECT 'name' AS kind, c_custkey AS id, c_name AS x FROM customer
  UNION ALL SELECT 'email', c_custkey, lower(replace(c_name, '#', '.')) || '@' || lower(c_mktsegment) || '.example' FROM customer
  UNION ALL SELECT 'phone', c_custkey, printf('+1 (%03d) 555-%04d', c_custkey % 1000, c_custkey % 10000) FROM customer
  UNION ALL SELECT 'part', p_partkey, p_name FROM part
  UNION ALL SELECT 'line', line_no + doc_id * 100000, exact_text FROM found)"""


@query(f"WITH {FOUND}, {_MASKED} SELECT kind, id, x, {MASK.format(x='x')} AS masked FROM names")
def partial_mask(spark, d):
    c, p = table(spark, d, "customer"), table(spark, d, "part")
    email = F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@"), F.lower("c_mktsegment"), F.lit(".example"))
    phone = F.format_string("+1 (%03d) 555-%04d", F.col("c_custkey") % 1000, F.col("c_custkey") % 10000)
    rows = c.select(F.lit("name").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("x"))
    for kind, frame, key, x in (("email", c, "c_custkey", email), ("phone", c, "c_custkey", phone), ("part", p, "p_partkey", F.col("p_name"))):
        rows = rows.unionByName(frame.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), x.alias("x")))
    lines = found(spark, d).select(F.lit("line").alias("kind"), (F.col("line_no") + F.col("doc_id") * 100000).alias("id"), F.col("exact_text").alias("x"))
    return rows.unionByName(lines).withColumn("masked", X.partial_mask(F.col("x")))


_TOKENS = """selected AS (
  SELECT *, coalesce(trim(custom_text), '') = '' AS plain FROM layers WHERE review_decision = 'confirmed' AND enabled AND action <> 'preserve'),
firsts AS (
  SELECT *, min(finding_id || '/' || layer_id) OVER (PARTITION BY doc_id, upper(entity_type), plain, exact_text) AS f FROM selected),
tokens AS (
  SELECT *, CASE WHEN plain THEN printf('%s_%03d', upper(entity_type), dense_rank() OVER (PARTITION BY doc_id, upper(entity_type), plain ORDER BY f)) END AS token
  FROM firsts)"""


def _tokens(spark, d):
    chosen = V.render_selection(layers(spark, d))
    return R.with_tokens(chosen, "doc_id", "entity_type", "exact_text", ["finding_id", "layer_id"])


@query(f"WITH {LAYERS}, {_TOKENS} SELECT finding_id, doc_id, entity_type, exact_text, token FROM tokens")
def pseudonym_tokens(spark, d):
    return _tokens(spark, d).select("finding_id", "doc_id", "entity_type", "exact_text", "token")


_REPLACED = f"""edits AS (
  SELECT doc_id, finding_id, CASE WHEN doc_id % 13 = 0 THEN line_no + 1000000 ELSE line_no END AS named, exact_text,
         CASE WHEN effect = 'partial_mask' THEN {MASK.format(x='exact_text')}
              WHEN effect = 'token_replace' AND NOT plain THEN custom_text
              WHEN effect = 'token_replace' THEN token ELSE '{R.BOX}' END AS replacement
  FROM tokens)"""


@query(
    f"""WITH RECURSIVE {LAYERS}, {_TOKENS}, {_REPLACED},
  sized AS (SELECT doc_id, len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) OR text = '' THEN 1 ELSE 0 END AS n_lines FROM documents),
  own AS (SELECT l.doc_id, l.line_no, e.exact_text, e.replacement, row_number() OVER (PARTITION BY l.doc_id, l.line_no ORDER BY e.finding_id) AS k
    FROM lines l JOIN sized USING (doc_id) JOIN edits e ON e.doc_id = l.doc_id AND (e.named = l.line_no OR e.named > n_lines)),
  n AS (SELECT doc_id, line_no, count(*) AS n_layers FROM own GROUP BY ALL),
  r AS (
    SELECT doc_id, line_no, 0 AS k, text AS redacted FROM lines
    UNION ALL
    SELECT r.doc_id, r.line_no, e.k, replace(r.redacted, e.exact_text, e.replacement)
    FROM r JOIN own e ON e.doc_id = r.doc_id AND e.line_no = r.line_no AND e.k = r.k + 1)
  SELECT l.doc_id, l.line_no, l.line_id, l.text, r.redacted, coalesce(n_layers, 0) AS n_layers
  FROM lines l LEFT JOIN n USING (doc_id, line_no) JOIN r ON r.doc_id = l.doc_id AND r.line_no = l.line_no AND r.k = coalesce(n_layers, 0)"""
)
def redacted_lines(spark, d):
    """Lines after their layers; those of some documents name a line that there is not."""
    edits = R.with_replacement(_tokens(spark, d), "exact_text")
    named = F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit("t"), F.col("line_no") + 1_000_000)).otherwise(F.col("line_id"))
    return R.render_lines(table(spark, d, "documents"), edits.withColumn("line_id", named), "finding_id")


@query(
    f"""WITH {LAYERS} SELECT doc_id, count(*) FILTER (review_decision = 'needs_review') AS n_pending,
      min(CASE WHEN review_decision = 'needs_review' THEN layer_id END) AS first_pending,
      count(*) FILTER (review_decision = 'needs_review') = 0 AS ready FROM layers GROUP BY doc_id"""
)
def pending_gate(spark, d):
    return V.pending_gate(layers(spark, d), "doc_id")


@query(
    f"""WITH {LAYERS} SELECT layer_id, doc_id, entity_type, action, effect FROM layers
      WHERE review_decision = 'confirmed' AND enabled AND action <> 'preserve'"""
)
def render_selection(spark, d):
    return V.render_selection(layers(spark, d)).select("layer_id", "doc_id", "entity_type", "action", "effect")


@query(
    f"""WITH {FOUND}, s AS (SELECT finding_id, doc_id, line_no, instr(line, exact_text) - 1 AS first_at,
        instr(line, exact_text) - 1 + length(exact_text) AS end_at FROM found),
      w AS (SELECT *, lag(end_at) OVER (PARTITION BY doc_id, line_no ORDER BY first_at, end_at, finding_id) AS previous_end FROM s)
      SELECT finding_id, doc_id, line_no, first_at, end_at, previous_end FROM w WHERE previous_end > first_at"""
)
def overlap_violations(spark, d):
    lines = _source_lines(spark, d).select("doc_id", "line_no", "text")
    at = F.instr("text", F.col("exact_text")) - 1
    spans = found(spark, d).join(lines, ["doc_id", "line_no"]).select("finding_id", "doc_id", "line_no", at.alias("first_at"), (at + F.length("exact_text")).alias("end_at"))
    return V.overlap_violations(spans, ["doc_id", "line_no"], "first_at", "end_at", "finding_id")


@query(
    f"""WITH {FOUND}, {rules_sql('gdpr')}, u AS (SELECT entity_type, count(*) AS n_findings FROM found GROUP BY 1),
      o AS (SELECT coalesce(r.entity_type, u.entity_type) AS entity_type, coalesce(r.display_name, u.entity_type) AS display_name,
                   coalesce(n_findings, 0) AS n_findings FROM rules r FULL JOIN u ON u.entity_type = r.entity_type)
      SELECT *, row_number() OVER (ORDER BY lower(display_name), entity_type) AS position FROM o"""
)
def classification_options(spark, d):
    from pyspark.sql import Window

    used = found(spark, d).groupBy(F.col("entity_type").alias("_e")).agg(F.count(F.lit(1)).alias("n"))
    rules = P.rules(spark, "gdpr").select("entity_type", "display_name")
    options = rules.join(used, F.col("entity_type") == F.col("_e"), "full").select(
        F.coalesce("entity_type", "_e").alias("entity_type"),
        F.coalesce("display_name", "_e").alias("display_name"),
        F.coalesce("n", F.lit(0)).alias("n_findings"),
    )  # a few rows a type
    return options.withColumn("position", F.row_number().over(Window.orderBy(X.casefold(F.col("display_name")), "entity_type")))


@query(
    """WITH s AS (SELECT page_id, regexp_split_to_array(html, '\\r\\n|\\r|\\n') AS v FROM pages),
     r AS (SELECT page_id, unnest(range(0, len(v))) AS pos, trim(regexp_replace(unnest(v), '\\s+', ' ', 'g')) AS text FROM s),
     n AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS line_no, text FROM r WHERE text <> ''),
     o AS (SELECT *, (length(text) - length(replace(text, 'the', ''))) // 3 AS n_matches FROM n)
     SELECT page_id, line_no, n_matches,
            coalesce(sum(n_matches) OVER (PARTITION BY page_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS matches_before
     FROM o"""
)
def occurrence_offsets(spark, d):
    """Matches of a text on earlier lines of a page, as a viewer counts them."""
    from pyspark.sql import Window

    rows = L.page_lines(table(spark, d, "pages"), "page_id", "html")
    n = F.regexp_count("text", F.lit("the")).cast("long")
    before = Window.partitionBy("page_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("n_matches", n)
    return rows.select("page_id", "line_no", "n_matches", F.coalesce(F.sum("n_matches").over(before), F.lit(0)).alias("matches_before"))


@query(
    """WITH n AS (SELECT page_id, url, regexp_extract(url, '([^/\\\\]*)$', 1) AS base FROM pages)
     SELECT page_id, coalesce(nullif(trim(regexp_replace(base, '(.)\\.[^.]*$', '\\1')), ''), nullif(trim(base), ''), 'Untitled review') AS title,
            substr(regexp_replace(url, '[^A-Za-z0-9._\\-]+', '_', 'g'), 1, 120) AS stored FROM n"""
)
def file_names(spark, d):
    return table(spark, d, "pages").select("page_id", X.file_stem(F.col("url")).alias("title"), X.safe_filename(F.col("url")).alias("stored"))


@query()
def comparison_texts(spark, d):
    """Projected texts of page lines, with where their first and last characters came from."""
    rows = L.page_lines(table(spark, d, "pages"), "page_id", "html")
    rows = rows.withColumn("p", M.comparison_ends("text"))
    return rows.select("page_id", "line_no", F.col("p.text").alias("projected"), "p.first_at", "p.end_at")


@query()
def docx_locators(spark, d):
    """The middle of each line located in its projected line: null unless it occurs once."""
    rows = _source_lines(spark, d)
    part = F.substring("text", (F.length("text") / 3).cast("int") + 1, (F.length("text") / 3).cast("int"))
    rows = rows.withColumn("span", M.unique_span("text", F.upper(part)))
    return rows.select("doc_id", "line_no", F.col("span.start").alias("start_at"), F.col("span.end").alias("end_at"))
