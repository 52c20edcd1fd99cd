"""Queries over blocks, projections and decision tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators import blocks as K
from palimpsest.operators import lines as L
from palimpsest.operators import projection as J
from palimpsest.plans.base import FOUND, LAYERS, LINES, found, layers, query, rules_sql
from palimpsest.plans.base import source_lines as _source_lines
from palimpsest.plans.text_queries import _BATCHES, BATCH_LIMIT
from palimpsest.session import table

PART, STORY = "/word/document.xml", "body"

_BLOCKS = (
    LINES
    + f""", blocks AS (
  SELECT l.doc_id, row_number() OVER (PARTITION BY l.doc_id ORDER BY line_no) - 1 AS ordinal, l.line_no, l.text,
         'b_' || sha256(concat_ws(chr(0), sha256(d.text), '{PART}', '{STORY}', 'document[0]/body[0]/p[' || (line_no - 1) || ']')) AS block_id
  FROM lines l JOIN documents d USING (doc_id))"""
)


def _blocks(spark, d, whole=False, of=None):
    """Blocks of all documents, or of those of ``of`` (doc_id, text); ``whole``: dealt by doc_id as whole texts,
    before they are cut."""
    docs = table(spark, d, "documents") if of is None else of
    docs = (docs.select("doc_id", "text").repartition("doc_id") if whole else docs).withColumn("sha", F.sha2("text", 256))
    each = docs.select("doc_id", "sha", F.posexplode(F.split("text", X.LINE_END, -1)).alias("pos", "text")).where(~X.is_blank(F.col("text")))
    path = F.concat(F.lit("document[0]/body[0]/p["), F.col("pos"), F.lit("]"))
    ordinal = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1
    return each.select(
        "doc_id", ordinal.alias("ordinal"), (F.col("pos") + 1).alias("line_no"), "text", K.block_id(F.col("sha"), F.lit(PART), F.lit(STORY), path).alias("block_id")
    )


@query(f"WITH {_BLOCKS} SELECT doc_id, ordinal, block_id, text FROM blocks")
def docx_blocks(spark, d):
    return _blocks(spark, d).select("doc_id", "ordinal", "block_id", "text")


@query(_BATCHES.format(extra="98"))
def docx_batches(spark, d):
    """Block batches: a block costs its text, its id and an overhead."""
    size = F.octet_length("text") + F.octet_length("block_id") + K.BLOCK_OVERHEAD
    return L.batches(_blocks(spark, d).select("doc_id", "line_no", size.alias("cost")), BATCH_LIMIT)


@query(
    f"""WITH {_BLOCKS} SELECT doc_id, count(*) AS n_blocks, sum(length(b.text))::BIGINT AS characters,
      min(ordinal) = 0 AND max(ordinal) = count(*) - 1 AS contiguous, count(DISTINCT block_id) = count(*) AS unique_ids,
      sum(length(b.text)) = any_value(length(replace(d.text, chr(10), ''))) AS complete FROM blocks b JOIN documents d USING (doc_id) GROUP BY doc_id"""
)
def docx_inspection(spark, d):
    told = table(spark, d, "documents").select("doc_id", F.length(F.replace("text", F.lit("\n"), F.lit(""))).alias("told"))
    return K.inspection(_blocks(spark, d).join(told, "doc_id"), "doc_id", F.col("told"))


_RANGES = f"""{_BLOCKS}, {FOUND.removeprefix(LINES + ', ')}, r AS (
  SELECT b.block_id, instr(b.text, f.exact_text) - 1 AS s, f.exact_text, '<' || f.entity_type || '>' AS replacement, f.doc_id % 17 > 0 AS ok
  FROM found f JOIN blocks b ON b.doc_id = f.doc_id AND b.line_no = f.line_no
  WHERE instr(substr(b.text, instr(b.text, f.exact_text) + 1), f.exact_text) = 0),
ranges AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY s DESC, length(exact_text) DESC, exact_text DESC, replacement DESC) AS k FROM r WHERE ok),
stale AS (SELECT block_id, count(*) AS n_stale FROM r WHERE NOT ok GROUP BY 1)"""


@query(
    f"""WITH RECURSIVE {_RANGES}, n AS (SELECT block_id, count(*) AS n FROM ranges GROUP BY 1),
  f AS (SELECT block_id, text AS rendered, 0 AS k FROM blocks
    UNION ALL SELECT f.block_id, substr(f.rendered, 1, r.s) || r.replacement || substr(f.rendered, r.s + length(r.exact_text) + 1), r.k
    FROM f JOIN ranges r ON r.block_id = f.block_id AND r.k = f.k + 1)
  SELECT f.block_id, f.rendered, coalesce(n_stale, 0) AS n_stale FROM f LEFT JOIN n USING (block_id) LEFT JOIN stale USING (block_id) WHERE f.k = coalesce(n.n, 0)"""
)
def docx_render(spark, d):
    """Blocks with their ranges replaced; ranges of some documents name another story and are left out."""
    blocks = _blocks(spark, d).withColumn("story", F.lit(STORY))
    hits = found(spark, d).join(blocks.select("doc_id", "line_no", "block_id", F.col("text").alias("_t")), ["doc_id", "line_no"])
    start = X.unique_offset(F.col("_t"), F.col("exact_text"))
    ranges = hits.select(
        "block_id", start.alias("start"), (start + F.length("exact_text")).alias("end"), "exact_text",
        F.concat(F.lit("<"), "entity_type", F.lit(">")).alias("replacement"), F.when(F.col("doc_id") % 17 > 0, STORY).otherwise("header").alias("story"),
    ).where("start IS NOT NULL")
    return K.replace_ranges(blocks, ranges, "block_id", ("story",)).select("block_id", "rendered", "n_stale")


_MEDIA = ["image/png", "IMAGE/JPEG", "image/tiff", "image/x-emf", ""]


@query(
    f"""WITH p AS (SELECT l_orderkey, CASE WHEN l_partkey % 19 = 0 THEN l_linenumber % 2 * 2 ELSE 1 END AS pictures, CASE WHEN l_suppkey % 23 = 0 THEN 2 ELSE 1 END AS fills,
        CASE WHEN l_partkey % 29 = 0 THEN 0 ELSE 1 END AS shapes, CASE WHEN l_partkey % 31 = 0 THEN 2 ELSE 1 END AS properties,
        CASE WHEN l_partkey % 7 = 0 THEN 'http://x' END AS link, CASE WHEN l_partkey % 11 = 0 THEN ' ' ELSE 'rId1' END AS embed,
        CASE WHEN l_partkey % 13 > 0 THEN {_MEDIA!r}[1 + l_suppkey % 5] END AS media FROM lineitem),
      r AS (SELECT *, CASE WHEN pictures = 0 THEN 'unsupported_drawing_type' WHEN pictures > 1 OR shapes <> 1 THEN 'unsupported_picture_container' WHEN fills <> 1 THEN 'unsupported_drawing_type'
          WHEN link <> '' THEN 'external_image' WHEN trim(embed) = '' THEN 'missing_image_relationship' WHEN properties <> 1 THEN 'unsupported_picture_container'
          WHEN media IS NULL THEN 'missing_image_relationship' WHEN media = '' THEN 'relationship_is_not_an_image'
          WHEN lower(media) NOT IN ('image/png', 'image/jpeg', 'image/gif', 'image/bmp', 'image/tiff') THEN 'unsupported_image_format' END AS reason FROM p)
      SELECT l_orderkey, count(*) FILTER (reason IS NULL) AS n_targetable, count(*) FILTER (reason IS NOT NULL) AS n_unsupported,
             string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM r GROUP BY 1"""
)
def picture_targets(spark, d):
    part, one = F.col("l_partkey"), F.lit(1)
    media = F.when(part % 13 > 0, F.get(F.array(*[F.lit(m) for m in _MEDIA]), (F.col("l_suppkey") % 5).cast("int")))
    reason = K.unsupported_reason(
        F.when(part % 19 == 0, F.col("l_linenumber") % 2 * 2).otherwise(1), F.when(F.col("l_suppkey") % 23 == 0, 2).otherwise(1), one,
        F.when(part % 29 == 0, 0).otherwise(1), one, F.when(part % 31 == 0, 2).otherwise(1), F.when(part % 7 == 0, "http://x"),
        F.when(part % 11 == 0, " ").otherwise("rId1"), media,
    )
    per = table(spark, d, "lineitem").withColumn("reason", reason).groupBy("l_orderkey").agg(
        F.count_if(F.col("reason").isNull()).alias("n_targetable"),
        F.count_if(F.col("reason").isNotNull()).alias("n_unsupported"),
        F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"),
    )
    return per.withColumn("reasons", F.nullif("reasons", F.lit("")))


@query(
    """WITH c AS (SELECT l_orderkey, l_linenumber, 50 + l_partkey % 900 AS w, 40 + l_suppkey % 70 AS h, (l_suppkey * 997) % 60000 AS l, (l_partkey * 131) % 50000 AS r, (l_partkey * 17) % 100001 AS t, l_suppkey % 3 * 2500 AS b FROM lineitem),
      e AS (SELECT *, round_even(w * l / 100000, 0)::BIGINT AS x0, round_even(h * t / 100000, 0)::BIGINT AS y0, w - round_even(w * r / 100000, 0)::BIGINT AS x1, h - round_even(h * b / 100000, 0)::BIGINT AS y1 FROM c)
      SELECT l_orderkey, l_linenumber, x0 AS crop_left, y0 AS crop_top, x1 AS crop_right, y1 AS crop_bottom FROM e WHERE l + r < 100000 AND t + b < 100000 AND x1 > x0 AND y1 > y0"""
)
def picture_crops(spark, d):
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    box = K.crop_box(50 + part % 900, 40 + supp % 70, (supp * 997) % 60000, (part * 17) % 100_001, (part * 131) % 50000, supp % 3 * 2500)
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", box.alias("c")).where("c IS NOT NULL")
    return rows.select("l_orderkey", "l_linenumber", *[F.col(f"c.{side}").alias(f"crop_{side}") for side in ("left", "top", "right", "bottom")])


@query(
    """WITH q AS (SELECT l_orderkey, l_linenumber, 100 + l_partkey % 400 AS xa, 100 + l_suppkey % 500 AS ya, 100 + l_partkey % 400 + l_quantity * 4 AS xb, 100 + l_suppkey % 500 + l_discount * 90 AS yb,
        100 + l_partkey % 400 + l_quantity * 4 - l_tax * 80 AS xc, 150 + l_suppkey % 500 + l_discount * 90 + l_quantity AS yc, 100 + l_partkey % 400 - l_tax * 80 AS xd, 150 + l_suppkey % 500 + l_quantity AS yd FROM lineitem),
      s AS (SELECT *, sqrt((xc - xd) ** 2 + (yc - yd) ** 2) / 612 AS w, sqrt((xa - xd) ** 2 + (ya - yd) ** 2) / 792 AS h, (xa + xb + xc + xd) / 4 / 612 AS cx, (792 - (ya + yb + yc + yd) / 4) / 792 AS cy,
        -degrees(atan2(yc - yd, xc - xd)) AS turn FROM q)
      SELECT l_orderkey, l_linenumber, round(greatest(0, least(cx - w / 2, 1 - w)), 6) AS x, round(greatest(0, least(cy - h / 2, 1 - h)), 6) AS y, round(least(w, 1), 6) AS width, round(least(h, 1), 6) AS height,
        round((turn + 180) - 360 * floor((turn + 180) / 360) - 180, 6) AS rotation FROM s WHERE w > 0 AND h > 0"""
)
def picture_placements(spark, d):
    """Pictures on a page of 612 by 792 points."""
    xa, ya = 100 + F.col("l_partkey") % 400, 100 + F.col("l_suppkey") % 500
    across, rise, lean, up = F.col("l_quantity") * 4, F.col("l_discount") * 90, F.col("l_tax") * 80, 50 + F.col("l_quantity")
    corners = [(xa, ya), (xa + across, ya + rise), (xa + across - lean, ya + rise + up), (xa - lean, ya + up)]
    placed = K.quad_placement(corners, F.lit(612.0), F.lit(792.0))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.inline(F.array(placed))).where("x IS NOT NULL")
    return rows.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in ("x", "y", "width", "height", "rotation")])


@query(
    f"""WITH {LAYERS}, o AS (SELECT *, instr(line, exact_text) - 1 AS s, '#' || printf('%06d', doc_id) AS colour FROM layers)
      SELECT layer_id, '{{"layer_id":"' || layer_id || '","entity_type":"' || entity_type || '","action":"' || action || '","effect":"' || effect || '","fill_color":'
        || CASE WHEN effect = 'box' THEN '"' || colour || '"' ELSE 'null' END || ',"target":{{"line_id":"' || line_id || '","start":' || s || ',"end":' || (s + length(exact_text)) || '}}}}' AS audit
      FROM o"""
)
def audit_projection(spark, d):
    lines = _source_lines(spark, d).select("doc_id", "line_no", "text")
    start = F.instr("text", F.col("exact_text")) - 1
    rows = layers(spark, d).join(lines, ["doc_id", "line_no"]).withColumns(
        {"start": start, "end": start + F.length("exact_text"), "fill_color": F.concat(F.lit("#"), F.format_string("%06d", "doc_id"))}
    )
    return rows.select("layer_id", J.audit_projection(rows).alias("audit"))


@query(f"WITH {FOUND}, {rules_sql('gdpr')} SELECT finding_id, coalesce(r.entity_type, 'unknown') AS safe_type FROM found f LEFT JOIN rules r ON r.entity_type = f.entity_type")
def safe_entity_types(spark, d):
    return J.safe_entity_type(found(spark, d), "entity_type", "gdpr").select("finding_id", "safe_type")


@query(
    """WITH e AS (SELECT event_id, ['document', 'image', 'audio'][1 + event_id % 3] AS kind, ['text', 'fixed', 'word_processing'][1 + event_id % 5 % 3] AS layout,
        ['uploaded', 'review_ready', 'error'][1 + user_id % 3] AS status, ['completed', 'failed', 'cancelled'][1 + event_id % 7 % 3] AS outcome FROM events)
      SELECT event_id, CASE WHEN kind = 'audio' THEN 'audio' WHEN kind = 'image' OR layout = 'fixed' THEN 'image' ELSE 'text' END AS prompt,
        CASE WHEN outcome = 'completed' OR status = 'review_ready' THEN 'review_ready' WHEN outcome = 'failed' THEN 'error' ELSE 'cancelled' END AS status_after FROM e"""
)
def session_decisions(spark, d):
    pick = lambda names, n: F.get(F.array(*[F.lit(x) for x in names.split()]), n.cast("int"))
    e = F.col("event_id")
    prompt = J.prompt_route(pick("document image audio", e % 3), pick("text fixed word_processing", e % 5 % 3))
    after = J.status_after(pick("uploaded review_ready error", F.col("user_id") % 3), pick("completed failed cancelled", e % 7 % 3))
    return table(spark, d, "events").select("event_id", prompt.alias("prompt"), after.alias("status_after"))


@query(
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ['document', 'image', 'audio', 'document'][1 + l_suppkey % 4] AS source_kind, ['text', 'fixed', 'word_processing'][1 + l_partkey % 3] AS layout,
        ['document', 'image', 'audio', 'document', 'image'][1 + l_linenumber % 5] AS target_kind, ['file', 'page', 'picture'][1 + (l_partkey + l_suppkey) % 3] AS surface, l_partkey % 12 AS page, l_suppkey % 9 AS pages,
        CASE WHEN l_partkey % 4 = 0 THEN 'docx' ELSE 'text' END AS locator, l_quantity AS e, 40.0::DOUBLE AS duration, (l_suppkey % 10)::VARCHAR AS exact FROM lineitem),
      j AS (SELECT t.*, p_size % 4 > 0 AS targetable, contains(s_name, exact) AS held, contains(p_name, exact) AS located FROM t LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey)
      SELECT l_orderkey, l_linenumber, CASE
        WHEN target_kind = 'image' THEN CASE WHEN source_kind = 'image' AND surface = 'file' THEN NULL
          WHEN source_kind = 'document' AND layout = 'fixed' AND surface = 'page' THEN CASE WHEN page > pages THEN 'pdf_page_out_of_range' END
          WHEN source_kind = 'document' AND layout = 'word_processing' AND surface = 'picture' THEN CASE WHEN NOT coalesce(targetable, false) THEN 'docx_picture_target_invalid' END
          ELSE 'image_surface_mismatch' END
        WHEN target_kind <> source_kind THEN 'kind_mismatch'
        WHEN target_kind = 'document' THEN CASE WHEN layout = 'fixed' THEN 'pdf_requires_visual_target' WHEN locator <> CASE WHEN layout = 'text' THEN 'text' ELSE 'docx' END THEN 'source_format_mismatch'
          WHEN layout = 'text' AND NOT coalesce(held, false) THEN 'exact_text_not_found' WHEN layout = 'word_processing' AND NOT coalesce(located, false) THEN 'invalid_docx_text_target' END
        WHEN e > duration THEN 'range_beyond_end' END AS reason FROM j"""
)
def target_validity(spark, d):
    """Targets against their sources; parts stand in for pictures, and names for the texts of lines."""
    pick = lambda names, n: F.get(F.array(*[F.lit(x) for x in names.split()]), n.cast("int"))
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", (supp % 10).cast("string").alias("exact"))
    pictures = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") % 4 > 0).alias("targetable"), "p_name")
    lines = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    met = rows.join(pictures, "l_partkey", "left").join(lines, "l_suppkey", "left")
    reason = J.target_reason(
        {
            "source_kind": pick("document image audio document", supp % 4), "layout": pick("text fixed word_processing", part % 3), "page_count": supp % 9, "duration": F.lit(40.0),
            "target_kind": pick("document image audio document image", F.col("l_linenumber") % 5), "surface": pick("file page picture", (part + supp) % 3), "page": part % 12,
            "locator": F.when(part % 4 == 0, "docx").otherwise("text"), "end_time": F.col("l_quantity"), "occurrence_targetable": F.col("targetable"),
            "line_holds_text": F.col("s_name").contains(F.col("exact")), "locator_valid": F.col("p_name").contains(F.col("exact")),
        }
    )
    return met.select("l_orderkey", "l_linenumber", reason.alias("reason"))


@query(
    """SELECT page_id, sha256(html) AS sha256, sha256(html) || '-' || substr(regexp_replace(url, '[^A-Za-z0-9._\\-]+', '_', 'g'), 1, 120) AS stored_as, strlen(html) AS bytes FROM pages"""
)
def file_descriptors(spark, d):
    pages = table(spark, d, "pages")
    return pages.select("page_id", J.descriptor(F.sha2("html", 256), F.col("url"), F.octet_length("html").cast("long")).alias("f")).select("page_id", "f.*")


@query(
    f"""WITH {FOUND}, g AS (SELECT sha256(text) AS sha, doc_id AS occurrence, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_doc FROM documents)
      SELECT f.finding_id || '@' || g.occurrence AS finding_id, g.occurrence, f.entity_type FROM found f JOIN g ON g.first_doc = f.doc_id"""
)
def fanned_out_findings(spark, d):
    """One analysis for each distinct text, its findings for every copy."""
    docs = table(spark, d, "documents").select(F.sha2("text", 256).alias("sha"), "doc_id")
    groups = docs.groupBy("sha").agg(F.min("doc_id").alias("first_doc"))
    members = docs.join(groups, "sha").select("first_doc", F.col("doc_id").alias("occurrence"))
    return J.fan_out(found(spark, d).withColumnRenamed("doc_id", "first_doc"), members, "first_doc").select("finding_id", "occurrence", "entity_type")


@query(
    """SELECT l_orderkey, l_partkey % 20 AS part_group, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1"""
)
def duplicate_keys(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", (F.col("l_partkey") % 20).alias("part_group"))
    return rows.agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(
    """SELECT c_custkey, 'no_orders' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
       UNION ALL SELECT * FROM (SELECT DISTINCT o_custkey, 'unknown_customer' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))
       UNION ALL SELECT * FROM (SELECT c_custkey, 'both' FROM customer INTERSECT SELECT o_custkey, 'both' FROM orders)"""
)
def set_differences(spark, d):
    known, asked = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return (
        known.join(asked, "c_custkey", "left_anti").withColumn("side", F.lit("no_orders"))
        .unionByName(asked.join(known, "c_custkey", "left_anti").distinct().withColumn("side", F.lit("unknown_customer")))
        .unionByName(known.intersect(asked).withColumn("side", F.lit("both")))
    )


@query(
    """WITH e AS (SELECT event_id, user_id, value, count(*) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS done FROM events)
      SELECT event_id, round(0.15 + 0.45 * done / total, 9) AS progress, greatest(round_even((value - 20) * 1000, 0)::BIGINT, 0) AS duration_ms FROM e"""
)
def analysis_progress(spark, d):
    user = Window.partitionBy("user_id")
    rows = table(spark, d, "events").withColumns({"total": F.count(F.lit(1)).over(user), "done": F.row_number().over(user.orderBy("event_id"))})
    return rows.select(
        "event_id", F.round(J.progress(F.col("done"), F.col("total")), 9).alias("progress"), J.duration_ms(F.lit(20.0), F.col("value")).alias("duration_ms")
    )


@query(
    f"""WITH {LINES}, p AS (SELECT doc_id, '{{"lines":[' || string_agg('{{"line_id":"' || line_id || '","text":' || to_json(text) || '}}', ',' ORDER BY line_no) || ']}}' AS payload,
        count(*) AS n_lines, sum(length(text))::BIGINT AS n_chars FROM lines GROUP BY doc_id)
      SELECT doc_id, n_lines, n_chars, strlen(payload) AS payload_bytes, sha256(payload) AS payload_sha256 FROM p"""
)
def request_summaries(spark, d):
    """Payload of a whole document as one request: its size, lines, characters and digest."""
    row = F.struct("line_no", F.struct("line_id", "text").alias("line"))
    per = _source_lines(spark, d).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(row)).alias("rows"), F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("text")).alias("n_chars")
    )
    payload = F.to_json(F.struct(F.transform("rows", lambda r: r["line"]).alias("lines")))
    return per.select("doc_id", "n_lines", "n_chars", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"))


@query(
    """WITH s AS (SELECT page_id, regexp_split_to_array(html, '\\r\\n|\\r|\\n') AS v FROM pages),
     r AS (SELECT page_id, unnest(range(0, len(v))) AS pos, trim(regexp_replace(unnest(v), '\\s+', ' ', 'g')) AS text FROM s),
     n AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS line_no, replace(text, ' ', '') AS t FROM r WHERE text <> ''),
     o AS (SELECT *, coalesce(sum(length(t)) OVER (PARTITION BY page_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS starts_at FROM n)
     SELECT page_id, line_no, starts_at, starts_at + length(t) AS ends_at FROM o"""
)
def page_projection(spark, d):
    """Where each line lies in its page's text without spaces: which character is whose."""
    rows = L.page_lines(table(spark, d, "pages"), "page_id", "html").withColumn("n", F.length(F.replace("text", F.lit(" "), F.lit(""))))
    before = Window.partitionBy("page_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(before), F.lit(0))
    return rows.select("page_id", "line_no", start.alias("starts_at"), (start + F.col("n")).alias("ends_at"))


_STORIES = ["header", "body", "endnotes", "body", "footer", "comments", "footnotes"]


@query(
    f"""WITH {LINES}, p AS (SELECT l.doc_id, sha256(d.text) AS sha, l.line_no, l.text, {_STORIES!r}[1 + l.line_no % 7] AS story, l.line_no % 3 AS k FROM lines l JOIN documents d USING (doc_id)),
      q AS (SELECT *, CASE WHEN story IN ('header', 'footer') THEN '/word/' || story || k || '.xml' ELSE '/word/' || story || '.xml' END AS part, 'p[' || (line_no - 1) || ']' AS path,
        list_position(['body', 'header', 'footer', 'footnotes', 'endnotes'], story) AS rank FROM p WHERE story <> 'comments')
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rank, part, line_no) - 1 AS ordinal, story, part, 'b_' || sha256(concat_ws(chr(0), sha, part, story, path)) AS block_id FROM q"""
)
def docx_stories(spark, d):
    """Lines as paragraphs of several stories, in the order in which these are read."""
    story = F.get(F.array(*[F.lit(x) for x in _STORIES]), (F.col("line_no") % 7).cast("int"))
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    rows = _source_lines(spark, d).join(docs, "doc_id").withColumn("story", story)
    several = F.when(F.col("story").isin("header", "footer"), (F.col("line_no") % 3).cast("string")).otherwise("")
    part = F.concat(F.lit("/word/"), "story", several, F.lit(".xml"))
    rows = rows.select("doc_id", "sha", "story", part.alias("part"), F.concat(F.lit("p["), F.col("line_no") - 1, F.lit("]")).alias("path"), F.col("line_no").alias("nth"))
    return K.story_blocks(rows, "doc_id").select("doc_id", "ordinal", "story", "part", "block_id")


@query(
    """WITH t AS (SELECT l_orderkey, l_linenumber, ['document', 'image', 'audio'][1 + l_partkey % 3] AS kind, l_suppkey AS n, l_partkey AS m FROM lineitem)
      SELECT l_orderkey, l_linenumber, CASE kind WHEN 'document' THEN '{"kind":"document","line_id":"t' || n || '","start":' || CASE WHEN m % 2 = 0 THEN m::VARCHAR ELSE 'null' END || ',"end":' || CASE WHEN m % 2 = 0 THEN (m + 4)::VARCHAR ELSE 'null' END || '}'
        WHEN 'image' THEN '{"kind":"image","page":' || n || ',"x":' || m || ',"y":' || n || ',"width":7,"height":9,"rotation_degrees":' || (m % 180) || '}' ELSE '{"kind":"audio","start_time":' || n || ',"end_time":' || (n + m) || '}' END AS target FROM t"""
)
def audit_targets(spark, d):
    """Targets of all kinds without their contents."""
    n, m = F.col("l_suppkey"), F.col("l_partkey")
    kind = F.get(F.array(F.lit("document"), F.lit("image"), F.lit("audio")), (m % 3).cast("int"))
    unique = lambda c: F.when(m % 2 == 0, c)
    fields = {
        "line_id": F.concat(F.lit("t"), n), "start": unique(m), "end": unique(m + 4), "page": n, "x": m, "y": n, "width": F.lit(7), "height": F.lit(9), "rotation_degrees": m % 180, "start_time": n, "end_time": n + m,
    }
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", J.audit_target(kind, fields).alias("target"))
