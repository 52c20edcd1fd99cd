"""Personal data: pattern matches, and terms that give them away.

Information-theoretic sanitisation. Patterns find e-mail addresses, IP addresses, card and phone
numbers; each distinct value is a protected entity. The corpus then says which terms reveal an
entity: with n documents of which n(e) mention the entity, n(t) hold the term and n(t, e) do both,
the pointwise mutual information log(n * n(t, e) / (n(t) * n(e))) is at most the entity's
information content log(n / n(e)), and their ratio is the share of the entity that the term
discloses. Terms are words outside of e-mail addresses, anywhere in a document. Every occurrence of a
disclosing term in the documents that mention the entity is a span: above ``GENERALISE`` it is
replaced by its initial and its class, above ``CLASS`` by its class, above ``REMOVE`` it goes. Two
documents at least have to agree on a term.

All steps are DataFrame functions. Only documents with a match are written once for the later steps;
of all others nothing is kept but (term hash, documents) counts, combined on the map side. A term
that more documents hold than could leave it the ratio is dropped before it meets the entities.

Defined cases: a null text counts as empty and gives no spans; rows that repeat an id are kept
apart by their text and equal ones count once as evidence; a null id is kept; an empty table gives
an empty result; other columns are not read by ``find`` and returned as they were by ``sanitise``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.columns import numbered
from palimpsest.session import stored

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Possessive repeats and look-behinds keep the scan linear on long runs; the matches are the same.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without it holds no match.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
WORD = r"\p{L}+"
LEAST_DOCUMENTS = 2
GENERALISE, CLASS, REMOVE = 0.8, 0.875, 0.95


def _valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(kind == "ip", value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
        .when(kind == "card", (n >= 14) & (n <= 19) & F.call_function("luhn_check", digits))
        .when(kind == "phone", (n >= 10) & (n <= 15))
        .otherwise(True)
    )


def _entity(kind: Column, value: Column) -> Column:
    return F.when(kind.isin("card", "phone"), F.regexp_replace(value, "[^0-9]", "")).otherwise(F.lower(value))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))


def _hits(rows: DataFrame) -> DataFrame:
    """The documents with a match of any pattern, valid or not: doc_id, key, text, and the values by kind."""
    found = [F.when(F.col("text").contains(NEEDS[k]), F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0))).alias(k) for k in KINDS]
    return rows.select("*", *found).where(reduce(lambda a, b: a | b, [F.size(k) > 0 for k in KINDS])).dropDuplicates(["doc_id", "key"])


def matches(hits: DataFrame) -> DataFrame:
    """Valid matches: doc_id, key, kind, entity, first, last."""
    by_kind = F.array(
        *[
            F.struct(
                F.lit(k).alias("kind"),
                F.col(k).alias("values"),
                F.when(F.size(k) > 0, F.split("text", PATTERNS[k], -1)).alias("pieces"),
            )
            for k in KINDS
        ]
    )
    each = hits.select("doc_id", "key", F.explode(by_kind).alias("m")).where("size(m.values) > 0")
    # Pieces lie between the matches, so their lengths add up to positions.
    value = F.transform("m.values", lambda v, k: F.struct(v.alias("value"), F.length(F.get("m.pieces", k)).alias("gap")))
    each = each.select("doc_id", "key", "m.kind", F.posexplode(value).alias("nth", "v"))
    order = "PARTITION BY doc_id, key, kind ORDER BY nth ROWS UNBOUNDED PRECEDING"
    placed = each.withColumn("last", F.expr(f"sum(v.gap + length(v.value)) OVER ({order})"))
    return placed.where(_valid(F.col("kind"), F.col("v.value"))).select(
        "doc_id",
        "key",
        "kind",
        _entity(F.col("kind"), F.col("v.value")).alias("entity"),
        (F.col("last") - F.length("v.value")).alias("first"),
        "last",
    )


def _masked(text: Column) -> Column:
    """The text with blanks for its e-mail addresses, which are no terms."""
    values, pieces = F.regexp_extract_all(text, F.lit(PATTERNS["email"]), F.lit(0)), F.split(text, PATTERNS["email"], -1)
    blank = lambda piece, value: F.concat(piece, F.coalesce(F.repeat(F.lit(" "), F.length(value)), F.lit("")))
    return F.when(text.contains("@"), F.array_join(F.zip_with(pieces, values, blank), "")).otherwise(text)


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(_masked(text)), F.lit(WORD), F.lit(0)))


def disclosing_terms(rows: DataFrame, hits: DataFrame, found: DataFrame) -> DataFrame:
    """kind, entity, term and the share of the entity that the term discloses, from GENERALISE on.

    ``rows``: all documents; ``hits``: those with a match; ``found``: the matches.
    """
    total = rows.count()
    document = ["doc_id", "key"]
    mentions = found.select(*document, "kind", "entity").distinct()
    common = mentions.groupBy("kind", "entity").agg(F.count(F.lit(1)).alias("n_e")).where(F.col("n_e") >= LEAST_DOCUMENTS)
    mentions = stored(mentions.join(common, ["kind", "entity"]), "pii-mentions")
    held = rows.select(F.explode(_terms(F.col("text"))).alias("term")).select(F.xxhash64("term").alias("h"))
    held = held.groupBy("h").agg(F.count(F.lit(1)).alias("n_t"))
    most = mentions.groupBy(*document).agg(F.max("n_e").alias("most"))
    own = hits.select(*document, "text").join(most, document).select(*document, "most", F.explode(_terms(F.col("text"))).alias("term"))
    own = own.withColumn("h", F.xxhash64("term")).join(held, "h")
    # n(t, e) <= n(e), so a ratio r asks for n(t) <= n(e) * (n / n(e)) ** (1 - r).
    bound = F.col("most") * F.pow(F.lit(float(total)) / F.col("most"), F.lit(1.0 - GENERALISE)) * 1.001
    own = own.where(F.col("n_t") <= bound).select(*document, "term", "n_t")
    met = mentions.join(own, document).groupBy("kind", "entity", "n_e", "term", "n_t").agg(F.count(F.lit(1)).alias("n_te"))
    content = F.log2(F.lit(float(total)) / F.col("n_e"))
    shared = F.log2(F.lit(float(total)) * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
    ratio = F.when(content > 0, F.least(shared / content, F.lit(1.0))).otherwise(0.0)
    met = met.where(F.col("n_te") >= LEAST_DOCUMENTS).select("kind", "entity", "term", ratio.alias("disclosed"))
    risky = met.where(F.col("disclosed") >= GENERALISE)
    return mentions.join(risky, ["kind", "entity"]).groupBy(*document, "term").agg(F.max("disclosed").alias("disclosed"))


def _places(hits: DataFrame, risky: DataFrame) -> DataFrame:
    """doc_id, key, first, last, disclosed of every occurrence of a document's disclosing terms."""
    document = ["doc_id", "key"]
    some = hits.select(*document, "text").join(risky.select(*document).distinct(), document, "left_semi")
    some = some.select(*document, _masked(F.col("text")).alias("text"))
    words, gaps = F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.split("text", WORD, -1)
    each = some.select(*document, F.posexplode(F.arrays_zip(words.alias("w"), F.transform(gaps, lambda g: F.length(g)).alias("gap"))).alias("nth", "z"))
    order = "PARTITION BY doc_id, key ORDER BY nth ROWS UNBOUNDED PRECEDING"
    each = each.where("z.w IS NOT NULL").select(
        *document, F.lower("z.w").alias("term"), F.length("z.w").alias("n"), F.expr(f"sum(z.gap + length(z.w)) OVER ({order})").alias("last")
    )
    return each.join(risky, [*document, "term"]).select(*document, (F.col("last") - F.col("n")).alias("first"), "last", "disclosed")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All spans: doc_id, key, kind, rank of the kind, first, last, action."""
    rows = _keyed(docs, id_col, text_col)
    hits = stored(_hits(rows), "pii-hits")
    found = stored(matches(hits), "pii-matches")
    risky = stored(disclosing_terms(rows, hits, found), "pii-terms")
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    base = found.select("doc_id", "key", "kind", rank.alias("rank"), "first", "last", F.lit("replace").alias("action"))
    share = F.col("disclosed")
    action = F.when(share >= REMOVE, "remove").when(share >= CLASS, "class").otherwise("initial")
    terms = _places(hits, risky).select("doc_id", "key", F.lit(TERM).alias("kind"), F.lit(len(KINDS) + 1).alias("rank"), "first", "last", action.alias("action"))
    return base.unionByName(terms)


def _per_document(all_spans: DataFrame) -> DataFrame:
    one = F.struct("first", "rank", "kind", "last", "action")
    return all_spans.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(one)).alias("spans"))


def _joined(spans_: Column) -> Column:
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["first"], s["last"])), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms."""
    per = _per_document(spans(docs, id_col, text_col)).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "spans")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    every = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"))
    met = every.join(per, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    none = F.array().cast(T.ArrayType(per.schema["spans"].dataType.elementType))
    met = met.withColumn("spans", F.coalesce("spans", none))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != TERM)
    return met.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        count(TERM).alias("n_terms"),
    )


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with matches replaced by their kind, disclosing terms by their initial and [TERM], by
    [TERM] alone or by nothing.

    Where spans overlap, the first one counts.
    """
    per = _per_document(spans(docs, id_col, text_col)).select(F.col("doc_id").alias("span_id"), F.col("key").alias("span_key"), "spans")
    own = numbered(docs)
    name = own.columns[docs.columns.index(text_col)]
    text = F.col(name).cast("string")
    same = F.col(own.columns[docs.columns.index(id_col)]).cast("long").eqNullSafe(F.col("span_id")) & (
        F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("span_key")
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    kind = lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
    initial = lambda s: F.substring(text, (s["first"] + 1).cast("int"), F.lit(1))
    put = lambda s: F.when(s["action"] == "remove", "").when(s["action"] == "initial", F.concat(initial(s), kind(s))).otherwise(kind(s))
    step = lambda a, s: F.when(
        s["first"] >= a["at"],
        F.struct(
            s["last"].cast("long").alias("at"),
            F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (s["first"] - a["at"]).cast("int")), put(s)).alias("out"),
        ),
    ).otherwise(a)
    clean = F.aggregate("spans", start, step, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    met = own.join(per, same, "left")
    return met.select(*[F.when(F.col("spans").isNull(), text).otherwise(clean).alias(c) if c == name else F.col(c) for c in own.columns]).toDF(*docs.columns)


def _oracle() -> str:
    """The query in DuckDB's SQL, whose patterns need no look-behinds."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    hits = " UNION ALL ".join(
        f"SELECT doc_id, '{kind}' AS kind, {rank} AS rank, regexp_extract_all(t, '{p}') AS ms, regexp_split_to_array(t, '{p}') AS ps FROM d"
        for rank, (kind, p) in enumerate(plain.items(), 1)
    )
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
hits AS ({hits}),
each AS (SELECT doc_id, kind, rank, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM hits WHERE len(ms) > 0),
placed AS (
  SELECT *, ms[i] AS v, regexp_replace(ms[i], '[^0-9]', '', 'g') AS digits,
         list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s
  FROM each),
valid AS (
  SELECT * FROM placed WHERE CASE kind
    WHEN 'ip' THEN list_max(list_transform(string_split(v, '.'), lambda x: coalesce(try_cast(x AS HUGEINT), 256))) <= 255
    WHEN 'card' THEN length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda k:
      CASE WHEN (length(digits) - k) % 2 = 0 THEN digits[k]::INT WHEN digits[k]::INT > 4 THEN digits[k]::INT * 2 - 9 ELSE digits[k]::INT * 2 END)) % 10 = 0
    WHEN 'phone' THEN length(digits) BETWEEN 10 AND 15 ELSE true END),
found AS (
  SELECT doc_id, kind, rank, s, s + length(v) AS e, CASE WHEN kind IN ('card', 'phone') THEN digits ELSE lower(v) END AS entity FROM valid),
masked AS (
  SELECT doc_id, array_to_string(list_transform(range(1, len(ps) + 1), lambda k: ps[k] || repeat(' ', coalesce(length(ms[k]), 0))), '') AS t
  FROM hits WHERE kind = 'email'),
held AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(t), '\p{{L}}+'))) AS term FROM masked),
mentions AS (SELECT DISTINCT doc_id, kind, entity FROM found),
n_t AS (SELECT term, count(*) AS n_t FROM held GROUP BY 1),
n_e AS (SELECT kind, entity, count(*) AS n_e FROM mentions GROUP BY ALL HAVING count(*) >= {LEAST_DOCUMENTS}),
n_te AS (SELECT kind, entity, term, count(*) AS n_te FROM mentions JOIN n_e USING (kind, entity) JOIN held USING (doc_id) GROUP BY ALL HAVING count(*) >= {LEAST_DOCUMENTS}),
risky AS (
  SELECT kind, entity, term FROM n_te JOIN n_t USING (term) JOIN n_e USING (kind, entity), (SELECT count(*)::DOUBLE AS total FROM d)
  WHERE total > n_e AND least(log2(total * n_te / (n_t * n_e)) / log2(total / n_e), 1) >= {GENERALISE}),
told AS (SELECT DISTINCT doc_id, term FROM mentions JOIN risky USING (kind, entity)),
texts AS (
  SELECT doc_id, regexp_extract_all(t, '\p{{L}}+') AS ws, regexp_split_to_array(t, '\p{{L}}+') AS bs FROM masked WHERE doc_id IN (SELECT doc_id FROM told)),
words AS (SELECT doc_id, unnest(ws) AS w, unnest(bs[1:len(ws)]) AS b, unnest(range(len(ws))) AS k FROM texts WHERE len(ws) > 0),
placed_words AS (SELECT doc_id, lower(w) AS term, length(w) AS n, sum(length(b) + length(w)) OVER (PARTITION BY doc_id ORDER BY k)::BIGINT AS e FROM words),
spans AS (
  SELECT doc_id, kind, rank, s, e FROM found UNION ALL
  SELECT doc_id, '{TERM}', {len(KINDS) + 1}, e - n, e FROM placed_words JOIN told USING (doc_id, term)),
per AS (
  SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS)}, count(*) FILTER (kind = '{TERM}') AS n_terms,
         coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (kind <> '{TERM}'), '') AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM spans GROUP BY 1)
SELECT doc_id, {', '.join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS)}, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_terms, 0) AS n_terms
FROM documents LEFT JOIN per USING (doc_id)
"""


ORACLE = _oracle()
