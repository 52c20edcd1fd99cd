"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sizes are words. Sources get weights in a repeating pattern, targets are their shares of all words,
limited to a number of passes over the source, and the excess is reshared by weight. The target is
cut into equal-token blocks, which highest quotients apportion to sources and, within a source, to
shards of bounded size, so that a source with a third of all rows is many shards. Within a shard,
documents lie one after another in a seeded order; the shard's quota of blocks is as many whole
passes as fit, and a seeded systematic choice of the remaining blocks. Which words of a document are
taken follows from its offset in closed form, so blocks are never materialised.

Only (id, source, size) rows are shuffled, never texts. Windows without a partition run over one row
per source (targets) and a few per source (quotients): a dimension table, not documents.

Defined cases: a null text has no words; a null source is a source of its own, last in order; a
document without words takes 0; rows that repeat an id are documents of their own, whatever their
texts; a null id is an id like others; a text of any length is one number here; an empty table gives
an empty result; ``mix`` neither reads nor returns other columns, and ``mixed_documents`` returns them
as they were, but for those with the names of columns that it adds, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.columns import numbered
from palimpsest.session import stored

WORD = r"[^\x20\x09-\x0D]+"


def sainte_lague(parties: DataFrame, group: list[str], key: str, votes: str, seats: str) -> DataFrame:
    """Add ``quota``: seats of each group given to its parties by the highest quotients votes/(2k+1).

    Every divisor that gives away all seats lies within bounds that follow from the number of
    parties, so all but about five seats a party are known beforehand and only those are ranked.
    """
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    near = parties.select("*", F.sum(votes).over(whole).alias("_all"), F.count(F.lit(1)).over(whole).alias("_n"))
    ideal = F.when(F.col("_all") > 0, F.col(votes) / F.col("_all") * F.col(seats)).otherwise(0.0)
    near = near.select("*", ideal.alias("_ideal"), (F.col("_n") / (2 * F.greatest(F.col(seats), F.lit(1)))).alias("_slack"))
    near = near.select(
        "*",
        F.greatest(F.floor(F.col("_ideal") * (1 - F.col("_slack")) - 0.5) - 1, F.lit(0)).cast("long").alias("_low"),
        (F.ceil(F.col("_ideal") * (1 + F.col("_slack")) + 0.5) + 1).cast("long").alias("_high"),
    )
    left = F.when(F.col("_all") > 0, F.col(seats) - F.sum("_low").over(whole)).otherwise(0)
    near = near.select("*", left.alias("_left"))
    ranked = near.select("*", F.explode(F.sequence("_low", F.col("_high"))).alias("_k"))
    by_quotient = whole.orderBy((F.col(votes) / (2 * F.col("_k") + 1)).desc(), F.col(key), F.col("_k"))
    ranked = ranked.select("*", F.row_number().over(by_quotient).alias("_rank"))
    names = parties.columns
    won = F.sum((F.col("_rank") <= F.col("_left")).cast("long"))
    return ranked.groupBy(*names, "_low").agg(won.alias("_won")).select(*names, (F.col("_low") + F.col("_won")).alias("quota"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], passes: int) -> DataFrame:
    """Per source: source_size and target. The level at which weight * level, cut at passes *
    size, adds up to all words is found by one pass over the sources in the order in which they
    reach their limit."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    rows = (
        sizes.groupBy("source", "source_key")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(pattern, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
        .withColumn("limit", passes * F.col("source_size").cast("double"))
    )
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), "source_key")
    before = F.coalesce(F.sum("limit").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    still = F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    every = Window.partitionBy(F.lit(0))
    rows = rows.withColumn("_level", (F.sum("source_size").over(every) - before) / still)
    rows = rows.withColumn("_at", F.row_number().over(by_limit))
    open_ = F.when(F.col("_level") * F.col("weight") <= F.col("limit"), F.struct("_at", "_level"))
    level = F.min(open_).over(every)["_level"]
    return rows.withColumn("target", F.least(level * F.col("weight"), F.col("limit"))).drop("_level", "_at")


def _seeded(seed: int, *parts: str) -> Column:
    """60 bits that depend on the seed and the parts alone, in any engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 15), 16, 10).cast("long")


def _taken_before(x: Column, block: Column, blocks: Column, chosen: Column, phase: Column) -> Column:
    """Words of the systematic choice before position x of a shard."""
    whole = F.least((x / block).cast("long"), blocks)
    picked = lambda b: F.floor((b * chosen + phase) / F.greatest(blocks, F.lit(1)))
    part = F.when(whole < blocks, (picked(whole + 1) - picked(whole)) * (x - whole * block)).otherwise(0)
    return picked(whole) * block + part


def _sized(docs: DataFrame, id_col: str, source_col: str, text_col: str, *more: Column) -> DataFrame:
    source = F.col(source_col).cast("string")
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        source.alias("source"),
        F.coalesce(F.concat(F.lit("s"), source), F.lit("")).alias("source_key"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        *more,
    )


def _sources(sizes: DataFrame, weights: tuple[int, ...], passes: int, block_words: int, shard_words: int) -> DataFrame:
    """Per source: source_size, target, block, source_quota (in blocks) and shards."""
    every = Window.partitionBy(F.lit(0))
    # One row a source; written, so that its windows are planned once.
    sources = stored(source_targets(sizes, weights, passes), "mix-targets")
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(every)
    block = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.coalesce(least, F.lit(0.0)) / 64))).cast("long")
    sources = sources.select("*", block.alias("block"), F.sum("source_size").over(every).alias("_total"))  # the targets' sum, too
    sources = sources.select("*", F.floor(F.col("_total") / F.col("block")).cast("long").alias("blocks")).drop("_total")
    sources = sainte_lague(sources, [], "source_key", "target", "blocks").select(
        "source_key",
        "source_size",
        "target",
        "block",
        F.least("quota", F.floor(F.col("limit") / F.col("block")).cast("long")).alias("source_quota"),
        F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long").alias("shards"),
    )
    return stored(sources, "mix-sources")


def _mixed(
    docs: DataFrame, id_col: str, source_col: str, text_col: str, carried: bool,
    weights: tuple[int, ...], passes: int, block_words: int, shard_words: int, seed: int,
) -> DataFrame:
    """Every row with its size, source, shard and taken words; ``carried``: and its own columns."""
    sizes = stored(_sized(docs, id_col, source_col, text_col), "mix-sizes")
    sources = _sources(sizes, weights, passes, block_words, shard_words)
    deal = lambda rows: rows.join(sources, "source_key").select(
        "*", F.pmod(_seeded(seed, "doc_id"), F.col("shards")).alias("shard")
    )
    shards = deal(sizes).groupBy("source_key", "shard", "source_quota", "block").agg(F.sum("size").alias("shard_size"))
    shards = sainte_lague(shards, ["source_key"], "shard", "shard_size", "source_quota")
    quota = F.least("quota", F.floor(passes * F.col("shard_size") / F.col("block")).cast("long")).alias("shard_quota")
    words = F.col("shard_quota") * F.col("block")
    full = F.when(F.col("shard_size") > 0, F.floor(words / F.col("shard_size"))).otherwise(0).cast("long")
    rest = F.round((words - F.col("full") * F.col("shard_size")) / F.col("block")).cast("long")
    shards = shards.select("*", quota).select("*", full.alias("full"), F.floor(F.col("shard_size") / F.col("block")).cast("long").alias("n_blocks"))
    shards = shards.select(
        "source_key", "shard", "shard_quota", "full", "n_blocks",
        F.least(rest, F.col("n_blocks")).alias("chosen"),
        F.pmod(_seeded(seed + 2, "source_key", "shard"), F.greatest(F.col("n_blocks"), F.lit(1))).alias("phase"),
    )
    shards = stored(shards, "mix-shards")

    tie = F.xxhash64(text_col)  # rows that repeat an id and a size lie in the order of their texts
    rows = _sized(docs, id_col, source_col, text_col, tie.alias("tie"), *map(F.col, docs.columns)) if carried else sizes.select("*", F.lit(0).alias("tie"))
    along = Window.partitionBy("source_key", "shard").orderBy("turn", "doc_id", "size", "tie")
    laid = deal(rows).select("*", _seeded(seed + 1, "doc_id").alias("turn")).join(shards, ["source_key", "shard"])
    laid = laid.select("*", F.sum("size").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("end"))
    at = lambda x: _taken_before(x, F.col("block"), F.col("n_blocks"), F.col("chosen"), F.col("phase"))
    part = F.when(F.col("full") < passes, at(F.col("end")) - at(F.col("end") - F.col("size"))).otherwise(0)
    return laid.select("*", (F.col("full") * F.col("size") + part).cast("long").alias("taken"))


ADDED = ("size", "source_size", "target", "taken")


def _added() -> list[Column]:
    kinds = {"source_size": "long", "target": "double"}
    return [F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in ADDED]


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    passes: int = 3,
    block_words: int = 64,
    shard_words: int = 1 << 20,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """Return doc_id, size, source_size, target, taken, source, shard, shard_quota per document."""
    docs = docs.select(F.col(f"`{id_col}`").alias("c0"), F.col(f"`{source_col}`").alias("c1"), F.col(f"`{text_col}`").alias("c2"))
    laid = _mixed(docs, "c0", "c1", "c2", False, weights, passes, block_words, shard_words, seed)
    return laid.select("doc_id", *_added(), "source", "shard", "shard_quota")


def mixed_documents(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    passes: int = 3,
    block_words: int = 64,
    shard_words: int = 1 << 20,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """The documents of which the mix takes words, all columns as they were, and size, source_size,
    target and taken. Texts are shuffled once, with what decides on them, and never joined by id."""
    own = numbered(docs)
    at = lambda c: own.columns[docs.columns.index(c)]
    laid = _mixed(own, at(id_col), at(source_col), at(text_col), True, weights, passes, block_words, shard_words, seed)
    kept = [(k, c) for k, c in zip(own.columns, docs.columns, strict=True) if c.lower() not in ADDED]
    return laid.where("taken > 0").select(*[F.col(k).alias(c) for k, c in kept], *_added())


def _sainte_lague_sql(name: str, parties: str, group: str, key: str, votes: str, seats: str) -> str:
    """CTEs that end in one called ``name``: the parties with their quota."""
    whole = f"PARTITION BY {group}"
    return f"""
{name}_a AS (SELECT *, {seats} AS seats_, sum({votes}) OVER ({whole}) AS all_, count(*) OVER ({whole}) AS n_ FROM {parties}),
{name}_b AS (SELECT *, CASE WHEN all_ > 0 THEN {votes} / all_ * seats_ ELSE 0 END AS ideal_, n_ / (2 * greatest(seats_, 1)) AS slack_ FROM {name}_a),
{name}_c AS (SELECT *, greatest(floor(ideal_ * (1 - slack_) - 0.5) - 1, 0)::BIGINT AS low_, (ceil(ideal_ * (1 + slack_) + 0.5) + 1)::BIGINT AS high_ FROM {name}_b),
{name}_d AS (SELECT *, CASE WHEN all_ > 0 THEN seats_ - sum(low_) OVER ({whole}) ELSE 0 END AS left_ FROM {name}_c),
{name}_e AS (SELECT *, unnest(range(low_, high_ + 1)) AS k_ FROM {name}_d),
{name}_f AS (SELECT *, row_number() OVER ({whole} ORDER BY {votes} / (2 * k_ + 1) DESC, {key}, k_) AS rank_ FROM {name}_e),
{name} AS (SELECT {group}, {key}, low_ + count(*) FILTER (rank_ <= left_) AS quota FROM {name}_f GROUP BY {group}, {key}, low_)"""


def _seeded_sql(seed: int, *parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(parts)})), 1, 15))::BIGINT"


def _taken_sql(x: str) -> str:
    whole = f"least(({x}) // block, n_blocks)"
    picked = lambda b: f"((({b}) * chosen + phase) // greatest(n_blocks, 1))"
    part = f"CASE WHEN {whole} < n_blocks THEN ({picked(whole + ' + 1')} - {picked(whole)}) * (({x}) - {whole} * block) ELSE 0 END"
    return f"({picked(whole)} * block + {part})"


#: The query in DuckDB's SQL, with the default parameters.
ORACLE = rf"""
WITH sizes AS (
  SELECT doc_id, source, coalesce('s' || source, '') AS source_key,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
src AS (SELECT source, source_key, sum(size)::BIGINT AS source_size FROM sizes GROUP BY ALL),
weighed AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, 3.0::DOUBLE * source_size AS lim FROM src),
levels AS (
  SELECT *, row_number() OVER w AS nth,
    (sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / weight, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY lim / weight, source_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW w AS (ORDER BY lim / weight, source_key)),
targets AS (
  SELECT source_key, source_size, lim, least((SELECT arg_min(level, nth) FROM levels WHERE level * weight <= lim) * weight, lim) AS target FROM levels),
blocked AS (
  SELECT *, greatest(1, least(64, floor(coalesce((SELECT min(target) FROM targets WHERE target > 0), 0) / 64)))::BIGINT AS block, 0 AS one FROM targets),
counted AS (SELECT *, ((SELECT sum(source_size) FROM src) // block)::BIGINT AS blocks FROM blocked),
{_sainte_lague_sql("won", "counted", "one", "source_key", "target", "blocks").strip()},
sources AS (
  SELECT source_key, source_size, target, block, least(quota, floor(lim / block)::BIGINT) AS source_quota,
         greatest(1, ceil(source_size / {1 << 20}))::BIGINT AS shards
  FROM counted JOIN won USING (source_key)),
dealt AS (SELECT *, {_seeded_sql(17, "doc_id")} % shards AS shard FROM sizes JOIN sources USING (source_key)),
shards AS (SELECT source_key, shard, source_quota, block, sum(size)::BIGINT AS shard_size FROM dealt GROUP BY ALL),
{_sainte_lague_sql("dwon", "shards", "source_key", "shard", "shard_size", "source_quota").strip()},
quotas AS (SELECT source_key, shard, shard_size, least(quota, (3 * shard_size) // block) AS shard_quota FROM shards JOIN dwon USING (source_key, shard)),
laid AS (
  SELECT *, (sum(size) OVER (PARTITION BY source_key, shard ORDER BY {_seeded_sql(18, "doc_id")}, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS e,
         CASE WHEN shard_size > 0 THEN (shard_quota * block) // shard_size ELSE 0 END AS passes, shard_size // block AS n_blocks
  FROM dealt JOIN quotas USING (source_key, shard)),
chose AS (SELECT *, least(round((shard_quota * block - passes * shard_size) / block)::BIGINT, n_blocks) AS chosen,
                 {_seeded_sql(19, "source_key", "shard")} % greatest(n_blocks, 1) AS phase FROM laid)
SELECT doc_id, size, source_size, target, source, shard, shard_quota,
       passes * size + CASE WHEN passes < 3 THEN {_taken_sql("e")} - {_taken_sql("e - size")} ELSE 0 END AS taken
FROM chose
"""
