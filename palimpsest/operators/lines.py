"""Line models and byte-budget batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.session import stored


def source_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line_no, line_id, text of all lines that are not blank; blank ones keep their number."""
    # One split; the empty piece after a line end at the end of a text is blank and goes with the others.
    pieces = F.split(F.coalesce(F.col(text_col), F.lit("")), X.LINE_END, -1)
    each = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(pieces).alias("pos", "text"))
    return each.where(~X.is_blank(F.col("text"))).select(
        "doc_id", (F.col("pos") + 1).alias("line_no"), F.concat(F.lit("t"), F.col("pos") + 1).alias("line_id"), "text"
    )


def measurements(docs: DataFrame) -> DataFrame:
    """Lines (blank ones too), code points and bytes as an upload counts them."""
    parts = F.split("text", r"\r\n|\r|\n", -1)
    lines = F.size(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0)
    return docs.select(
        "doc_id",
        lines.cast("long").alias("line_count"),
        F.length("text").cast("long").alias("character_count"),
        F.octet_length("text").cast("long").alias("byte_count"),
        F.sha2("text", 256).alias("sha256"),
    )


def page_lines(pages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines with white space collapsed, numbered within the page after blank ones went."""
    each = pages.select(F.col(id_col), F.posexplode(F.split(text_col, r"\r\n|\r|\n")).alias("pos", "raw"))
    each = each.withColumn("text", X.collapse(F.col("raw"))).where("text <> ''")
    nth = F.row_number().over(Window.partitionBy(id_col).orderBy("pos"))
    return each.select(F.col(id_col), nth.alias("line_no"), F.format_string("l%04d", nth).alias("line_id"), "text")


def greedy_batches(lines: Column, limit: int) -> Column:
    """Batches of lines (struct no, cost) in order: a batch is closed when the next cost would exceed
    the limit. What the fold carries is the open batch; only closed ones are added to the result."""
    kind = "struct<first_line: bigint, last_line: bigint, n_lines: bigint, cost: bigint>"
    none = F.lit(None).cast(kind)
    one = lambda first, line, n, cost: F.struct(
        first.cast("long").alias("first_line"), line["no"].cast("long").alias("last_line"), n.cast("long").alias("n_lines"), cost.cast("long").alias("cost")
    )
    start = F.struct(none.alias("open"), F.array().cast(f"array<{kind}>").alias("closed"))

    def step(a: Column, line: Column) -> Column:
        full = a["open"].isNotNull() & (a["open"]["cost"] > 0) & (a["open"]["cost"] + line["cost"] > limit)
        fresh = full | a["open"].isNull()
        begun = one(line["no"], line, F.lit(1), line["cost"])
        grown = one(a["open"]["first_line"], line, a["open"]["n_lines"] + 1, a["open"]["cost"] + line["cost"])
        closed = F.when(full, F.concat(a["closed"], F.array(a["open"]))).otherwise(a["closed"])
        return F.struct(F.when(fresh, begun).otherwise(grown).alias("open"), closed.alias("closed"))

    return F.aggregate(lines, start, step, lambda a: F.when(a["open"].isNull(), a["closed"]).otherwise(F.concat(a["closed"], F.array(a["open"]))))


#: Lines of a source are taken by blocks of so many line numbers.
BLOCK_LINES = 1024


def _pointed(lines: DataFrame, limit: int, source: str, block_lines: int) -> DataFrame:
    """Per block of a source: rows, its lines (no, cost, sum, next) in order. ``sum`` are the costs so far,
    ``next`` the place in the block of the line that a batch which begins at this one leaves to the next."""
    rows = lines.select(source, F.col("line_no").cast("long").alias("no"), F.col("cost").cast("long").alias("cost"))
    rows = rows.withColumn("block", F.floor(F.col("no") / block_lines))
    whole = Window.partitionBy(source, "block")
    rows = rows.withColumn("sum", F.sum("cost").over(whole.orderBy("no"))).withColumn("nth", F.row_number().over(whole.orderBy("no")))
    # Lines that go with the one before, if a batch ends there: by value of the sums, not by rows.
    rows = rows.withColumn("until", F.count(F.lit(1)).over(whole.orderBy("sum").rangeBetween(Window.unboundedPreceding, limit)))
    first = F.count_if(F.col("sum") <= limit).over(whole)
    until = F.coalesce(F.lag("until").over(whole.orderBy("no")), first)
    rows = rows.withColumn("next", F.greatest(until, F.col("nth")) + 1)
    return rows.groupBy(source, "block").agg(F.array_sort(F.collect_list(F.struct("no", "cost", "sum", "next"))).alias("rows"))


def _summed_up(blocks: DataFrame, limit: int) -> DataFrame:
    """Add what a block makes of a batch that is open before it, by the line at which it cuts: ``cuts`` with
    (sum, out, n), the sums until it, what is open after the block, and the batches begun in it."""
    n = F.size("rows")
    kind = "array<struct<out: bigint, n: bigint>>"

    def step(acc: Column, row: Column) -> Column:
        beyond = row["next"] > n
        then = F.get(acc, (n - row["next"]).cast("int"))  # acc holds the lines from the last one on
        out = F.when(beyond, F.element_at("rows", -1)["sum"] - row["sum"] + row["cost"]).otherwise(then["out"])
        return F.array_append(acc, F.struct(out.alias("out"), F.when(beyond, F.lit(1).cast("long")).otherwise(then["n"] + 1).alias("n")))

    back = F.aggregate(F.reverse("rows"), F.array().cast(kind), step, F.reverse)
    near = F.transform(F.filter("rows", lambda r: r["sum"] <= limit), lambda r: r["sum"])
    cuts = F.struct(near.alias("sums"), F.slice(back, F.lit(1), F.size(near) + 1).alias("after"))
    return blocks.withColumn("cuts", cuts)


def _opened(blocks: DataFrame, limit: int, source: str) -> DataFrame:
    """Per source, in order over its blocks' sums: what is open before each block (null: nothing yet) and
    how many batches began before it; or that a line is above the limit."""
    block = F.struct(
        "block", "cuts", F.element_at("rows", -1)["sum"].alias("total"), F.get("rows", F.lit(0))["no"].alias("first_line"), F.element_at("rows", -1)["no"].alias("last_line"),
        F.size("rows").cast("long").alias("n_lines"), F.array_max(F.transform("rows", lambda r: r["cost"])).alias("most"),
    )
    per = blocks.groupBy(source).agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    kind = "array<struct<block: bigint, open: bigint, begun: bigint>>"
    start = F.struct(F.lit(None).cast("long").alias("open"), F.lit(0).cast("long").alias("begun"), F.array().cast(kind).alias("seen"))

    def step(acc: Column, b: Column) -> Column:
        kept = F.when(acc["open"].isNull(), 0).otherwise(F.size(F.filter(b["cuts"]["sums"], lambda s: s <= limit - acc["open"])))
        then = F.get(b["cuts"]["after"], kept)  # null if the block cuts nowhere
        return F.struct(
            F.coalesce(then["out"], acc["open"] + b["total"]).alias("open"),
            (acc["begun"] + F.coalesce(then["n"], F.lit(0))).alias("begun"),
            F.array_append(acc["seen"], F.struct(b["block"].alias("block"), acc["open"].alias("open"), acc["begun"].alias("begun"))).alias("seen"),
        )

    most = F.array_max(F.transform("blocks", lambda b: b["most"]))
    whole = F.struct(
        F.get("blocks", F.lit(0))["first_line"].alias("first_line"), F.element_at("blocks", -1)["last_line"].alias("last_line"),
        F.aggregate("blocks", F.lit(0).cast("long"), lambda n, b: n + b["n_lines"]).alias("n_lines"), most.alias("cost"),
    )
    none = F.array().cast(kind)
    return per.select(source, F.when(most > limit, whole).alias("failed"), F.when(most > limit, none).otherwise(F.aggregate("blocks", start, step, lambda a: a["seen"])).alias("seen"))


def _pieces(rows: str, limit: int) -> Column:
    """Batches of a block's lines, or what of them lies in it: (batch, first_line, last_line, n_lines, cost)."""
    n = F.size(rows)
    kept = F.when(F.col("open").isNull(), 0).otherwise(F.size(F.filter(rows, lambda r: r["sum"] <= limit - F.col("open")))).cast("long")
    start = F.struct((kept + 1).alias("due"), F.lit(0).cast("long").alias("nth"), F.array().cast("array<bigint>").alias("starts"))

    def step(acc: Column, row: Column) -> Column:
        nth, here = acc["nth"] + 1, acc["nth"] + 1 == acc["due"]
        return F.struct(
            F.when(here, row["next"]).otherwise(acc["due"]).alias("due"), nth.alias("nth"), F.when(here, F.array_append(acc["starts"], nth)).otherwise(acc["starts"]).alias("starts")
        )

    starts = F.aggregate(rows, start, step, lambda a: a["starts"])
    # The piece before the first start belongs to the batch that was open.
    edges = F.when(kept > 0, F.concat(F.array(F.lit(1).cast("long")), starts)).otherwise(starts)
    before = F.when(kept > 0, F.col("begun")).otherwise(F.col("begun") + 1)
    row = lambda k: F.get(rows, (k - 1).cast("int"))

    def piece(k: Column, i: Column) -> Column:
        last = F.coalesce(F.get(edges, i + 1) - 1, n.cast("long"))
        return F.struct(
            (before + i).alias("batch"), row(k)["no"].alias("first_line"), row(last)["no"].alias("last_line"), (last - k + 1).alias("n_lines"),
            (row(last)["sum"] - row(k)["sum"] + row(k)["cost"]).alias("cost"),
        )

    return F.transform(edges, piece)


def batches(lines: DataFrame, limit: int, source: str = "doc_id", block_lines: int = BLOCK_LINES) -> DataFrame:
    """source, batch, first_line, last_line, n_lines, cost over rows (source, line_no, cost).

    A batch is closed when the next line's cost would exceed the limit. A line above the limit fails its
    whole source, which then has one row with batch 0.

    A source of any length is dealt to many tasks by blocks of lines. Each line points to the one where a
    batch that begins with it ends, from which follows what a block makes of any batch that is open before
    it; only these sums, a few a block, are gone through in order. Then blocks cut their own lines.
    """
    blocks = stored(_pointed(lines, limit, source, block_lines), "line-blocks")
    opened = stored(_opened(_summed_up(blocks, limit), limit, source), "open-batches")
    failed = opened.where("failed IS NOT NULL").select(source, F.lit(0).cast("long").alias("batch"), "failed.*")
    states = opened.where("failed IS NULL").select(source, F.explode("seen").alias("s")).select(source, "s.*")
    cut = blocks.join(states, [source, "block"]).select(source, F.explode(_pieces("rows", limit)).alias("p")).select(source, "p.*")
    merged = cut.groupBy(source, "batch").agg(
        F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"), F.sum("n_lines").alias("n_lines"), F.sum("cost").alias("cost")
    )
    return merged.unionByName(failed).withColumn("batch", F.col("batch").cast("int"))


def text_batches(docs: DataFrame, limit: int) -> DataFrame:
    """Batches of a text's lines; a line costs its bytes and one more."""
    return batches(source_lines(docs).select("doc_id", "line_no", (F.octet_length("text") + 1).alias("cost")), limit)
