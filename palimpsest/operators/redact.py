"""Replacements for findings and their rendering into lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import LINE_END, is_blank, line_number, partial_mask

BOX = "[REDACTED]"


def with_tokens(layers: DataFrame, session: str, entity: str, text: str, order: list[str]) -> DataFrame:
    """Add ``token``: ENTITY_001 and so on by first appearance of a text within session and entity.

    Layers with a text of their own that is not blank neither take nor use up a number.
    """
    plain = F.coalesce(F.trim("custom_text"), F.lit("")) == ""
    name = F.upper(entity)
    same = Window.partitionBy(session, name, plain, text)
    ranked = layers.withColumn("_first", F.min(F.struct(*order)).over(same))
    nth = F.dense_rank().over(Window.partitionBy(session, name, plain).orderBy("_first"))
    return ranked.withColumn("token", F.when(plain, F.format_string("%s_%03d", name, nth))).drop("_first")


def with_replacement(layers: DataFrame, text: str) -> DataFrame:
    own = F.coalesce(F.trim("custom_text"), F.lit("")) != ""
    return layers.withColumn(
        "replacement",
        F.when(F.col("effect") == "partial_mask", partial_mask(F.col(text)))
        .when((F.col("effect") == "token_replace") & own, F.col("custom_text"))
        .when(F.col("effect") == "token_replace", F.col("token"))
        .otherwise(BOX),
    )


#: Edited lines are kept by blocks of so many, so that a line is looked up among few.
_BLOCK = 64


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _edit_map(layers: DataFrame, order: str, id_col: str) -> DataFrame:
    """_id, edits: of each document the edits of each line, in order: block of lines -> line -> edits.
    Line 0 has those that name none."""
    edit = F.struct(F.col(order).alias("at"), F.col("exact_text").alias("old"), F.col("replacement").alias("new"))
    no = F.greatest(F.coalesce(line_number(F.col("line_id")), F.lit(0)), F.lit(0))
    lines = layers.groupBy(F.col(id_col).alias("_id"), no.alias("no")).agg(F.array_sort(F.collect_list(edit)).alias("e"))
    block = F.floor((F.col("no") - 1) / _BLOCK).cast("int")
    blocks = lines.groupBy("_id", block.alias("block")).agg(F.map_from_entries(F.collect_list(F.struct("no", "e"))).alias("by_line"))
    return blocks.groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("block", "by_line"))).alias("edits"))


def _placeless(edits: Column, n_lines: Column) -> Column:
    """Edits whose line is none of 1 to n_lines, in order. Only the first and the last blocks can hold any."""
    last = F.floor((n_lines - 1) / _BLOCK).cast("int")
    entries = F.flatten(F.transform(F.filter(F.map_entries(edits), lambda b: (b["key"] < 0) | (b["key"] >= last)), lambda b: F.map_entries(b["value"])))
    return F.array_sort(F.flatten(F.transform(F.filter(entries, lambda x: (x["key"] < 1) | (x["key"] > n_lines)), lambda x: x["value"])))


def render_lines(docs: DataFrame, layers: DataFrame, order: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, line_no, line_id, text, redacted, n_layers of all lines that are not blank.

    Layers (id, line_id, exact_text, replacement) are applied one after another, every occurrence each
    time; later ones see what earlier ones wrote. One whose line the document does not have is applied
    to every line. Layers, which are few, go to the documents, and lines are rendered where they lie:
    no line is shuffled on its own, and each folds over its own edits and the placeless ones alone.
    """
    met = docs.select(id_col, F.col(text_col).alias("_text")).join(_edit_map(layers, order, id_col), F.col(id_col) == F.col("_id"), "left")
    met = met.withColumn("lines", F.split(F.coalesce("_text", F.lit("")), LINE_END, -1))
    # An empty piece behind the last line end is no line.
    n = F.size("lines") - (F.element_at("lines", -1) == "").cast("int")
    put = lambda text, edits: F.coalesce(F.aggregate(edits, text, lambda a, e: F.replace(a, e["old"], e["new"])), text)
    rendered = lambda text, edits: F.struct(text.alias("text"), put(text, edits).alias("redacted"), F.size(edits).alias("n_layers"))
    plain = lambda text: F.struct(text.alias("text"), text.alias("redacted"), F.lit(0).alias("n_layers"))

    def line(text: Column, own: Column, rest: Column) -> Column:
        both = F.when(F.size(rest) == 0, own).otherwise(F.array_sort(F.concat(F.coalesce(own, F.slice(rest, 1, 0)), rest)))
        return _let(both, lambda edits: F.when(edits.isNull(), plain(text)).otherwise(rendered(text, edits)))

    def block(k: Column, rest: Column) -> Column:
        texts = F.slice("lines", (k * _BLOCK + 1).cast("int"), F.lit(_BLOCK))
        number = lambda i: (k * _BLOCK + i + 1).cast("int")
        return _let(F.try_element_at("edits", k), lambda own: F.transform(texts, lambda text, i: line(text, F.try_element_at(own, number(i)), rest)))

    blocks = F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / _BLOCK).cast("int"))
    done = _let(_placeless(F.col("edits"), n), lambda rest: F.flatten(F.transform(blocks, lambda k: block(k, rest))))
    each = met.select(id_col, F.posexplode(F.when(F.col("edits").isNull(), F.transform("lines", plain)).otherwise(done)).alias("pos", "l"))
    number = F.col("pos") + 1
    return each.where(~is_blank(F.col("l.text"))).select(
        id_col, number.alias("line_no"), F.concat(F.lit("t"), number).alias("line_id"), "l.text", "l.redacted", "l.n_layers"
    )
