"""Text blocks of word-processing documents: identity, consistency, replacement by code points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_OVERHEAD = 32


def block_id(sha256: Column, part: Column, story: Column, path: Column) -> Column:
    return F.concat(F.lit("b_"), F.sha2(F.concat_ws("\0", sha256, part, story, path), 256))


# Stories in the order in which they are read.
STORIES = "body header footer footnotes endnotes".split()


def story_blocks(paragraphs: DataFrame, source: str) -> DataFrame:
    """Add ordinal and block_id to paragraphs (source, sha, story, part, path, nth, text): the body comes
    first, then headers and footers by their parts, then notes; within a part, paragraphs keep their
    order. Paragraphs of unknown stories are none."""
    rank = F.array_position(F.array(*[F.lit(x) for x in STORIES]), F.col("story"))
    along = Window.partitionBy(source).orderBy(rank, "part", "nth")
    known = paragraphs.where(F.col("story").isin(STORIES))
    return known.select("*", (F.row_number().over(along) - 1).alias("ordinal"), block_id(F.col("sha"), F.col("part"), F.col("story"), F.col("path")).alias("block_id"))


def inspection(blocks: DataFrame, source: str, told_characters: Column) -> DataFrame:
    """Per source: are ordinals 0..n-1, ids unique, and code points as many as told."""
    n = F.count(F.lit(1))
    return blocks.groupBy(source).agg(
        n.alias("n_blocks"),
        F.sum(F.length("text")).alias("characters"),
        ((F.min("ordinal") == 0) & (F.max("ordinal") == n - 1)).alias("contiguous"),
        (F.count_distinct("block_id") == n).alias("unique_ids"),
        (F.sum(F.length("text")) == F.first(told_characters)).alias("complete"),
    )


def replace_ranges(blocks: DataFrame, ranges: DataFrame, key: str, same: tuple[str, ...] = ()) -> DataFrame:
    """Put replacements in place, the last range first, so that earlier offsets stay valid.

    ``ranges``: key, start, end, exact_text, replacement and the columns ``same``. A range whose text is
    not what the block holds there, or which differs from the block in one of those columns, is left
    out and counted in ``n_stale``; ranges must not overlap.
    """
    one = F.struct("start", "end", "exact_text", "replacement", *same)
    per = ranges.groupBy(key).agg(F.sort_array(F.collect_list(one), asc=False).alias("_r"))
    met = blocks.join(per, key, "left")

    def held(r: Column) -> Column:
        good = F.substring("text", (r["start"] + 1).cast("int"), (r["end"] - r["start"]).cast("int")) == r["exact_text"]
        for c in same:
            good = good & (r[c] == F.col(c))
        return good

    good = F.filter("_r", held)
    put = lambda a, r: F.concat(
        F.substring(a, 1, r["start"].cast("int")), r["replacement"], F.substring(a, (r["end"] + 1).cast("int"), F.length(a))
    )
    return met.select(
        *blocks.columns,
        F.coalesce(F.aggregate(good, F.col("text"), put), F.col("text")).alias("rendered"),
        F.coalesce(F.size("_r") - F.size(good), F.lit(0)).alias("n_stale"),
    )


# Picture types that can be redacted.
PICTURE_TYPES = "image/png image/jpeg image/gif image/bmp image/tiff".split()


def unsupported_reason(
    pictures: Column, fills: Column, blips: Column, shapes: Column, transforms: Column, properties: Column, link: Column, embed: Column, media: Column
) -> Column:
    """Why a drawing cannot be a target, the first reason that holds; null if it can.

    The first six count the drawing's elements; ``link`` and ``embed`` are its relationships, and
    ``media`` is the type of the part that is embedded: null where there is none, empty where it is
    no picture.
    """
    return (
        F.when(pictures == 0, "unsupported_drawing_type")
        .when((pictures > 1) | (shapes != 1) | (transforms > 1), "unsupported_picture_container")
        .when((fills != 1) | (blips != 1), "unsupported_drawing_type")
        .when(F.coalesce(link, F.lit("")) != "", "external_image")
        .when(F.trim(F.coalesce(embed, F.lit(""))) == "", "missing_image_relationship")
        .when(properties != 1, "unsupported_picture_container")
        .when(media.isNull(), "missing_image_relationship")
        .when(media == "", "relationship_is_not_an_image")
        .when(~F.lower(media).isin(PICTURE_TYPES), "unsupported_image_format")
    )


def crop_box(width: Column, height: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """Pixels that are left of a picture cut by shares in 1/100000 at its sides; null if nothing is,
    or if the shares of two opposite sides make up the whole."""
    share = lambda size, part: F.bround(size * part / 100_000, 0).cast("long")
    x0, y0, x1, y1 = share(width, left), share(height, top), width - share(width, right), height - share(height, bottom)
    whole = (left + right >= 100_000) | (top + bottom >= 100_000)
    box = F.struct(x0.alias("left"), y0.alias("top"), x1.alias("right"), y1.alias("bottom"))
    return F.when(~whole & (x1 > x0) & (y1 > y0), box)


def quad_placement(corners: list[tuple[Column, Column]], page_width: Column, page_height: Column) -> Column:
    """Where a picture lies on its page, in shares of the page and from its top: corner, sides and
    rotation. ``corners``: bottom left, bottom right, top right, top left, in points from the bottom.
    Null for a picture or a page without an extent."""
    (xa, ya), (xb, yb), (xc, yc), (xd, yd) = corners
    wide, high = F.hypot(xc - xd, yc - yd) / page_width, F.hypot(xa - xd, ya - yd) / page_height
    x = (xa + xb + xc + xd) / 4 / page_width - wide / 2
    y = (page_height - (ya + yb + yc + yd) / 4) / page_height - high / 2
    within = lambda v, size: F.greatest(F.lit(0.0), F.least(v, 1 - size))
    turn = -F.degrees(F.atan2(yc - yd, xc - xd))
    return F.when(
        (page_width > 0) & (page_height > 0) & (wide > 0) & (high > 0),
        F.struct(
            within(x, wide).alias("x"),
            within(y, high).alias("y"),
            F.least(wide, F.lit(1.0)).alias("width"),
            F.least(high, F.lit(1.0)).alias("height"),
            (F.pmod(turn + 180, F.lit(360.0)) - 180).alias("rotation"),
        ),
    )


#: Characters that a replacement must not hold: controls, and what XML takes no single unit for.
BAD_CHARACTERS = r"[\p{Cc}\x{FFFE}\x{FFFF}\x{10000}-\x{10FFFF}]"
MOST_UNITS = 512


def render_violations(ranges: DataFrame, key: str, expected_sha256: str) -> DataFrame:
    """Ranges that must not be rendered, with the first reason that holds: not a range of this source,
    one that begins before the one before it in its block ends, or a replacement that is too long or
    holds characters that it must not."""
    before = F.lag("end").over(Window.partitionBy(key).orderBy("start", "end", "layer_id"))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    target = (F.col("source_sha256") != F.col(expected_sha256)) | blank("story") | blank("part") | (F.col("start") < 0)
    target = target | (F.col("end") <= F.col("start")) | (F.coalesce("exact_text", F.lit("")) == "")
    units = F.octet_length(F.encode("replacement", "UTF-16BE")) / 2
    reason = (
        F.when(target, "invalid_target")
        .when(before > F.col("start"), "overlapping_targets")
        .when((units > MOST_UNITS) | F.col("replacement").rlike(BAD_CHARACTERS), "invalid_replacement")
    )
    return ranges.withColumn("reason", reason).where("reason IS NOT NULL")


def replace_in_leaves(leaves: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """Leaves (key, nth, text) after one range a block was replaced: the first leaf that it touches gets
    the replacement, the others lose their part of it."""
    along = Window.partitionBy(key).orderBy("nth")
    end = F.sum(F.length("text")).over(along)
    placed = leaves.select("*", (end - F.length("text")).alias("_from"), end.alias("_to")).join(ranges, key, "left")
    touched = (F.col("_from") < F.col("end")) & (F.col("_to") > F.col("start"))
    first = F.col("nth") == F.min(F.when(touched, F.col("nth"))).over(Window.partitionBy(key))
    head = F.left("text", F.greatest(F.col("start") - F.col("_from"), F.lit(0)).cast("int"))
    tail = F.substring("text", (F.least("end", "_to") - F.col("_from") + 1).cast("int"), F.length("text"))
    value = F.concat(head, F.when(first, F.col("replacement")).otherwise(""), tail)
    return placed.select(*leaves.columns, F.when(touched, value).otherwise(F.col("text")).alias("rendered"))


def evidence_violations(pictures: DataFrame, evidence: list[str]) -> DataFrame:
    """Targetable pictures that lack evidence or have a reason not to be, and others that have none."""
    lacking = F.lit(False)
    for c in evidence:
        lacking = lacking | F.col(c).isNull()
    bad = F.when(F.col("targetable"), F.when(lacking | F.col("reason").isNotNull(), "incomplete_evidence")).otherwise(F.when(F.col("reason").isNull(), "no_reason"))
    return pictures.withColumn("violation", bad).where("violation IS NOT NULL")
