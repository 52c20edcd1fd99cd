"""Audio timelines: chunk plans, merging of overlaps, effect sweeps. Always within a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK, OVERLAP = 300, 2
# A stronger effect hides a weaker one.
PRIORITY = {"mute": 2, "bleep": 1}
# Sample rate, pitch, loudness and fade of the tones.
RATE, TONE, GAIN, FADE = 48000, 1000, 0.35, 0.008


def chunk_plan(sources: DataFrame, duration: str) -> DataFrame:
    """chunk, chunk_start, chunk_duration: chunks of 300 s that overlap by 2 s and cover the source."""
    step = CHUNK - OVERLAP
    last = F.greatest(F.lit(0), F.ceil((F.col(duration) - CHUNK) / step)).cast("int")
    each = sources.select("*", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    each = each.withColumn("chunk_start", (F.col("chunk") * step).cast("double"))
    return each.withColumn("chunk_duration", F.least(F.lit(float(CHUNK)), F.col(duration) - F.col("chunk_start")))


def merge_overlaps(spans: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Spans of one key that overlap or touch become one, with the attributes of the most confident
    (the earliest among equals; unknown is least)."""
    by_start = Window.partitionBy(*keys).orderBy("start_time", *order)
    reach = F.max("end_time").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("start_time") <= reach, 0).otherwise(1)
    islands = spans.withColumn("island", F.sum(new).over(by_start)).withColumn("nth", F.row_number().over(by_start))
    best = F.struct(F.coalesce("confidence", F.lit(-1.0)), -F.col("nth"))
    return islands.groupBy(*keys, "island").agg(
        F.min("start_time").alias("start_time"),
        F.max("end_time").alias("end_time"),
        F.count(F.lit(1)).alias("n_merged"),
        F.max_by(F.col(order[0]), best).alias("kept"),
        F.max_by("confidence", best).alias("confidence"),
    )


def effect_sweep(spans: DataFrame, session: str, duration: Column) -> DataFrame:
    """Intervals with one effect each: the strongest that is active, equal neighbours joined.

    Instead of meeting every interval with every span, each span counts at its ends: running sums
    say how many spans of each effect are open.
    """
    begin, end = F.greatest("start_time", F.lit(0.0)), F.least("end_time", duration)
    cut = spans.select(session, "effect", begin.alias("_begin"), end.alias("_end")).where("_end > _begin")
    ends = cut.select(session, F.col("_begin").alias("at"), "effect", F.lit(1).alias("d")).unionByName(
        cut.select(session, F.col("_end").alias("at"), "effect", F.lit(-1).alias("d"))
    )
    opened = [F.sum(F.when(F.col("effect") == e, F.col("d")).otherwise(0)).alias(f"d_{e}") for e in PRIORITY]
    along = Window.partitionBy(session).orderBy("at")
    points = ends.groupBy(session, "at").agg(*opened)
    effect = F.coalesce(*[F.when(F.sum(f"d_{e}").over(along) > 0, e) for e in PRIORITY])
    pieces = points.select(session, "at", F.lead("at").over(along).alias("until"), effect.alias("effect"))
    before = F.lag("effect").over(along)
    pieces = pieces.withColumn("new", (~F.col("effect").eqNullSafe(before)).cast("int"))
    pieces = pieces.withColumn("run", F.sum("new").over(along)).where("effect IS NOT NULL")
    return pieces.groupBy(session, "run", "effect").agg(F.min("at").alias("start_time"), F.max("until").alias("end_time")).drop("run")


def filter_graph(sweep: DataFrame, session: str) -> DataFrame:
    """What a renderer is told of each session: ``graph``, which silences the intervals and lays tones
    with short fades over those with a bleep, and ``inputs``, where the tones come from."""
    row = F.struct("start_time", "end_time", "effect")
    per = sweep.groupBy(session).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    per = per.withColumn("tones", F.filter("rows", lambda r: r["effect"] == "bleep"))
    silent = F.transform("rows", lambda r: F.format_string("volume=volume=0:enable='between(t,%.6f,%.6f)'", r["start_time"], r["end_time"]))
    base = F.concat(F.lit(f"[0:a:0]aformat=sample_fmts=fltp:sample_rates={RATE}:channel_layouts=stereo,"), F.array_join(silent, ","), F.lit("[base]"))

    def tone(r: Column, k: Column) -> Column:
        length = r["end_time"] - r["start_time"]
        fade = F.least(F.lit(FADE), length / 2)
        return F.format_string(
            f"[%d:a]aformat=sample_fmts=fltp:channel_layouts=stereo,afade=t=in:st=0:d=%.6f,afade=t=out:st=%.6f:d=%.6f,volume={GAIN},adelay=%d:all=1[bleep%d]",
            k + 1, fade, length - fade, fade, F.bround(r["start_time"] * 1000, 0).cast("long"), k,
        )

    names = F.array_join(F.transform("tones", lambda _, k: F.format_string("[bleep%d]", k)), "")
    mixed = F.format_string("[base]%samix=inputs=%d:duration=first:dropout_transition=0:normalize=0[aout]", names, F.size("tones") + 1)
    last = F.when(F.size("tones") > 0, mixed).otherwise("[base]anull[aout]")
    source = lambda r: F.format_string(f"-f lavfi -i sine=frequency={TONE}:sample_rate={RATE}:duration=%.6f", r["end_time"] - r["start_time"])
    return per.select(
        session,
        F.concat_ws(";", F.concat(F.array(base), F.transform("tones", tone), F.array(last))).alias("graph"),
        F.array_join(F.transform("tones", source), " ").alias("inputs"),
    )


def overlap_join(left: DataFrame, right: DataFrame, key: str, width: float) -> DataFrame:
    """Pairs of one key whose intervals overlap (touching is none).

    ``left``: key, l_start, l_end and more; ``right``: key, r_start, r_end and more. Both are dealt
    to time buckets of ``width`` and meet by (key, bucket), so that a long session is many small
    joins; a pair counts in the first bucket that it shares.
    """
    deal = lambda df, side: df.withColumn(
        "_bucket", F.explode(F.sequence(F.floor(F.col(f"{side}_start") / width), F.floor(F.col(f"{side}_end") / width)))
    )
    met = deal(left, "l").join(deal(right, "r"), [key, "_bucket"])
    met = met.where((F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end")))
    return met.where(F.col("_bucket") == F.floor(F.greatest("l_start", "r_start") / width)).drop("_bucket")
