"""Upload formats, file admission and binary sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values: (format, suffixes, accepted types, kind, layout).
FORMATS = (
    ("txt", "txt", "text/plain", "document", "text"),
    ("csv", "csv", "text/csv text/plain application/vnd.ms-excel", "document", "text"),
    ("md", "md markdown", "text/markdown text/plain", "document", "text"),
    ("pdf", "pdf", "application/pdf", "document", "fixed"),
    ("docx", "docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "document", "word_processing"),
    ("jpeg", "jpg jpeg", "image/jpeg", "image", ""),
    ("png", "png", "image/png", "image", ""),
    ("webp", "webp", "image/webp", "image", ""),
    ("wav", "wav", "audio/wav audio/x-wav audio/wave", "audio", ""),
    ("mp3", "mp3", "audio/mpeg audio/mp3", "audio", ""),
    ("m4a", "m4a", "audio/mp4 audio/x-m4a", "audio", ""),
    ("ogg", "ogg", "audio/ogg", "audio", ""),
    ("flac", "flac", "audio/flac audio/x-flac", "audio", ""),
)
MAX_UPLOAD_BYTES = 50 * 1024 * 1024
#: Limits of an archive: entries, bytes of an entry, bytes in all, compression ratio.
ARCHIVE = (2048, 50 * 1024 * 1024, 200 * 1024 * 1024, 200)


def formats(spark: SparkSession) -> DataFrame:
    rows = [(f, s, t.split(), k, layout or None) for f, suffixes, t, k, layout in FORMATS for s in suffixes.split()]
    return spark.createDataFrame(rows, "format string, suffix string, types array<string>, kind string, layout string")


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))


def resolve_format(files: DataFrame, name: str, mime: str) -> DataFrame:
    """Add format, kind and layout; null where suffix and type do not agree on one."""
    dim = F.broadcast(formats(files.sparkSession))  # a fixed table
    met = files.withColumn("_suffix", suffix(F.col(name))).join(
        dim, (F.col("_suffix") == F.col("suffix")) & F.array_contains("types", F.lower(mime)), "left"
    )
    return met.select(*files.columns, "format", "kind", "layout")


def read_binary(spark: SparkSession, path: str, max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """Files of a folder with their digest; larger ones are left out before their bytes are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= max_bytes)
    return files.select("path", "modificationTime", "length", F.sha2("content", 256).alias("sha256"), "content")


def stored_name(sha256: Column, safe_name: Column) -> Column:
    return F.concat_ws("-", sha256, safe_name)


def archive_admission(entries: DataFrame, package: str) -> DataFrame:
    """Per package, over its entries (name, size, packed): the first limit that it breaks, or null."""
    most, each, total, ratio = ARCHIVE
    bad_name = F.col("name").rlike(r"(^|[/\\])\.\.([/\\]|$)|^[/\\]|^[A-Za-z]:|\\|\x00") | (F.col("name") == "")
    per = entries.groupBy(package).agg(
        F.count(F.lit(1)).alias("n_entries"),
        F.max("size").alias("largest"),
        F.sum("size").alias("expanded"),
        F.sum("packed").alias("packed"),
        F.bool_or(bad_name).alias("unsafe"),
        (F.count(F.lit(1)) - F.count_distinct(F.lower("name"))).alias("duplicates"),
    )
    reason = (
        F.when(F.col("n_entries") > most, "too_many_entries")
        .when(F.col("unsafe"), "unsafe_name")
        .when(F.col("duplicates") > 0, "duplicate_name")
        .when(F.col("largest") > each, "entry_too_large")
        .when(F.col("expanded") > total, "too_large")
        .when(F.col("expanded") > ratio * F.col("packed"), "ratio")
    )
    return per.withColumn("reason", reason)


# Parts of a package that could run or carry something else, and containers of sound that can be written.
ACTIVE_PARTS = (
    "ActiveXPart AlternativeFormatImportPart EmbeddedControlPersistenceBinaryDataPart EmbeddedControlPersistencePart "
    "EmbeddedObjectPart EmbeddedPackagePart VbaDataPart VbaProjectPart"
).split()
SOUND_SUFFIXES = "aac flac m4a mp3 mp4 ogg opus wav".split()


def kind_of(file_format: Column) -> Column:
    """The kind that a format is of, null if there is no such format."""
    return F.coalesce(*[F.when(file_format == f, k) for f, _, _, k, _ in FORMATS])


def kind_violations(files: DataFrame, file_format: str, kind: str) -> DataFrame:
    """Files whose format is unknown, or of another kind than is stored, with the kind that is expected."""
    expected = kind_of(F.col(file_format))
    return files.withColumn("expected_kind", expected).where(F.col("expected_kind").isNull() | (F.col("expected_kind") != F.col(kind)))


def package_contents(parts: DataFrame, package: str) -> DataFrame:
    """Per package, over its parts (part, external, bytes): why it is refused, and the active part."""
    active = F.col("part").isin(ACTIVE_PARTS)
    per = parts.groupBy(package).agg(
        (F.sum("bytes") > MAX_UPLOAD_BYTES).alias("large"), F.bool_or("external").alias("external"), F.min(F.when(active, F.col("part"))).alias("active")
    )
    reason = F.when(F.col("large"), "package_limit").when(F.col("external"), "external_relationship").when(F.col("active").isNotNull(), "active_content")
    return per.select(package, reason.alias("reason"), "active")


def upload_reason(size: Column, limit: int = MAX_UPLOAD_BYTES) -> Column:
    return F.when(size > limit, "file_too_large").when(size == 0, "empty")


def output_format(kind: Column, suffix: Column) -> Column:
    """Format of a rendered file: pictures become PNG, sound keeps a container that can be written."""
    sound = F.when(F.lower(suffix).isin(SOUND_SUFFIXES), F.lower(suffix)).otherwise("wav")
    return F.when(kind == "image", "png").when(kind == "audio", sound).otherwise(suffix)


def finalised(outputs: DataFrame, key: str) -> DataFrame:
    """Outputs (sha256, output) under the name that their contents give them; all but the first with the
    same contents find it there already."""
    first = F.min(key).over(Window.partitionBy("sha256", "output"))
    return outputs.withColumn("stored_as", F.concat_ws(".", "sha256", "output")).withColumn("reused", F.col(key) != first)
