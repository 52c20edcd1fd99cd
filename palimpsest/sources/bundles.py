"""Export bundles: one ZIP a session, written by a data source that commits all of them or none.

A bundle holds what was rendered, the audit events and the policy snapshot of a session, and a signed
manifest that lists the digests of these files and the last audit event.
"""

from __future__ import annotations

import io
import posixpath
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from palimpsest.operators.audit import canonical_json, hmac_sha256
from palimpsest.session import ship

# Names of the files.
AUDIT, SNAPSHOT, MANIFEST = "audit.json", "instruction_set_snapshot.json", "export_manifest.json"
FILES = "array<struct<name: string, content: binary>>"


def bundles(audit: DataFrame, snapshots: DataFrame, rendered: DataFrame, session: str, key: bytes) -> DataFrame:
    """session, name, files: what goes into each session's bundle.

    ``audit``: chained events; ``snapshots``: session, snapshot; ``rendered``: session, filename, content. Sessions that lack
    any of the three have no bundle. A session's files are one row, as they are one ZIP.
    """
    fields = sorted(c for c in audit.columns if c != session)
    event = F.struct("seq", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))
    per = audit.groupBy(session).agg(
        F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(event)), lambda e: e["json"]), ","), F.lit("]")).alias("audit"),
        F.max_by(F.struct("event_id", "event_hash"), "seq").alias("last"),
    )
    met = per.join(snapshots.select(session, "snapshot"), session).join(rendered.select(session, "filename", "content"), session)
    file = lambda name, content: F.struct(name.alias("name"), content.cast("binary").alias("content"))
    files = F.array_sort(F.array(file(F.lit(AUDIT), F.col("audit")), file(F.lit(SNAPSHOT), F.col("snapshot")), file(F.col("filename"), F.col("content"))))
    entry = lambda f: F.struct(f["name"].alias("filename"), F.sha2(f["content"], 256).alias("sha256"), F.octet_length(f["content"]).alias("size_bytes"))
    manifest = canonical_json(
        {
            "audit_boundary": F.struct(F.col("last.event_hash").alias("last_event_hash"), F.col("last.event_id").alias("last_event_id")),
            "export_schema_version": F.lit(1),
            "files": F.transform("files", entry),
            "rendered_file": F.col("filename"),
            "session_id": F.col(session).cast("string"),
        }
    )
    signature = F.concat(F.regexp_replace("manifest", r"\}$", ""), F.lit(',"signature":"'), hmac_sha256(key, F.col("manifest")), F.lit('"}'))
    whole = met.withColumn("files", files).withColumn("manifest", manifest)
    name = F.concat(F.lit("bundle-"), F.col(session).cast("string"), F.lit(".zip"))
    return whole.select(F.col(session), name.alias("name"), F.concat("files", F.array(file(F.lit(MANIFEST), signature))).alias("files"))


def zipped(files: list[tuple[str, bytes]]) -> bytes:
    """A ZIP that is the same whenever it is made."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as bundle:
        for name, content in files:
            bundle.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content, zipfile.ZIP_DEFLATED)
    return out.getvalue()


@dataclass
class Staged(WriterCommitMessage):
    """Bundles that a task has written beside their place: their names and its folder."""

    folder: str
    names: list[str]


class BundleWriter(DataSourceWriter):
    """Tasks write to a folder of their own; once all have, the bundles are moved to their place. If any
    fails, or two bundles have one name, the folders go and nothing is seen."""

    def __init__(self, path: str):
        self.path = path
        self.staging = posixpath.join(path, f"_staging-{uuid.uuid4().hex}")
        files, place = self._open(self.staging)
        files.create_dir(place)

    def _open(self, path: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def write(self, iterator: Iterator) -> Staged:
        folder, names = posixpath.join(self.staging, uuid.uuid4().hex), []
        files, place = self._open(folder)
        files.create_dir(place, recursive=False)  # fails where the write was aborted meanwhile
        for row in iterator:
            with files.open_output_stream(posixpath.join(place, row["name"])) as out:
                out.write(zipped([(f["name"], bytes(f["content"])) for f in row["files"]]))
            names.append(row["name"])
        return Staged(folder, names)

    def commit(self, messages: list) -> None:
        staged = [m for m in messages if m is not None]
        names = [n for m in staged for n in m.names]
        if len(names) != len(set(names)):
            self.abort(messages)
            raise ValueError("two bundles have one name")
        for m in staged:
            files, place = self._open(m.folder)
            for name in m.names:
                files.move(posixpath.join(place, name), posixpath.join(self._open(self.path)[1], name))
        self.abort(messages)

    def abort(self, messages: list) -> None:
        files, place = self._open(self.staging)
        if files.get_file_info(place).type != fs.FileType.NotFound:
            files.delete_dir(place)


class BundleSource(DataSource):
    """Sink for rows (name, files) at a path that the driver and all executors share."""

    @classmethod
    def name(cls) -> str:
        return "palimpsest_bundles"

    def schema(self) -> str:
        return f"name string, files {FILES}"

    def writer(self, schema: T.StructType, overwrite: bool) -> BundleWriter:
        return BundleWriter(self.options["path"])


def write_bundles(made: DataFrame, path: str) -> None:
    spark = made.sparkSession
    ship(spark)
    spark.dataSource.register(BundleSource)
    made.select("name", "files").write.format("palimpsest_bundles").mode("append").save(path)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("content", T.BinaryType())])))
def unzipped(contents: pd.Series) -> pd.Series:
    def files(data: bytes) -> list[dict]:
        with zipfile.ZipFile(io.BytesIO(data)) as bundle:
            return [{"name": n, "content": bundle.read(n)} for n in bundle.namelist()]

    return contents.map(files)


def read_bundles(spark: SparkSession, path: str, key: bytes) -> DataFrame:
    """name, files, manifest, verified of all bundles at a path: whether the manifest is signed by the key,
    and lists all other files with their digests and sizes."""
    ship(spark)
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    rows = rows.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), unzipped("content").alias("files"))
    text = lambda f: f["content"].cast("string")
    rows = rows.withColumn("manifest", text(F.get(F.filter("files", lambda f: f["name"] == MANIFEST), F.lit(0))))
    return rows.withColumn("verified", F.coalesce(verified(F.col("files"), F.col("manifest"), key), F.lit(False)))


def verified(files: Column, manifest: Column, key: bytes) -> Column:
    mark = r',"signature":"([0-9a-f]{64})"\}$'
    signed = F.regexp_extract(manifest, mark, 1) == hmac_sha256(key, F.regexp_replace(manifest, mark, "}"))
    told = F.from_json(manifest, "files array<struct<filename: string, sha256: string, size_bytes: int>>")["files"]
    entry = lambda f: F.struct(f["name"].alias("filename"), F.sha2(f["content"], 256).alias("sha256"), F.octet_length(f["content"]).alias("size_bytes"))
    there = F.transform(F.filter(files, lambda f: f["name"] != MANIFEST), entry)
    return signed & (F.array_sort(told) == F.array_sort(there))
