"""Sessions, table loading and shared scratch tables."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("palimpsest")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


_shipped: set[str] = set()


#: Spark's default and ours: a batch of texts in a Python worker holds a tenth of the usual rows.
_BATCH_ROWS, _TEXT_BATCH_ROWS = "10000", "1000"
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of every executor, once per application.

    Texts may be long, so Arrow batches are made shorter, unless the session has a size of its own.
    """
    context = spark.sparkContext
    if spark.conf.get(_BATCH_SETTING) == _BATCH_ROWS:
        spark.conf.set(_BATCH_SETTING, _TEXT_BATCH_ROWS)
    home = Path(__file__).resolve().parent
    if context.applicationId in _shipped or not home.is_dir():
        return
    _shipped.add(context.applicationId)
    archive = Path(tempfile.mkdtemp(prefix="palimpsest-package-")) / f"{home.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(home.rglob("*.py")):
            out.write(path, path.relative_to(home.parent))
    context.addPyFile(str(archive))  # served by the driver to the executors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table. Only Spark opens the path, so any store that Spark reads will do."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where that setting is absent and the master is local (tests, a laptop) a temporary folder is set
    once per session. On a cluster its absence is an error, as each executor would write to its own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("palimpsest.scratch", None)
    if not root:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise RuntimeError(f"spark.checkpoint.dir has to name a shared folder on {master}")
        root = tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("palimpsest.scratch", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def stored(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared scratch folder, by the session's codec or another one, and read it back.

    This cuts the lineage: a lost executor costs one task's input, not the whole chain before it.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    schema = df.schema
    del df
    release(spark)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Free what finished steps have left behind.

    Spark removes shuffle files, broadcasts and the plans that made them only once the driver's
    collector has found their handles, which a quiet driver does late; disks fill meanwhile, and its
    heap grows to its limit. Steps are few, so they ask for a collection each.
    """
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()
