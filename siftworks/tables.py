"""Reading tables and cutting lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """This application's part of the folder that all executors share, ``spark.checkpoint.dir``; a local folder only where that is unset."""
    app = spark.sparkContext.applicationId
    root = spark.conf.get("spark.checkpoint.dir", None) or _local.get(app)
    if not root:
        root = _local[app] = "file://" + tempfile.mkdtemp(prefix="siftworks-")
    return f"{root.rstrip('/')}/siftworks-{app}"


_local: dict[str, str] = {}
_folders: set[str] = set()
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable by the Python workers of all executors, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent
    handle, local = tempfile.mkstemp(suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(local, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target = path(f"{shared_folder(spark)}/{root.name}.zip")
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).copyFromLocalFile(True, True, path(f"file://{local}"), target)
    spark.sparkContext.addPyFile(target.toString())


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _sweep() -> None:
    spark = SparkSession.getActiveSession()
    for folder in _folders:
        try:
            _remove(spark, folder)
        except Exception:  # noqa: BLE001 - the session may be gone; the folder then stays
            return


def _free(spark: SparkSession) -> None:
    """Collect the driver's garbage once its heap takes more than half of its limit.

    What finished steps have broadcast and shuffled is freed with it, and the heap shrinks. Left to itself it grows to its
    limit, in a job of many steps with plans that have served.
    """
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > runtime.maxMemory() // 2:
        runtime.gc()


def release(spark: SparkSession) -> None:
    """Have the driver's garbage collected now: what finished steps have shuffled leaves the disk with it, before a step that shuffles much."""
    spark.sparkContext._jvm.java.lang.System.gc()


def cut(df: DataFrame, replaces: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there and survives lost executors.

    ``replaces`` is an earlier result of ``cut`` that nothing needs any more; its files are removed once the new ones
    are complete, so that a loop holds two generations at most. ``by`` is a column of few values that the files are
    parted by, so that a filter on it reads those only. A driver's heap that has grown is cleared (``_free``).
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    if folder not in _folders:
        if not _folders:
            atexit.register(_sweep)
        _folders.add(folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    if replaces is not None and getattr(replaces, "_cut_path", None):
        _remove(spark, replaces._cut_path)
    _free(spark)
    return out
