"""Session helpers shared by every part of the library."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch on its way to Python in the pipeline.
BATCH_BYTES = 4 << 20
_own_dirs: dict[str, str] = {}
_shipped: set[str] = set()
_deleted_at_end: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent, a temporary folder is made in local mode (tests,
    a laptop). Elsewhere that is an error: each executor would write to its own disk.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="lumenfold-")
    return _own_dirs[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses; it goes when the application ends."""
    app = spark.sparkContext.applicationId
    base = f"{shared_dir(spark)}/lumenfold/{app}"
    if app not in _deleted_at_end:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(folder)  # only a folder that is there can be marked
        fs.deleteOnExit(folder)
        _deleted_at_end.add(app)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def mounted_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder for tasks that open files themselves; an error where no mounted folder is shared."""
    url = urlparse(scratch_path(spark, name))
    if url.scheme not in ("", "file"):
        raise RuntimeError(f"page folders need a shared folder that driver and executors have mounted; spark.checkpoint.dir is in {url.scheme}://")
    return url.path


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends here.

    A written table survives the loss of executors, unlike a local checkpoint,
    and stays columnar, so later steps read only the columns they use.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`keep` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    base = shared_dir(spark).split(":", 1)[-1].lstrip("/")
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles():
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if f"{base}/lumenfold/" in folder.toString():
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
            return


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session end at ``BATCH_BYTES``, or where they did if that is less.

    By default they hold 10,000 rows or 64 MB, which a task has several times:
    in the JVM's buffers beside its heap, and in its Python worker.
    """
    at = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = int(spark.conf.get(at).rstrip("b"))
    if not 0 < held <= BATCH_BYTES:
        spark.conf.set(at, str(BATCH_BYTES))


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers that lack it on their path."""
    root = Path(__file__).resolve().parent
    known = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if str(root.parent) in known or app in _shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="lumenfold-ship-")) / "lumenfold.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, f"lumenfold/{file.relative_to(root)}")
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
