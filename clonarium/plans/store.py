"""Scratch tables in the shared folder, and shipping of this package to Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parents[1]


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset and Spark runs on one machine a temporary folder of
    this machine is taken; on a cluster without it this raises, as executors would write to disks of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="clonarium-"))
    return sc.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/clonarium-{label}-{uuid.uuid4().hex}"


def stash(df: DataFrame, label: str, rows: int = 1000) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which cuts its lineage. Arrow batches on the way hold ``rows`` rows.

    The files outlive any executor. ``drop_stash`` removes them as soon as nothing reads them any more.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    with small_batches(spark, rows), cleaned_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of so many rows for the jobs that run inside; long texts then take little memory on either side of a worker's pipe."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def cleaned_shuffles(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside remove their shuffle files when they end. What they write is read from the shared folder, never from the shuffle."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    try:
        spark.conf.set(key, "true")
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def drop_stash(*frames: DataFrame) -> None:
    for df in frames:
        if path := getattr(df, "_stash_path", None):
            remove(df.sparkSession, path)


def share(spark: SparkSession, paths: dict[str, str]) -> dict[str, str]:
    """Copies of files of the driver's machine in the shared folder, for executors to read; on one machine the files themselves."""
    if spark.sparkContext.master.startswith("local"):
        return paths
    jvm, folder = spark.sparkContext._jvm, new_folder(spark, "files")
    fs = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(folder))
    out = {k: f"{folder}/{os.path.basename(p)}" for k, p in paths.items()}
    for k, p in paths.items():
        fs.copyFromLocalFile(jvm.org.apache.hadoop.fs.Path(f"file://{os.path.abspath(p)}"), jvm.org.apache.hadoop.fs.Path(out[k]))
    return out


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers wherever the driver was started from."""
    sc = spark.sparkContext
    if getattr(sc, "_clonarium_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="clonarium-")) / "clonarium_pkg.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, os.path.join(_PACKAGE.name, p.relative_to(_PACKAGE)))
    sc.addPyFile(str(target))
    sc._clonarium_shipped = True


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
