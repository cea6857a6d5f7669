"""Session settings and the shared folder for files that must outlive one executor."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_FOLDERS: dict[str, list[str]] = {}


def local_session(app: str = "pulseloom", cpus: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    Only a local session may leave that unset; it gets a temporary folder that goes with the process.  On a cluster the
    machines don't share a temporary folder, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="pulseloom-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    folder = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    _FOLDERS.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return folder


def _delete(spark: SparkSession, folders: list[str]) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> int:
    """Delete the folders that this session's steps have written, once their results are no longer read."""
    folders = _FOLDERS.pop(spark.sparkContext.applicationId, [])
    _delete(spark, folders)
    return len(folders)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Folders that are written inside the block go at its end, except for the tables that the given function writes.

    So a step's intermediate tables take room only until its result is there.  The result must be written inside the block.
    """
    folders = _FOLDERS.setdefault(spark.sparkContext.applicationId, [])
    before, kept = len(folders), []

    def keep(df: DataFrame) -> DataFrame:
        written = materialise(df)
        kept.append(folders[-1])
        return written

    try:
        yield keep
    finally:
        own = folders[before:]
        folders[before:] = kept
        _delete(spark, [f for f in own if f not in kept])


def materialise(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back: lineage ends, columns can still be pruned."""
    path = f"{shared_folder(df.sparkSession)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
