"""Session helpers."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Where scratch paths are noted while ``scratch_paths`` is open.
_NOTED: ContextVar[list[str] | None] = ContextVar("scratch_paths", default=None)


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A small local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("trialops")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as named by the session.

    Only where the session names none on a local master is a temporary folder set.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder is None:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else None
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="trialops-checkpoint-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder whose files are removed when the application ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid4().hex}"
    files, place = _place(spark, path)
    files.deleteOnExit(place)
    noted = _NOTED.get()
    if noted is not None:
        noted.append(path)
    return path


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


@contextmanager
def scratch_paths() -> Iterator[list[str]]:
    """The scratch paths that are made inside, in order."""
    before = _NOTED.set([])
    try:
        yield _NOTED.get()
    finally:
        _NOTED.reset(before)


def remove_scratch(spark: SparkSession, *paths: str) -> None:
    """Remove scratch paths that no result reads any more before the application ends."""
    for path in paths:
        files, place = _place(spark, path)
        files.delete(place, True)
        files.cancelDeleteOnExit(place)


def shared_table(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Store an intermediate result as Parquet in the shared folder, so that several results read it.

    Runs at once.  The files are removed when the application ends, or by ``discard``.
    """
    path = scratch_path(df.sparkSession, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path, compression="zstd")
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables as ``shared_table`` gave them, once all that is read from them is stored."""
    for table in tables:
        remove_scratch(table.sparkSession, table._scratch_path)
