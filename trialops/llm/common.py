"""Helpers that several operators share."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialops.session import shared_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the folder all executors share and read it back.

    Lost executors cost only the tasks that ran on them, and every later use reads the file.  The
    files are removed when the application ends.
    """
    return shared_table(df, name, *partition_by)


#: Bits that tell which values a scan keeps; sent to all tasks, 8 MB at most.
KEPT_BITS = 26


def kept_bits(values: DataFrame, column: str) -> np.ndarray:
    """A bit per remainder of a 64-bit hash, 1 for all ``values`` and for a few others.

    Rows that a join would drop are left out with it before they are shuffled; the join still decides.
    """
    value = F.col(column)
    word = F.shiftright(F.pmod(value, F.lit(1 << KEPT_BITS)), 6)
    bit = F.element_at(F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)]), (F.pmod(value, F.lit(64)) + 1).cast("int"))
    found = values.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(1 << (KEPT_BITS - 6), np.int64)
    bits[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return bits.view(np.uint64)


def among(values: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which of ``values`` have their bit."""
    place = values & ((1 << KEPT_BITS) - 1)
    return (bits[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Steps that run inside hand texts to Python at most so many rows at a time, and hold fewer at once on both sides."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def free_name(name: str, df: DataFrame) -> str:
    """``name``, with signs behind it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that no one refers to any more."""
    for _ in range(2):  # the driver's objects first, then what only they referred to
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
