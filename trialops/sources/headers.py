"""Folders whose files have different headers: one scan per kind of header.

A manifest job reads the first line of every file and nothing behind it; files are then grouped by
that line and each group is read with its own columns.  The plan holds as many scans as there are
kinds of headers, however many files there are.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def first_lines(spark: SparkSession, path, glob: str) -> DataFrame:
    """``file`` and ``header``, the first line that is not empty, of each file; empty files are left out.

    The job runs in a session of its own, in which a file is a task by itself and rows go to Python
    one at a time: a task stops at the first line, so that a large file costs one read buffer.
    """
    probe = spark.newSession()
    probe.conf.set("spark.sql.files.maxPartitionBytes", "1")
    probe.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    # files are not split with multiLine; no separator and no quotes, so a line is one value
    reader = probe.read.schema("line string").options(multiLine=True, sep="\x01", quote="", pathGlobFilter=glob)
    lines = reader.csv(path).select(F.col("_metadata.file_path").alias("file"), F.col("line").alias("header"))

    def first(batches):
        for batch in batches:
            if batch.column(1)[0].as_py():
                yield batch
                return

    return lines.mapInArrow(first, lines.schema)


def header_groups(spark: SparkSession, path, glob: str) -> list[list[str]]:
    """The files of each kind of header, kinds in the order of their header.

    The driver holds the names of the files, as it does for any folder that Spark reads.
    """
    kinds = first_lines(spark, path, glob).groupBy("header").agg(F.array_sort(F.collect_set("file")).alias("files"))
    return [[as_path(f) for f in kind["files"]] for kind in sorted(kinds.collect(), key=lambda k: k["header"])]


def as_path(uri: str) -> str:
    """The path of a file as readers take it: decoded, with signs of patterns escaped."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", unquote(uri))
