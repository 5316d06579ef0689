"""Coded events with onset and offset, cut at the first interruption of the session.

Long form: ``file, stream, code, onset, offset``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialops.functions.nulls import INFINITY
from trialops.operators.joins import spread_join

APPROACH = "A"  # fixed value: code of approaching a toy


def merged_event(first: Column, second: Column, blank: str = ".") -> Column:
    return F.coalesce(first, second, F.lit(blank))


def to_intervals(coded: DataFrame, streams: dict[str, tuple[str, str, str]], file: str = "file") -> DataFrame:
    """Side-by-side event columns to one row per event; ``streams`` maps a stream to its
    (code, onset, offset) columns.  One scan, no union."""
    events = F.array(
        *[
            F.struct(
                F.lit(stream).alias("stream"),
                F.col(f"`{code}`").cast("string").alias("code"),
                F.col(f"`{onset}`").cast("double").alias("onset"),
                F.col(f"`{offset}`").cast("double").alias("offset"),
            )
            for stream, (code, onset, offset) in streams.items()
        ]
    )
    return coded.select(file, F.inline(events)).filter(F.col("onset").isNotNull())


def first_interruption(df: DataFrame, file: str = "file", onset: str = "onset") -> DataFrame:
    """Onset of the first interruption per file, +inf where there is none."""
    first = F.coalesce(F.min(onset), F.lit(INFINITY))
    return df.groupBy(file).agg(first.alias("first_irruption_onset"))


def cut_at_interruption(events: DataFrame, files: DataFrame, file: str = "file") -> DataFrame:
    """Events that start before the ``first_irruption_onset`` of their file, ending with it at
    the latest.  ``files`` has a row per file; a file may hold most of the events."""
    joined = spread_join(events, files, file)
    clamped = F.when(F.col("offset").isNotNull(), F.least("offset", "first_irruption_onset"))
    return joined.filter(F.col("onset") < F.col("first_irruption_onset")).withColumn("offset", clamped)


def with_duration(events: DataFrame) -> DataFrame:
    return events.withColumn("duration", F.col("offset") - F.col("onset"))


def time_per_code(events: DataFrame, file: str = "file") -> DataFrame:
    """Total duration and first onset of each code."""
    coded = events.filter(F.col("code").isNotNull())
    return coded.groupBy(file, "stream", "code").agg(
        F.coalesce(F.sum("duration"), F.lit(0.0)).alias("total_time"), F.min("onset").alias("first_onset")
    )


def first_approach(stream: str) -> Column:
    """Aggregate: first approach to the toy of a stream, +inf without one."""
    hit = (F.col("stream") == stream) & (F.col("code") == APPROACH)
    return F.coalesce(F.min(F.when(hit, F.col("onset"))), F.lit(INFINITY))


def time_without_approach(stream: str) -> Column:
    """Aggregate: time in all codes that do not start with the approach code; NULL without codes."""
    coded = (F.col("stream") == stream) & F.col("code").isNotNull()
    other = F.when(coded & ~F.col("code").startswith(APPROACH), F.col("duration"))
    return F.when(F.count_if(coded) > 0, F.coalesce(F.sum(other), F.lit(0.0)))


def preferred(first: Column, second: Column, toy_one: Column, toy_two: Column) -> Column:
    """The toy approached first; the second one on a tie or without any approach."""
    return F.when(first < second, toy_one).otherwise(toy_two)


def toys(coded: DataFrame, file: str = "file", one: str = "toy1", two: str = "toy2") -> DataFrame:
    """Distinct toy names per file, sorted."""
    names = [F.sort_array(F.collect_set(c)).alias(c) for c in (one, two)]
    return coded.groupBy(file).agg(*names)


def wide_times(
    events: DataFrame,
    codes: dict[str, Sequence[str]],
    totals: Sequence[str],
    keys: Sequence[str] = ("file",),
    approaches: dict[str, str] | None = None,
) -> DataFrame:
    """One row per file: ``<stream>_time_<code>``, ``<stream>_total_time`` and first approaches.

    A single aggregate; ``approaches`` maps output names to streams.
    """
    cells = [
        F.sum(
            F.when((F.col("stream") == stream) & (F.col("code") == code), F.coalesce(F.col("duration"), F.lit(0.0)))
        ).alias(f"{stream}_time_{code}")
        for stream, listed in codes.items()
        for code in listed
    ]
    sums = [time_without_approach(s).alias(f"{s}_total_time") for s in totals]
    firsts = [first_approach(s).alias(name) for name, s in (approaches or {}).items()]
    return events.groupBy(*keys).agg(*cells, *sums, *firsts)
