"""Fixation tables: trial bounds, last and first fixations, latencies, reduction by area."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialops.functions.looks import trial_filter
from trialops.operators.medians import median_of_counts
from trialops.operators.reshape import extreme_rows, last_of
from trialops.session import shared_table

TRIAL = ("subject", "trial")
LATENCY = "saccade_latency"
END_WINDOW_MS = 200  # fixed value: length of the period at the end of the central stimulus


def sample_bounds(gaze: DataFrame, keys=TRIAL, time: str = "time") -> DataFrame:
    """First and last sample time of every trial."""
    return gaze.groupBy(*keys).agg(F.min(time).alias("first_time"), F.max(time).alias("last_time"))


def target_side(gaze: DataFrame, keys=TRIAL, side: str = "side", time: str = "time") -> DataFrame:
    """Sides shown in a trial, joined in order of appearance."""
    shown = gaze.groupBy(*keys, side).agg(F.min(time).alias("since"))
    in_order = F.array_sort(F.collect_list(F.struct("since", F.col(side).alias("side"))))
    joined = F.array_join(F.transform(in_order, lambda x: x["side"]), "")
    return shown.filter(F.col(side).isNotNull()).groupBy(*keys).agg(joined.alias("target_pos"))


def last_fixation(
    fixations: DataFrame, bounds: DataFrame, keys=TRIAL, start: str = "start_t", end: str = "end_t",
    tolerance_ms: float = 0.0,
) -> DataFrame:
    """Last fixation of a trial against the end of the trial, with the inclusion flag.

    A trial is included when the fixation ends with the trial, excluded when it ends earlier.
    """
    complete = fixations.filter(F.col(start).isNotNull() & F.col(end).isNotNull())
    last = last_of(complete, keys, start, end)
    gap = F.col("last_time") - F.col(end)
    return last.join(bounds.select(*keys, "last_time"), list(keys)).select(
        *keys,
        gap.alias("gap"),
        (F.col("last_time") - END_WINDOW_MS).alias("window_start"),
        F.col("last_time").alias("window_end"),
        start,
        end,
        trial_filter(gap, tolerance_ms).alias("trial_filter"),
    )


def trial_counts(last: DataFrame, subject: str = "subject", trial: str = "trial", parity: bool = False) -> DataFrame:
    """Excluded and total trials per subject; with ``parity`` only subjects with exclusions."""
    counts = last.groupBy(subject).agg(
        F.count_if(F.col("gap") > 0).alias("excluded"), F.countDistinct(trial).alias("total_trials")
    )
    return counts.filter("excluded > 0") if parity else counts


def first_correct(
    fixations: DataFrame, bounds: DataFrame, keys=TRIAL, keep: Sequence[str] = (), start: str = "start_t",
    flag: str = "fix_target_correct",
) -> DataFrame:
    """First fixation on the target in each trial, and its latency from the trial's first sample.

    The earliest start comes from an aggregate, which combines before the shuffle, and the ``keep``
    columns from the rows that reach it, instead of from sorting whole trials.
    """
    hits = fixations.filter(F.col(flag) == 1)
    if keep:
        first = extreme_rows(hits, keys, start, list(keep))
    else:
        first = hits.groupBy(*keys).agg(F.min(start).alias(start))
    onset = bounds.select(*keys, "first_time")
    return first.join(onset, list(keys)).withColumn(LATENCY, F.col(start) - F.col("first_time"))


def with_latency(last: DataFrame, latencies: DataFrame, keys=TRIAL) -> DataFrame:
    """The trials of ``last`` with the latency of their first look at the target, if there was one."""
    return last.join(latencies.select(*keys, LATENCY), list(keys), "left")


def latency_scores(
    last: DataFrame,
    latencies: DataFrame,
    threshold_ms: float,
    groups: list[str] | None = None,
    keys=TRIAL,
    share: bool = False,
) -> DataFrame:
    """Median latency, valid trials, trials with and without a look at the target, and the
    excluded and total trials.

    Valid trials are included ones whose latency, if any, reaches the threshold.  Trials are
    counted once by group, validity and latency, and all scores follow from those counts.  The counts
    are used several times; with ``share`` they are stored at once, so that fixations and samples
    are planned and read a single time.
    """
    groups = groups or ["subject"]
    latency, n = F.col(LATENCY), F.col("copies")
    valid = (F.col("trial_filter") == 1) & (latency.isNull() | (latency >= threshold_ms))
    trials = with_latency(last, latencies, keys).select(
        *groups,
        F.coalesce(valid, F.lit(False)).alias("valid"),
        (F.col("gap") > 0).alias("excluded"),
        F.when(valid, latency).alias(LATENCY),
    )
    counted = trials.groupBy(*groups, "valid", "excluded", LATENCY).agg(F.count(F.lit(1)).alias("copies"))
    if share:
        counted = shared_table(counted, "latencies")
    scores = median_of_counts(
        counted,
        groups,
        LATENCY,
        "median_latency",
        {
            "valid_trials": F.when(F.col("valid"), n).otherwise(0),
            "no_disengagement": F.when(F.col("valid") & latency.isNull(), n).otherwise(0),
            "disengagement": F.when(latency.isNotNull(), n).otherwise(0),
            "excluded_trials": F.when(F.col("excluded"), n).otherwise(0),
            "total_trials": n,
        },
    )
    return scores.filter("valid_trials > 0")


def reduce_fixations(
    fixations: DataFrame, keys: list[str], area: str = "aoi", dur: str = "dur", start: str = "start_t", end: str = "end_t"
) -> DataFrame:
    """Total and mean duration, first start and last end per trial and area."""
    return fixations.groupBy(*keys, area).agg(
        F.coalesce(F.sum(dur), F.lit(0.0)).alias("sum_fix"),
        F.mean(dur).alias("mean_fix"),
        F.min(start).alias("min_start_time"),
        F.max(end).alias("max_end_time"),
    )
