"""Stop-signal and Go/NoGo task: response times, errors and the cleaned trials."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialops.operators.clean import is_stop, is_valid_go, settle_pretarget, stop_trials, strict_cast, valid_go
from trialops.operators.reshape import label, pivot_wide
from trialops.operators.scores import ERROR_MEASURES, error_counts, mean_and_median

KEYS = ["Subject", "Task", "TrialType"]
# Columns that are cast to whole numbers and may not be missing.
INTEGERS = ["Subject", "FixDuration", "PreTarget_RT", "PreTarget_ACC", "Target_RT", "Target_ACC", "SubTrial"]
COLUMNS = [*KEYS, *[c for c in INTEGERS if c not in KEYS], "PreTarget_Duration"]


class Scores(NamedTuple):
    response_times: DataFrame
    errors: DataFrame
    trials: DataFrame


def clean(trials: DataFrame, on_null: str = "fail") -> DataFrame:
    return strict_cast(settle_pretarget(trials).select(*COLUMNS), INTEGERS, on_null)


def _named(df: DataFrame) -> DataFrame:
    return df.filter(F.col("Task").isNotNull() & F.col("TrialType").isNotNull())


def go_times(trials: DataFrame) -> DataFrame:
    """Mean and median RT of correct Go trials per task."""
    go = _named(valid_go(trials, "TrialType", "Target_RT", "Target_ACC"))
    return mean_and_median(go, KEYS, "Target_RT", "target_RT")


def pretarget_times(trials: DataFrame) -> DataFrame:
    """Mean and median pre-target duration of stop trials, whatever the response."""
    return mean_and_median(_named(stop_trials(trials, "TrialType")), KEYS, "PreTarget_Duration", "pretarget")


def response_times(trials: DataFrame) -> DataFrame:
    """``go_times`` and ``pretarget_times`` in one table, from one count of the trials.

    A trial is a Go or a stop trial, so each has one time: that of its response or its pre-target
    duration.  A cell has ``target_RT_mean, target_RT_median`` or ``pretarget_mean, pretarget_median``.
    """
    go, stop = is_valid_go("TrialType", "Target_RT", "Target_ACC"), is_stop("TrialType")
    time = F.when(go, F.col("Target_RT").cast("double")).when(stop, F.col("PreTarget_Duration").cast("double"))
    timed = _named(trials).filter(go | stop).select(*KEYS, time.alias("time"))
    scores = mean_and_median(timed, KEYS, "time", "time")
    cells = {f"{name}_{m}": F.when(kind, F.col(f"time_{m}")) for name, kind in (("target_RT", ~stop), ("pretarget", stop)) for m in ("mean", "median")}
    return scores.select(*KEYS, *[cell.alias(name) for name, cell in cells.items()])


def errors(trials: DataFrame) -> DataFrame:
    """Error counts per task and trial type; an omission is an error without a response."""
    counts = error_counts(F.col("Target_ACC"), F.col("Target_RT"), omission_needs_error=True)
    return _named(trials).groupBy(*KEYS).agg(
        *[counts[m].alias(m) for m in ERROR_MEASURES],
        F.count_if(F.col("PreTarget_ACC") == 0).alias("pretarget_responses"),
    )


def reduce(
    trials: DataFrame, go: Sequence[str], stop: Sequence[str], types: Sequence[str], on_null: str = "fail"
) -> Scores:
    """``go``, ``stop`` and ``types`` list the ``<task>_<type>`` names of the wide columns.

    The response-time table has the subjects with both Go and stop trials.
    """
    rows = clean(trials, on_null)
    named = label("Task", "TrialType")
    times = response_times(rows)
    columns = {"target_RT_mean": go, "target_RT_median": go, "pretarget_mean": stop, "pretarget_median": stop}
    both = [F.count("target_RT_mean").alias("go"), F.count("pretarget_mean").alias("stop")]
    wide = pivot_wide(times, ["Subject"], named, list(columns), list(dict.fromkeys([*go, *stop])), extra=both)
    times_wide = wide.filter("go > 0 AND stop > 0").select("Subject", *[f"{m}_{t}" for m, types in columns.items() for t in types])
    error_wide = pivot_wide(errors(rows), ["Subject"], named, [*ERROR_MEASURES, "pretarget_responses"], types)
    return Scores(times_wide, error_wide, rows)
