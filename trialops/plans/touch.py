"""Touchscreen tasks with two conditions (alerting, orienting, spatial conflict)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialops.functions.nulls import total
from trialops.operators.clean import ANTICIPATORY_MS, complete_trials, drop_anticipatory
from trialops.operators.reshape import pivot_wide
from trialops.operators.scores import anticipation_counts, touch_cells

SESSION = ["subject", "timestamp"]
# Names of the error columns.
ERRORS = {
    "number_errors": "errors",
    "number_errors_commission": "errors_commission",
    "number_errors_omission": "errors_omission",
    "number_trials": "total_trials",
}


def clean(trials: DataFrame) -> DataFrame:
    """Complete trials without anticipatory responses."""
    columns = ["subject", "condition", "rt", "acc", "timestamp"]
    return drop_anticipatory(complete_trials(trials, columns, ["subject", "rt", "acc"]))


def reduce(trials: DataFrame, first: str = "Alert", second: str = "NoAlert") -> DataFrame:
    """Median RT and errors per subject and session; absent conditions count 0.

    Sessions without any correct trial have no row.
    """
    return _wide(touch_cells(clean(trials), [*SESSION, "condition"]), first, second, ERRORS)


def _wide(cells: DataFrame, first: str, second: str, counts: dict[str, str]) -> DataFrame:
    medians = F.count("median_rt").alias("medians")
    measures = {"median_rt": "median_rt", **counts}
    wide = pivot_wide(cells, SESSION, "condition", measures, (first, second), extra=[medians])
    named = wide.filter("medians > 0").drop("medians").withColumnsRenamed(
        {f"median_rt_{c}": c for c in (first, second)}
    )
    filled = named.fillna(0, subset=[c for c in named.columns if c not in SESSION])
    totals = {"total_errors": "errors", "total_trials": "total_trials"}
    if "anticipations" in counts:
        totals["total_anticipations"] = "anticipations"
    return filled.withColumns(
        {name: total([F.col(f"{m}_{first}"), F.col(f"{m}_{second}")]) for name, m in totals.items()}
    )


def anticipations(trials: DataFrame, first: str = "Alert", second: str = "NoAlert") -> DataFrame:
    """Anticipatory touches per session over all recorded trials."""
    counted = anticipation_counts(trials.dropna(subset=[*SESSION, "condition"]), [*SESSION, "condition"])
    wide = pivot_wide(counted, SESSION, "condition", ["anticipations"], (first, second))
    names = [f"anticipations_{first}", f"anticipations_{second}"]
    filled = wide.fillna(0, subset=names)
    return filled.withColumn("total_anticipations", total([F.col(n) for n in names]))


def reduce_with_anticipations(trials: DataFrame, first: str = "Alert", second: str = "NoAlert") -> DataFrame:
    """``reduce`` with the touches of ``anticipations``, in one pass over the trials.

    Trials that do not enter the scores lose their response but stay for the touches.
    """
    rt, acc = F.col("rt"), F.col("acc")
    complete = rt.isNotNull() & acc.isNotNull()
    kept = complete & ((rt.cast("int") > ANTICIPATORY_MS) | (rt.cast("int") == 0))
    known = trials.dropna(subset=[*SESSION, "condition"]).withColumns(
        {
            "subject": F.col("subject").cast("int"),
            "rt": F.when(kept, rt.cast("int")),
            "acc": F.when(kept, acc.cast("int")),
        }
    )
    cells = touch_cells(known, [*SESSION, "condition"], touches="anticipated_count")
    return _wide(cells, first, second, {**ERRORS, "anticipations": "anticipations"})
