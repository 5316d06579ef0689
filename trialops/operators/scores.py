"""Response-time and error scores of trial tables.

Trials are first counted at the finest grain that the task needs.  That step combines on the
map side, so a subject with most of the rows is reduced before the shuffle, and every grouping
set or pivot afterwards works on the counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialops.functions.nulls import differs
from trialops.operators.medians import grouped_median, weighted_median

ERROR_MEASURES = ("n_total_trials", "n_total_errors", "n_omission_errors", "n_comission_errors")


def error_counts(acc: Column, rt: Column, omission_needs_error: bool = False) -> dict[str, Column]:
    """Aggregates: trials, errors, omissions (RT 0) and the rest, commissions.

    Omissions do not look at accuracy unless asked to, so commissions may be negative.
    """
    errors = F.count_if(acc == 0)
    omission = (acc == 0) & (rt == 0) if omission_needs_error else rt == 0
    omissions = F.count_if(omission)
    return {
        "n_total_trials": F.count(acc),
        "n_total_errors": errors,
        "n_omission_errors": omissions,
        "n_comission_errors": errors - omissions,
    }


def trial_sums(df: DataFrame, keys: Sequence[str], rt: str = "rt", acc: str = "acc", correct: int = 1) -> DataFrame:
    """Sums per cell from which means and error counts of any coarser grouping follow."""
    response = F.when(F.col(acc) == correct, F.col(rt))
    counts = error_counts(F.col(acc), F.col(rt))
    return df.groupBy(*keys).agg(
        F.sum(response).alias("rt_sum"),
        F.count(response).alias("rt_count"),
        *[counts[m].alias(m) for m in ERROR_MEASURES],
    )


def scores_by_sets(
    df: DataFrame,
    subject: str = "subject",
    block: str = "block",
    cue: str = "cue",
    flanker: str = "flanker",
    rt: str = "rt",
    acc: str = "acc",
    levels: Sequence[str] = ("subject", "block"),
    parts: bool = False,
    cells: DataFrame | None = None,
) -> DataFrame:
    """Mean RT of correct trials and error counts for cue, flanker and flanker x cue,
    per subject (``level`` 'subject') and per subject and block ('block').

    ``by`` names the grouping and ``condition`` the joined condition; ``target_rt`` is missing
    where no trial is correct.  Trials without a named block count per subject only.  With
    ``parts`` the flanker and the cue that a condition is joined of follow.  ``cells`` are the
    ``trial_sums`` of the trials where they are known already.
    """
    cells = trial_sums(df, [subject, block, cue, flanker], rt, acc) if cells is None else cells
    sums = [F.sum(m).alias(m) for m in ("rt_sum", "rt_count", *ERROR_MEASURES)]
    s, b, c, f = (F.col(x) for x in (subject, block, cue, flanker))
    per_level = {"subject": [[s, c], [s, f], [s, f, c]], "block": [[s, b, c], [s, b, f], [s, b, f, c]]}
    sets = [keys for level in levels for keys in per_level[level]]
    by_block, by_cue, by_flanker = F.grouping(b) == 0, F.grouping(c) == 0, F.grouping(f) == 0
    grouped = cells.groupingSets(sets, s, b, c, f).agg(
        *sums,
        by_block.alias("by_block"),
        by_cue.alias("by_cue"),
        by_flanker.alias("by_flanker"),
    )
    condition = F.concat_ws("_", F.when(F.col("by_flanker"), f), F.when(F.col("by_cue"), c))
    complete = (
        (~F.col("by_block") | b.isNotNull())
        & (~F.col("by_cue") | c.isNotNull())
        & (~F.col("by_flanker") | f.isNotNull())
        & s.isNotNull()
    )
    return grouped.filter(complete).select(
        s,
        F.when(F.col("by_block"), "block").otherwise("subject").alias("level"),
        F.when(~F.col("by_cue"), "flanker")
        .when(~F.col("by_flanker"), "cue")
        .otherwise("flanker_cue")
        .alias("by"),
        b,
        condition.alias("condition"),
        F.try_divide("rt_sum", "rt_count").alias("target_rt"),
        *ERROR_MEASURES,
        *([f, c] if parts else []),
    )


def mean_and_median(df: DataFrame, keys: list[str], value: str, prefix: str) -> DataFrame:
    """Mean and exact median per group, ``<prefix>_mean`` and ``<prefix>_median``."""
    v, n = F.col(value), F.col("copies")
    sums = {"value_sum": v * n, "value_count": F.when(v.isNotNull(), n)}
    scores = grouped_median(df, keys, value, f"{prefix}_median", sums)
    return scores.select(
        *keys, F.try_divide("value_sum", "value_count").alias(f"{prefix}_mean"), f"{prefix}_median"
    )


def touch_cells(
    df: DataFrame, keys: list[str], rt: str = "rt", acc: str = "acc", correct: int = 1, touches: str | None = None
) -> DataFrame:
    """Median RT of correct trials and error counts per group, in one pass over the trials.

    Trials without ``rt`` and ``acc`` count for nothing but ``anticipations``, the trials with an
    anticipatory touch, given with ``touches``.
    """
    anticipated = [F.count_if(differs(F.col(touches), 0)).alias("anticipations")] if touches else []
    counted = df.groupBy(*keys, rt, acc).agg(F.count(F.lit(1)).alias("copies"), *anticipated)
    n, right = F.col("copies"), F.col(acc) == correct

    def count_of(condition: Column) -> Column:
        return F.sum(F.when(condition, n).otherwise(0))

    errors, omissions = count_of(F.col(acc) == 0), count_of(F.col(rt) == 0)
    return counted.groupBy(*keys).agg(
        weighted_median(F.when(right, F.col(rt)), n).alias("median_rt"),
        count_of(F.col(acc).isNotNull()).alias("number_trials"),
        errors.alias("number_errors"),
        omissions.alias("number_errors_omission"),
        (errors - omissions).alias("number_errors_commission"),
        *[F.sum("anticipations").alias("anticipations") for _ in anticipated],
    )


def anticipation_counts(df: DataFrame, keys: list[str], touches: str = "anticipated_count") -> DataFrame:
    """Trials with an anticipatory touch; an unrecorded count is counted as one."""
    return df.groupBy(*keys).agg(F.count_if(differs(F.col(touches), 0)).alias("anticipations"))
