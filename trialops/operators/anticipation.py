"""Anticipatory and reactive looks of the switching task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialops.functions.looks import side_differs, side_matches
from trialops.functions.nulls import is_true, sum_or_zero

FILE = ("subject", "block")
FACTS = ("position", "anticipations_count_variable", "trial_max_completed")


def file_facts(
    gaze: DataFrame, keys=FILE, side: str = "target_side", count: str = "anticipations", trial: str = "trial"
) -> DataFrame:
    """Target side, recorded anticipations and last trial of each file.

    Samples are first counted per side, in a hash table: the greatest of a text would be found by
    sorting them.  A file has few sides.
    """
    sides = gaze.groupBy(*keys, side).agg(F.max(count).alias("count"), F.max(trial).alias("trial"))
    return sides.groupBy(*keys).agg(
        F.array_max(F.collect_set(side)).alias("position"),
        F.max("count").alias("anticipations_count_variable"),
        F.max("trial").alias("trial_max_completed"),
    )


def add_facts(reduced: DataFrame, facts: DataFrame, keys=FILE) -> DataFrame:
    """Facts of each file on its rows; files without facts have none.

    Reduced rows are few per file, a row per trial and area, so they are joined as they are; rows that
    are not reduced yet take ``joins.lookup``, which counts them first.
    """
    return reduced.join(facts, list(keys), "left")


def label_anticipations(df: DataFrame, area: str = "aoi", side: str = "position") -> DataFrame:
    """1 or NULL for looks at the coming side and at the other side."""
    return df.withColumns(
        {
            "correct_anticipation": F.when(side_matches(F.col(area), F.col(side)), 1),
            "incorrect_anticipation": F.when(side_differs(F.col(area), F.col(side)), 1),
        }
    )


def choose_anticipation(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per trial with a side look; of two looks the longer one counts, a tie leaves both.

    The two looks of a trial meet in one conditional aggregate, which needs no self join.
    """
    measures = [c for c in ("sum_fix", "mean_fix", "min_start_time", "max_end_time") if c in df.columns]
    looks = df.filter((F.col("correct_anticipation") == 1) | (F.col("incorrect_anticipation") == 1))
    cells = [
        F.max(F.when(F.col(f"{kind}_anticipation") == 1, F.col(m))).alias(f"{m}_{kind}")
        for kind in ("correct", "incorrect")
        for m in measures
    ]
    trials = looks.groupBy(*keys).agg(
        *cells,
        F.max("correct_anticipation").alias("correct_anticipation"),
        F.max("incorrect_anticipation").alias("incorrect_anticipation"),
    )
    both = is_true((F.col("correct_anticipation") == 1) & (F.col("incorrect_anticipation") == 1))
    correct, incorrect = F.col("sum_fix_correct"), F.col("sum_fix_incorrect")
    return trials.withColumns(
        {
            "correct_anticipation": F.when(both & is_true(correct < incorrect), 0).otherwise(
                F.col("correct_anticipation")
            ),
            "incorrect_anticipation": F.when(both & is_true(correct > incorrect), 0).otherwise(
                F.col("incorrect_anticipation")
            ),
        }
    )


def label_reactive(df: DataFrame, area: str = "aoi", side: str = "position") -> DataFrame:
    """1 for looks at the stimulus, else 0."""
    hit = is_true(side_matches(F.col(area), F.col(side)))
    return df.withColumn("correct_reactive", F.when(hit, 1).otherwise(0))


def reactive_counts(df: DataFrame, keys=FILE) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("correct_reactive").alias("n_reactive"))


def anticipation_report(chosen: DataFrame, keys=FILE) -> DataFrame:
    """Anticipations per file, with its facts."""
    return chosen.groupBy(*keys, *FACTS).agg(
        sum_or_zero(F.col("correct_anticipation")).alias("correct_anticipations"),
        sum_or_zero(F.col("incorrect_anticipation")).alias("incorrect_anticipations"),
        F.mean("sum_fix_correct").alias("fix_mean_correct_anticipation"),
        F.mean("sum_fix_incorrect").alias("fix_mean_incorrect_anticipation"),
    )


def reactive_report(labelled: DataFrame, keys=FILE) -> DataFrame:
    """Looks at the stimulus per file, with its side and last trial."""
    return labelled.groupBy(*keys, "position", "trial_max_completed").agg(
        sum_or_zero(F.col("correct_reactive")).alias("correct_reactive"),
        F.mean("sum_fix").alias("fix_mean_correct_reactive"),
    )


def join_reports(anticipations: DataFrame, reactive: DataFrame, keys=FILE) -> DataFrame:
    """Files with both reports that agree on side and last trial."""
    return anticipations.join(reactive, [*keys, "position", "trial_max_completed"])
