"""Reduction of exported area visits of the sequence task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialops.functions import screens
from trialops.functions.nulls import strict_total
from trialops.operators.clean import drop_practice

TYPES = ("ambiguous", "unambiguous")
BLOCKS = ("block1", "block2")
COUNTS = ("valid_correct_anticipation", "valid_incorrect_anticipation", "reactive")


def right_eye(df: DataFrame, eye: str = "eye") -> DataFrame:
    return df.filter(F.col(eye) == "Right")


def label_visits(df: DataFrame) -> DataFrame:
    """All row labels of ``trial, stimulus, aoi, aoi_group, entry_ms`` visits."""
    area, entry = F.col("aoi"), F.col("entry_ms")
    stimulus, group = F.col("stimulus"), F.col("aoi_group")
    return (
        df.withColumns(
            {
                "position": screens.stimulus_position(area),
                "trial_type": screens.trial_type(area),
                "trial_recoded": screens.trial_recoded(F.col("trial")),
                "reactive": screens.reactive(area, entry),
                "trial_raw": screens.trial_raw(F.col("trial")),
            }
        )
        .withColumn("subtrial", screens.subtrial(F.col("trial_raw")))
        .withColumn("previous_position", screens.previous_position(F.col("position"), F.col("subtrial")))
        .withColumns(
            {
                "correct_anticipation": screens.correct_anticipation(stimulus, area, group, entry),
                "incorrect_anticipation": screens.incorrect_anticipation(
                    stimulus, area, group, entry, F.col("previous_position")
                ),
            }
        )
    )


def looking_times(visits: DataFrame, fixation_ms: str = "fix_ms") -> DataFrame:
    """Fixation time by kind of look per participant, trial and trial type; 0 without looks."""
    correct, incorrect, reactive = (
        F.col(c) == 1 for c in ("correct_anticipation", "incorrect_anticipation", "reactive")
    )

    def time_of(condition):
        return F.coalesce(F.sum(F.when(condition, F.col(fixation_ms))), F.lit(0.0))

    present = visits.filter(F.col("participant").isNotNull())
    return present.groupBy("participant", "trial_recoded", "trial_type").agg(
        time_of(correct & ~incorrect & ~reactive).alias("correct_anticipation_time"),
        time_of(incorrect & ~correct & ~reactive).alias("incorrect_anticipation_time"),
        time_of(reactive & ~correct & ~incorrect).alias("reactive_time"),
    )


def validate_anticipations(times: DataFrame, min_ms: float = 100.0) -> DataFrame:
    """Longer kind of look per trial, ignored when the two differ by less than ``min_ms``,
    and valid when the stimulus itself was looked at for longer than ``min_ms``."""
    correct, incorrect = F.col("correct_anticipation_time"), F.col("incorrect_anticipation_time")
    apart = F.abs(correct - incorrect)
    flags = times.withColumns(
        {
            "difference_between_fixations": apart,
            "correct_anticipation": F.when((correct > incorrect) & (apart >= min_ms), 1).otherwise(0),
            "incorrect_anticipation": F.when((correct < incorrect) & (apart >= min_ms), 1).otherwise(0),
            "reactive": F.when(F.col("reactive_time") > min_ms, 1).otherwise(0),
            "block": screens.block(F.col("trial_recoded")),
        }
    )
    return flags.withColumns(
        {
            "valid_correct_anticipation": F.col("reactive") * F.col("correct_anticipation"),
            "valid_incorrect_anticipation": F.col("reactive") * F.col("incorrect_anticipation"),
        }
    )


def count_anticipations(trials: DataFrame) -> DataFrame:
    """Valid anticipations and reactive looks after practice, wide by type and by type x block.

    Totals need both types.  One aggregate per participant gives all columns.
    """
    after = drop_practice(trials)
    cells = after.groupBy("participant", "trial_type", "block").agg(*[F.sum(m).alias(m) for m in COUNTS])
    kind, block = F.col("trial_type"), F.col("block")
    wide = [
        F.sum(F.when(kind == t, F.col(m))).alias(f"{m}_{t}") for m in COUNTS for t in TYPES
    ] + [
        F.sum(F.when((kind == t) & (block == b), F.col(m))).alias(f"{m}_{t}_{b}")
        for m in COUNTS
        for t in TYPES
        for b in BLOCKS
    ]
    scores = cells.groupBy("participant").agg(*wide)
    totals = {f"{m}_total": strict_total([F.col(f"{m}_{t}") for t in TYPES]) for m in COUNTS}
    for block_name in BLOCKS:
        for m in COUNTS:
            totals[f"{m}_total_{block_name}"] = strict_total([F.col(f"{m}_{t}_{block_name}") for t in TYPES])
    return scores.withColumns(totals)


def counts_by_sets(trials: DataFrame) -> DataFrame:
    """The same counts in long form: per type, and per type and block (``level``)."""
    after = drop_practice(trials)
    cells = after.groupBy("participant", "trial_type", "block").agg(*[F.sum(m).alias(m) for m in COUNTS])
    p, t, b = F.col("participant"), F.col("trial_type"), F.col("block")
    grouped = cells.groupingSets([[p, t], [p, t, b]], p, t, b).agg(
        F.when(F.grouping(b) == 0, "block").otherwise("total").alias("level"), *[F.sum(m).alias(m) for m in COUNTS]
    )
    return grouped.select(p, t, b, "level", *COUNTS)
