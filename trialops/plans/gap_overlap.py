"""Gap-overlap task: latency and disengagement scores per subject."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialops.functions.looks import Screen, central_area, on_target, target_area, target_flags
from trialops.functions.nulls import ratio, strict_total
from trialops.operators.detect import Detection, detect_fixations
from trialops.operators.fixations import (
    first_correct,
    last_fixation,
    latency_scores,
    sample_bounds,
    target_side,
)
from trialops.operators.reshape import pivot_wide

KEYS = ["subject", "condition", "trial"]
CONDITIONS = {"overlap": "Overlap", "gap": "Gap"}
# Names of the scores per condition.
MEASURES = {
    "median_latency": "median_SaccLat_StartFix_StartTrial",
    "valid_trials": "total_ValidTrials",
    "no_disengagement": "total_NoDisengagement",
    "disengagement": "total_Disengagement",
}
THRESHOLD_MS = 120.0


class Period(NamedTuple):
    """Fixations and trial bounds of one period, both keyed by subject, condition and trial."""

    fixations: DataFrame
    bounds: DataFrame


def period(gaze: DataFrame, options: Detection = Detection(), with_side: bool = False) -> Period:
    """Segment ``subject, condition, trial, time, left/right x/y (, side)`` samples."""
    fixations = detect_fixations(gaze, KEYS, options)
    if with_side:
        fixations = fixations.join(target_side(gaze, KEYS), KEYS, "left")
    return Period(fixations, sample_bounds(gaze, KEYS))


def central(stimulus: Period, screen: Screen = Screen(), tolerance_ms: float = 0.0) -> DataFrame:
    """Last fixation of each central period, with the inclusion flag."""
    return last_fixation(stimulus.fixations, stimulus.bounds, KEYS, tolerance_ms=tolerance_ms)


def label_central(fixations: DataFrame, screen: Screen = Screen()) -> DataFrame:
    return fixations.withColumn("aoi", central_area(F.col("xpos"), F.col("ypos"), screen))


def label_target(fixations: DataFrame, screen: Screen = Screen(), strict_parity: bool = False) -> DataFrame:
    labelled = fixations.withColumn("aoi", target_area(F.col("xpos"), F.col("ypos"), screen))
    return labelled.withColumns(target_flags(F.col("target_pos"), F.col("aoi"), strict_parity))


def target_hits(fixations: DataFrame, screen: Screen = Screen()) -> DataFrame:
    """Fixations on the target only, flagged as such."""
    hits = fixations.filter(on_target(F.col("target_pos"), F.col("xpos"), F.col("ypos"), screen))
    return hits.withColumn("fix_target_correct", F.lit(1))


def reduce(
    central_period: Period,
    target_period: Period,
    threshold_ms: float = THRESHOLD_MS,
    screen: Screen = Screen(),
    tolerance_ms: float = 0.0,
    parity_totals: bool = False,
    share: bool = True,
) -> DataFrame:
    """Scores of subjects with valid trials in both conditions.

    ``parity_totals`` leaves the totals of subjects without excluded trials empty.  With ``share``
    the counted latencies are stored at once and the scores read those alone.
    """
    last = central(central_period, screen, tolerance_ms)
    latencies = first_correct(target_hits(target_period.fixations, screen), target_period.bounds, KEYS)
    scores = latency_scores(last, latencies, threshold_ms, ["subject", "condition"], KEYS, share)
    return combine(scores, parity_totals)


def combine(scores: DataFrame, parity_totals: bool = False) -> DataFrame:
    """Both conditions side by side, with totals and proportions."""
    over, gap = CONDITIONS.values()
    named = F.create_map(*[F.lit(v) for pair in CONDITIONS.items() for v in pair])[F.col("condition")]
    if parity_totals:
        scores = scores.withColumn("total_trials", F.when(F.col("excluded_trials") > 0, F.col("total_trials")))
    wide = pivot_wide(scores, ["subject"], named, {**MEASURES, "total_trials": "trials"}, (over, gap))
    both = wide.filter(F.col(f"total_ValidTrials_{over}").isNotNull() & F.col(f"total_ValidTrials_{gap}").isNotNull())
    both = both.withColumnsRenamed({f"trials_{gap}": "Total_GapTrials", f"trials_{over}": "Total_OverlapTrials"})
    valid = {c: F.col(f"total_ValidTrials_{c}") for c in (over, gap)}
    left = {c: F.col(f"total_Disengagement_{c}") for c in (over, gap)}
    all_trials = strict_total([F.col("Total_GapTrials"), F.col("Total_OverlapTrials")])
    all_valid = strict_total([valid[over], valid[gap]])
    latency = MEASURES["median_latency"]
    return both.withColumns(
        {
            "Total_Trials": all_trials,
            "Total_ValidTrials": all_valid,
            "index": ratio(F.col(f"{latency}_{over}"), F.col(f"{latency}_{gap}")),
            "prop_Disengagement_Over": ratio(left[over], valid[over]),
            "prop_Disengagement_Gap": ratio(left[gap], valid[gap]),
            "prop_Disengagement_Total": ratio(left[over] + left[gap], all_valid),
            "prop_valid_Total": ratio(all_valid, all_trials),
            "prop_valid_Gap_Total": ratio(valid[gap], F.col("Total_GapTrials")),
            "prop_valid_Overlap_Total": ratio(valid[over], F.col("Total_OverlapTrials")),
        }
    )
