"""Switching task: anticipatory and reactive looks per subject, wide by block."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialops.functions.looks import Screen, numbered_area
from trialops.operators import anticipation as looks
from trialops.operators.detect import EYES, Detection, detect_fixations
from trialops.operators.fixations import reduce_fixations
from trialops.operators.reshape import pivot_wide
from trialops.sources import schemas
from trialops.sources.delimited import read_gaze, stack
from trialops.sources.sinks import write_table

KEYS = ["subject", "block", "trial"]
BLOCKS = ("block1", "block2")
PERIODS = ("anticipatory", "reactive")
# Measures of the wide report.
MEASURES = (
    "anticipations_count_variable",
    "correct_anticipations",
    "correct_reactive",
    "fix_mean_correct_anticipation",
    "fix_mean_correct_reactive",
    "fix_mean_incorrect_anticipation",
    "incorrect_anticipations",
    "trial_max_completed",
)


class Reports(NamedTuple):
    anticipations: DataFrame
    reactive: DataFrame
    short: DataFrame


def tag_block(gaze: DataFrame, block: str, side: str) -> DataFrame:
    """Mark the samples of one block and take the side column that holds its target."""
    return gaze.withColumns({"block": F.lit(block), "target_side": F.col(side)})


def read_periods(
    spark: SparkSession,
    folders: Mapping[str, Mapping[str, tuple[str, str]]],
    subject: tuple[int, int] = schemas.SWITCHING_SUBJECT,
    by_header: bool = False,
) -> DataFrame:
    """The samples of all folders as one gaze table, with ``period`` and ``block``.

    ``folders`` names, per period and block, a folder of recordings and the column of the target
    side in that block.
    """
    tables = [
        tag_block(read_gaze(spark, folder, subject, schemas.SWITCHING_COLUMNS, by_header), block, side)
        .withColumn("period", F.lit(period))
        .select("period", *KEYS, "target_side", "anticipations", "time", *[c for eye in EYES for c in eye])
        for period, blocks in folders.items()
        for block, (folder, side) in blocks.items()
    ]
    return stack(*tables)


def store_gaze(gaze: DataFrame, path: str) -> DataFrame:
    """The gaze table as Parquet by period and block: later plans read the columns and the period
    they need instead of the delimited files."""
    write_table(gaze, path, ("period", "block"))
    return gaze.sparkSession.read.schema(gaze.schema).parquet(path).select(*gaze.columns)


def segment(gaze: DataFrame, options: Detection = Detection()) -> DataFrame:
    return detect_fixations(gaze, KEYS, options)


def trial_looks(fixations: DataFrame, facts: DataFrame, screen: Screen = Screen()) -> DataFrame:
    """Total looking time per trial and area, with the facts of the file (target side, counts)."""
    labelled = fixations.withColumn("aoi", numbered_area(F.col("xpos"), F.col("ypos"), screen))
    return looks.add_facts(reduce_fixations(labelled, KEYS), facts)


def long_anticipations(fixations: DataFrame, facts: DataFrame, screen: Screen = Screen()) -> DataFrame:
    """One row per trial with a side look.  The facts ride along as keys: a file has one of each."""
    labelled = looks.label_anticipations(trial_looks(fixations, facts, screen))
    return looks.choose_anticipation(labelled, [*KEYS, *looks.FACTS])


def reduce(
    anticipatory: DataFrame,
    anticipatory_facts: DataFrame,
    reactive: DataFrame,
    reactive_facts: DataFrame,
    screen: Screen = Screen(),
) -> Reports:
    """Long and short reports from the fixations and file facts of the two periods."""
    chosen = long_anticipations(anticipatory, anticipatory_facts, screen)
    reacted = looks.label_reactive(trial_looks(reactive, reactive_facts, screen))
    joined = looks.join_reports(looks.anticipation_report(chosen), looks.reactive_report(reacted))
    return Reports(chosen, reacted, pivot_wide(joined, ["subject"], "block", MEASURES, BLOCKS))


def reduce_gaze(gaze: DataFrame, options: Detection = Detection()) -> Reports:
    """Long and short reports from the samples of both periods, ``period, subject, block, trial,
    time, left/right x/y, target_side, anticipations``.

    Per period and block the off-monitor samples are masked, fixations detected and scored against
    the facts of the recording.
    """
    periods = [gaze.filter(F.col("period") == p) for p in PERIODS]
    parts = [(segment(p, options), looks.file_facts(p)) for p in periods]
    return reduce(*parts[0], *parts[1], options.screen)
