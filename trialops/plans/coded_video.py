"""Violation-of-expectation sessions coded from video: one row per file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialops.functions.nulls import INFINITY
from trialops.operators import intervals as iv

STREAMS = {
    "Behaviour1": ("behaviour_beh1", "behaviour_onset", "behaviour_offset"),
    "Behaviour2": ("behaviour_beh2", "behaviour_onset", "behaviour_offset"),
    "Orienting": ("orienting_object", "orienting_onset", "orienting_offset"),
}
CODERS = ("Behaviour1", "Behaviour2")


def facts(coded: DataFrame) -> DataFrame:
    """First interruption and toys of each file."""
    return coded.groupBy("file").agg(
        F.coalesce(F.min("irruption_onset"), F.lit(INFINITY)).alias("first_irruption_onset"),
        F.sort_array(F.collect_set("toy1")).alias("toy1"),
        F.sort_array(F.collect_set("toy2")).alias("toy2"),
    )


def events(coded: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Long events up to the first interruption of each file, with durations and the facts."""
    known = facts(coded) if known is None else known
    return iv.with_duration(iv.cut_at_interruption(iv.to_intervals(coded, STREAMS), known))


def reduce(coded: DataFrame, behaviours: Sequence[str], objects: Sequence[str]) -> DataFrame:
    """Times per code, first approaches and the preferred toy of ``file, irruption_*, behaviour_*,
    orienting_*, toy1, toy2`` sheets.

    Files without any event before the interruption have no row.
    """
    codes = {**{s: behaviours for s in CODERS}, "Orienting": objects}
    approaches = {"Toy1_A_onset": "Behaviour1", "Toy2_A_onset": "Behaviour2"}
    kept = ["first_irruption_onset", "toy1", "toy2"]
    wide = iv.wide_times(events(coded), codes, CODERS, ["file", *kept], approaches)
    toy = iv.preferred(F.col("Toy1_A_onset"), F.col("Toy2_A_onset"), F.col("toy1"), F.col("toy2"))
    times = [c for c in wide.columns if c.startswith(("Behaviour", "Orienting"))]
    return wide.select(
        F.col("file").alias("code"), kept[0], *times, *approaches, toy.alias("Toy_preferred")
    )
