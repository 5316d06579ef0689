"""Visual sequence learning from the area export of the tracker."""

from __future__ import annotations

from pyspark.sql import DataFrame

from trialops.operators import visits as v


def trials(visits: DataFrame, min_ms: float = 100.0) -> DataFrame:
    """Validated anticipations per participant, trial and trial type (right eye)."""
    return v.validate_anticipations(v.looking_times(v.label_visits(v.right_eye(visits))), min_ms)


def reduce(visits: DataFrame, min_ms: float = 100.0) -> DataFrame:
    return v.count_anticipations(trials(visits, min_ms))
