"""Row selection and repair of trial tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialops.functions.looks import Screen, off_monitor
from trialops.functions.nulls import is_true, nan_to_null, strict_int

# Responses up to this many ms are anticipatory; 0 means no response.
ANTICIPATORY_MS = 200
BLOCK_NAMES = {1: "block1", 2: "block2", 3: "block3", 4: "block4"}


def strict_cast(df: DataFrame, columns: list[str], on_null: str = "fail", kind: str = "int") -> DataFrame:
    """Integer columns; a missing value fails the job, or drops the row with ``on_null='drop'``."""
    if on_null == "drop":
        df = df.dropna(subset=columns)
        return df.withColumns({c: F.col(c).cast(kind) for c in columns})
    return df.withColumns({c: strict_int(c, kind) for c in columns})


def complete_trials(df: DataFrame, columns: list[str], integers: list[str]) -> DataFrame:
    """Listed columns, complete rows only, integers cast."""
    rows = df.select(*columns).dropna()
    return rows.withColumns({c: F.col(c).cast("int") for c in integers})


def drop_anticipatory(df: DataFrame, rt: str = "rt") -> DataFrame:
    """Keep responses slower than 200 ms and missing responses (RT 0)."""
    return df.filter((F.col(rt) > ANTICIPATORY_MS) | (F.col(rt) == 0))


def correct_only(df: DataFrame, acc: str = "acc", correct: int = 1) -> DataFrame:
    return df.filter(F.col(acc) == correct)


def valid_go(df: DataFrame, trial_type: str, rt: str, acc: str) -> DataFrame:
    """Correct, non-anticipatory Go trials."""
    return df.filter(is_valid_go(trial_type, rt, acc))


def is_valid_go(trial_type: str, rt: str, acc: str) -> Column:
    return (F.col(trial_type) == "Go") & (F.col(rt) > ANTICIPATORY_MS) & (F.col(acc) == 1)


def stop_trials(df: DataFrame, trial_type: str) -> DataFrame:
    return df.filter(is_stop(trial_type))


def is_stop(trial_type: str) -> Column:
    return F.col(trial_type) == "StopSignal"


def name_blocks(block: Column, names: dict = BLOCK_NAMES) -> Column:
    """Block names by number; other blocks have no name."""
    label = F.lit(None).cast("string")
    for number, name in names.items():
        label = F.when(block == number, name).otherwise(label)
    return label


def settle_pretarget(
    df: DataFrame,
    trial_type: str = "TrialType",
    pre_rt: str = "PreTarget_RT",
    target_rt: str = "Target_RT",
    pre_acc: str = "PreTarget_ACC",
) -> DataFrame:
    """Pre-target responses count in stop trials only; where there was one it is the response.

    Whether there was one is read from the recorded value, the response from the settled one: a
    Go trial with a pre-target response ends with RT 0.  A missing record counts as a response.
    """
    stop = is_true(F.col(trial_type) == "StopSignal")
    silent = is_true(F.col(pre_rt) == 0)
    settled = F.when(stop, F.col(pre_rt)).otherwise(0)
    return df.withColumns(
        {
            pre_rt: settled,
            target_rt: F.when(silent, F.col(target_rt)).otherwise(settled),
            pre_acc: F.when(stop, F.col(pre_acc)).otherwise(1),
        }
    )


def relative_time(df: DataFrame, stamp: str = "TIMESTAMP", start: str = "TRIAL_START_TIME", name: str = "TIME") -> DataFrame:
    return df.withColumn(name, F.col(stamp) - F.col(start))


def mask_off_monitor(
    df: DataFrame,
    eyes: tuple[tuple[str, str], ...] = (("LEFT_GAZE_X", "LEFT_GAZE_Y"), ("RIGHT_GAZE_X", "RIGHT_GAZE_Y")),
    screen: Screen = Screen(),
    missing: float | None = None,
) -> DataFrame:
    """Both coordinates of an eye become ``missing`` when the eye is off the monitor."""
    columns = {}
    for x, y in eyes:
        off = off_monitor(nan_to_null(F.col(x)), nan_to_null(F.col(y)), screen)
        for name in (x, y):
            columns[name] = F.when(off, F.lit(missing).cast("double")).otherwise(nan_to_null(F.col(name)))
    return df.withColumns(columns)


def drop_early_latencies(df: DataFrame, latency: str, threshold_ms: float) -> DataFrame:
    """Drop latencies below the threshold; rows without a latency stay."""
    return df.filter(F.col(latency).isNull() | (F.col(latency) >= threshold_ms))


def drop_central(df: DataFrame, area: str = "aoi") -> DataFrame:
    """Drop looks in no area and in the central one."""
    return df.filter(F.col(area).isNotNull() & (F.col(area) != 0))


def text_trial_number(column: Column) -> Column:
    """12 from ``Trial012``; a number that is no int fails."""
    return F.substr(column, F.lit(6)).cast("int")


def drop_practice(df: DataFrame, trial: str = "trial_recoded", last_practice: int = 12) -> DataFrame:
    return df.filter(F.col(trial) > last_practice)
