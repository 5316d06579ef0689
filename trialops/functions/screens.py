"""Labels of the exported area visits of the sequence task (one row per screen, area, eye)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trialops.functions.nulls import is_true

# Area names, stimulus names and area groups of the export.
REACTIVE_AREAS = ["DOING IT 1", "DOING IT 2", "DOING IT 3"]
CORRECT_AREAS = [
    "ANTICIPATION CORRECT 1 (POSITION 1)",
    "ANTICIPATION CORRECT 2 (POSITION 2)",
    "ANTICIPATION CORRECT 3 (POSITION 3)",
]
INCORRECT_AREAS = [
    "ANTICIPATION INCORRECT 1 (POSITION 2)",
    "ANTICIPATION INCORRECT 1 (POSITION 3)",
    "ANTICIPATION INCORRECT 2 (POSITION 1)",
    "ANTICIPATION INCORRECT 2 (POSITION 3)",
    "ANTICIPATION INCORRECT 3 (POSITION 1)",
    "ANTICIPATION INCORRECT 3 (POSITION 2)",
]
UNAMBIGUOUS_AREAS = [
    "ANTICIPATION CORRECT 1 (POSITION 1)",
    "ANTICIPATION INCORRECT 1 (POSITION 2)",
    "ANTICIPATION INCORRECT 1 (POSITION 3)",
    "DOING IT 2",
    "DOING IT 3",
]
BLACK_SCREENS = ["BlackScreen1.bmp", "BlackScreen2.bmp", "BlackScreen3.bmp"]
# Entry windows in ms, open at both ends.
BLACK_SCREEN_WINDOW = (200, 1000)
GROUP_WINDOWS = {"150ms": (0, 150), "50ms": (0, 50)}
LAST_SCREEN = 384


def stimulus_position(area: Column) -> Column:
    """Position 1-3 named by the area; 0 when it names none."""
    label = F.lit(0)
    for number in (1, 2, 3):
        named = [f"ANTICIPATION INCORRECT {number}", f"ANTICIPATION CORRECT {number}", f"DOING IT {number}"]
        hit = is_true(area.contains(named[0]) | area.contains(named[1]) | area.contains(named[2]))
        label = F.when(hit, number).otherwise(label)
    return label


def trial_type(area: Column) -> Column:
    return F.when(is_true(area.isin(UNAMBIGUOUS_AREAS)), "unambiguous").otherwise("ambiguous")


def trial_recoded(screen: Column) -> Column:
    """Six screens make a trial, counted from screen 9; later screens give 0."""
    return (
        F.when(screen < 9, 1)
        .when(screen <= LAST_SCREEN, (2 + F.floor((screen - 9) / 6)).cast("int"))
        .otherwise(0)
    )


def trial_raw(screen: Column) -> Column:
    """Six screens make a trial, counted from screen 6; later screens give 65."""
    return (
        F.when(screen < 6, 1)
        .when(screen > LAST_SCREEN, 65)
        .when(screen.isNull(), 0)
        .otherwise((1 + F.floor(screen / 6)).cast("int"))
    )


def subtrial(raw: Column) -> Column:
    """Place in the four-step sequence."""
    return F.when(raw.between(1, 65), (raw - 1) % 4 + 1).otherwise(0)


def previous_position(position: Column, step: Column) -> Column:
    """Position shown before the current one; 0 when the step does not fit the position."""
    return (
        F.when((position == 2) & (step == 2), 1)
        .when((position == 3) & (step == 4), 1)
        .when((position == 1) & (step == 3), 2)
        .when((position == 1) & (step == 1), 3)
        .otherwise(0)
    )


def reactive(area: Column, entry_ms: Column) -> Column:
    return F.when(is_true(area.isin(REACTIVE_AREAS) & (entry_ms > 0)), 1).otherwise(0)


def _entered(entry_ms: Column, window: tuple[int, int]) -> Column:
    return (entry_ms > window[0]) & (entry_ms < window[1])


def in_anticipation_window(stimulus: Column, group: Column, entry_ms: Column) -> Column:
    black = is_true(stimulus.isin(BLACK_SCREENS) & _entered(entry_ms, BLACK_SCREEN_WINDOW))
    for name, window in GROUP_WINDOWS.items():
        black |= is_true((group == name) & _entered(entry_ms, window))
    return black


def correct_anticipation(stimulus: Column, area: Column, group: Column, entry_ms: Column) -> Column:
    named = is_true(area.isin(CORRECT_AREAS))
    return F.when(named & in_anticipation_window(stimulus, group, entry_ms), 1).otherwise(0)


def incorrect_anticipation(
    stimulus: Column, area: Column, group: Column, entry_ms: Column, previous: Column
) -> Column:
    """Incorrect anticipation, unless the look stays on the previous position."""
    named = is_true(area.isin(INCORRECT_AREAS))
    stays = F.lit(False)
    for number in (1, 2, 3):
        stays |= is_true(area.contains(f"POSITION {number}") & (previous == number))
    return F.when(named & in_anticipation_window(stimulus, group, entry_ms) & ~stays, 1).otherwise(0)


def block(trial: Column) -> Column:
    """Half of the task after practice; empty outside both halves."""
    return (
        F.when((trial > 12) & (trial <= 38), "block1")
        .when((trial > 38) & (trial <= 65), "block2")
        .otherwise("")
    )
