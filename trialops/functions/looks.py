"""Labels of fixations: areas of interest, correct and incorrect looks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from trialops.functions.nulls import is_true


@dataclass(frozen=True)
class Screen:
    """Recording set-up: pixels, sampling rate in Hz, size and distance in cm."""

    xres: int = 1920
    yres: int = 1080
    freq: int = 500
    size_cm: tuple[int, int] = (52, 30)
    distance_cm: int = 60
    min_fixation_ms: float = 100.0


@dataclass(frozen=True)
class Box:
    """A rectangle; bounds are open unless named in ``closed`` (``left right top bottom``)."""

    x: tuple[float, float]
    y: tuple[float, float] | None = None
    closed: frozenset[str] = field(default_factory=frozenset)

    def contains(self, x: Column, y: Column) -> Column:
        inside = x >= self.x[0] if "left" in self.closed else x > self.x[0]
        inside &= x <= self.x[1] if "right" in self.closed else x < self.x[1]
        if self.y is not None:
            inside &= y >= self.y[0] if "top" in self.closed else y > self.y[0]
            inside &= y <= self.y[1] if "bottom" in self.closed else y < self.y[1]
        return is_true(inside)


# Areas of the gap-overlap task, in pixels.
GAP_OVERLAP_AREAS = {
    "left": Box(x=(16, 616), y=(140, 940)),
    "right": Box(x=(1302, 1902), y=(140, 940)),
    "central": Box(x=(660, 1260), y=(140, 940)),
}

# Vertical bands of the switching and sequence tasks, in pixels.
BAND_AREAS = {
    1: Box(x=(0, 764), closed=frozenset({"right"})),
    2: Box(x=(1156, 1920), closed=frozenset({"left"})),
    0: Box(x=(764, 1156)),
}


def three_position_areas(upper_left: tuple, upper_right: tuple, bottom_central: tuple) -> dict[int, Box]:
    """Areas of the three-position sequence; each argument is ``((x0, x1), (y0, y1))``."""
    return {
        1: Box(*upper_left, closed=frozenset({"right", "bottom"})),
        2: Box(*upper_right, closed=frozenset({"left", "top"})),
        3: Box(*bottom_central),
    }


def on_screen(x: Column, y: Column, screen: Screen) -> Column:
    return is_true((x > 0) & (x < screen.xres) & (y > 0) & (y < screen.yres))


def target_area(x: Column, y: Column, screen: Screen = Screen(), areas=GAP_OVERLAP_AREAS) -> Column:
    """``Missing``, ``0`` central, ``2`` right, ``1`` left or ``Out_AOIs``."""
    return (
        F.when(~on_screen(x, y, screen), "Missing")
        .when(areas["central"].contains(x, y), "0")
        .when(areas["right"].contains(x, y), "2")
        .when(areas["left"].contains(x, y), "1")
        .otherwise("Out_AOIs")
    )


def central_area(x: Column, y: Column, screen: Screen = Screen(), areas=GAP_OVERLAP_AREAS) -> Column:
    """``Missing``, ``0`` central or ``Out_AOIs``."""
    return (
        F.when(~on_screen(x, y, screen), "Missing")
        .when(areas["central"].contains(x, y), "0")
        .otherwise("Out_AOIs")
    )


def numbered_area(x: Column, y: Column, screen: Screen = Screen(), areas=BAND_AREAS) -> Column:
    """Number of the area that holds the point; NULL off the screen or in none of them."""
    label = F.lit(None).cast("int")
    for number, box in areas.items():
        label = F.when(box.contains(x, y), F.lit(number)).otherwise(label)
    return F.when(on_screen(x, y, screen), label)


def off_monitor(x: Column, y: Column, screen: Screen = Screen()) -> Column:
    """Gaze more than one monitor away from the screen."""
    return is_true((x < -screen.xres) | (x > 2 * screen.xres)) | is_true((y < -screen.yres) | (y > 2 * screen.yres))


def target_flags(side: Column, area: Column, strict_parity: bool = False) -> dict[str, Column]:
    """1/0 flags of a fixation: on the target, on the other side, on the centre.

    With ``strict_parity`` every fixation counts as incorrect, as the original flag does.
    """
    correct = is_true(((side == "right") & (area == "2")) | ((side == "left") & (area == "1")))
    opposite = is_true(((side == "right") & (area == "1")) | ((side == "left") & (area == "2")))
    incorrect = F.lit(True) if strict_parity else opposite
    return {
        "fix_target_correct": F.when(correct, 1).otherwise(0),
        "fix_target_incorrect": F.when(incorrect, 1).otherwise(0),
        "fix_central_stim": F.when(area == "0", 1).otherwise(0),
    }


def on_target(side: Column, x: Column, y: Column, screen: Screen = Screen(), areas=GAP_OVERLAP_AREAS) -> Column:
    """The fixation is in the area of the target side.

    The same as the ``fix_target_correct`` flag of a labelled fixation, without the label: one
    short condition that Spark can run as a filter on the scan.
    """
    left, right = areas["left"].contains(x, y), areas["right"].contains(x, y)
    hit = ((side == "right") & right) | ((side == "left") & left & ~right)
    return is_true(hit) & on_screen(x, y, screen) & ~areas["central"].contains(x, y)


def trial_filter(gap: Column, tolerance_ms: float = 0.0) -> Column:
    """1 when the last fixation ends with the trial, 0 when it ends before, else NULL."""
    return F.when(gap > tolerance_ms, 0).when((gap >= 0) & (gap <= tolerance_ms), 1)


def side_matches(area: Column, side: Column) -> Column:
    return ((area == 2) & (side == "Right")) | ((area == 1) & (side == "Left"))


def side_differs(area: Column, side: Column) -> Column:
    return ((area == 1) & (side == "Right")) | ((area == 2) & (side == "Left"))


def position_matches(area: Column, position: Column) -> Column:
    """The look stays where the stimulus was (positions 1 and 2)."""
    return area.isin(1, 2) & (area == position)


def position_differs(area: Column, position: Column) -> Column:
    """The look moves to the other of the positions 1 and 2."""
    return area.isin(1, 2) & position.isin(1, 2) & (area != position)
