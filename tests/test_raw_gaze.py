"""Recordings on disk to scores, for the two tasks that start from several folders."""

import pytest

from trialops.functions.looks import three_position_areas
from trialops.plans import sequence_learning, switching
from trialops.sources import schemas

HEADER = list(schemas.SWITCHING_COLUMNS)
LEFT, CENTRE, RIGHT = 400, 960, 1500


def recording(folder, name, trials, header=HEADER, **constant):
    """A tab-separated file with decimal commas: per trial the places (x, y, ms) of the eye in turn."""
    folder.mkdir(parents=True, exist_ok=True)
    lines = ["\t".join(header)]
    for trial, places in trials.items():
        time = 0
        for x, y, dwell in places:
            for k in range(0, dwell, 4):
                values = {"TRIAL_INDEX": trial, "TRIAL_START_TIME": "1000,5", "TIMESTAMP": f"{1000 + time + k},5", **constant}
                blink = 100 <= time + k < 120
                for eye in ("LEFT", "RIGHT"):
                    values[f"{eye}_GAZE_X"] = "." if blink else f"{x + k % 3},0"
                    values[f"{eye}_GAZE_Y"] = "." if blink else f"{y + k % 2},0"
                lines.append("\t".join(str(values.get(c, "extra")) for c in header))
            time += dwell
    (folder / name).write_text("\n".join(lines) + "\n")
    return str(folder)


def test_switching_from_block_folders(spark, tmp_path):
    look = {"right": (RIGHT, 500, 500), "left": (LEFT, 500, 500), "brief": (LEFT, 500, 300), "centre": (CENTRE, 500, 300)}
    turns = {
        ("anticipatory", "block1"): {1: ["centre", "right"], 2: ["brief", "right"], 3: ["centre", "left"]},
        ("anticipatory", "block2"): {1: ["centre", "right"], 2: ["centre", "left"], 3: ["centre", "left"]},
        ("reactive", "block1"): {1: ["centre", "right"], 2: ["centre", "right"], 3: ["centre", "left"]},
        ("reactive", "block2"): {1: ["centre", "left"], 2: ["centre", "right"], 3: ["centre", "right"]},
    }
    folders = {p: {} for p in switching.PERIODS}
    for (period, block), trials in turns.items():
        side = {"target_side_1": "Right", "target_side_2": "Left", "ANTICIPATIONS": 5 if block == "block1" else 6}
        # the columns of one folder stand in another order
        header = [*reversed(HEADER), "NOTE"] if block == "block2" else HEADER
        name = "recordings__S07_x.txt"
        places = {t: [look[n] for n in names] for t, names in trials.items()}
        folder = recording(tmp_path / period / block, name, places, header, **side)
        folders[period][block] = (folder, "target_side_1" if block == "block1" else "target_side_2")
    gaze = switching.read_periods(spark, folders)
    stored = switching.store_gaze(gaze, str(tmp_path / "gaze"))
    assert stored.columns == gaze.columns and stored.count() == gaze.count() == sum(p[2] // 4 for ts in turns.values() for t in ts.values() for p in map(look.get, t))
    for table in (gaze, stored):
        (short,) = switching.reduce_gaze(table).short.collect()
        assert short.subject == "S07"
        assert (short.correct_anticipations_block1, short.incorrect_anticipations_block1, short.correct_reactive_block1) == (2, 1, 2)
        assert (short.correct_anticipations_block2, short.incorrect_anticipations_block2, short.correct_reactive_block2) == (2, 1, 1)
        assert (short.anticipations_count_variable_block1, short.anticipations_count_variable_block2) == (5, 6)
        assert short.trial_max_completed_block1 == 3
        assert short.fix_mean_correct_anticipation_block1 == pytest.approx(500, abs=40)
        # of two looks the brief one is kept as the time of the incorrect look
        assert short.fix_mean_incorrect_anticipation_block1 == pytest.approx(400, abs=40)
    assert "PartitionFilters: [isnotnull(period" in switching.reduce_gaze(stored).short._jdf.queryExecution().executedPlan().toString()


AREAS = three_position_areas(((100, 700), (100, 500)), ((1200, 1800), (100, 500)), ((700, 1200), (600, 1000)))
PLACES = {1: (400, 300), 2: (1500, 300), 3: (950, 800)}


def test_sequence_of_three_positions_from_folders(spark, tmp_path):
    sequence = {t: (1, 2, 1, 3)[(t - 1) % 4] for t in range(1, 17)}
    seen = {t: [(*PLACES[p], 300)] for t, p in sequence.items()}
    # after the sequence is attended, the eye stays in trial 9 and goes on in the others
    ahead = {t: [(*PLACES[p if t == 9 else 3 - p if p < 3 else 1], 300)] for t, p in sequence.items()}
    header = list(schemas.GAZE_COLUMNS)
    folders = {
        "reactive": recording(tmp_path / "reactive", "sequence___S000001.txt", seen, header),
        "anticipatory": recording(tmp_path / "black", "sequence___S000001.txt", ahead, [*header[::-1], "more"]),
    }
    gaze = sequence_learning.store_gaze(sequence_learning.read_periods(spark, folders), str(tmp_path / "gaze"))
    scores = sequence_learning.reduce_gaze(gaze, "16m", AREAS)
    (subject,) = scores.subject.collect()
    assert subject.subject == "S000001"
    # looks at positions 1 and 2 count: trials 1-3, 5-7, ... are attended; the third pair ends at trial 6
    reached = subject.trial_second_sequence_attended
    counted = [t for t, p in sequence.items() if p < 3 and t > reached]
    assert subject.n_total_anticipations == len(counted) and subject.trial_max_completed == max(counted)
    assert subject.n_sticky_fixation == 1 and subject.n_correct_anticipations == len(counted) - 1
    assert subject.n_reactive_all_task == sum(p < 3 for p in sequence.values())
    (wide,) = scores.subgroup.collect()
    assert wide.n_total_anticipations_1 == len(counted) and wide.n_total_anticipations_2 is None
