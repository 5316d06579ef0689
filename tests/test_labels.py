import pytest
from pyspark.sql import functions as F

from trialops.functions import looks, screens, sequences


def column(spark, values, build, kind):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r.x for r in df.select(build(F.col("v")).alias("x")).collect()]


def points(spark, values, build):
    df = spark.createDataFrame(values, "x double, y double")
    return [r.a for r in df.select(build(F.col("x"), F.col("y")).alias("a")).collect()]


def test_target_areas_have_open_bounds(spark):
    xy = [(16.0, 500.0), (17.0, 500.0), (616.0, 500.0), (661.0, 500.0), (1302.0, 500.0), (1303.0, 140.0), (1303.0, 141.0)]
    assert points(spark, xy, looks.target_area) == ["Out_AOIs", "1", "Out_AOIs", "0", "Out_AOIs", "Out_AOIs", "2"]
    off = [(0.0, 500.0), (1920.0, 500.0), (None, 500.0), (700.0, None), (700.0, 1080.0)]
    assert set(points(spark, off, looks.target_area)) == {"Missing"}
    assert set(points(spark, off, looks.central_area)) == {"Missing"}
    assert points(spark, [(700.0, 500.0), (100.0, 500.0)], looks.central_area) == ["0", "Out_AOIs"]


def test_bands(spark):
    xy = [(0.0, 5.0), (1.0, 5.0), (764.0, 5.0), (765.0, 5.0), (1155.0, 5.0), (1156.0, 5.0), (1919.0, 5.0), (1920.0, 5.0), (5.0, 0.0), (None, 5.0)]
    assert points(spark, xy, looks.numbered_area) == [None, 1, 1, 0, 0, 2, 2, None, None, None]


def test_three_positions_use_both_coordinates(spark):
    areas = looks.three_position_areas(((100, 700), (100, 500)), ((1200, 1800), (100, 500)), ((700, 1200), (600, 1000)))
    xy = [(100.0, 200.0), (700.0, 500.0), (1200.0, 100.0), (1800.0, 100.0), (701.0, 601.0), (700.0, 601.0), (400.0, 600.0)]
    assert points(spark, xy, lambda x, y: looks.numbered_area(x, y, areas=areas)) == [None, 1, 2, None, 3, None, None]


def test_target_flags(spark):
    df = spark.createDataFrame([("right", "2"), ("right", "1"), ("left", "1"), ("left", "0"), (None, "2")], "s string, a string")
    for parity, incorrect in ((False, [0, 1, 0, 0, 0]), (True, [1, 1, 1, 1, 1])):
        got = df.select(*[c.alias(n) for n, c in looks.target_flags(F.col("s"), F.col("a"), parity).items()]).collect()
        assert [r.fix_target_correct for r in got] == [1, 0, 1, 0, 0]
        assert [r.fix_target_incorrect for r in got] == incorrect
        assert [r.fix_central_stim for r in got] == [0, 0, 0, 1, 0]


def test_trial_filter(spark):
    assert column(spark, [5.0, 0.0, -1.0, None], looks.trial_filter, "double") == [0, 1, None, None]
    assert column(spark, [5.0, 6.0], lambda g: looks.trial_filter(g, 5.0), "double") == [1, 0]


def test_screen_numbers_match_the_interval_lists(spark):
    numbers = list(range(1, 401))
    recoded = {t: 1 for t in numbers if t < 9}
    raw = {t: 1 for t in numbers if t < 6} | {t: 65 for t in numbers if t > 384}
    for n in range(63):
        recoded |= {t: n + 2 for t in range(9 + 6 * n, min(14 + 6 * n, 384) + 1)}
    for n in range(64):
        raw |= {t: n + 2 for t in range(6 + 6 * n, min(11 + 6 * n, 384) + 1)}
    assert column(spark, numbers, screens.trial_recoded, "int") == [recoded.get(t, 0) for t in numbers]
    assert column(spark, numbers, screens.trial_raw, "int") == [raw[t] for t in numbers]
    steps = {1: {*range(1, 65, 4), 65}, 2: set(range(2, 66, 4)), 3: set(range(3, 67, 4)), 4: set(range(4, 68, 4))}
    want = [next((k for k, v in steps.items() if t in v), 0) for t in range(0, 66)]
    assert column(spark, list(range(0, 66)), screens.subtrial, "int") == want
    assert column(spark, [None], screens.trial_recoded, "int") == [0]


def test_entry_windows_are_open(spark):
    area, bad = screens.CORRECT_AREAS[0], screens.INCORRECT_AREAS[0]
    cases = [
        ("BlackScreen1.bmp", area, "other", 200.0, 0), ("BlackScreen1.bmp", area, "other", 201.0, 1),
        ("BlackScreen1.bmp", area, "other", 999.0, 1), ("BlackScreen1.bmp", area, "other", 1000.0, 0),
        ("Face.bmp", area, "150ms", 0.0, 0), ("Face.bmp", area, "150ms", 149.0, 1), ("Face.bmp", area, "150ms", 150.0, 0),
        ("Face.bmp", area, "50ms", 49.0, 1), ("Face.bmp", area, "50ms", 50.0, 0), ("Face.bmp", None, "50ms", 49.0, 0),
        ("Face.bmp", bad, "50ms", 49.0, 0), (None, area, None, None, 0),
    ]
    df = spark.createDataFrame([c[:4] for c in cases], "s string, a string, g string, e double")
    got = df.select(screens.correct_anticipation(F.col("s"), F.col("a"), F.col("g"), F.col("e")).alias("x")).collect()
    assert [r.x for r in got] == [c[4] for c in cases]


def test_looks_that_stay_are_no_incorrect_anticipation(spark):
    df = spark.createDataFrame([(screens.INCORRECT_AREAS[0], p) for p in (0, 1, 2, 3)], "a string, p int")
    flag = screens.incorrect_anticipation(F.lit("BlackScreen1.bmp"), F.col("a"), F.lit(None), F.lit(500.0), F.col("p"))
    assert [r.x for r in df.select(flag.alias("x")).collect()] == [1, 1, 0, 1]


def test_positions_types_and_previous_positions(spark):
    areas = ["ANTICIPATION INCORRECT 1 (POSITION 3)", "DOING IT 2", "ANTICIPATION CORRECT 3 (POSITION 3)", "FACE", None]
    assert column(spark, areas, screens.stimulus_position, "string") == [1, 2, 3, 0, 0]
    assert column(spark, areas, screens.trial_type, "string") == ["unambiguous", "unambiguous", "ambiguous", "ambiguous", "ambiguous"]
    df = spark.createDataFrame([(2, 2), (3, 4), (1, 3), (1, 1), (2, 1), (0, 2)], "p int, s int")
    got = [r.x for r in df.select(screens.previous_position(F.col("p"), F.col("s")).alias("x")).collect()]
    assert got == [1, 1, 2, 3, 0, 0]


@pytest.mark.parametrize("variant, length, trials", [("6m", 2, 24), ("9m", 3, 48), ("16m", 4, 64)])
def test_sequence_numbers(spark, variant, length, trials):
    numbers = list(range(0, trials + 3))
    want = [(t + length - 1) // length if 1 <= t <= trials else None for t in numbers]
    assert column(spark, numbers, lambda t: sequences.sequence_number(t, variant), "int") == want
    groups = column(spark, numbers, lambda t: sequences.subgroup_number(t, variant), "int")
    assert groups[0] is None and groups[-1] is None
    counts = [groups.count(g) for g in (1, 2, 3, 4)]
    assert counts == ([16, 16, 20, 12] if variant == "16m" else [trials // 4] * 4)


def test_stimulus_positions(spark):
    six = column(spark, [1, 2, 3, 4], lambda t: sequences.stimulus_position(t, "6m"), "int")
    nine = column(spark, [1, 2, 3, 4, 5, 6], lambda t: sequences.stimulus_position(t, "9m"), "int")
    sixteen = column(spark, [1, 2, 3, 4, 62, 64, 65, 66, 68], lambda t: sequences.stimulus_position(t, "16m"), "int")
    assert six == [1, 2, 1, 2] and nine == [1, 1, 2, 1, 1, 2]
    assert sixteen == [1, 2, 1, 3, 2, 3, 1, None, None]


def test_target_condition_equals_the_label(spark):
    xs = [None, 0.0, 16.0, 17.0, 616.0, 700.0, 1303.0, 1902.0, 1920.0]
    rows = [(side, x, y) for side in ("left", "right", None) for x in xs for y in (None, 0.0, 140.0, 500.0, 940.0)]
    df = spark.createDataFrame(rows, "s string, x double, y double")
    crossed = {"left": looks.Box((0, 1000), (0, 1080)), "right": looks.Box((600, 1920), (0, 1080)), "central": looks.Box((650, 800), (0, 1080))}
    for areas in (looks.GAP_OVERLAP_AREAS, crossed):
        label = looks.target_area(F.col("x"), F.col("y"), areas=areas)
        flag = looks.target_flags(F.col("s"), label)["fix_target_correct"]
        direct = looks.on_target(F.col("s"), F.col("x"), F.col("y"), areas=areas)
        assert df.filter((flag == 1) != direct).count() == 0 and df.filter(direct).count() > 0
