import pytest
from pyspark.sql import functions as F

from trialops.operators import anticipation, fixations
from trialops.plans import gap_overlap, switching


@pytest.fixture
def gaze(spark):
    samples = [(1, t, ms, side) for t in (1, 2, 3, 4) for ms, side in ((998.0, "right"), (0.0, "right"), (1000.0, "right"))]
    return spark.createDataFrame(samples + [(1, 5, 0.0, "left"), (1, 5, 4.0, "right"), (1, 5, 8.0, "left")], "subject int, trial int, time double, side string")


FIX = "subject int, trial int, start_t double, end_t double, xpos double, ypos double"


def test_bounds_and_sides(gaze):
    bounds = {r.trial: (r.first_time, r.last_time) for r in fixations.sample_bounds(gaze).collect()}
    assert bounds[1] == (0.0, 1000.0) and bounds[5] == (0.0, 8.0)
    sides = {r.trial: r.target_pos for r in fixations.target_side(gaze).collect()}
    assert sides[1] == "right" and sides[5] == "leftright"


def test_last_fixation_must_end_with_the_trial(spark, gaze):
    fix = spark.createDataFrame(
        [
            (1, 1, 500.0, 1000.0, 0.0, 0.0), (1, 1, 0.0, 400.0, 0.0, 0.0),  # ends with the trial
            (1, 2, 500.0, 990.0, 0.0, 0.0),  # ends before
            (1, 3, 500.0, 1010.0, 0.0, 0.0),  # ends after: neither
        ],
        FIX,
    )
    last = fixations.last_fixation(fix, fixations.sample_bounds(gaze))
    got = {r.trial: (r.gap, r.window_start, r.trial_filter) for r in last.collect()}
    assert got == {1: (0.0, 800.0, 1), 2: (10.0, 800.0, 0), 3: (-10.0, 800.0, None)}
    tolerant = fixations.last_fixation(fix, fixations.sample_bounds(gaze), tolerance_ms=10.0)
    assert {r.trial: r.trial_filter for r in tolerant.collect()}[2] == 1
    counts = fixations.trial_counts(last).first()
    assert (counts.excluded, counts.total_trials) == (1, 3)
    assert fixations.trial_counts(last.filter("trial <> 2"), parity=True).count() == 0


def test_first_correct_fixation_is_the_earliest_whatever_the_order(spark, gaze):
    fix = spark.createDataFrame(
        [(1, 1, 700.0, 900.0, 1.0, 1), (1, 1, 300.0, 500.0, 2.0, 1), (1, 1, 100.0, 200.0, 3.0, 0), (1, 2, 100.0, 200.0, 4.0, 0)],
        "subject int, trial int, start_t double, end_t double, xpos double, fix_target_correct int",
    )
    first = fixations.first_correct(fix, fixations.sample_bounds(gaze), keep=["end_t", "xpos"]).collect()
    assert [(r.trial, r.start_t, r.xpos, r.saccade_latency) for r in first] == [(1, 300.0, 2.0, 300.0)]


def test_latency_scores(spark):
    last = spark.createDataFrame(
        [(1, 1, 0.0, 1), (1, 2, 0.0, 1), (1, 3, 0.0, 1), (1, 4, 9.0, 0), (1, 5, 0.0, 1), (2, 1, 9.0, 0)],
        "subject int, trial int, gap double, trial_filter int",
    )
    lat = spark.createDataFrame([(1, 1, 200.5), (1, 2, 100.0), (1, 4, 500.0), (1, 5, 301.5)], "subject int, trial int, saccade_latency double")
    got = fixations.latency_scores(last, lat, 120.0).collect()
    assert len(got) == 1  # subject 2 has no valid trial
    r = got[0]
    assert (r.valid_trials, r.no_disengagement, r.disengagement, r.median_latency) == (3, 1, 2, 251.0)
    assert (r.excluded_trials, r.total_trials) == (1, 5)


def test_gap_overlap_scores_by_hand(spark):
    rows, samples = [], []
    for condition, start in (("overlap", 400.0), ("gap", 200.0)):
        for trial in (1, 2):
            rows.append((1, condition, trial, start, 1000.0, 1500.0, 500.0, "right"))
            samples += [(1, condition, trial, 0.0), (1, condition, trial, 1000.0)]
    rows.append((2, "gap", 1, 200.0, 1000.0, 1500.0, 500.0, "right"))  # one condition only
    samples += [(2, "gap", 1, 0.0), (2, "gap", 1, 1000.0)]
    fix = spark.createDataFrame(rows, "subject int, condition string, trial int, start_t double, end_t double, xpos double, ypos double, target_pos string")
    gaze = spark.createDataFrame(samples, "subject int, condition string, trial int, time double")
    period = gap_overlap.Period(fix, fixations.sample_bounds(gaze, gap_overlap.KEYS))
    got = gap_overlap.reduce(period, period).collect()
    assert len(got) == 1
    r = got[0].asDict()
    assert r["index"] == 2.0 and r["Total_Trials"] == 4 and r["Total_ValidTrials"] == 4
    assert r["prop_Disengagement_Over"] == 1.0 and r["prop_valid_Total"] == 1.0
    parity = gap_overlap.reduce(period, period, parity_totals=True).first()
    assert parity.Total_Trials is None and parity.prop_valid_Total is None


def reduced(spark):
    return spark.createDataFrame(
        [
            (1, "block1", 1, 2, 300.0), (1, "block1", 1, 1, 200.0),  # the longer look is correct
            (1, "block1", 2, 2, 100.0), (1, "block1", 2, 1, 200.0),  # the longer one is not
            (1, "block1", 3, 2, 150.0), (1, "block1", 3, 1, 150.0),  # tie
            (1, "block1", 4, 2, 150.0), (1, "block1", 5, 1, 150.0), (1, "block1", 6, 0, 900.0), (1, "block1", 7, None, 900.0),
        ],
        "subject int, block string, trial int, aoi int, sum_fix double",
    ).withColumn("position", F.lit("Right"))


def test_choice_of_anticipation_equals_the_full_outer_join(spark):
    labelled = anticipation.label_anticipations(reduced(spark))
    keys = ["subject", "block", "trial", "position"]
    chosen = anticipation.choose_anticipation(labelled, keys)
    got = {r.trial: (r.correct_anticipation, r.incorrect_anticipation) for r in chosen.collect()}
    assert got == {1: (1, 0), 2: (0, 1), 3: (1, 1), 4: (1, None), 5: (None, 1)}
    right = labelled.filter("correct_anticipation = 1").select(*keys, F.col("sum_fix").alias("c"))
    wrong = labelled.filter("incorrect_anticipation = 1").select(*keys, F.col("sum_fix").alias("i"))
    joined = right.join(wrong, keys, "full_outer").collect()
    assert {(r.trial, r.sum_fix_correct, r.sum_fix_incorrect) for r in chosen.collect()} == {(r.trial, r.c, r.i) for r in joined}


def test_reactive_looks_count_zero_and_one(spark):
    counted = anticipation.reactive_counts(anticipation.label_reactive(reduced(spark)))
    assert counted.first().n_reactive == 4


def test_switching_loses_files_whose_last_trials_differ(spark):
    fix = spark.createDataFrame(
        [(1, b, t, 1500.0, 500.0, 0.0, 200.0, 200.0) for b in ("block1", "block2") for t in (1, 2)],
        "subject int, block string, trial int, xpos double, ypos double, start_t double, end_t double, dur double",
    )
    facts = spark.createDataFrame([(1, "block1", "Right", 3, 2), (1, "block2", "Left", 4, 2)], "subject int, block string, position string, anticipations_count_variable int, trial_max_completed int")
    short = switching.reduce(fix, facts, fix, facts).short.first()
    assert (short.correct_anticipations_block1, short.incorrect_anticipations_block2) == (2, 2)
    assert (short.correct_reactive_block1, short.correct_reactive_block2) == (2, 0)
    assert short.fix_mean_correct_anticipation_block1 == 200.0 and short.fix_mean_correct_anticipation_block2 is None
    other = facts.withColumn("trial_max_completed", F.when(F.col("block") == "block1", 2).otherwise(9))
    partly = switching.reduce(fix, facts, fix, other).short.first()
    assert partly.correct_reactive_block1 == 2 and partly.correct_reactive_block2 is None
