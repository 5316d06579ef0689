import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trialops.functions import nulls
from trialops.operators import clean


def test_responses_of_200_ms_or_less_are_dropped_but_missing_ones_stay(spark, rows):
    df = spark.createDataFrame([(0,), (1,), (200,), (201,), (None,)], "rt int")
    assert rows(clean.drop_anticipatory(df)) == [(0,), (201,)]


def test_strict_cast_cuts_fractions_and_fails_on_missing(spark, rows):
    df = spark.createDataFrame([(1.9,), (-1.9,)], "x double")
    assert rows(clean.strict_cast(df, ["x"])) == [(-1,), (1,)]
    holes = spark.createDataFrame([(1.0,), (None,)], "x double")
    with pytest.raises(PySparkException, match="missing value in column x"):
        clean.strict_cast(holes, ["x"]).collect()
    assert rows(clean.strict_cast(holes, ["x"], on_null="drop")) == [(1,)]


def test_complete_trials_drops_rows_with_any_hole(spark, rows):
    df = spark.createDataFrame([(1, 2.0, None), (1, 2.0, "a"), (None, 1.0, "b")], "s int, rt double, c string")
    assert rows(clean.complete_trials(df, ["s", "rt", "c"], ["rt"])) == [(1, 2, "a")]


def test_pretarget_responses_settle_in_order(spark):
    df = spark.createDataFrame(
        [
            (1, "Go", 0, 300, 1),  # silent Go trial keeps its response
            (2, "Go", 150, 300, 0),  # a Go trial with a pre-target response ends with RT 0
            (3, "StopSignal", 150, 300, 0),  # the pre-target response becomes the response
            (4, "StopSignal", 0, 300, 1),
            (5, "Go", None, 300, 0),  # a missing record counts as a response
        ],
        "id int, TrialType string, PreTarget_RT int, Target_RT int, PreTarget_ACC int",
    )
    got = {r.id: (r.PreTarget_RT, r.Target_RT, r.PreTarget_ACC) for r in clean.settle_pretarget(df).collect()}
    assert got == {1: (0, 300, 1), 2: (0, 0, 1), 3: (150, 150, 0), 4: (0, 300, 1), 5: (0, 0, 1)}


def test_block_five_has_no_name(spark, rows):
    df = spark.createDataFrame([(1,), (4,), (5,), (None,)], "b int").select("b", clean.name_blocks(F.col("b")).alias("n"))
    assert {r.b: r.n for r in df.collect()} == {1: "block1", 4: "block4", 5: None, None: None}


def test_gaze_more_than_a_monitor_away_is_missing_in_both_coordinates(spark):
    points = [(-1920.0, 0.0), (-1921.0, 0.0), (3840.0, 0.0), (3841.0, 0.0), (0.0, 2161.0), (None, -1081.0), (float("nan"), 5.0)]
    df = spark.createDataFrame(points, "x double, y double")
    got = [tuple(r) for r in clean.mask_off_monitor(df, (("x", "y"),)).collect()]
    assert got == [(-1920.0, 0.0), (None, None), (3840.0, 0.0), (None, None), (None, None), (None, None), (None, 5.0)]
    sentinel = clean.mask_off_monitor(df, (("x", "y"),), missing=99999.0).collect()
    assert tuple(sentinel[1]) == (99999.0, 99999.0)


def test_early_latencies_go_and_missing_ones_stay(spark, rows):
    df = spark.createDataFrame([(119.0,), (120.0,), (None,)], "l double")
    assert {r.l for r in clean.drop_early_latencies(df, "l", 120).collect()} == {120.0, None}


def test_null_rules(spark):
    df = spark.createDataFrame([(1, None), (None, None), (0, 0)], "a int, b int")
    got = df.select(
        nulls.differs(F.col("a"), 0).alias("d"),
        nulls.total([F.col("a"), F.col("b")]).alias("t"),
        nulls.strict_total([F.col("a"), F.col("b")]).alias("s"),
        (~nulls.is_true(F.col("a") > 0)).alias("n"),
        nulls.ratio(F.col("a"), F.col("b")).alias("r"),
    ).collect()
    assert [tuple(r) for r in got] == [(True, 1, None, False, None), (True, 0, None, True, None), (False, 0, 0, True, None)]


def test_sums_of_nothing_are_zero(spark):
    df = spark.createDataFrame([(1, None)], "k int, x double")
    assert df.groupBy("k").agg(nulls.sum_or_zero(F.col("x")).alias("s")).first().s == 0


def test_text_trial_number_and_practice(spark, rows):
    df = spark.createDataFrame([("Trial001",), ("Trial384",)], "t string")
    assert rows(df.select(clean.text_trial_number(F.col("t")))) == [(1,), (384,)]
    trials = spark.createDataFrame([(12,), (13,)], "trial_recoded int")
    assert rows(clean.drop_practice(trials)) == [(13,)]
