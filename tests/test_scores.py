import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trialops.operators import scores
from trialops.operators.medians import FINE_RANGES_PER_OCTAVE, grouped_median, value_range
from trialops.operators.reshape import fill_grid, label, pivot_wide, select_like
from trialops.plans import attention_network, stop_signal, touch

SCHEMA = "subject int, block_number int, trial string, rt int, acc int, cue string, flanker string"
TRIALS = [
    (1, 1, "a", 300, 1, "none", "congruent"),
    (1, 1, "a", 500, 1, "none", "congruent"),
    (1, 1, "a", 0, 0, "none", "incongruent"),  # omission
    (1, 2, "a", 400, 0, "centre", "incongruent"),  # commission
    (1, 5, "a", 900, 1, "centre", "congruent"),  # block without a name
    (1, 1, "a", 200, 1, "none", "congruent"),  # anticipatory
    (1, 1, "a", None, 1, "none", "congruent"),  # incomplete
    (2, 1, "a", 0, 1, "none", "congruent"),  # omission coded correct: negative commissions
    (2, 1, "a", 700, 1, "none", "neutral"),
    (3, 1, "a", 350, 0, "none", "congruent"),  # no correct trial at all
    (4, 5, "a", 350, 1, "none", "congruent"),  # correct, but in no named block
]
CUES, FLANKERS = ["none", "centre"], ["congruent", "incongruent", "neutral"]


@pytest.fixture
def trials(spark):
    return spark.createDataFrame(TRIALS, SCHEMA)


def test_attention_scores_by_hand(trials):
    result = attention_network.reduce(trials, CUES, FLANKERS)
    subject = {r.subject: r for r in result.subject.collect()}
    assert set(subject) == {1, 2, 4}
    one = subject[1]
    assert one.Target_RT_none == 400 and one.Target_RT_centre == 900
    assert one.Target_RT_congruent == pytest.approx((300 + 500 + 900) / 3)
    assert one.Target_RT_congruent_none == 400 and one.Target_RT_incongruent_none is None
    assert one.n_total_trials_none == 3 and one.n_omission_errors_none == 1
    assert one.n_comission_errors_incongruent == 1 and one.n_total_errors == 2
    two = subject[2]
    assert two.Target_RT_congruent == 0 and two.n_comission_errors_congruent == -1
    assert two.n_total_errors is None  # no incongruent trial: a plain sum is missing
    block = {r.subject: r for r in result.block.collect()}
    assert set(block) == {1, 2}
    assert block[1].n_total_errors_block1 == 1 and block[1].n_total_errors_block3 == 0
    assert block[1].n_total_comission_errors_block2 == 1
    assert block[1].Target_RT_block1_congruent_none == 400


def test_grouping_sets_equal_separate_groupings(spark, trials):
    clean = attention_network.clean(trials)
    long = scores.scores_by_sets(clean)
    keys = {"cue": ["cue"], "flanker": ["flanker"], "flanker_cue": ["flanker", "cue"]}
    for level in ("subject", "block"):
        for by, columns in keys.items():
            grouping = ["subject", *(["block"] if level == "block" else []), *columns]
            source = clean.filter("block IS NOT NULL") if level == "block" else clean
            single = source.groupBy(*grouping).agg(
                F.mean(F.when(F.col("acc") == 1, F.col("rt"))).alias("target_rt"),
                F.count("acc").alias("n"),
                F.count_if(F.col("rt") == 0).alias("o"),
            )
            want = sorted((r.subject, "_".join(r[c] for c in columns), r.target_rt or -1, r.n, r.o) for r in single.collect())
            part = long.filter((F.col("level") == level) & (F.col("by") == by)).collect()
            got = sorted((r.subject, r.condition, r.target_rt or -1, r.n_total_trials, r.n_omission_errors) for r in part)
            assert got == want


STOP = "Subject int, Task string, TrialType string, SubTrial int, FixDuration int, Target_RT int, Target_ACC int, PreTarget_RT int, PreTarget_ACC int, PreTarget_Duration double"


def test_stop_signal_scores_by_hand(spark):
    df = spark.createDataFrame(
        [
            (1, "S", "Go", 1, 500, 300, 1, 0, 1, 0.0),
            (1, "S", "Go", 2, 500, 500, 1, 0, 1, 0.0),
            (1, "S", "Go", 3, 500, 900, 1, 0, 1, 0.0),
            (1, "S", "Go", 4, 500, 700, 1, 150, 0, 0.0),  # pre-target response: RT 0
            (1, "S", "StopSignal", 5, 500, 0, 0, 0, 1, 100.5),
            (1, "S", "StopSignal", 6, 500, 300, 0, 120, 0, 200.5),
            (2, "S", "Go", 1, 500, 300, 1, 0, 1, 0.0),  # no stop trials
            (3, "S", "Go", 1, 500, 300, 1, 0, 1, 0.0),
            (3, "S", "StopSignal", 2, 500, 300, 1, 0, 1, None),  # only missing durations
        ],
        STOP,
    )
    result = stop_signal.reduce(df, ["S_Go"], ["S_StopSignal"], ["S_Go", "S_StopSignal"])
    times = result.response_times.collect()
    assert [r.Subject for r in times] == [1]
    assert times[0].target_RT_median_S_Go == 500 and times[0].target_RT_mean_S_Go == pytest.approx(1700 / 3)
    assert times[0].pretarget_mean_S_StopSignal == 150.5 and times[0].pretarget_median_S_StopSignal == 150.5
    errors = {r.Subject: r for r in result.errors.collect()}
    assert errors[1].n_omission_errors_S_StopSignal == 1 and errors[1].n_comission_errors_S_StopSignal == 1
    assert errors[1].pretarget_responses_S_StopSignal == 1 and errors[1].pretarget_responses_S_Go == 0
    assert errors[2].n_total_trials_S_StopSignal is None and result.trials.count() == 9


def test_touch_scores_by_hand(spark):
    df = spark.createDataFrame(
        [
            (1, "Alert", 300, 1, "d1", 0),
            (1, "Alert", 500, 1, "d1", None),
            (1, "Alert", 0, 0, "d1", 2),
            (1, "Alert", 150, 1, "d1", 1),
            (1, "NoAlert", 400, 0, "d1", 0),
            (1, "Alert", 700, 1, "d2", 0),  # second session, one condition
            (2, "Alert", 700, 0, "d1", 0),  # no correct trial
        ],
        "subject int, condition string, rt int, acc int, timestamp string, anticipated_count int",
    )
    got = {(r.subject, r.timestamp): r for r in touch.reduce_with_anticipations(df).collect()}
    assert set(got) == {(1, "d1"), (1, "d2")}
    first, second = got[1, "d1"], got[1, "d2"]
    assert (first.Alert, first.NoAlert) == (400.0, 0.0)
    assert (first.errors_Alert, first.errors_omission_Alert, first.errors_commission_NoAlert) == (1, 1, 1)
    assert (first.total_errors, first.total_trials) == (2, 4)
    assert (first.anticipations_Alert, first.anticipations_NoAlert, first.total_anticipations) == (3, 0, 3)
    assert (second.Alert, second.NoAlert, second.total_trials, second.total_anticipations) == (700.0, 0.0, 1, 0)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(1, 3), st.one_of(st.none(), st.floats(-1e6, 1e6, allow_nan=False).map(lambda x: round(x, 2)))), min_size=1, max_size=40))
def test_medians_equal_brute_force(spark, pairs):
    df = spark.createDataFrame(pairs, "k int, v double")
    got = {r.k: r.m for r in grouped_median(df, ["k"], "v", "m").collect()}
    want = {}
    for k in {k for k, _ in pairs}:
        present = [v for key, v in pairs if key == k and v is not None]
        want[k] = statistics.median(present) if present else None
    assert got == pytest.approx(want)


def test_median_of_a_hot_group_and_of_whole_numbers(spark):
    values = [float(i) / 7 for i in range(5001)]
    df = spark.createDataFrame([(0, v) for v in values] + [(1, 1.0), (1, 2.0), (1, 3.0), (1, 10.0)], "k int, v double")
    got = {r.k: r.m for r in grouped_median(df, ["k"], "v", "m").collect()}
    assert got == {0: statistics.median(values), 1: 2.5}
    whole = df.select("k", F.floor("v").cast("int").alias("v"))
    assert {r.k: r.m for r in grouped_median(whole, ["k"], "v", "m").collect()} == {0: 357.0, 1: 2.5}


def test_ranges_keep_the_order_of_values(spark):
    values = sorted([-1e300, -5.5, -1e-9, 0.0, 1e-9, 0.001, 1.0, 1.0000001, 7.0, 1e12, 1e300] + [i / 97 for i in range(300)])
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.r for r in df.orderBy("v").select(value_range(F.col("v")).alias("r")).collect()]
    assert got == sorted(got)


def test_pivot_names_and_dropped_keys(spark, rows):
    df = spark.createDataFrame([(1, "a", 1.0, 2), (1, "b", 3.0, None), (2, "a", None, None), (3, "other", 1.0, 1)], "k int, c string, m double, n int")
    wide = pivot_wide(df, ["k"], "c", {"m": "mean", "n": "n"}, ["a", "b"])
    assert wide.columns == ["k", "mean_a", "mean_b", "n_a", "n_b"]
    assert {tuple(r) for r in wide.collect()} == {(1, 1.0, 3.0, 2, None), (3, None, None, None, None)}
    quoted = spark.createDataFrame([(1, "it's", 1)], "k int, c string, m int")
    assert pivot_wide(quoted, ["k"], "c", ["m"], ["it's"]).first()["m_it's"] == 1


def test_labels_grid_and_column_picks(spark, rows):
    df = spark.createDataFrame([(1, "x", "y"), (2, None, "y")], "k int, a string, b string")
    assert rows(df.select(label("a", "b"))) == [(None,), ("x_y",)]
    counts = spark.createDataFrame([(1, 2, 7)], "k int, g int, n int")
    assert {tuple(r) for r in fill_grid(counts, "k", "g", (1, 2, 3)).collect()} == {(1, 1, None), (1, 2, 7), (1, 3, None)}
    dotted = spark.createDataFrame([(1, 2)], "`Toy.one` int, other int")
    assert select_like(dotted, "Toy").columns == ["Toy.one"]


def test_a_cue_named_like_a_flanker(spark):
    data = [(1, 1, "a", 400, 1, "neutral", "congruent"), (1, 1, "b", 600, 1, "none", "neutral"), (1, 1, "c", 900, 1, "neutral", "neutral")]
    trials = spark.createDataFrame(data, "subject int, block_number int, trial string, rt int, acc int, cue string, flanker string")
    result = attention_network.reduce(trials, ["none", "neutral"], ["congruent", "incongruent", "neutral"])
    row = result.subject.first()
    assert (row.Target_RT_cue_neutral, row.Target_RT_flanker_neutral, row.Target_RT_neutral_neutral) == (650, 750, 900)
    assert result.block.first().Target_RT_block1_flanker_neutral == 750


def test_names_that_cannot_be_told_apart_are_rejected(spark, trials):
    with pytest.raises(ValueError, match="one name"):
        attention_network.reduce(trials, ["c", "b_c"], ["congruent", "incongruent", "a_b", "a"])


def test_medians_of_times_since_an_epoch(spark):
    """A day in ms: one range, but no fine range holds more than a thousandth of the values."""
    day = spark.range(0, 86_400_000, 4321).selectExpr("1 AS k", "1700000000000 + id AS whole", "1.7e12 + id / 3 AS part")
    values = [1_700_000_000_000 + i for i in range(0, 86_400_000, 4321)]
    assert grouped_median(day, ["k"], "whole", "m").first().m == statistics.median(values)
    assert grouped_median(day, ["k"], "part", "m").first().m == pytest.approx(1.7e12 + statistics.median(range(0, 86_400_000, 4321)) / 3, abs=1e-3)
    fine = day.groupBy(value_range(F.col("whole").cast("double"), FINE_RANGES_PER_OCTAVE)).count().agg(F.max("count")).first()[0]
    assert fine <= len(values) / 1000
