
from trialops.functions import screens
from trialops.operators import intervals as iv
from trialops.operators import visits as v
from trialops.plans import area_export, coded_video

INF = float("inf")


def test_validated_anticipations(spark):
    df = spark.createDataFrame(
        [
            (1, 13, "ambiguous", 300.0, 200.0, 101.0),  # correct and looked at
            (1, 14, "ambiguous", 299.0, 200.0, 101.0),  # too close
            (1, 39, "ambiguous", 100.0, 200.0, 101.0),  # incorrect
            (1, 40, "unambiguous", 300.0, 0.0, 100.0),  # the stimulus was not looked at long enough
            (1, 12, "ambiguous", 300.0, 0.0, 500.0),  # practice
        ],
        "participant int, trial_recoded int, trial_type string, correct_anticipation_time double, incorrect_anticipation_time double, reactive_time double",
    )
    valid = v.validate_anticipations(df)
    got = {r.trial_recoded: (r.valid_correct_anticipation, r.valid_incorrect_anticipation, r.reactive, r.block) for r in valid.collect()}
    assert got == {13: (1, 0, 1, "block1"), 14: (0, 0, 1, "block1"), 39: (0, 1, 1, "block2"), 40: (0, 0, 0, "block2"), 12: (1, 0, 1, "")}
    r = v.count_anticipations(valid).first()
    assert (r.valid_correct_anticipation_ambiguous, r.valid_correct_anticipation_unambiguous) == (1, 0)
    assert (r.valid_incorrect_anticipation_total, r.reactive_total) == (1, 3)
    assert r.reactive_ambiguous_block1 == 2 and r.reactive_unambiguous_block1 is None and r.reactive_total_block1 is None
    assert r.reactive_total_block2 == 1


def test_export_counts_the_right_eye_only(spark):
    rows = [
        (1, 90, eye, name, "BlackScreen1.bmp", "other", 500.0, ms)
        for eye in ("Right", "Left")
        for name, ms in ((screens.CORRECT_AREAS[1], 400.0), (screens.INCORRECT_AREAS[3], 100.0), ("DOING IT 2", 300.0), (None, 50.0))
    ]
    df = spark.createDataFrame(rows, "participant int, trial int, eye string, aoi string, stimulus string, aoi_group string, entry_ms double, fix_ms double")
    got = {r.trial_type: (r.correct_anticipation_time, r.incorrect_anticipation_time, r.reactive_time) for r in area_export.trials(df).collect()}
    assert got == {"ambiguous": (400.0, 100.0, 0.0), "unambiguous": (0.0, 0.0, 300.0)}


CODED = (
    "file string, irruption_onset double, behaviour_onset double, behaviour_offset double, behaviour_beh1 string, behaviour_beh2 string, "
    "orienting_onset double, orienting_offset double, orienting_object string, toy1 string, toy2 string"
)
SHEETS = [
    # a: no irruption; 'A' and 'AB' do not count in the total
    ("a", None, 1.0, 3.0, "A", "P", 0.0, 2.0, "toy", "duck", None),
    ("a", None, 4.0, 5.0, "AB", None, None, None, None, None, "ball"),
    ("a", None, 6.0, 9.0, "P", "A", None, None, None, None, None),
    # b: the irruption cuts the first event and drops the second; rows are not in order of time
    ("b", 9.0, 5.0, 8.0, "P", None, None, None, None, "duck", "ball"),
    ("b", 4.0, 2.0, 7.0, "P", None, None, None, None, None, None),
    # c: the irruption comes first, nothing is left
    ("c", 1.0, 2.0, 3.0, "P", None, 5.0, 6.0, "toy", "duck", "ball"),
    # d: orienting without behaviour
    ("d", None, None, None, None, None, 1.0, 2.5, "toy", "duck", "ball"),
    # e: only approaches
    ("e", None, 1.0, 2.0, "A", "A", None, None, None, "duck", "ball"),
]


def test_coded_video_by_hand(spark):
    got = {r.code: r for r in coded_video.reduce(spark.createDataFrame(SHEETS, CODED), ["A", "AB", "P"], ["toy"]).collect()}
    assert set(got) == {"a", "b", "d", "e"}
    a, b, d, e = (got[k] for k in "abde")
    assert (a.Behaviour1_time_A, a.Behaviour1_time_AB, a.Behaviour1_time_P, a.Behaviour1_total_time) == (2.0, 1.0, 3.0, 3.0)
    assert (a.Toy1_A_onset, a.Toy2_A_onset, a.Toy_preferred) == (1.0, 6.0, ["duck"])
    assert a.first_irruption_onset == INF and a.Orienting_time_toy == 2.0
    assert (b.first_irruption_onset, b.Behaviour1_time_P, b.Behaviour2_total_time) == (4.0, 2.0, None)
    assert (b.Toy1_A_onset, b.Toy_preferred) == (INF, ["ball"])
    assert d.Behaviour1_total_time is None and d.Orienting_time_toy == 1.5 and d.Toy1_A_onset == INF
    assert e.Behaviour1_total_time == 0.0 and e.Toy_preferred == ["ball"]  # tie


def test_events_are_cut_at_the_irruption(spark):
    events = coded_video.events(spark.createDataFrame(SHEETS, CODED)).filter("file = 'b' AND stream = 'Behaviour1'").collect()
    assert [(r.onset, r.offset, r.duration) for r in events] == [(2.0, 4.0, 2.0)]


def test_open_offsets_have_no_duration(spark):
    df = spark.createDataFrame([("a", 1.0, None)], "file string, onset double, offset double")
    files = spark.createDataFrame([("a", 5.0)], "file string, first_irruption_onset double")
    cut = iv.with_duration(iv.cut_at_interruption(df.selectExpr("*", "'s' AS stream"), files)).first()
    assert cut.offset is None and cut.duration is None


def test_a_file_with_most_events_is_spread(spark):
    rows = [("hot", float(i), float(i) + 1.0, "s") for i in range(400)] + [("cold", 1.0, 2.0, "s")]
    df = spark.createDataFrame(rows, "file string, onset double, offset double, stream string")
    files = spark.createDataFrame([("hot", 200.0), ("cold", INF)], "file string, first_irruption_onset double")
    cut = iv.cut_at_interruption(df, files)
    assert cut.groupBy("file").count().collect() is not None
    assert {r["file"]: r["count"] for r in cut.groupBy("file").count().collect()} == {"hot": 200, "cold": 1}
    assert "salt" not in cut.columns
