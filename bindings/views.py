"""Trial, fixation, visit and coding tables derived from the given ones, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings.registry import table
from trialops.functions import screens

TRIAL_SQL = """
trial_raw AS (
  SELECT user_id AS subject, CAST(CAST(ts AS DATE) AS VARCHAR) AS timestamp,
         event_id % 5 + 1 AS block_number, 'Trial' || (event_id % 48) AS trial, event_type AS cue,
         CASE event_id % 3 WHEN 0 THEN 'congruent' WHEN 1 THEN 'incongruent' ELSE 'neutral' END AS flanker,
         CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 0
              ELSE CAST(floor(value * 20) AS INTEGER) END AS rt,
         CASE WHEN event_id % 7 = 0 THEN 0 ELSE 1 END AS acc,
         CASE WHEN event_id % 6 = 5 THEN NULL ELSE event_id % 3 END AS anticipated_count
  FROM events),
trial AS (
  SELECT *, CASE block_number WHEN 1 THEN 'block1' WHEN 2 THEN 'block2' WHEN 3 THEN 'block3'
                              WHEN 4 THEN 'block4' END AS block
  FROM trial_raw WHERE rt IS NOT NULL AND (rt > 200 OR rt = 0))
"""


def trial_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("subject"),
        F.col("ts").cast("date").cast("string").alias("timestamp"),
        (e % 5 + 1).alias("block_number"),
        F.concat(F.lit("Trial"), e % 48).alias("trial"),
        F.col("event_type").alias("cue"),
        F.when(e % 3 == 0, "congruent").when(e % 3 == 1, "incongruent").otherwise("neutral").alias("flanker"),
        F.when(e % 13 == 0, None).when(e % 11 == 0, 0).otherwise(F.floor(F.col("value") * 20).cast("int")).alias("rt"),
        F.when(e % 7 == 0, 0).otherwise(1).alias("acc"),
        F.when(e % 6 == 5, None).otherwise(e % 3).alias("anticipated_count"),
    )


STOP_SQL = """
stop_raw AS (
  SELECT user_id AS "Subject", CASE WHEN event_id % 2 = 0 THEN 'GoNoGo' ELSE 'Stop' END AS "Task",
         CASE event_id % 4 WHEN 2 THEN 'NoGo' WHEN 3 THEN 'StopSignal' ELSE 'Go' END AS "TrialType",
         event_id % 64 AS "SubTrial", event_id % 500 AS "FixDuration",
         CASE WHEN event_id % 11 = 0 THEN 0 ELSE CAST(floor(value * 20) AS INTEGER) END AS "Target_RT",
         CASE WHEN event_id % 7 = 0 THEN 0 ELSE 1 END AS "Target_ACC",
         CASE WHEN event_id % 9 = 0 AND event_id % 4 <> 3 THEN NULL
              WHEN event_id % 5 = 0 THEN CAST(floor(value * 3) AS INTEGER) ELSE 0 END AS "PreTarget_RT",
         CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 END AS "PreTarget_ACC",
         value AS "PreTarget_Duration"
  FROM events),
settled AS (
  SELECT "Subject", "Task", "TrialType", "SubTrial", "FixDuration", "Target_ACC", "PreTarget_Duration",
         CASE WHEN "TrialType" = 'StopSignal' THEN "PreTarget_RT" ELSE 0 END AS "PreTarget_RT",
         CASE WHEN "PreTarget_RT" = 0 THEN "Target_RT"
              WHEN "TrialType" = 'StopSignal' THEN "PreTarget_RT" ELSE 0 END AS "Target_RT",
         CASE WHEN "TrialType" = 'StopSignal' THEN "PreTarget_ACC" ELSE 1 END AS "PreTarget_ACC"
  FROM stop_raw)
"""


def stop_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, value = F.col("event_id"), F.col("value")
    stop = e % 4 == 3
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("Subject"),
        F.when(e % 2 == 0, "GoNoGo").otherwise("Stop").alias("Task"),
        F.when(e % 4 == 2, "NoGo").when(stop, "StopSignal").otherwise("Go").alias("TrialType"),
        (e % 64).alias("SubTrial"),
        (e % 500).alias("FixDuration"),
        F.when(e % 11 == 0, 0).otherwise(F.floor(value * 20).cast("int")).alias("Target_RT"),
        F.when(e % 7 == 0, 0).otherwise(1).alias("Target_ACC"),
        F.when((e % 9 == 0) & ~stop, None)
        .when(e % 5 == 0, F.floor(value * 3).cast("int"))
        .otherwise(0)
        .alias("PreTarget_RT"),
        F.when(e % 5 == 0, 0).otherwise(1).alias("PreTarget_ACC"),
        value.alias("PreTarget_Duration"),
    )


FIX_SQL = """
fix AS (
  SELECT l_suppkey AS subject, 1 + l_orderkey % 24 AS trial,
         CASE WHEN l_linenumber % 2 = 0 THEN 'block1' ELSE 'block2' END AS block,
         CASE WHEN l_linenumber % 2 = 0 THEN 'overlap' ELSE 'gap' END AS condition,
         CASE WHEN l_orderkey % 2 = 0 THEN 'left' ELSE 'right' END AS target_pos,
         CASE WHEN (l_suppkey + l_linenumber) % 2 = 0 THEN 'Left' ELSE 'Right' END AS target_side,
         l_orderkey % 10 AS anticipations,
         floor(l_extendedprice) AS start_t, l_quantity * 10 AS dur,
         floor(l_extendedprice) + l_quantity * 10 AS end_t,
         floor(l_extendedprice) + l_quantity * 10 - 10 * (l_partkey % 2) AS time,
         CAST((l_partkey * 37 + l_linenumber * 211) % 2000 - 40 AS DOUBLE) AS xpos,
         CAST((l_orderkey * 13) % 1120 - 20 AS DOUBLE) AS ypos
  FROM lineitem)
"""


def fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixations; ``time``, ``target_side`` and ``anticipations`` serve as the sample table."""
    order, line = F.col("l_orderkey"), F.col("l_linenumber")
    start, dur = F.floor("l_extendedprice").cast("double"), F.col("l_quantity") * 10
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("subject"),
        (1 + order % 24).alias("trial"),
        F.when(line % 2 == 0, "block1").otherwise("block2").alias("block"),
        F.when(line % 2 == 0, "overlap").otherwise("gap").alias("condition"),
        F.when(order % 2 == 0, "left").otherwise("right").alias("target_pos"),
        F.when((F.col("l_suppkey") + line) % 2 == 0, "Left").otherwise("Right").alias("target_side"),
        (order % 10).alias("anticipations"),
        start.alias("start_t"),
        dur.alias("dur"),
        (start + dur).alias("end_t"),
        (start + dur - 10 * (F.col("l_partkey") % 2)).alias("time"),
        ((F.col("l_partkey") * 37 + line * 211) % 2000 - 40).cast("double").alias("xpos"),
        ((order * 13) % 1120 - 20).cast("double").alias("ypos"),
    )


_SIDE_LOOKS = """CASE WHEN NOT (xpos > 0 AND xpos < 1920 AND ypos > 0 AND ypos < 1080) THEN NULL
                 WHEN xpos <= 764 THEN 1 WHEN xpos >= 1156 THEN 2 ELSE 0 END AS aoi"""
GLANCE_SQL = f"""
glance AS (
  SELECT user_id AS subject, 1 + event_id % 24 AS trial,
         CASE WHEN event_type IN ('view', 'signup') THEN 'anticipatory' ELSE 'reactive' END AS period,
         floor(value) AS start_t, floor(value) + 10 * (event_id % 30) AS end_t, CAST(10 * (event_id % 30) AS DOUBLE) AS dur,
         CAST((event_id * 37) % 2000 - 40 AS DOUBLE) AS xpos, CAST((event_id * 13) % 1120 - 20 AS DOUBLE) AS ypos
  FROM events),
glance_banded AS (SELECT *, {_SIDE_LOOKS} FROM glance)
"""


def glance(spark: SparkSession, sf_dir: str, period: str) -> DataFrame:
    """Sparse fixations of the sequence task: two or three per subject and trial."""
    e, start = F.col("event_id"), F.floor("value").cast("double")
    dur = (10 * (e % 30)).cast("double")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("subject"),
        (1 + e % 24).alias("trial"),
        F.when(F.col("event_type").isin("view", "signup"), "anticipatory").otherwise("reactive").alias("period"),
        start.alias("start_t"),
        (start + dur).alias("end_t"),
        dur.alias("dur"),
        ((e * 37) % 2000 - 40).cast("double").alias("xpos"),
        ((e * 13) % 1120 - 20).cast("double").alias("ypos"),
    )
    return rows.filter(F.col("period") == period)


BAND_SQL = f"""
banded AS (SELECT *, {_SIDE_LOOKS} FROM fix)
"""

ATTENDED_SQL = """
attended AS (SELECT DISTINCT user_id AS subject, 1 + event_id % 24 AS trial FROM events WHERE event_type = 'click')
"""


def attended(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = table(spark, sf_dir, "events").filter("event_type = 'click'")
    return clicks.select(F.col("user_id").alias("subject"), (1 + F.col("event_id") % 24).alias("trial")).distinct()


AREAS = [*screens.CORRECT_AREAS, *screens.INCORRECT_AREAS, *screens.REACTIVE_AREAS, "FACE", "OTHER"]
_AREA_CASES = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(AREAS))
VISIT_SQL = f"""
visit AS (
  SELECT l_suppkey AS participant, 1 + l_orderkey % 390 AS trial,
         CASE WHEN l_linenumber % 2 = 0 THEN 'Left' ELSE 'Right' END AS eye,
         CASE l_partkey % {len(AREAS) + 1} {_AREA_CASES} END AS aoi,
         CASE l_orderkey % 4 WHEN 0 THEN 'Face.bmp' ELSE 'BlackScreen' || (l_orderkey % 4) || '.bmp' END AS stimulus,
         CASE l_linenumber % 3 WHEN 0 THEN '150ms' WHEN 1 THEN '50ms' ELSE 'other' END AS aoi_group,
         l_quantity * 30 AS entry_ms, l_quantity * 10 AS fix_ms
  FROM lineitem)
"""


def visit(spark: SparkSession, sf_dir: str) -> DataFrame:
    order, line = F.col("l_orderkey"), F.col("l_linenumber")
    names = F.array(*[F.lit(a) for a in AREAS])
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("participant"),
        (1 + order % 390).alias("trial"),
        F.when(line % 2 == 0, "Left").otherwise("Right").alias("eye"),
        F.get(names, (F.col("l_partkey") % (len(AREAS) + 1)).cast("int")).alias("aoi"),
        F.when(order % 4 == 0, "Face.bmp")
        .otherwise(F.concat(F.lit("BlackScreen"), order % 4, F.lit(".bmp")))
        .alias("stimulus"),
        F.when(line % 3 == 0, "150ms").when(line % 3 == 1, "50ms").otherwise("other").alias("aoi_group"),
        (F.col("l_quantity") * 30).alias("entry_ms"),
        (F.col("l_quantity") * 10).alias("fix_ms"),
    )


CODED_SQL = """
second AS (
  SELECT *, CAST(extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + floor(extract(second FROM ts))
                 AS DOUBLE) AS onset,
         CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'P' WHEN 'purchase' THEN 'AB'
                         WHEN 'signup' THEN 'L' END AS code
  FROM events),
coded AS (
  SELECT user_id AS file,
         CASE WHEN event_type = 'error' THEN onset END AS irruption_onset,
         CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'noise' END AS irruption_event1,
         CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'pause' END AS irruption_event2,
         CASE WHEN event_type <> 'error' THEN onset END AS behaviour_onset,
         CASE WHEN event_type <> 'error' THEN onset + value * 20 END AS behaviour_offset,
         CASE WHEN event_id % 2 = 0 THEN code END AS behaviour_beh1,
         CASE WHEN event_id % 3 = 0 THEN code END AS behaviour_beh2,
         CASE WHEN event_id % 4 = 0 THEN onset END AS orienting_onset,
         CASE WHEN event_id % 4 = 0 THEN onset + value * 10 END AS orienting_offset,
         CASE WHEN event_id % 4 = 0 THEN 'object' || (event_id % 3) END AS orienting_object,
         CASE WHEN event_id % 10 = 0 THEN 'toy' || (user_id % 4) END AS toy1,
         CASE WHEN event_id % 10 = 1 THEN 'toy' || (4 + user_id % 4) END AS toy2
  FROM second),
cut AS (SELECT file, coalesce(min(irruption_onset), CAST('Infinity' AS DOUBLE)) AS first_irruption_onset
        FROM coded GROUP BY file),
event_long AS (
  SELECT file, 'Behaviour1' AS stream, behaviour_beh1 AS code, behaviour_onset AS onset, behaviour_offset AS "offset" FROM coded
  UNION ALL SELECT file, 'Behaviour2', behaviour_beh2, behaviour_onset, behaviour_offset FROM coded
  UNION ALL SELECT file, 'Orienting', orienting_object, orienting_onset, orienting_offset FROM coded),
kept AS (
  SELECT file, stream, code, onset, least("offset", first_irruption_onset) AS "offset",
         least("offset", first_irruption_onset) - onset AS duration
  FROM event_long JOIN cut USING (file) WHERE onset < first_irruption_onset)
"""


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, value = F.col("event_id"), F.col("value")
    error = F.col("event_type") == "error"
    onset = (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("double")
    kind = F.col("event_type")
    code = F.when(kind == "click", "A").when(kind == "view", "P").when(kind == "purchase", "AB").when(kind == "signup", "L")
    turned = e % 4 == 0
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("file"),
        F.when(error, onset).alias("irruption_onset"),
        F.when(error & (e % 2 == 0), "noise").alias("irruption_event1"),
        F.when(error & (e % 3 == 0), "pause").alias("irruption_event2"),
        F.when(~error, onset).alias("behaviour_onset"),
        F.when(~error, onset + value * 20).alias("behaviour_offset"),
        F.when(e % 2 == 0, code).alias("behaviour_beh1"),
        F.when(e % 3 == 0, code).alias("behaviour_beh2"),
        F.when(turned, onset).alias("orienting_onset"),
        F.when(turned, onset + value * 10).alias("orienting_offset"),
        F.when(turned, F.concat(F.lit("object"), e % 3)).alias("orienting_object"),
        F.when(e % 10 == 0, F.concat(F.lit("toy"), F.col("user_id") % 4)).alias("toy1"),
        F.when(e % 10 == 1, F.concat(F.lit("toy"), 4 + F.col("user_id") % 4)).alias("toy2"),
    )


# --- gaze with known jumps: places of the eye, in Spark with their samples and in SQL without ----

SAMPLE_MS = 4
#: Places of the eye on the screen by side, in pixels.
SIDE_X = {"left": 400, "centre": 960, "right": 1500}


def gaze_at(places: DataFrame, keys: list[str]) -> DataFrame:
    """Samples of both eyes at the places ``keys, since, dwell, x, y``, with a jitter of two pixels."""
    k = F.explode(F.sequence(F.lit(0), (F.col("dwell") / SAMPLE_MS).cast("int") - 1)).alias("k")
    rows = places.select(*keys, "since", "x", "y", k)
    x = (F.col("x") + (F.col("k") * 7 + F.col("since")) % 5 - 2).cast("double")
    y = (F.col("y") + F.col("k") * 3 % 5 - 2).cast("double")
    time = (F.col("since") + SAMPLE_MS * F.col("k")).cast("double")
    return rows.select(
        *keys, time.alias("time"), x.alias("left_x"), y.alias("left_y"), (x + 1).alias("right_x"), y.alias("right_y")
    )


JUMP_SQL = """
jump AS (
  SELECT s_suppkey AS subject, trial, j + 1 AS place, CASE WHEN (s_suppkey + trial + j) % 2 = 0 THEN 'left' ELSE 'right' END AS side,
         300 + 100 * ((s_suppkey + 2 * trial + j) % 3) AS dwell,
         coalesce(list_sum(list_transform(range(0, j), lambda i: 300 + 100 * ((s_suppkey + 2 * trial + i) % 3))), 0) AS since
  FROM supplier, range(1, 3) t(trial), range(0, 4) p(j) WHERE j < 2 + s_suppkey % 3)
"""


def jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two trials per supplier, in which the eye jumps between two places two to four times."""
    s, trial, j = F.col("s_suppkey"), F.col("trial"), F.col("j")
    rows = (
        table(spark, sf_dir, "supplier")
        .select("s_suppkey", F.explode(F.array(F.lit(1), F.lit(2))).alias("trial"))
        .select("*", F.explode(F.sequence(F.lit(0), (1 + s % 3).cast("int"))).alias("j"))
    )

    def dwell(i):
        return 300 + 100 * ((s + 2 * trial + i) % 3)

    before = F.when(j > 0, F.sequence(F.lit(0), j - 1)).otherwise(F.array().cast("array<int>"))
    return rows.select(
        s.alias("subject"),
        "trial",
        F.when((s + trial + j) % 2 == 0, SIDE_X["left"]).otherwise(SIDE_X["right"]).alias("x"),
        F.lit(500).alias("y"),
        dwell(j).alias("dwell"),
        F.aggregate(before, F.lit(0).cast("long"), lambda total, i: total + dwell(i)).alias("since"),
    )


def in_turn(rows: DataFrame, keys: list[str], turns: list[tuple]) -> DataFrame:
    """Places of the eye one after the other; ``turns`` are (condition, x, y, dwell), and those whose
    condition fails are left out."""
    named = [
        F.when(condition, F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(dwell).cast("long").alias("dwell")))
        for condition, x, y, dwell in turns
    ]
    kept = rows.select(*keys, F.array_compact(F.array(*named)).alias("places"))

    def start(place, i):
        return F.aggregate(F.slice("places", F.lit(1), i), F.lit(0).cast("long"), lambda total, p: total + p["dwell"])

    return kept.select(*keys, F.inline(F.transform("places", lambda p, i: p.withField("since", start(p, i)))))


SWITCH_SQL = """
switch AS (
  SELECT s_suppkey AS subject, b, 'block' || b AS block, t AS trial, (s_suppkey + b) % 7 AS anticipations,
         (s_suppkey + b + t) % 3 AS kind, (s_suppkey + t) % 2 AS late, 3 + s_suppkey % 2 AS trials
  FROM supplier, range(1, 3) blocks(b), range(1, 5) ts(t) WHERE t <= 3 + s_suppkey % 2)
"""


def switching_gaze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of the switching task: two blocks of three or four trials per supplier.

    A trial starts at the centre.  In the anticipatory period the eye then goes to the other side, to
    the coming side, or to one after the other; in the reactive period to one of the sides.
    """
    s, b, t = F.col("s_suppkey"), F.col("b"), F.col("t")
    right = (s + b) % 2 == 0
    rows = (
        table(spark, sf_dir, "supplier")
        .select("s_suppkey", F.explode(F.array(F.lit(1), F.lit(2))).alias("b"))
        .select("*", F.explode(F.sequence(F.lit(1), (3 + s % 2).cast("int"))).alias("t"))
        .select("*", F.explode(F.array(F.lit("anticipatory"), F.lit("reactive"))).alias("period"))
        .select(
            "period",
            s.alias("subject"),
            F.concat(F.lit("block"), b.cast("string")).alias("block"),
            t.alias("trial"),
            F.when(right, "Right").otherwise("Left").alias("target_side"),
            ((s + b) % 7).alias("anticipations"),
            F.when(right, SIDE_X["right"]).otherwise(SIDE_X["left"]).alias("side"),
            F.when(right, SIDE_X["left"]).otherwise(SIDE_X["right"]).alias("other"),
            ((s + b + t) % 3).alias("kind"),
            ((s + t) % 2).alias("late"),
        )
    )
    early, kind, y = F.col("period") == "anticipatory", F.col("kind"), F.lit(500)
    turns = [
        (F.lit(True), F.lit(SIDE_X["centre"]), y, 300),
        (early & (kind < 2), F.col("other"), y, 300),
        (early & (kind != 1), F.col("side"), y, 500),
        (~early, F.when(F.col("late") == 0, F.col("side")).otherwise(F.col("other")), y, 500),
    ]
    keys = ["period", "subject", "block", "trial", "target_side", "anticipations"]
    return gaze_at(in_turn(rows, keys, turns), keys)


#: Centres of the areas of the sequence task by number: two bands, or three positions.
TWO_PLACES = {1: (400, 500), 2: (1500, 500)}
THREE_PLACES = {1: (400, 300), 2: (1500, 300), 3: (950, 800)}


def sequence_gaze(spark: SparkSession, sf_dir: str, trials: int, position, places: dict[int, tuple[int, int]]) -> DataFrame:
    """Samples of the sequence task: ``trials`` trials in both periods per supplier.

    ``position`` is the column function of the place of the stimulus.  In the reactive period the
    eye goes there in four of five trials, else to the next place; in the anticipatory period it
    stays there in one of four trials and goes to the next place in the others.
    """
    s, t = F.col("s_suppkey"), F.col("t")
    rows = (
        table(spark, sf_dir, "supplier")
        .select("s_suppkey", F.explode(F.sequence(F.lit(1), F.lit(trials))).alias("t"))
        .select("*", F.explode(F.array(F.lit("anticipatory"), F.lit("reactive"))).alias("period"))
    )
    there, reactive = position(t), F.col("period") == "reactive"
    stays = F.when(reactive, (s + t) % 5 != 0).otherwise((3 * s + t) % 4 == 0)
    looked = F.when(stays, there).otherwise(there % len(places) + 1)
    x, y = (F.create_map(*[F.lit(v) for n, xy in places.items() for v in (n, xy[i])])[looked] for i in (0, 1))
    named = rows.select("period", s.alias("subject"), t.alias("trial"), x.alias("x"), y.alias("y"))
    turns = [(F.lit(True), F.col("x"), F.col("y"), 300)]
    keys = ["period", "subject", "trial"]
    return gaze_at(in_turn(named, keys, turns), keys)


def sequence_sql(trials: int, position: str, places: int) -> str:
    """The looks of ``sequence_gaze`` by their plan: period, subject, trial, aoi, position."""
    return f"""
    planned AS (SELECT s_suppkey AS s, trial, period, {position} AS position,
      CASE WHEN period = 'reactive' THEN (s_suppkey + trial) % 5 <> 0 ELSE (3 * s_suppkey + trial) % 4 = 0 END AS stays
      FROM supplier, range(1, {trials + 1}) ts(trial), (VALUES ('anticipatory'), ('reactive')) periods(period)),
    glanced AS (SELECT period, s AS subject, trial, position, CASE WHEN stays THEN position ELSE position % {places} + 1 END AS aoi FROM planned)
    """
