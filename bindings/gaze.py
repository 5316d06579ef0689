"""Fixations: gap-overlap and switching tasks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from bindings.registry import bind, out, table
from bindings.views import BAND_SQL, FIX_SQL, JUMP_SQL, SIDE_X, SWITCH_SQL, fix, gaze_at, jumps, switching_gaze
from trialops.functions import looks
from trialops.functions.nulls import ratio
from trialops.operators import anticipation, clean, fixations
from trialops.operators.detect import Detection, detect_fixations
from trialops.plans import gap_overlap, switching

FIX = f"WITH {FIX_SQL}"
BAND = f"WITH {FIX_SQL}, {BAND_SQL}"

_ON = "xpos > 0 AND xpos < 1920 AND ypos > 0 AND ypos < 1080"
_Y = "ypos > 140 AND ypos < 940"
_TARGET = f"""CASE WHEN NOT ({_ON}) THEN 'Missing' WHEN xpos > 660 AND xpos < 1260 AND {_Y} THEN '0'
  WHEN xpos > 1302 AND xpos < 1902 AND {_Y} THEN '2' WHEN xpos > 16 AND xpos < 616 AND {_Y} THEN '1' ELSE 'Out_AOIs' END"""
_CENTRAL = f"CASE WHEN NOT ({_ON}) THEN 'Missing' WHEN xpos > 660 AND xpos < 1260 AND {_Y} THEN '0' ELSE 'Out_AOIs' END"
_HIT = "((target_pos = 'right' AND aoi = '2') OR (target_pos = 'left' AND aoi = '1'))"
_OTHER = "((target_pos = 'right' AND aoi = '1') OR (target_pos = 'left' AND aoi = '2'))"


def xy():
    return F.col("xpos"), F.col("ypos")


@bind(
    "c1_target_area",
    out(f"{FIX} SELECT subject, trial, xpos, ypos, {_TARGET} AS aoi FROM fix", "subject trial", "xpos ypos", "aoi"),
)
def target_area(spark, sf_dir):
    return fix(spark, sf_dir).select("subject", "trial", "xpos", "ypos", looks.target_area(*xy()).alias("aoi"))


@bind(
    "c2_central_area",
    out(f"{FIX} SELECT subject, trial, xpos, ypos, {_CENTRAL} AS aoi FROM fix", "subject trial", "xpos ypos", "aoi"),
)
def central_area(spark, sf_dir):
    return fix(spark, sf_dir).select("subject", "trial", "xpos", "ypos", looks.central_area(*xy()).alias("aoi"))


@bind(
    "c3_bands",
    out(
        f"{BAND} SELECT subject, aoi, count(*) AS fixations, sum(dur) AS dur FROM banded GROUP BY ALL",
        "subject fixations", "aoi dur",
    ),
    doubles="aoi",
)
def bands(spark, sf_dir):
    rows = fix(spark, sf_dir).withColumn("aoi", looks.numbered_area(*xy()))
    return rows.groupBy("subject", "aoi").agg(F.count(F.lit(1)).alias("fixations"), F.sum("dur").alias("dur"))


THREE = looks.three_position_areas(((100, 700), (100, 500)), ((1200, 1800), (100, 500)), ((700, 1200), (600, 1000)))


@bind(
    "c4_three_positions",
    out(
        f"""{FIX} SELECT subject, CASE WHEN NOT ({_ON}) THEN NULL
        WHEN xpos > 100 AND xpos <= 700 AND ypos > 100 AND ypos <= 500 THEN 1
        WHEN xpos >= 1200 AND xpos < 1800 AND ypos >= 100 AND ypos < 500 THEN 2
        WHEN xpos > 700 AND xpos < 1200 AND ypos > 600 AND ypos < 1000 THEN 3 END AS aoi, count(*) AS fixations
        FROM fix GROUP BY ALL""",
        "subject fixations", "aoi",
    ),
    doubles="aoi",
)
def three_positions(spark, sf_dir):
    rows = fix(spark, sf_dir).withColumn("aoi", looks.numbered_area(*xy(), areas=THREE))
    return rows.groupBy("subject", "aoi").agg(F.count(F.lit(1)).alias("fixations"))


def labelled(spark, sf_dir):
    return gap_overlap.label_target(fix(spark, sf_dir))


_LABELLED = f"labelled AS (SELECT *, {_TARGET} AS aoi FROM fix)"
_FLAGS = ("fix_target_correct", "fix_target_incorrect", "fix_central_stim")


@bind(
    "c5_target_flags",
    out(
        f"""{FIX}, {_LABELLED} SELECT subject, trial, sum(CASE WHEN {_HIT} THEN 1 ELSE 0 END) AS fix_target_correct,
        sum(CASE WHEN {_OTHER} THEN 1 ELSE 0 END) AS fix_target_incorrect,
        sum(CASE WHEN aoi = '0' THEN 1 ELSE 0 END) AS fix_central_stim FROM labelled GROUP BY ALL""",
        "subject trial " + " ".join(_FLAGS),
    ),
)
def target_flags(spark, sf_dir):
    return labelled(spark, sf_dir).groupBy("subject", "trial").agg(*[F.sum(f).alias(f) for f in _FLAGS])


@bind(
    "g8a_g8b_sample_bounds",
    out(
        f"{FIX} SELECT subject, trial, min(time) AS first_time, max(time) AS last_time FROM fix GROUP BY ALL",
        "subject trial", "first_time last_time",
    ),
)
def sample_bounds(spark, sf_dir):
    return fixations.sample_bounds(fix(spark, sf_dir))


@bind(
    "c21_target_side",
    out(
        f"""{FIX} SELECT subject, trial, string_agg(target_side, '' ORDER BY since, target_side) AS target_pos FROM
        (SELECT subject, trial, target_side, min(time) AS since FROM fix GROUP BY ALL) GROUP BY ALL""",
        "subject trial", "", "target_pos",
    ),
)
def target_side(spark, sf_dir):
    return fixations.target_side(fix(spark, sf_dir), side="target_side")


_BOUNDS = "bounds AS (SELECT subject, trial, min(time) AS first_time, max(time) AS last_time FROM fix GROUP BY ALL)"
_LAST = f"""{_BOUNDS}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY subject, trial ORDER BY start_t DESC, end_t DESC) AS place FROM fix),
last_fix AS (
  SELECT r.subject, r.trial, last_time - end_t AS gap, last_time - 200 AS window_start, last_time AS window_end,
         start_t, end_t, CASE WHEN last_time - end_t > 0 THEN 0 WHEN last_time - end_t = 0 THEN 1 END AS trial_filter
  FROM ranked r JOIN bounds b ON r.subject = b.subject AND r.trial = b.trial WHERE place = 1)"""


def last(spark, sf_dir):
    rows = fix(spark, sf_dir)
    return fixations.last_fixation(rows, fixations.sample_bounds(rows))


@bind(
    "w6_g9_c20_j3a_last_fixation",
    out(
        f"{FIX}, {_LAST} SELECT * FROM last_fix", "subject trial",
        "gap window_start window_end start_t end_t trial_filter",
    ),
    doubles="trial_filter",
)
def last_fixation(spark, sf_dir):
    return last(spark, sf_dir)


@bind(
    "g10a_g10b_trial_counts",
    out(
        f"""{FIX}, {_LAST} SELECT subject, count(*) FILTER (gap > 0) AS excluded, count(DISTINCT trial) AS total_trials
        FROM last_fix GROUP BY subject""",
        "subject excluded total_trials",
    ),
)
def trial_counts(spark, sf_dir):
    return fixations.trial_counts(last(spark, sf_dir))


_FIRST = f"""{_LABELLED}, {_BOUNDS}, first_hit AS (
  SELECT l.subject, l.trial, min(start_t) AS start_t, min(start_t) - any_value(first_time) AS saccade_latency
  FROM labelled l JOIN bounds b ON l.subject = b.subject AND l.trial = b.trial WHERE {_HIT} GROUP BY ALL)"""


@bind(
    "w4_j3b_first_correct",
    out(f"{FIX}, {_FIRST} SELECT * FROM first_hit", "subject trial", "start_t saccade_latency"),
)
def first_correct(spark, sf_dir):
    rows = fix(spark, sf_dir)
    first = fixations.first_correct(gap_overlap.target_hits(rows), fixations.sample_bounds(rows))
    return first.select("subject", "trial", "start_t", "saccade_latency")


_THRESHOLD = 5000.0


def latencies(spark, sf_dir):
    rows = fix(spark, sf_dir)
    return fixations.first_correct(gap_overlap.target_hits(rows), fixations.sample_bounds(rows))


_VALID = f"""SELECT l.subject, l.trial, f.saccade_latency FROM last_fix l LEFT JOIN first_hit f
  ON l.subject = f.subject AND l.trial = f.trial WHERE trial_filter = 1"""


_FIRST_ONLY = _FIRST[_FIRST.index("first_hit AS"):]
_ALL = f"{FIX}, {_LABELLED}, {_LAST}, {_FIRST_ONLY}"


@bind("j4_valid_with_latency", out(f"{_ALL} {_VALID}", "subject trial", "saccade_latency"))
def valid_with_latency(spark, sf_dir):
    valid = last(spark, sf_dir).filter("trial_filter = 1")
    return fixations.with_latency(valid, latencies(spark, sf_dir)).select("subject", "trial", "saccade_latency")


@bind(
    "p20_drop_early_latencies",
    out(
        f"""{_ALL} SELECT * FROM ({_VALID}) WHERE saccade_latency IS NULL OR saccade_latency >= {_THRESHOLD}""",
        "subject trial", "saccade_latency",
    ),
)
def drop_early(spark, sf_dir):
    return clean.drop_early_latencies(valid_with_latency(spark, sf_dir), "saccade_latency", _THRESHOLD)


@bind(
    "g11_latency_scores",
    out(
        f"""{_ALL} SELECT subject, count(trial) AS valid_trials, count(*) FILTER (saccade_latency IS NULL) AS no_disengagement,
        count(saccade_latency) AS disengagement, median(saccade_latency) AS median_latency, any_value(excluded) AS excluded_trials,
        any_value(total) AS total_trials FROM ({_VALID}) JOIN
        (SELECT subject, count(*) FILTER (gap > 0) AS excluded, count(*) AS total FROM last_fix GROUP BY subject) USING (subject)
        WHERE saccade_latency IS NULL OR saccade_latency >= {_THRESHOLD} GROUP BY subject""",
        "subject valid_trials no_disengagement disengagement excluded_trials total_trials", "median_latency",
    ),
)
def latency_scores(spark, sf_dir):
    return fixations.latency_scores(last(spark, sf_dir), latencies(spark, sf_dir), _THRESHOLD, share=True)


_T5 = f"""{FIX}, {_LABELLED},
b AS (SELECT subject, condition, trial, min(time) AS first_time, max(time) AS last_time FROM fix GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY subject, condition, trial ORDER BY start_t DESC, end_t DESC) AS place FROM fix),
c AS (SELECT r.subject, r.condition, r.trial, last_time - end_t AS gap FROM r JOIN b
      ON r.subject = b.subject AND r.condition = b.condition AND r.trial = b.trial WHERE place = 1),
f AS (SELECT l.subject, l.condition, l.trial, min(start_t) - any_value(first_time) AS latency FROM labelled l JOIN b
      ON l.subject = b.subject AND l.condition = b.condition AND l.trial = b.trial WHERE {_HIT} GROUP BY ALL),
v AS (SELECT c.subject, c.condition, c.trial, latency FROM c LEFT JOIN f
      ON c.subject = f.subject AND c.condition = f.condition AND c.trial = f.trial
      WHERE gap = 0 AND (latency IS NULL OR latency >= 120)),
s AS (SELECT subject, condition, median(latency) AS med, count(*) AS valid, count(*) - count(latency) AS stay,
             count(latency) AS leave FROM v GROUP BY ALL),
t AS (SELECT subject, condition, count(DISTINCT trial) AS n FROM c GROUP BY ALL),
w AS (SELECT o.subject, o.med AS o_med, o.valid AS o_valid, o.stay AS o_stay, o.leave AS o_leave,
             g.med AS g_med, g.valid AS g_valid, g.stay AS g_stay, g.leave AS g_leave, tg.n AS g_n, t2.n AS o_n
      FROM s o JOIN s g ON o.subject = g.subject AND o.condition = 'overlap' AND g.condition = 'gap'
      LEFT JOIN t tg ON tg.subject = o.subject AND tg.condition = 'gap'
      LEFT JOIN t t2 ON t2.subject = o.subject AND t2.condition = 'overlap')
SELECT subject, o_med AS "median_SaccLat_StartFix_StartTrial_Overlap", g_med AS "median_SaccLat_StartFix_StartTrial_Gap",
  o_valid AS "total_ValidTrials_Overlap", g_valid AS "total_ValidTrials_Gap",
  o_stay AS "total_NoDisengagement_Overlap", g_stay AS "total_NoDisengagement_Gap",
  o_leave AS "total_Disengagement_Overlap", g_leave AS "total_Disengagement_Gap",
  g_n AS "Total_GapTrials", o_n AS "Total_OverlapTrials", g_n + o_n AS "Total_Trials",
  o_valid + g_valid AS "Total_ValidTrials", o_med / nullif(g_med, 0) AS "index",
  o_leave / o_valid AS "prop_Disengagement_Over", g_leave / g_valid AS "prop_Disengagement_Gap",
  (o_leave + g_leave) / (o_valid + g_valid) AS "prop_Disengagement_Total",
  (o_valid + g_valid) / (g_n + o_n) AS "prop_valid_Total", g_valid / g_n AS "prop_valid_Gap_Total",
  o_valid / o_n AS "prop_valid_Overlap_Total" FROM w"""


@bind(
    "t5_j5_gap_overlap",
    out(
        _T5,
        "subject total_ValidTrials_Overlap total_ValidTrials_Gap total_NoDisengagement_Overlap total_NoDisengagement_Gap "
        "total_Disengagement_Overlap total_Disengagement_Gap Total_GapTrials Total_OverlapTrials Total_Trials Total_ValidTrials",
        "median_SaccLat_StartFix_StartTrial_Overlap median_SaccLat_StartFix_StartTrial_Gap index prop_Disengagement_Over "
        "prop_Disengagement_Gap prop_Disengagement_Total prop_valid_Total prop_valid_Gap_Total prop_valid_Overlap_Total",
    ),
)
def gap_overlap_scores(spark, sf_dir):
    rows = fix(spark, sf_dir)
    both = gap_overlap.Period(rows, fixations.sample_bounds(rows, gap_overlap.KEYS))
    return gap_overlap.reduce(both, both)


@bind(
    "p24_ratio",
    out(
        f"{FIX} SELECT subject, sum(dur) / nullif(sum(CASE WHEN trial = 1 THEN dur ELSE 0 END), 0) AS share FROM fix GROUP BY ALL",
        "subject", "share",
    ),
)
def share(spark, sf_dir):
    first = F.sum(F.when(F.col("trial") == 1, F.col("dur")).otherwise(0))
    return fix(spark, sf_dir).groupBy("subject").agg(ratio(F.sum("dur"), first).alias("share"))


@bind(
    "p12_mask_off_monitor",
    out(
        """SELECT l_suppkey AS subject, CASE WHEN bad THEN NULL ELSE x END AS x, CASE WHEN bad THEN NULL ELSE y END AS y FROM
        (SELECT l_suppkey, x, y, (x < -1920 OR x > 3840) OR (y < -1080 OR y > 2160) AS bad FROM
         (SELECT l_suppkey, CAST(l_partkey * 37 % 8000 - 3000 AS DOUBLE) AS x, CAST(l_orderkey * 13 % 5000 - 2000 AS DOUBLE) AS y
          FROM lineitem))""",
        "subject", "x y",
    ),
)
def mask_off_monitor(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("subject"),
        (F.col("l_partkey") * 37 % 8000 - 3000).cast("double").alias("x"),
        (F.col("l_orderkey") * 13 % 5000 - 2000).cast("double").alias("y"),
    )
    return clean.mask_off_monitor(rows, (("x", "y"),))


@bind(
    "p5_p6_time_differences",
    out("SELECT l_suppkey AS subject, l_extendedprice - l_quantity AS time FROM lineitem", "subject", "time"),
)
def time_differences(spark, sf_dir):
    timed = clean.relative_time(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", "time")
    return timed.select(F.col("l_suppkey").alias("subject"), "time")


def banded(spark, sf_dir):
    return fix(spark, sf_dir).withColumn("aoi", looks.numbered_area(*xy()))


_REDUCED = """reduced AS (SELECT subject, block, trial, aoi, coalesce(sum(dur), 0) AS sum_fix, avg(dur) AS mean_fix,
  min(start_t) AS min_start_time, max(end_t) AS max_end_time FROM banded GROUP BY ALL)"""
_FACTS = """facts AS (SELECT subject, block, max(target_side) AS position, max(anticipations) AS anticipations_count_variable,
  max(trial) AS trial_max_completed FROM fix GROUP BY ALL)"""


@bind(
    "g12_reduce_fixations",
    out(
        f"{BAND}, {_REDUCED} SELECT * FROM reduced", "subject trial",
        "aoi sum_fix mean_fix min_start_time max_end_time", "block",
    ),
    doubles="aoi",
)
def reduce_fixations(spark, sf_dir):
    return fixations.reduce_fixations(banded(spark, sf_dir), switching.KEYS)


@bind(
    "g13_file_facts",
    out(f"{FIX}, {_FACTS} SELECT * FROM facts", "subject anticipations_count_variable trial_max_completed", "", "block position"),
)
def file_facts(spark, sf_dir):
    return anticipation.file_facts(fix(spark, sf_dir))


_LOOKS = f"""{_REDUCED}, {_FACTS}, looked AS (
  SELECT r.*, position, CASE WHEN (aoi = 2 AND position = 'Right') OR (aoi = 1 AND position = 'Left') THEN 1 END AS correct,
         CASE WHEN (aoi = 1 AND position = 'Right') OR (aoi = 2 AND position = 'Left') THEN 1 END AS incorrect
  FROM reduced r LEFT JOIN facts f ON r.subject = f.subject AND r.block = f.block)"""


def trial_looks(spark, sf_dir):
    return switching.trial_looks(fix(spark, sf_dir), file_facts(spark, sf_dir))


@bind(
    "c15_c24_label_anticipations",
    out(
        f"""{BAND}, {_LOOKS} SELECT subject, trial, block, position, aoi, correct AS correct_anticipation,
        incorrect AS incorrect_anticipation FROM looked""",
        "subject trial", "aoi correct_anticipation incorrect_anticipation", "block position",
    ),
    doubles="aoi correct_anticipation incorrect_anticipation",
)
def label_anticipations(spark, sf_dir):
    rows = anticipation.label_anticipations(trial_looks(spark, sf_dir))
    return rows.select("subject", "trial", "block", "position", "aoi", "correct_anticipation", "incorrect_anticipation")


# the two looks of a trial by a full outer join, as a check of the aggregate
_CHOSEN = f"""{_LOOKS}, chosen AS (
  SELECT coalesce(c.subject, i.subject) AS subject, coalesce(c.trial, i.trial) AS trial, coalesce(c.block, i.block) AS block,
         coalesce(c.position, i.position) AS position, c.sum_fix AS sum_fix_correct, i.sum_fix AS sum_fix_incorrect,
         CASE WHEN c.correct = 1 AND i.incorrect = 1 AND c.sum_fix < i.sum_fix THEN 0 ELSE c.correct END AS correct_anticipation,
         CASE WHEN c.correct = 1 AND i.incorrect = 1 AND c.sum_fix > i.sum_fix THEN 0 ELSE i.incorrect END AS incorrect_anticipation
  FROM (SELECT * FROM looked WHERE correct = 1) c FULL OUTER JOIN (SELECT * FROM looked WHERE incorrect = 1) i
  ON c.subject = i.subject AND c.trial = i.trial AND c.block = i.block AND c.position = i.position)"""


def chosen(spark, sf_dir):
    return switching.long_anticipations(fix(spark, sf_dir), file_facts(spark, sf_dir))


@bind(
    "j7_c22_choose_anticipation",
    out(
        f"{BAND}, {_CHOSEN} SELECT * FROM chosen", "subject trial",
        "sum_fix_correct sum_fix_incorrect correct_anticipation incorrect_anticipation", "block position",
    ),
    doubles="correct_anticipation incorrect_anticipation",
)
def choose_anticipation(spark, sf_dir):
    return chosen(spark, sf_dir).select(
        "subject", "trial", "block", "position", "sum_fix_correct", "sum_fix_incorrect", "correct_anticipation",
        "incorrect_anticipation",
    )


@bind(
    "c16_g15a_reactive_counts",
    out(
        f"{BAND}, {_LOOKS} SELECT subject, block, sum(coalesce(correct, 0)) AS n_reactive FROM looked GROUP BY ALL",
        "subject n_reactive", "", "block",
    ),
)
def reactive_counts(spark, sf_dir):
    return anticipation.reactive_counts(anticipation.label_reactive(trial_looks(spark, sf_dir)))


_REPORT = """ant AS (SELECT c.subject, c.block, coalesce(sum(correct_anticipation), 0) AS correct_anticipations,
  coalesce(sum(incorrect_anticipation), 0) AS incorrect_anticipations, avg(sum_fix_correct) AS fix_mean_correct_anticipation,
  avg(sum_fix_incorrect) AS fix_mean_incorrect_anticipation, any_value(f.anticipations_count_variable) AS anticipations_count_variable,
  any_value(f.trial_max_completed) AS trial_max_completed, any_value(f.position) AS position
  FROM chosen c LEFT JOIN facts f ON c.subject = f.subject AND c.block = f.block GROUP BY c.subject, c.block),
rea AS (SELECT l.subject, l.block, coalesce(sum(coalesce(correct, 0)), 0) AS correct_reactive, avg(sum_fix) AS fix_mean_correct_reactive,
  any_value(f.trial_max_completed) AS trial_max_completed, any_value(f.position) AS position
  FROM looked l LEFT JOIN facts f ON l.subject = f.subject AND l.block = f.block GROUP BY l.subject, l.block),
joined AS (SELECT a.*, correct_reactive, fix_mean_correct_reactive FROM ant a JOIN rea r ON a.subject = r.subject
  AND a.block = r.block AND a.position = r.position AND a.trial_max_completed = r.trial_max_completed)"""


@bind(
    "g14a_anticipation_report",
    out(
        f"{BAND}, {_CHOSEN}, {_REPORT} SELECT * FROM ant",
        "subject correct_anticipations incorrect_anticipations anticipations_count_variable trial_max_completed",
        "fix_mean_correct_anticipation fix_mean_incorrect_anticipation", "block position",
    ),
)
def anticipation_report(spark, sf_dir):
    return anticipation.anticipation_report(chosen(spark, sf_dir))


@bind(
    "g14b_reactive_report",
    out(
        f"{BAND}, {_CHOSEN}, {_REPORT} SELECT * FROM rea", "subject correct_reactive trial_max_completed",
        "fix_mean_correct_reactive", "block position",
    ),
)
def reactive_report(spark, sf_dir):
    reacted = anticipation.label_reactive(trial_looks(spark, sf_dir))
    return anticipation.reactive_report(reacted)


_WIDE = " ".join(f"{m}_{b}" for m in switching.MEASURES for b in switching.BLOCKS)


@bind(
    "t6_j8_v5_switching",
    out(
        f"""{BAND}, {_CHOSEN}, {_REPORT} SELECT subject, {', '.join(f"max({m}) FILTER (block = '{b}') AS {m}_{b}" for m in switching.MEASURES for b in switching.BLOCKS)}
        FROM joined GROUP BY subject""",
        "subject", _WIDE,
    ),
    doubles=_WIDE,
)
def switching_scores(spark, sf_dir):
    rows, facts = fix(spark, sf_dir), file_facts(spark, sf_dir)
    return switching.reduce(rows, facts, rows, facts).short


@bind(
    "u1_w9_detect_fixations",
    out(
        f"""WITH {JUMP_SQL} SELECT subject, trial, place, side, round(since / 100) AS starts, round((since + dwell) / 100) AS ends
        FROM jump""",
        "subject trial place starts ends", "", "side",
    ),
)
def detected(spark, sf_dir):
    """Fixations found in gaze that jumps at known times; edges to a tenth of a second."""
    found = detect_fixations(gaze_at(jumps(spark, sf_dir), ["subject", "trial"]), ["subject", "trial"], Detection())
    in_trial = Window.partitionBy("subject", "trial").orderBy("start_t")
    return found.select(
        "subject",
        "trial",
        F.row_number().over(in_trial).alias("place"),
        F.when(F.col("xpos") < SIDE_X["centre"], "left").otherwise("right").alias("side"),
        F.round(F.col("start_t") / 100).cast("long").alias("starts"),
        F.round(F.col("end_t") / 100).cast("long").alias("ends"),
    )


# --- raw gaze to scores --------------------------------------------------------------------

_RAW = {
    "anticipations_count_variable": "max(anticipations)",
    "trial_max_completed": "max(trials)",
    "correct_anticipations": "count(*) FILTER (kind <> 1)",
    "incorrect_anticipations": "count(*) FILTER (kind = 1)",
    "correct_reactive": "count(*) FILTER (late = 0)",
    # the eye dwells 500 ms on the coming side and 300 ms elsewhere
    "fix_mean_correct_anticipation": "CASE WHEN count(*) FILTER (kind <> 1) > 0 THEN 5 END",
    "fix_mean_incorrect_anticipation": "CASE WHEN count(*) FILTER (kind < 2) > 0 THEN 3 END",
    "fix_mean_correct_reactive": "4",
}
_RAW_WIDE = " ".join(f"{m}_{b}" for m in _RAW for b in switching.BLOCKS)
_RAW_CELLS = ", ".join(f"max({m}) FILTER (block = '{b}') AS {m}_{b}" for m in _RAW for b in switching.BLOCKS)


@bind(
    "t6_raw_gaze_switching",
    out(
        f"""WITH {SWITCH_SQL}, report AS (SELECT subject, block, {", ".join(f"{sql} AS {m}" for m, sql in _RAW.items())}
        FROM switch GROUP BY subject, block) SELECT subject, {_RAW_CELLS} FROM report GROUP BY subject""",
        "subject", _RAW_WIDE,
    ),
    doubles=_RAW_WIDE,
)
def raw_switching(spark, sf_dir):
    """From samples to the wide report of the switching task; durations to a tenth of a second."""
    short = switching.reduce_gaze(switching_gaze(spark, sf_dir)).short
    means = [c for c in short.columns if c.startswith("fix_mean_")]
    return short.withColumns({c: F.round(F.col(c) / 100) for c in means})
