"""Key-press and touch tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.registry import bind, out, table
from bindings.views import STOP_SQL, TRIAL_SQL, stop_raw, trial_raw
from trialops.functions.nulls import strict_total, total
from trialops.operators import clean, scores
from trialops.operators.medians import grouped_median
from trialops.operators.reshape import label, pivot_wide
from trialops.plans import attention_network, stop_signal, touch

CUES = ("click", "error", "purchase", "signup", "view")
FLANKERS = ("congruent", "incongruent", "neutral")
BLOCKS = ("block1", "block2", "block3", "block4")
MEASURES = ("n_total_trials", "n_total_errors", "n_omission_errors", "n_comission_errors")
TRIAL = f"WITH {TRIAL_SQL}"
STOP = f"WITH {STOP_SQL}"


def cleaned(spark, sf_dir):
    return attention_network.clean(trial_raw(spark, sf_dir))


def stopped(spark, sf_dir):
    return stop_signal.clean(stop_raw(spark, sf_dir))


@bind("p1_keep_columns", out("SELECT user_id, event_type, value FROM events", "user_id", "value", "event_type"))
def keep_columns(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", "value")


@bind(
    "p3_p4_complete_trials",
    out(f"{TRIAL} SELECT subject, cue, rt, acc FROM trial_raw WHERE rt IS NOT NULL", "subject rt acc", "", "cue"),
)
def complete_trials(spark, sf_dir):
    return clean.complete_trials(trial_raw(spark, sf_dir), ["subject", "cue", "rt", "acc"], ["rt", "acc"])


@bind(
    "p4_strict_cast",
    out(
        "SELECT event_id, CAST(trunc(value) AS BIGINT) AS value FROM events", "event_id value"
    ),
)
def strict_cast(spark, sf_dir):
    return clean.strict_cast(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value"), ["value"])


@bind(
    "p7_drop_anticipatory",
    out(f"{TRIAL} SELECT subject, cue, rt FROM trial_raw WHERE rt > 200 OR rt = 0", "subject rt", "", "cue"),
)
def drop_anticipatory(spark, sf_dir):
    return clean.drop_anticipatory(trial_raw(spark, sf_dir)).select("subject", "cue", "rt")


@bind("p8_correct_only", out(f"{TRIAL} SELECT subject, rt, acc FROM trial WHERE acc = 1", "subject rt acc"))
def correct_only(spark, sf_dir):
    return clean.correct_only(cleaned(spark, sf_dir)).select("subject", "rt", "acc")


@bind(
    "p9_valid_go",
    out(
        f"""{STOP} SELECT "Subject", "Task", "Target_RT" FROM settled
        WHERE "TrialType" = 'Go' AND "Target_RT" > 200 AND "Target_ACC" = 1""",
        "Subject Target_RT", "", "Task",
    ),
)
def valid_go(spark, sf_dir):
    rows = clean.valid_go(stopped(spark, sf_dir), "TrialType", "Target_RT", "Target_ACC")
    return rows.select("Subject", "Task", "Target_RT")


@bind(
    "p10_stop_trials",
    out(
        f"""{STOP} SELECT "Subject", "SubTrial", "PreTarget_RT" FROM settled WHERE "TrialType" = 'StopSignal'""",
        "Subject SubTrial PreTarget_RT",
    ),
)
def stop_trials(spark, sf_dir):
    return clean.stop_trials(stopped(spark, sf_dir), "TrialType").select("Subject", "SubTrial", "PreTarget_RT")


@bind(
    "p11_settle_pretarget",
    out(
        f"{STOP} SELECT * FROM settled",
        "Subject SubTrial FixDuration Target_RT Target_ACC PreTarget_RT PreTarget_ACC", "PreTarget_Duration",
        "Task TrialType",
    ),
)
def settle_pretarget(spark, sf_dir):
    return stopped(spark, sf_dir)


@bind(
    "p14_name_blocks",
    out(
        f"{TRIAL} SELECT block, count(*) AS trials FROM trial GROUP BY block", "trials", "", "block"
    ),
)
def name_blocks(spark, sf_dir):
    return cleaned(spark, sf_dir).groupBy("block").agg(F.count(F.lit(1)).alias("trials"))


@bind(
    "p22_p23_row_totals",
    out(
        f"""{TRIAL} SELECT subject, trial, rt + anticipated_count AS strict, coalesce(rt, 0) + coalesce(anticipated_count, 0)
        AS skipping FROM trial_raw""",
        "subject skipping", "strict", "trial",
    ),
    doubles="strict",
)
def row_totals(spark, sf_dir):
    parts = [F.col("rt"), F.col("anticipated_count")]
    return trial_raw(spark, sf_dir).select(
        "subject", "trial", strict_total(parts).alias("strict"), total(parts).alias("skipping")
    )


_COUNTS = """count(acc) AS n_total_trials, count(*) FILTER (acc = 0) AS n_total_errors,
  count(*) FILTER (rt = 0) AS n_omission_errors,
  count(*) FILTER (acc = 0) - count(*) FILTER (rt = 0) AS n_comission_errors"""


def _sets_sql(select: str) -> str:
    parts = []
    for level, by, keys in (
        ("subject", "cue", "cue"),
        ("subject", "flanker", "flanker"),
        ("subject", "flanker_cue", "flanker, cue"),
        ("block", "cue", "block, cue"),
        ("block", "flanker", "block, flanker"),
        ("block", "flanker_cue", "block, flanker, cue"),
    ):
        condition = {"cue": "cue", "flanker": "flanker", "flanker_cue": "flanker || '_' || cue"}[by]
        block = "block" if level == "block" else "CAST(NULL AS VARCHAR)"
        where = "WHERE block IS NOT NULL" if level == "block" else ""
        parts.append(
            f"SELECT subject, '{level}' AS level, '{by}' AS \"by\", {block} AS block, {condition} AS condition, "
            f"{select} FROM trial {where} GROUP BY subject, {keys}"
        )
    return " UNION ALL ".join(parts)


_MEAN = "avg(rt) FILTER (acc = 1) AS target_rt"


@bind(
    "g1_mean_rt_by_sets",
    out(
        f"{TRIAL} SELECT * FROM ({_sets_sql(_MEAN)}) WHERE target_rt IS NOT NULL", "subject", "target_rt",
        "level by block condition",
    ),
)
def mean_rt_by_sets(spark, sf_dir):
    long = scores.scores_by_sets(cleaned(spark, sf_dir)).filter("target_rt IS NOT NULL")
    return long.select("subject", "target_rt", "level", "by", "block", "condition")


@bind(
    "g2_errors_by_sets",
    out(f"{TRIAL} {_sets_sql(_COUNTS)}", "subject " + " ".join(MEASURES), "", "level by block condition"),
)
def errors_by_sets(spark, sf_dir):
    return scores.scores_by_sets(cleaned(spark, sf_dir)).drop("target_rt")


_GO = """SELECT "Subject", "Task", "TrialType", avg("Target_RT") AS "target_RT_mean", median("Target_RT") AS "target_RT_median"
  FROM settled WHERE "TrialType" = 'Go' AND "Target_RT" > 200 AND "Target_ACC" = 1 GROUP BY ALL"""
_PRE = """SELECT "Subject", "Task", "TrialType", avg("PreTarget_Duration") AS pretarget_mean,
  median("PreTarget_Duration") AS pretarget_median FROM settled WHERE "TrialType" = 'StopSignal' GROUP BY ALL"""
_STOP_ERRORS = """SELECT "Subject", "Task", "TrialType", count("Target_ACC") AS n_total_trials,
  count(*) FILTER ("Target_ACC" = 0) AS n_total_errors,
  count(*) FILTER ("Target_ACC" = 0 AND "Target_RT" = 0) AS n_omission_errors,
  count(*) FILTER ("Target_ACC" = 0) - count(*) FILTER ("Target_ACC" = 0 AND "Target_RT" = 0) AS n_comission_errors,
  count(*) FILTER ("PreTarget_ACC" = 0) AS pretarget_responses FROM settled GROUP BY ALL"""


@bind("g3a_go_times", out(f"{STOP} {_GO}", "Subject", "target_RT_mean target_RT_median", "Task TrialType"))
def go_times(spark, sf_dir):
    return stop_signal.go_times(stopped(spark, sf_dir))


@bind("g3b_pretarget_times", out(f"{STOP} {_PRE}", "Subject", "pretarget_mean pretarget_median", "Task TrialType"))
def pretarget_times(spark, sf_dir):
    return stop_signal.pretarget_times(stopped(spark, sf_dir))


@bind(
    "g4_stop_errors",
    out(f"{STOP} {_STOP_ERRORS}", "Subject pretarget_responses " + " ".join(MEASURES), "", "Task TrialType"),
)
def stop_errors(spark, sf_dir):
    return stop_signal.errors(stopped(spark, sf_dir))


@bind(
    "g5_median_rt",
    out(
        f"{TRIAL} SELECT subject, timestamp, cue, median(rt) AS median_rt FROM trial WHERE acc = 1 GROUP BY ALL",
        "subject", "median_rt", "timestamp cue",
    ),
)
def median_rt(spark, sf_dir):
    rows = clean.correct_only(cleaned_sessions(spark, sf_dir))
    return grouped_median(rows, ["subject", "timestamp", "cue"], "rt", "median_rt")


def cleaned_sessions(spark, sf_dir):
    return clean.drop_anticipatory(trial_raw(spark, sf_dir).dropna(subset=["rt"]))


@bind(
    "g5_median_by_ranges",
    out("SELECT event_type, median(value) AS median_value FROM events GROUP BY ALL", "", "median_value", "event_type"),
)
def median_by_ranges(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return grouped_median(events, ["event_type"], "value", "median_value")


@bind(
    "g5_median_whole_numbers",
    out("SELECT l_returnflag AS flag, median(l_orderkey) AS median_order FROM lineitem GROUP BY ALL", "", "median_order", "flag"),
)
def median_whole_numbers(spark, sf_dir):
    """Whole numbers with as many distinct values as there are orders, in three groups."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_orderkey").cast("int").alias("order"))
    return grouped_median(rows, ["flag"], "order", "median_order")


@bind(
    "g5_median_tiny_values",
    out(
        """SELECT event_type, median(CASE WHEN event_id % 5 = 0 THEN -value ELSE value END * 1e-15) * 1e15 AS median_value FROM events
        GROUP BY ALL""",
        "", "median_value", "event_type",
    ),
)
def median_tiny_values(spark, sf_dir):
    """Values far below 1e-11 of both signs, which lie in several ranges like any others."""
    value = F.when(F.col("event_id") % 5 == 0, -F.col("value")).otherwise(F.col("value")) * 1e-15
    rows = table(spark, sf_dir, "events").select("event_type", value.alias("value"))
    medians = grouped_median(rows, ["event_type"], "value", "median_value")
    return medians.withColumn("median_value", F.col("median_value") * 1e15)


_TOUCH = """SELECT subject, timestamp, flanker AS condition, median(rt) FILTER (acc = 1) AS median_rt,
  count(acc) AS number_trials, count(*) FILTER (acc = 0) AS number_errors,
  count(*) FILTER (rt = 0) AS number_errors_omission,
  count(*) FILTER (acc = 0) - count(*) FILTER (rt = 0) AS number_errors_commission FROM trial GROUP BY ALL"""


@bind(
    "g6_session_errors",
    out(
        f"{TRIAL} {_TOUCH}",
        "subject number_trials number_errors number_errors_omission number_errors_commission", "median_rt",
        "timestamp condition",
    ),
)
def session_errors(spark, sf_dir):
    rows = cleaned_sessions(spark, sf_dir).withColumnRenamed("flanker", "condition")
    return scores.touch_cells(rows, ["subject", "timestamp", "condition"])


@bind(
    "g7_anticipations",
    out(
        f"""{TRIAL} SELECT subject, timestamp, flanker, count(*) FILTER (anticipated_count IS DISTINCT FROM 0) AS anticipations
        FROM trial_raw GROUP BY ALL""",
        "subject anticipations", "", "timestamp flanker",
    ),
)
def anticipations(spark, sf_dir):
    return scores.anticipation_counts(trial_raw(spark, sf_dir), ["subject", "timestamp", "flanker"])


def _cell(names: dict[str, str], where: str, name: str) -> str:
    return ", ".join(f'max({m}) FILTER ({where}) AS "{n}_{name}"' for m, n in names.items())


_ANT_NAMES = {"target_rt": "Target_RT", **{m: m for m in MEASURES}}
_CONDITIONS = [*CUES, *FLANKERS, *[f"{f}_{c}" for f in FLANKERS for c in CUES]]


def _ant_columns(level: str) -> list[tuple[str, str]]:
    if level == "subject":
        return [(f"level = 'subject' AND condition = '{c}'", c) for c in _CONDITIONS]
    return [(f"level = 'block' AND block = '{b}' AND condition = '{c}'", f"{b}_{c}") for b in BLOCKS for c in _CONDITIONS]


def _ant_sql(level: str) -> str:
    cells = ", ".join(_cell(_ANT_NAMES, where, name) for where, name in _ant_columns(level))
    wide = (
        f"{TRIAL}, long AS ({_sets_sql(f'{_MEAN}, {_COUNTS}')}) SELECT subject, {cells} FROM long "
        f"WHERE level = '{level}' GROUP BY subject HAVING count(target_rt) > 0"
    )
    totals = []
    if level == "subject":
        for name, m in (("n_total_comission_errors", "n_comission_errors"), ("n_total_omission_errors", "n_omission_errors"), ("n_total_errors", "n_total_errors")):
            totals.append(f'"{m}_congruent" + "{m}_incongruent" AS "{name}"')
    else:
        for b in BLOCKS:
            com = [f'coalesce("n_comission_errors_{b}_{c}", 0)' for c in FLANKERS[:2]]
            omi = [f'coalesce("n_omission_errors_{b}_{c}", 0)' for c in FLANKERS[:2]]
            totals += [f'{" + ".join(com)} AS "n_total_comission_errors_{b}"', f'{" + ".join(omi)} AS "n_total_omission_errors_{b}"', f'{" + ".join(com + omi)} AS "n_total_errors_{b}"']
    return out(f"SELECT *, {', '.join(totals)} FROM ({wide})", "subject", _ant_doubles(level))


def _ant_doubles(level: str) -> str:
    """All measures: any condition may be absent for a subject."""
    totals = ["n_total_comission_errors", "n_total_omission_errors", "n_total_errors"]
    if level == "block":
        totals = [f"{t}_{b}" for t in totals for b in BLOCKS]
    return " ".join([f"{m}_{n}" for _, n in _ant_columns(level) for m in _ANT_NAMES.values()] + totals)


def _ant(spark, sf_dir):
    return attention_network.reduce(trial_raw(spark, sf_dir), CUES, FLANKERS)


@bind("t1_attention_subject", _ant_sql("subject"), _ant_doubles("subject"))
def attention_subject(spark, sf_dir):
    return _ant(spark, sf_dir).subject


@bind("t1_attention_block", _ant_sql("block"), _ant_doubles("block"))
def attention_block(spark, sf_dir):
    return _ant(spark, sf_dir).block


@bind(
    "v1_pivot_rt_by_condition",
    out(
        f"""{TRIAL} SELECT subject, {', '.join(f"avg(rt) FILTER (acc = 1 AND flanker = '{f}' AND cue = '{c}') AS Target_RT_{f}_{c}" for f in FLANKERS for c in CUES)}
        FROM trial WHERE acc = 1 GROUP BY subject""",
        "subject", " ".join(f"Target_RT_{f}_{c}" for f in FLANKERS for c in CUES),
    ),
)
def pivot_rt(spark, sf_dir):
    sums = scores.trial_sums(cleaned(spark, sf_dir), ["subject", "flanker", "cue"])
    means = sums.withColumn("target_rt", F.try_divide("rt_sum", "rt_count"))
    values = [f"{f}_{c}" for f in FLANKERS for c in CUES]
    return pivot_wide(means, ["subject"], label("flanker", "cue"), {"target_rt": "Target_RT"}, values)


_GO_TYPES = ("GoNoGo_Go", "Stop_Go")
_STOP_TYPES = ("Stop_StopSignal",)
_ALL_TYPES = ("GoNoGo_Go", "GoNoGo_NoGo", "Stop_Go", "Stop_StopSignal")
_TYPE = "\"Task\" || '_' || \"TrialType\""


def _stop_cells(measures, types):
    return ", ".join(f'max("{m}") FILTER ({_TYPE} = \'{t}\') AS "{m}_{t}"' for m in measures for t in types)


_GO_M, _PRE_M = ("target_RT_mean", "target_RT_median"), ("pretarget_mean", "pretarget_median")


def _stop(spark, sf_dir):
    return stop_signal.reduce(stop_raw(spark, sf_dir), _GO_TYPES, _STOP_TYPES, _ALL_TYPES)


@bind(
    "t2_stop_signal_times",
    out(
        f"""{STOP} SELECT * FROM (SELECT "Subject", {_stop_cells(_GO_M, _GO_TYPES)} FROM ({_GO}) GROUP BY "Subject")
        JOIN (SELECT "Subject", {_stop_cells(_PRE_M, _STOP_TYPES)} FROM ({_PRE}) GROUP BY "Subject") USING ("Subject")""",
        "Subject", " ".join([f"{m}_{t}" for m in _GO_M for t in _GO_TYPES] + [f"{m}_{t}" for m in _PRE_M for t in _STOP_TYPES]),
    ),
)
def stop_signal_times(spark, sf_dir):
    return _stop(spark, sf_dir).response_times


@bind(
    "t2_stop_signal_errors",
    out(
        f'{STOP} SELECT "Subject", {_stop_cells((*MEASURES, "pretarget_responses"), _ALL_TYPES)} FROM ({_STOP_ERRORS}) GROUP BY "Subject"',
        "Subject " + " ".join(f"{m}_{t}" for m in (*MEASURES, "pretarget_responses") for t in _ALL_TYPES),
    ),
)
def stop_signal_errors(spark, sf_dir):
    return _stop(spark, sf_dir).errors


@bind(
    "v2_v9_pivot_task_type",
    out(
        f'{STOP} SELECT "Subject", {_stop_cells(("n_total_trials",), _ALL_TYPES)} FROM ({_STOP_ERRORS}) GROUP BY "Subject"',
        "Subject " + " ".join(f"n_total_trials_{t}" for t in _ALL_TYPES),
    ),
)
def pivot_task_type(spark, sf_dir):
    counts = stop_signal.errors(stopped(spark, sf_dir))
    return pivot_wide(counts, ["Subject"], label("Task", "TrialType"), ["n_total_trials"], _ALL_TYPES)


_PAIR = ("congruent", "incongruent")
_TOUCH_NAMES = {"number_errors": "errors", "number_errors_commission": "errors_commission", "number_errors_omission": "errors_omission", "number_trials": "total_trials"}
_TOUCH_WIDE = f"""SELECT subject, timestamp, {', '.join(f"coalesce(max(median_rt) FILTER (condition = '{c}'), 0) AS {c}" for c in _PAIR)},
  {', '.join(f"coalesce(max({m}) FILTER (condition = '{c}'), 0) AS {n}_{c}" for m, n in _TOUCH_NAMES.items() for c in _PAIR)}
  FROM ({_TOUCH}) GROUP BY subject, timestamp HAVING count(median_rt) > 0"""
_TOUCH_INTS = "subject total_errors total_trials " + " ".join(f"{n}_{c}" for n in _TOUCH_NAMES.values() for c in _PAIR)
_TOUCH_ALL = f"""SELECT *, errors_congruent + errors_incongruent AS total_errors,
  total_trials_congruent + total_trials_incongruent AS total_trials FROM ({_TOUCH_WIDE})"""
_ANTICIPATIONS = f"""SELECT subject, timestamp, {', '.join(f"count(*) FILTER (flanker = '{c}' AND anticipated_count IS DISTINCT FROM 0) AS anticipations_{c}" for c in _PAIR)}
  FROM trial_raw GROUP BY ALL"""


def touch_trials(spark, sf_dir):
    return trial_raw(spark, sf_dir).withColumnRenamed("flanker", "condition")


@bind("t3_touch", out(f"{TRIAL} {_TOUCH_ALL}", _TOUCH_INTS, "congruent incongruent", "timestamp"))
def touch_scores(spark, sf_dir):
    return touch.reduce(touch_trials(spark, sf_dir), *_PAIR)


@bind(
    "v4_anticipation_totals",
    out(
        f"{TRIAL} SELECT *, anticipations_congruent + anticipations_incongruent AS total_anticipations FROM ({_ANTICIPATIONS})",
        "subject anticipations_congruent anticipations_incongruent total_anticipations", "", "timestamp",
    ),
)
def anticipation_totals(spark, sf_dir):
    return touch.anticipations(touch_trials(spark, sf_dir), *_PAIR)


@bind(
    "t4_touch_anticipations",
    out(
        f"""{TRIAL} SELECT a.*, anticipations_congruent, anticipations_incongruent,
        anticipations_congruent + anticipations_incongruent AS total_anticipations
        FROM ({_TOUCH_ALL}) a JOIN ({_ANTICIPATIONS}) b ON a.subject = b.subject AND a.timestamp = b.timestamp""",
        _TOUCH_INTS + " anticipations_congruent anticipations_incongruent total_anticipations",
        "congruent incongruent", "timestamp",
    ),
)
def touch_anticipations(spark, sf_dir):
    return touch.reduce_with_anticipations(touch_trials(spark, sf_dir), *_PAIR)


@bind(
    "v3_pivot_median",
    out(
        f"""{TRIAL} SELECT subject, timestamp, {', '.join(f"coalesce(median(rt) FILTER (acc = 1 AND flanker = '{c}'), 0) AS median_rt_{c}" for c in FLANKERS)}
        FROM trial WHERE acc = 1 GROUP BY subject, timestamp""",
        "subject", " ".join(f"median_rt_{c}" for c in FLANKERS), "timestamp",
    ),
)
def pivot_median(spark, sf_dir):
    rows = clean.correct_only(cleaned_sessions(spark, sf_dir))
    medians = grouped_median(rows, ["subject", "timestamp", "flanker"], "rt", "median_rt")
    wide = pivot_wide(medians, ["subject", "timestamp"], "flanker", ["median_rt"], FLANKERS)
    return wide.fillna(0, subset=[f"median_rt_{c}" for c in FLANKERS])


@bind(
    "j2_times_with_errors",
    out(
        f"""{TRIAL} SELECT m.subject, m.timestamp, median_rt, errors FROM
        (SELECT subject, timestamp, median(rt) AS median_rt FROM trial WHERE acc = 1 GROUP BY ALL) m
        JOIN (SELECT subject, timestamp, count(*) FILTER (acc = 0) AS errors FROM trial GROUP BY ALL) e
        ON m.subject = e.subject AND m.timestamp = e.timestamp""",
        "subject errors", "median_rt", "timestamp",
    ),
)
def times_with_errors(spark, sf_dir):
    rows = cleaned_sessions(spark, sf_dir)
    keys = ["subject", "timestamp"]
    cells = scores.touch_cells(rows, keys).filter("median_rt IS NOT NULL")
    return cells.select(*keys, "median_rt", F.col("number_errors").alias("errors"))


_SHARED = {
    "click": "cue = 'click'", "error": "cue = 'error'", "cue_neutral": "cue = 'neutral'",
    "congruent": "flanker = 'congruent'", "flanker_neutral": "flanker = 'neutral'",
    "neutral_neutral": "flanker = 'neutral' AND cue = 'neutral'", "congruent_click": "flanker = 'congruent' AND cue = 'click'",
}


@bind(
    "j1_joined_tables",
    out(
        f"""{TRIAL}, named AS (SELECT subject, rt, acc, flanker, CASE WHEN cue = 'view' THEN 'neutral' ELSE cue END AS cue FROM trial)
        SELECT subject, {', '.join(f'avg(rt) FILTER (acc = 1 AND {where}) AS "Target_RT_{name}"' for name, where in _SHARED.items())}
        FROM named GROUP BY subject HAVING count(rt) FILTER (acc = 1) > 0""",
        "subject", " ".join(f"Target_RT_{name}" for name in _SHARED),
    ),
)
def joined_tables(spark, sf_dir):
    """Mean times by cue, by flanker and by both, side by side; one cue is named like a flanker."""
    rows = trial_raw(spark, sf_dir).withColumn("cue", F.when(F.col("cue") == "view", "neutral").otherwise(F.col("cue")))
    wide = attention_network.reduce(rows, [*CUES[:-1], "neutral"], FLANKERS).subject
    return wide.select("subject", *[f"Target_RT_{name}" for name in _SHARED])


@bind(
    "j1_condition_tables",
    out(
        f"""{TRIAL} SELECT c.subject, by_cue, by_flanker FROM
        (SELECT subject, count(DISTINCT cue) AS by_cue FROM trial WHERE acc = 1 GROUP BY subject) c
        JOIN (SELECT subject, count(DISTINCT flanker) AS by_flanker FROM trial WHERE acc = 1 GROUP BY subject) f
        ON c.subject = f.subject""",
        "subject by_cue by_flanker",
    ),
)
def condition_tables(spark, sf_dir):
    """Both condition tables of a subject meet in one aggregate, so no join is left."""
    long = scores.scores_by_sets(cleaned(spark, sf_dir)).filter("level = 'subject' AND target_rt IS NOT NULL")
    return long.groupBy("subject").agg(
        F.count_if(F.col("by") == "cue").alias("by_cue"), F.count_if(F.col("by") == "flanker").alias("by_flanker")
    )
