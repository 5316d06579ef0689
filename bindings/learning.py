"""Visual sequence learning: trial numbers, attended sequences, area export."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.registry import bind, out, table
from bindings.views import ATTENDED_SQL, GLANCE_SQL, THREE_PLACES, TWO_PLACES, VISIT_SQL, attended, glance, sequence_gaze
from bindings.views import sequence_sql, visit
from trialops.functions import screens
from trialops.functions import sequences as numbers
from trialops.functions.looks import BAND_AREAS, three_position_areas
from trialops.operators import clean
from trialops.operators import sequences as seq
from trialops.operators import visits as v
from trialops.operators.reshape import fill_grid
from trialops.plans import area_export, sequence_learning

ATTENDED = f"WITH {ATTENDED_SQL}"
VISIT = f"WITH {VISIT_SQL}"


def _in_table(low_to_high: list[tuple[int, int, int]], column: str = "trial") -> str:
    return "CASE " + " ".join(f"WHEN {column} BETWEEN {a} AND {b} THEN {n}" for a, b, n in low_to_high) + " END"


_SUBGROUPS = {
    "6m": _in_table([(1, 6, 1), (7, 12, 2), (13, 18, 3), (19, 24, 4)]),
    "9m": _in_table([(1, 12, 1), (13, 24, 2), (25, 36, 3), (37, 48, 4)]),
    "16m": _in_table([(1, 16, 1), (17, 32, 2), (33, 52, 3), (53, 64, 4)]),
}
_POSITIONS = {
    "6m": "CASE WHEN trial % 2 = 0 THEN 2 ELSE 1 END",
    "9m": "CASE WHEN trial % 3 = 0 THEN 2 ELSE 1 END",
    "16m": "CASE WHEN trial % 2 = 1 THEN 1 WHEN trial > 64 THEN NULL WHEN trial % 4 = 2 THEN 2 ELSE 3 END",
}
_LENGTHS = {"6m": (2, 24), "9m": (3, 48), "16m": (4, 64)}
_NUMBERS = ", ".join(
    f"""{_POSITIONS[m]} AS position_{m}, {_SUBGROUPS[m]} AS subgroup_{m},
    CASE WHEN trial <= {_LENGTHS[m][1]} THEN (trial + {_LENGTHS[m][0] - 1}) // {_LENGTHS[m][0]} END AS sequence_{m}"""
    for m in _LENGTHS
)
_DOUBLES = " ".join(f"{n}_{m}" for m in ("6m", "9m", "16m") for n in ("position", "subgroup", "sequence"))


@bind(
    "c17a_c17b_c17c_c18_trial_numbers",
    out(
        f"SELECT l_orderkey, trial, {_NUMBERS} FROM (SELECT l_orderkey, 1 + l_orderkey % 70 AS trial FROM lineitem)",
        "l_orderkey trial", _DOUBLES,
    ),
    doubles=_DOUBLES,
)
def trial_numbers(spark, sf_dir):
    trial = 1 + F.col("l_orderkey") % 70
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        trial.alias("trial"),
        *[
            build(trial, m).alias(f"{name}_{m}")
            for m in _LENGTHS
            for name, build in (
                ("position", numbers.stimulus_position),
                ("subgroup", numbers.subgroup_number),
                ("sequence", numbers.sequence_number),
            )
        ],
    )


_W1 = """steps AS (SELECT subject, trial, trial - lag(trial) OVER (PARTITION BY subject ORDER BY trial) AS step FROM attended),
pairs AS (SELECT subject, trial, row_number() OVER (PARTITION BY subject ORDER BY trial) AS pair,
          trial - lag(trial) OVER (PARTITION BY subject ORDER BY trial) AS pair_step FROM steps WHERE step = 1)"""
_W2 = f"""{_W1}, reached AS (SELECT subject, coalesce(max(CASE WHEN pair = 2 AND pair_step <> 1 THEN trial END),
  max(CASE WHEN pair = 3 THEN trial END)) AS trial_second_sequence_attended FROM pairs GROUP BY subject
  HAVING trial_second_sequence_attended IS NOT NULL)"""


@bind("w1_attended_pairs", out(f"{ATTENDED}, {_W1} SELECT * FROM pairs", "subject trial pair", "pair_step"), doubles="pair_step")
def attended_pairs(spark, sf_dir):
    return seq.attended_pairs(attended(spark, sf_dir))


@bind("w2_second_sequence", out(f"{ATTENDED}, {_W2} SELECT * FROM reached", "subject trial_second_sequence_attended"))
def second_sequence(spark, sf_dir):
    return seq.second_sequence(attended(spark, sf_dir))


@bind(
    "w3_j9_remaining_trials",
    out(
        f"""{ATTENDED}, {_W2} SELECT a.subject, trial, trial_second_sequence_attended,
        count(*) OVER (PARTITION BY a.subject) AS trials_remain, 1 AS correct_reactive
        FROM attended a JOIN reached r ON a.subject = r.subject WHERE trial > trial_second_sequence_attended""",
        "subject trial trial_second_sequence_attended trials_remain correct_reactive",
    ),
)
def remaining_trials(spark, sf_dir):
    rows = attended(spark, sf_dir)
    return seq.remaining_trials(rows, seq.second_sequence(rows))


@bind(
    "a1_remaining_trial_lists",
    out(
        f"""{ATTENDED}, {_W2}, rest AS (SELECT a.subject, trial FROM attended a LEFT JOIN reached r ON a.subject = r.subject
        WHERE trial > coalesce(trial_second_sequence_attended, 0))
        SELECT s.subject, r.trial FROM (SELECT DISTINCT subject FROM attended) s LEFT JOIN rest r ON s.subject = r.subject""",
        "subject", "trial",
    ),
    doubles="trial",
)
def remaining_trial_lists(spark, sf_dir):
    rows = attended(spark, sf_dir)
    return seq.remaining_trial_lists(rows, seq.second_sequence(rows))


@bind(
    "a2_j11_fill_grid",
    out(
        """SELECT s.subject, g.subgroup, n FROM (SELECT DISTINCT user_id AS subject FROM events) s
        CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS subgroup) g LEFT JOIN
        (SELECT user_id AS subject, event_id % 9 AS subgroup, count(*) AS n FROM events GROUP BY ALL) e
        ON e.subject = s.subject AND e.subgroup = g.subgroup
        UNION ALL SELECT user_id, event_id % 9, count(*) FROM events WHERE event_id % 9 NOT IN (1, 2, 3, 4) GROUP BY ALL""",
        "subject subgroup", "n",
    ),
    doubles="n",
)
def grid(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy(
        F.col("user_id").alias("subject"), (F.col("event_id") % 9).cast("int").alias("subgroup")
    )
    return fill_grid(counts.agg(F.count(F.lit(1)).alias("n")), "subject", "subgroup", seq.SUBGROUPS)


# the rules of positions 1 and 2; looks at a third position are neither
_SCORED = f"""reacted AS (SELECT *, CASE WHEN aoi = position AND aoi <= 2 THEN 1 ELSE 0 END AS correct_reactive FROM looked WHERE period = 'reactive'),
attended AS (SELECT subject, trial FROM reacted WHERE correct_reactive = 1), {_W2},
rest AS (SELECT a.subject, trial, trial_second_sequence_attended FROM attended a JOIN reached r ON a.subject = r.subject
         WHERE trial > trial_second_sequence_attended),
both_periods AS (SELECT l.*, 1 AS correct_reactive, trial_second_sequence_attended,
         CASE WHEN aoi <> position AND aoi <= 2 AND position <= 2 THEN 1 END AS correct_anticipation,
         CASE WHEN aoi = position AND aoi <= 2 THEN 1 END AS sticky_fixation
         FROM looked l JOIN rest r ON l.subject = r.subject AND l.trial = r.trial WHERE period = 'anticipatory'),
per_trial AS (SELECT subject, trial, avg(position) AS position, avg(correct_reactive) AS correct_reactive,
         max(correct_anticipation) AS correct_anticipation,
         CASE WHEN max(correct_anticipation) = 1 THEN NULL ELSE max(sticky_fixation) END AS sticky_fixation,
         max(sequence) AS sequence, max(subgroup) AS subgroup FROM both_periods GROUP BY subject, trial)"""
_LOOKED = f"""WITH {GLANCE_SQL}, looked AS (
  SELECT *, CASE WHEN trial % 2 = 0 THEN 2 ELSE 1 END AS position, (trial + 1) // 2 AS sequence, {_SUBGROUPS["6m"]} AS subgroup FROM
  (SELECT period, subject, trial, aoi, coalesce(sum(dur), 0) AS sum_fix, avg(dur) AS mean_fix, min(start_t) AS min_start_time,
          max(end_t) AS max_end_time FROM glance_banded WHERE aoi IS NOT NULL AND aoi <> 0 GROUP BY ALL)),
{_SCORED}"""


def trial_looks(spark, sf_dir, period="anticipatory"):
    return sequence_learning.trial_looks(glance(spark, sf_dir, period))


@bind(
    "p16_trial_looks",
    out(
        f"{_LOOKED} SELECT * FROM looked WHERE period = 'anticipatory'", "subject trial aoi position sequence subgroup",
        "sum_fix mean_fix min_start_time max_end_time",
    ),
)
def looks(spark, sf_dir):
    return trial_looks(spark, sf_dir)


def reacted(spark, sf_dir):
    return seq.label_reactive(trial_looks(spark, sf_dir, "reactive"))


@bind(
    "g15b_reactive_counts",
    out(
        f"""{_LOOKED} SELECT subject, subgroup, sum(correct_reactive) AS n_reactive_all_task FROM reacted GROUP BY ALL""",
        "subject subgroup n_reactive_all_task",
    ),
)
def reactive_counts(spark, sf_dir):
    return seq.reactive_counts(reacted(spark, sf_dir), ["subject", "subgroup"])


def with_reactive(spark, sf_dir):
    rows = seq.attended_trials(reacted(spark, sf_dir))
    remaining = seq.remaining_trials(rows, seq.second_sequence(rows))
    return seq.label_anticipations(seq.with_reactive_trials(trial_looks(spark, sf_dir), remaining))


@bind(
    "j10_c19_validate_looks",
    out(
        f"""{_LOOKED} SELECT subject, trial, aoi, position, trial_second_sequence_attended, correct_anticipation, sticky_fixation
        FROM both_periods""",
        "subject trial aoi position trial_second_sequence_attended", "correct_anticipation sticky_fixation",
    ),
    doubles="correct_anticipation sticky_fixation",
)
def validate_looks(spark, sf_dir):
    return with_reactive(spark, sf_dir).select(
        "subject", "trial", "aoi", "position", "trial_second_sequence_attended", "correct_anticipation", "sticky_fixation"
    )


@bind(
    "g16_p26_per_trial",
    out(
        f"{_LOOKED} SELECT * FROM per_trial", "subject trial sequence subgroup",
        "position correct_reactive correct_anticipation sticky_fixation",
    ),
    doubles="correct_anticipation sticky_fixation",
)
def per_trial(spark, sf_dir):
    return seq.summarize_trials(with_reactive(spark, sf_dir))


def _stats(keys: str, sticky: str) -> str:
    return f"""SELECT {keys}, coalesce(sum(correct_anticipation), 0) AS n_correct_anticipations,
      coalesce(sum(sticky_fixation), 0) AS {sticky}, coalesce(sum(correct_reactive), 0) AS n_reactive_after_second_sequence,
      max(trial) AS trial_max_completed, count(DISTINCT trial) AS n_total_anticipations FROM per_trial GROUP BY ALL"""


@bind(
    "t7_g17_j14_subject_statistics",
    out(
        f"""{_LOOKED} SELECT s.*, n_reactive_all_task, trial_second_sequence_attended FROM ({_stats("subject", "n_sticky_fixation")}) s
        LEFT JOIN (SELECT subject, sum(correct_reactive) AS n_reactive_all_task FROM reacted GROUP BY ALL) r ON s.subject = r.subject
        JOIN reached e ON s.subject = e.subject""",
        "subject n_correct_anticipations n_sticky_fixation trial_max_completed n_total_anticipations n_reactive_all_task "
        "trial_second_sequence_attended",
        "n_reactive_after_second_sequence",
    ),
)
def subject_statistics(spark, sf_dir):
    periods = [glance(spark, sf_dir, p) for p in ("anticipatory", "reactive")]
    return sequence_learning.reduce(*periods).subject


_SUBGROUP_STATS = f"""SELECT g.subject, g.subgroup, n_correct_anticipations, n_sticky_fixations, n_reactive_after_second_sequence,
  trial_max_completed, n_total_anticipations, n_reactive_all_task, trial_second_sequence_attended FROM
  (SELECT DISTINCT subject, unnest([1, 2, 3, 4]) AS subgroup FROM per_trial) g
  LEFT JOIN ({_stats("subject, subgroup", "n_sticky_fixations")}) s ON s.subject = g.subject AND s.subgroup = g.subgroup
  LEFT JOIN (SELECT subject, subgroup, sum(correct_reactive) AS n_reactive_all_task FROM reacted GROUP BY ALL) r
  ON r.subject = g.subject AND r.subgroup = g.subgroup JOIN reached e ON g.subject = e.subject"""
_SUB = " ".join(sequence_learning.MEASURES)


@bind(
    "g18_subgroup_statistics",
    out(f"{_LOOKED} {_SUBGROUP_STATS}", "subject subgroup trial_second_sequence_attended", _SUB),
    doubles=_SUB,
)
def subgroup_statistics(spark, sf_dir):
    periods = [glance(spark, sf_dir, p) for p in ("anticipatory", "reactive")]
    return seq.subgroup_table(sequence_learning.marked_trials(*periods))


_SUB_WIDE = " ".join(f"{m}_{n}" for m in sequence_learning.MEASURES for n in seq.SUBGROUPS)


@bind(
    "t7_v7_subgroups_wide",
    out(
        f"""{_LOOKED} SELECT subject, {', '.join(f"max({m}) FILTER (subgroup = {n}) AS {m}_{n}" for m in sequence_learning.MEASURES for n in seq.SUBGROUPS)}
        FROM ({_SUBGROUP_STATS}) GROUP BY subject""",
        "subject", _SUB_WIDE,
    ),
    doubles=_SUB_WIDE,
)
def subgroups_wide(spark, sf_dir):
    periods = [glance(spark, sf_dir, p) for p in ("anticipatory", "reactive")]
    return sequence_learning.reduce(*periods).subgroup


# --- raw gaze to scores ---------------------------------------------------------------------

THREE = three_position_areas(((100, 700), (100, 500)), ((1200, 1800), (100, 500)), ((700, 1200), (600, 1000)))


def _raw_sql(variant: str, places: int) -> str:
    """The planned looks of the eye, scored like the fixations of the other queries."""
    length, trials = _LENGTHS[variant]
    return f"""WITH {sequence_sql(trials, _POSITIONS[variant], places)}, looked AS (SELECT *, (trial + {length - 1}) // {length} AS sequence,
      {_SUBGROUPS[variant]} AS subgroup FROM glanced), {_SCORED}"""


_SUBJECT = f"""SELECT s.*, n_reactive_all_task, trial_second_sequence_attended FROM ({_stats("subject", "n_sticky_fixation")}) s
  LEFT JOIN (SELECT subject, sum(correct_reactive) AS n_reactive_all_task FROM reacted GROUP BY ALL) r ON s.subject = r.subject
  JOIN reached e ON s.subject = e.subject"""


def raw_scores(spark, sf_dir, variant, places, areas):
    trials = numbers.VARIANTS[variant].trials
    gaze = sequence_gaze(spark, sf_dir, trials, lambda t: numbers.stimulus_position(t, variant), places)
    return sequence_learning.reduce_gaze(gaze, variant, areas)


@bind(
    "t7_raw_gaze_9m",
    out(
        f"{_raw_sql('9m', 2)} {_SUBJECT}",
        "subject n_correct_anticipations n_sticky_fixation trial_max_completed n_total_anticipations n_reactive_all_task "
        "trial_second_sequence_attended",
        "n_reactive_after_second_sequence",
    ),
)
def raw_nine_months(spark, sf_dir):
    """Samples of the version of 9 months, in bands, to the scores of each subject."""
    return raw_scores(spark, sf_dir, "9m", TWO_PLACES, BAND_AREAS).subject


@bind(
    "t7_raw_gaze_16m_three_positions",
    out(
        f"""{_raw_sql('16m', 3)} SELECT subject, {', '.join(f"max({m}) FILTER (subgroup = {n}) AS {m}_{n}" for m in sequence_learning.MEASURES for n in seq.SUBGROUPS)}
        FROM ({_SUBGROUP_STATS}) GROUP BY subject""",
        "subject", _SUB_WIDE,
    ),
    doubles=_SUB_WIDE,
)
def raw_sixteen_months(spark, sf_dir):
    """Samples of the version of 16 months, with three positions, to the scores of each sub-block."""
    return raw_scores(spark, sf_dir, "16m", THREE_PLACES, THREE).subgroup


# --- area export ---------------------------------------------------------------------------

_NAMED = "aoi LIKE '%ANTICIPATION INCORRECT {n}%' OR aoi LIKE '%ANTICIPATION CORRECT {n}%' OR aoi LIKE '%DOING IT {n}%'"
_LIST = {k: ", ".join(f"'{a}'" for a in names) for k, names in (
    ("correct", screens.CORRECT_AREAS), ("incorrect", screens.INCORRECT_AREAS), ("reactive", screens.REACTIVE_AREAS),
    ("unambiguous", screens.UNAMBIGUOUS_AREAS), ("black", screens.BLACK_SCREENS))}
_WINDOW = f"""((coalesce(stimulus IN ({_LIST["black"]}), false) AND entry_ms > 200 AND entry_ms < 1000)
  OR (aoi_group = '150ms' AND entry_ms > 0 AND entry_ms < 150) OR (aoi_group = '50ms' AND entry_ms > 0 AND entry_ms < 50))"""
_V1 = f"""v1 AS (SELECT *, CASE WHEN {_NAMED.format(n=3)} THEN 3 WHEN {_NAMED.format(n=2)} THEN 2 WHEN {_NAMED.format(n=1)} THEN 1 ELSE 0 END AS position,
  CASE WHEN aoi IN ({_LIST["unambiguous"]}) THEN 'unambiguous' ELSE 'ambiguous' END AS trial_type,
  CASE WHEN trial < 9 THEN 1 WHEN trial <= 384 THEN 2 + (trial - 9) // 6 ELSE 0 END AS trial_recoded,
  CASE WHEN aoi IN ({_LIST["reactive"]}) AND entry_ms > 0 THEN 1 ELSE 0 END AS reactive,
  CASE WHEN trial < 6 THEN 1 WHEN trial > 384 THEN 65 ELSE 1 + trial // 6 END AS trial_raw FROM visit),
v2 AS (SELECT *, CASE WHEN trial_raw BETWEEN 1 AND 65 THEN (trial_raw - 1) % 4 + 1 ELSE 0 END AS subtrial FROM v1),
v3 AS (SELECT *, CASE WHEN position = 2 AND subtrial = 2 THEN 1 WHEN position = 3 AND subtrial = 4 THEN 1
  WHEN position = 1 AND subtrial = 3 THEN 2 WHEN position = 1 AND subtrial = 1 THEN 3 ELSE 0 END AS previous_position FROM v2),
labelled AS (SELECT *, CASE WHEN aoi IN ({_LIST["correct"]}) AND {_WINDOW} THEN 1 ELSE 0 END AS correct_anticipation,
  CASE WHEN aoi IN ({_LIST["incorrect"]}) AND {_WINDOW}
       AND NOT coalesce(aoi LIKE '%POSITION ' || previous_position || '%' AND previous_position > 0, false) THEN 1 ELSE 0 END AS incorrect_anticipation
  FROM v3)"""
_LABELS = "position trial_recoded reactive trial_raw subtrial previous_position correct_anticipation incorrect_anticipation"


@bind(
    "c6_c7_c8_c9_c10_c11_c12_c13_label_visits",
    out(
        f"{VISIT}, {_V1} SELECT * FROM labelled", f"participant trial {_LABELS}", "entry_ms fix_ms",
        "eye aoi stimulus aoi_group trial_type",
    ),
)
def label_visits(spark, sf_dir):
    return v.label_visits(visit(spark, sf_dir))


@bind(
    "p15_right_eye",
    out(f"{VISIT} SELECT participant, trial, fix_ms FROM visit WHERE eye = 'Right'", "participant trial", "fix_ms"),
)
def right_eye(spark, sf_dir):
    return v.right_eye(visit(spark, sf_dir)).select("participant", "trial", "fix_ms")


_TIMES = f"""{VISIT}, {_V1}, times AS (SELECT participant, trial_recoded, trial_type,
  coalesce(sum(fix_ms) FILTER (correct_anticipation = 1), 0) AS correct_anticipation_time,
  coalesce(sum(fix_ms) FILTER (incorrect_anticipation = 1), 0) AS incorrect_anticipation_time,
  coalesce(sum(fix_ms) FILTER (reactive = 1), 0) AS reactive_time
  FROM labelled WHERE eye = 'Right' GROUP BY ALL)"""
_TIME_NAMES = "correct_anticipation_time incorrect_anticipation_time reactive_time"


@bind(
    "g19_v6_p27_looking_times",
    out(f"{_TIMES} SELECT * FROM times", "participant trial_recoded", _TIME_NAMES, "trial_type"),
)
def looking_times(spark, sf_dir):
    return v.looking_times(v.label_visits(v.right_eye(visit(spark, sf_dir))))


_VALID = f"""{_TIMES}, flags AS (SELECT *, abs(correct_anticipation_time - incorrect_anticipation_time) AS difference_between_fixations,
  CASE WHEN reactive_time > 100 THEN 1 ELSE 0 END AS reactive,
  CASE WHEN trial_recoded > 12 AND trial_recoded <= 38 THEN 'block1' WHEN trial_recoded > 38 AND trial_recoded <= 65 THEN 'block2' ELSE '' END AS block
  FROM times),
validated AS (SELECT *,
  CASE WHEN difference_between_fixations < 100 THEN 0 WHEN correct_anticipation_time > incorrect_anticipation_time THEN 1 ELSE 0 END AS correct_anticipation,
  CASE WHEN difference_between_fixations < 100 THEN 0 WHEN correct_anticipation_time < incorrect_anticipation_time THEN 1 ELSE 0 END AS incorrect_anticipation
  FROM flags),
final AS (SELECT *, reactive * correct_anticipation AS valid_correct_anticipation,
  reactive * incorrect_anticipation AS valid_incorrect_anticipation FROM validated)"""


@bind(
    "c14_p25_validate_anticipations",
    out(
        f"{_VALID} SELECT * FROM final",
        "participant trial_recoded reactive correct_anticipation incorrect_anticipation valid_correct_anticipation valid_incorrect_anticipation",
        f"{_TIME_NAMES} difference_between_fixations", "trial_type block",
    ),
)
def validate_anticipations(spark, sf_dir):
    return area_export.trials(visit(spark, sf_dir))


@bind(
    "p18_drop_practice",
    out(f"{_VALID} SELECT participant, trial_recoded FROM final WHERE trial_recoded > 12", "participant trial_recoded"),
)
def drop_practice(spark, sf_dir):
    return clean.drop_practice(area_export.trials(visit(spark, sf_dir))).select("participant", "trial_recoded")


@bind(
    "g20_counts_by_sets",
    out(
        f"""{_VALID} SELECT participant, trial_type, CASE WHEN grouping(block) = 0 THEN block END AS block,
        CASE WHEN grouping(block) = 0 THEN 'block' ELSE 'total' END AS level, {', '.join(f'sum({m}) AS {m}' for m in v.COUNTS)}
        FROM final WHERE trial_recoded > 12
        GROUP BY GROUPING SETS ((participant, trial_type), (participant, trial_type, block))""",
        "participant " + " ".join(v.COUNTS), "", "trial_type block level",
    ),
)
def counts_by_sets(spark, sf_dir):
    return v.counts_by_sets(area_export.trials(visit(spark, sf_dir)))


_CELLS = ", ".join(
    [f"sum({m}) FILTER (trial_type = '{t}') AS {m}_{t}" for m in v.COUNTS for t in v.TYPES]
    + [f"sum({m}) FILTER (trial_type = '{t}' AND block = '{b}') AS {m}_{t}_{b}" for m in v.COUNTS for t in v.TYPES for b in v.BLOCKS]
)
_TOTALS = ", ".join(
    [f"{m}_ambiguous + {m}_unambiguous AS {m}_total" for m in v.COUNTS]
    + [f"{m}_ambiguous_{b} + {m}_unambiguous_{b} AS {m}_total_{b}" for m in v.COUNTS for b in v.BLOCKS]
)
_T8 = " ".join(
    [f"{m}_{t}" for m in v.COUNTS for t in (*v.TYPES, "total")]
    + [f"{m}_{t}_{b}" for m in v.COUNTS for t in (*v.TYPES, "total") for b in v.BLOCKS]
)


@bind(
    "t8_j12_area_export",
    out(
        f"""{_VALID} SELECT *, {_TOTALS} FROM (SELECT participant, {_CELLS} FROM final WHERE trial_recoded > 12 GROUP BY participant)""",
        "participant", _T8,
    ),
    doubles=_T8,
)
def area_export_scores(spark, sf_dir):
    return area_export.reduce(visit(spark, sf_dir))


@bind(
    "p21_text_trial_number",
    out("SELECT l_orderkey, 1 + l_orderkey % 390 AS trial FROM lineitem", "l_orderkey trial"),
)
def text_trial_number(spark, sf_dir):
    text = F.concat(F.lit("Trial"), F.lpad((1 + F.col("l_orderkey") % 390).cast("string"), 3, "0"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", text.alias("text"))
    return rows.select("l_orderkey", clean.text_trial_number(F.col("text")).alias("trial"))
