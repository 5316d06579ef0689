"""Attention-network task with key presses: scores per subject, and per subject by block."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialops.functions.nulls import strict_total
from trialops.operators.clean import complete_trials, drop_anticipatory, name_blocks
from trialops.operators.reshape import pivot_wide
from trialops.operators.scores import ERROR_MEASURES, scores_by_sets, trial_sums
from trialops.session import shared_table

# Conditions and blocks the totals are made of, and the score names.
FLANKERS = ("congruent", "incongruent")
BLOCKS = ("block1", "block2", "block3", "block4")
MEASURES = {"target_rt": "Target_RT", **{m: m for m in ERROR_MEASURES}}
#: Stands between the parts of a condition; no name of a condition holds it.
BETWEEN = "\x1f"
Condition = tuple[str, ...]


class Scores(NamedTuple):
    subject: DataFrame
    block: DataFrame


def clean(trials: DataFrame) -> DataFrame:
    """Complete trials without anticipatory responses, blocks named."""
    columns = ["subject", "block_number", "trial", "rt", "acc", "cue", "flanker"]
    rows = complete_trials(trials, columns, ["subject", "rt", "acc"])
    named = rows.withColumn("block", name_blocks(F.col("block_number"))).drop("block_number")
    return drop_anticipatory(named)


def reduce(
    trials: DataFrame,
    cues: Sequence[str],
    flankers: Sequence[str] = FLANKERS,
    blocks: Sequence[str] = BLOCKS,
    totals_of: Sequence[str] = FLANKERS,
    share: bool = False,
) -> Scores:
    """Wide scores of ``subject, block_number, trial, rt, acc, cue, flanker`` trials.

    Subjects need a correct trial, and for the block scores one in a named block.  Columns are named
    by the condition; where a cue and a flanker share a name, by ``cue_`` or ``flanker_`` and it.
    With ``share`` the trials are counted and the counts stored at once, and both tables read those.
    """
    names = condition_names(cues, flankers)
    totals = [names["flanker", f] for f in totals_of]
    rows = clean(trials)
    cells = shared_table(trial_sums(rows, ["subject", "block", "cue", "flanker"]), "trials") if share else None
    return Scores(
        _subject_scores(scores_by_sets(rows, levels=["subject"], parts=True, cells=cells), names, totals),
        _block_scores(scores_by_sets(rows, levels=["block"], parts=True, cells=cells), names, blocks, totals),
    )


def condition_names(cues: Sequence[str], flankers: Sequence[str]) -> dict[Condition, str]:
    """The names of the cues, the flankers and their combinations."""
    combined = [("flanker_cue", f, c) for f in flankers for c in cues]
    conditions = [*[("cue", c) for c in cues], *[("flanker", f) for f in flankers], *combined]
    often = Counter("_".join(parts) for _, *parts in conditions)
    return {c: "_".join(c[1:]) if often["_".join(c[1:])] == 1 else "_".join(c) for c in conditions}


def _wide(long: DataFrame, names: dict[Condition, str]) -> DataFrame:
    """One row per subject that has a correct trial at that level; ``names`` are by grouping, block
    if any, flanker and cue."""
    rows = long.withColumn("named", F.concat_ws(BETWEEN, "by", "block", "flanker", "cue"))
    values = {BETWEEN.join(condition): name for condition, name in names.items()}
    means = F.count("target_rt").alias("means")
    return pivot_wide(rows, ["subject"], "named", MEASURES, values, extra=[means]).filter("means > 0").drop("means")


def _subject_scores(long: DataFrame, names: dict[Condition, str], totals_of: Sequence[str]) -> DataFrame:
    wide = _wide(long, names)
    return wide.withColumns(
        {
            name: strict_total([F.col(f"{measure}_{c}") for c in totals_of])
            for name, measure in (
                ("n_total_comission_errors", "n_comission_errors"),
                ("n_total_omission_errors", "n_omission_errors"),
                ("n_total_errors", "n_total_errors"),
            )
        }
    )


def _block_scores(
    long: DataFrame, names: dict[Condition, str], blocks: Sequence[str], totals_of: Sequence[str]
) -> DataFrame:
    wide = _wide(long, {(c[0], b, *c[1:]): f"{b}_{name}" for b in blocks for c, name in names.items()})
    totals = []
    for block in blocks:
        commission = [f"coalesce(`n_comission_errors_{block}_{c}`, 0)" for c in totals_of]
        omission = [f"coalesce(`n_omission_errors_{block}_{c}`, 0)" for c in totals_of]
        totals += [
            f"{' + '.join(commission)} AS n_total_comission_errors_{block}",
            f"{' + '.join(omission)} AS n_total_omission_errors_{block}",
            f"{' + '.join(commission + omission)} AS n_total_errors_{block}",
        ]
    return wide.selectExpr("*", *totals)
