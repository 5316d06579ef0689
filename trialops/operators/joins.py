"""Joins of many rows with one row per key, where a single key may hold most of the rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

#: Rows of a key that one task joins.
ROWS_PER_TASK = 1_000_000
#: A key is spread over more tasks from this share of all rows on, so fewer keys than this are.
SHARES = 256


def fan_out(many: DataFrame, keys: list[str], rows_per_task: int = ROWS_PER_TASK, shares: int = SHARES) -> Column:
    """The number of tasks of each key of ``many`` that is spread: one value, a map by the hash of the key.

    Keys are counted first, which combines before the shuffle and reads their columns only.  A key
    is spread if it holds more than ``rows_per_task`` rows and more than one ``shares``th of all;
    its tasks hold about as much each.  The map has fewer than ``shares`` entries, whatever the data.
    """
    key = F.xxhash64(*keys).alias("key")
    counts = many.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    large = F.collect_list(F.when(F.col("rows") > rows_per_task, F.struct("key", "rows")))
    total = counts.agg(F.sum("rows").alias("total"), large.alias("large"))
    limit = F.greatest(F.lit(float(rows_per_task)), F.col("total") / shares)
    spread = F.filter("large", lambda k: k["rows"] > limit)
    tasks = F.transform(spread, lambda k: F.struct(k["key"], F.ceil(k["rows"] / limit).cast("int").alias("tasks")))
    return total.select(F.map_from_entries(tasks)).scalar()


def spread_join(
    many: DataFrame,
    one: DataFrame,
    keys: str | list[str],
    spread_by: list[str] | None = None,
    how: str = "inner",
    rows_per_task: int = ROWS_PER_TASK,
    shares: int = SHARES,
) -> DataFrame:
    """Inner or left join of ``many`` with ``one``, which has a row per key.

    The rows of a key with many of them go to as many tasks as their number asks for, by the hash of
    the ``spread_by`` columns (all of them, if none are named), and the key's row of ``one`` to each
    of these.  Other keys are joined as they are.  Rows that are equal in all these columns stay
    together.  An aggregate over the keys afterwards combines in those tasks first.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    names = spread_by or [f.name for f in many.schema if not isinstance(f.dataType, MapType)]
    left, right = salted(many, keys, names, fan_out(many, keys, rows_per_task, shares), one)
    same = reduce(and_, [left[k] == right[k] for k in [*keys, "salt"]])
    joined = left.join(right, same, how)
    others = [right[c] for c in one.columns if c not in keys]
    return joined.select(*[left[c] for c in many.columns], *others)


def salted(
    many: DataFrame, keys: list[str], spread_by: list[str], tasks_of: Column, one: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``salt``: a number below the tasks of the row's key, and all of these numbers."""
    tasks = F.coalesce(F.try_element_at(tasks_of, F.xxhash64(*keys)), F.lit(1))
    left = many.withColumn("salt", F.pmod(F.xxhash64(*spread_by), tasks).cast("int"))
    right = one.withColumn("salt", F.explode(F.sequence(F.lit(0), tasks - 1)))
    return left, right


def lookup(rows: DataFrame, facts: DataFrame, keys: str | list[str], **options) -> DataFrame:
    """The facts of its key on every row; rows whose key has none, or is missing, have NULL there."""
    return spread_join(rows, facts, keys, how="left", **options)
