"""Long to wide tables and dense grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pivot_wide(
    df: DataFrame,
    keys: list[str],
    on: Column | str,
    measures: Sequence[str] | Mapping[str, str],
    values: Sequence | Mapping,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """One row per key, one column ``<measure>_<value>`` per measure and listed value.

    ``df`` has at most one row per key and value, so a key gathers at most ``len(values)`` cells.
    ``measures`` may map a column to the name it gets, and ``values`` a value to the text that names
    it; names must differ.  Rows whose measures are all missing do
    not create a key.  ``extra`` aggregates over all rows of a key are added as they are.
    """
    names = dict(measures) if isinstance(measures, Mapping) else {m: m for m in measures}
    values = dict(values) if isinstance(values, Mapping) else {v: v for v in values}
    columns = [*keys, *(f"{name}_{text}" for name in names.values() for text in values.values())]
    if twice := sorted({c for c in columns if columns.count(c) > 1}):
        raise ValueError(f"columns of one name: {twice}")
    on = F.col(on) if isinstance(on, str) else on
    present = df.filter(" OR ".join(f"`{m}` IS NOT NULL" for m in names))
    cell = F.when(on.isin(list(values)), F.struct(on.alias("value"), F.struct(*names).alias("measures")))
    cells = present.groupBy(*keys).agg(F.map_from_entries(F.collect_list(cell)).alias("cells"), *extra)
    wide = [
        f"cells[{_literal(value)}].`{measure}` AS `{name}_{text}`"
        for measure, name in names.items()
        for value, text in values.items()
    ]
    others = [c for c in cells.columns if c not in keys and c != "cells"]
    return cells.selectExpr(*[f"`{c}`" for c in keys], *wide, *[f"`{c}`" for c in others])


def _literal(value) -> str:
    if isinstance(value, str):
        quoted = value.replace("\\", "\\\\").replace("'", "\\'")
        return f"'{quoted}'"
    return str(value)


def label(*parts: str) -> Column:
    """Joined condition name such as ``block1_congruent``; missing if a part is."""
    complete = F.lit(True)
    for part in parts:
        complete &= F.col(part).isNotNull()
    return F.when(complete, F.concat_ws("_", *[F.col(p).cast("string") for p in parts]))


def dense_grid(df: DataFrame, key: str, name: str, values: Sequence[int]) -> DataFrame:
    """Every key of ``df`` with every listed value."""
    listed = F.array(*[F.lit(v) for v in values])
    return df.select(key).distinct().select(key, F.explode(listed).alias(name))


def fill_grid(df: DataFrame, key: str, name: str, values: Sequence[int]) -> DataFrame:
    """Add the missing (key, value) rows of ``df``, with empty measures."""
    measures = [c for c in df.columns if c not in (key, name)]
    blank = dense_grid(df, key, name, values).select(
        key, name, *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in measures]
    )
    # the real row and its blank twin meet in one group, so no join is needed
    return df.unionByName(blank).groupBy(key, name).agg(*[F.max(c).alias(c) for c in measures])


def extreme_rows(
    df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], largest: bool = False
) -> DataFrame:
    """The row of the smallest (or ``largest``) ``order`` of each key, without sorting the rows.

    The extreme is found in a hash table, which combines before the shuffle; then only the rows that
    reach it are looked at, and of several the one whose ``columns`` come first.  Rows without an
    order do not count; a missing key is a key.
    """
    rows = df.filter(F.col(order).isNotNull()).select(*keys, order, *columns)
    best = F.max(order) if largest else F.min(order)
    named = {k: f"_key{i}" for i, k in enumerate(keys)}
    extremes = rows.groupBy(*[F.col(k).alias(n) for k, n in named.items()]).agg(best.alias("_best"))
    same = F.col(order) == F.col("_best")
    for key, name in named.items():
        same &= F.col(key).eqNullSafe(F.col(name))
    # one row per key goes into the hash table, the rows themselves are not sorted
    reached = rows.join(extremes.hint("shuffle_hash"), same, "left_semi")
    if not columns:
        return reached.groupBy(*keys).agg(F.max(order).alias(order))
    within = Window.partitionBy(*keys).orderBy(*columns)
    return reached.withColumn("_place", F.row_number().over(within)).filter("_place = 1").drop("_place")


def first_row(df: DataFrame, keys: list[str], order: str, columns: Sequence[str]) -> DataFrame:
    """The first row of each key by ``order``."""
    return extreme_rows(df, keys, order, columns)


def last_of(df: DataFrame, keys: Sequence[str], order: str, number: str) -> DataFrame:
    """The largest ``order`` of each key and the largest ``number`` beside it, both without a sort.

    Rows are first reduced to one per key and order; of one order there is then one number, so that
    the second step takes it along in its hash table.
    """
    each = df.groupBy(*keys, order).agg(F.max(number).alias(number))
    return each.groupBy(*keys).agg(F.max(order).alias(order), F.max_by(number, order).alias(number))


def select_like(df: DataFrame, fragment: str) -> DataFrame:
    """Columns whose name contains ``fragment``."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if fragment in c])
