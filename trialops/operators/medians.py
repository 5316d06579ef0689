"""Exact medians per group that survive a group holding most of the rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Whole numbers of at most 65,536 distinct values; all others are any number.
FEW = (T.ByteType, T.ShortType)
#: Octaves below 1 in which a double may lie, and one more than those above it.
OCTAVES_BELOW, OCTAVES_ABOVE = 1075, 1025
RANGES_PER_OCTAVE = 1024
FINE_RANGES_PER_OCTAVE = 2**25


def weighted_median(value: Column, weight: Column) -> Column:
    """Aggregate: the exact median of values that occur ``weight`` times each.

    Meant for whole milliseconds, whose distinct values are bounded by the length of a trial.
    """
    return F.percentile(value, 0.5, weight)


def count_copies(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct values of each group with their number, ``copies``.

    The shuffle carries one row per distinct value and map task, spread over (keys, value).
    """
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("copies"))


def grouped_median(
    df: DataFrame, keys: list[str], value: str, name: str, sums: dict[str, Column] | None = None
) -> DataFrame:
    """One row per group with the exact median of ``value`` (missing values skipped).

    ``sums`` are further totals per group, given per distinct value and its ``copies``.
    Rows without a key belong to no group.
    """
    counted = count_copies(df.filter(reduce(and_, [F.col(k).isNotNull() for k in keys])), keys, value)
    if isinstance(df.schema[value].dataType, FEW):
        totals = [F.sum(c).alias(n) for n, c in (sums or {}).items()]
        return counted.groupBy(*keys).agg(weighted_median(F.col(value), F.col("copies")).alias(name), *totals)
    return median_of_counts(counted, keys, value, name, sums)


def value_range(value: Column, per_octave: int = RANGES_PER_OCTAVE) -> Column:
    """Number of a narrow range of values; larger values never have a smaller number.

    A range is the same fraction of its values everywhere, also beside zero, so that values of any
    unit fall in several of them; zero is a range of its own.
    """
    octave = F.least(F.log2(F.abs(value)), F.lit(float(OCTAVES_ABOVE)))
    number = F.floor(per_octave * octave) + F.lit(OCTAVES_BELOW * per_octave).cast("long")
    return F.when(value == 0, F.lit(0).cast("long")).otherwise(F.signum(value).cast("long") * number)


def median_of_counts(
    counted: DataFrame, keys: list[str], value: str, name: str, sums: dict[str, Column] | None = None
) -> DataFrame:
    """Exact medians of any values from their ``copies``.

    Values can be as many as there are rows, so a group is never ordered as a whole: the ranges of
    its values are counted, then the fine ranges within the one that holds the middle ranks, and
    only the fine range that holds them is ordered.  Values that lie close together far from zero,
    such as times since an epoch, share a range but not a fine one.
    """
    sums = sums or {}
    # stated here for both uses of the counts, else later joins add it to one of them only
    counted = counted.filter(reduce(and_, [F.col(k).isNotNull() for k in keys]))
    ranged = counted.withColumn("range", value_range(F.nanvl(value, F.lit(None).cast("double"))))
    inside = F.coalesce(F.sum(F.when(F.col("range").isNotNull(), F.col("copies"))), F.lit(0))
    ranges = ranged.groupBy(*keys, "range").agg(inside.alias("inside"), *[F.sum(c).alias(n) for n, c in sums.items()])
    group = Window.partitionBy(*keys)
    upto = group.orderBy(F.col("range").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    holds = "total = 0 OR (before < high_rank AND before + inside >= low_rank)"
    middle = (
        ranges.withColumns(
            {
                "before": F.sum("inside").over(upto) - F.col("inside"),
                "total": F.sum("inside").over(group),
                **{n: F.sum(n).over(group) for n in sums},
            }
        )
        .withColumns({"low_rank": F.expr("(total + 1) div 2"), "high_rank": F.expr("total div 2 + 1")})
        # a group without values keeps its one row, for the totals
        .filter(holds)
        .drop("inside")
    )
    # null-safe matching: no filter reaches the counts from this side only, so that Spark runs
    # the shuffle of the counts once for both uses
    fine = value_range(F.nanvl(value, F.lit(None).cast("double")), FINE_RANGES_PER_OCTAVE)
    near = (
        middle.alias("m")
        .join(ranged.alias("v"), _same(keys, "range"), "left")
        .select("m.*", f"v.{value}", "v.copies")
        .withColumn("fine", fine)
    )
    about = [*sums, "before", "total", "low_rank", "high_rank"]
    in_range = Window.partitionBy(*keys, "range").orderBy(F.col("fine").asc_nulls_first())
    finer = (
        near.groupBy(*keys, "range", "fine")
        .agg(F.sum(F.when(F.col("fine").isNotNull(), F.col("copies"))).alias("inside"), *[F.max(c).alias(c) for c in about])
        .withColumn("inside", F.coalesce("inside", F.lit(0)))
        .withColumn("upto", F.sum("inside").over(in_range.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("before", F.col("before") + F.col("upto") - F.col("inside"))
        .filter(holds)
        .drop("inside", "upto", "total")
    )
    in_fine = Window.partitionBy(*keys, "range", "fine").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ordered = (
        finer.alias("m")
        .join(near.select(*keys, "range", "fine", value, "copies").alias("v"), _same(keys, "range", "fine"), "left")
        .select("m.*", f"v.{value}", "v.copies")
        .withColumn("last_rank", F.col("before") + F.sum("copies").over(in_fine))
    )
    rank = "{} > last_rank - copies AND {} <= last_rank"
    low, high = (F.max(F.when(F.expr(rank.format(r, r)), F.col(value))) for r in ("low_rank", "high_rank"))
    return ordered.groupBy(*keys).agg(((low + high) / 2).alias(name), *[F.max(n).alias(n) for n in sums])


def _same(keys: list[str], *others: str) -> Column:
    return reduce(and_, [F.col(f"m.{c}").eqNullSafe(F.col(f"v.{c}")) for c in [*keys, *others]])
