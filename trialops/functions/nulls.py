"""Null rules of the scores, stated once.

Missing values are NULL everywhere inside the engine.  A comparison with a missing value
counts as false, also under negation; a plain ``+`` keeps missing values, a total skips them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def is_true(condition: Column) -> Column:
    """A condition in which "unknown" means false, so that it can be negated safely."""
    return F.coalesce(condition, F.lit(False))


def nan_to_null(column: Column) -> Column:
    return F.nanvl(column, F.lit(None).cast("double"))


def differs(column: Column, value) -> Column:
    """``!=`` where a missing value differs from every value."""
    return ~column.eqNullSafe(F.lit(value))


def sum_or_zero(column: Column) -> Column:
    """Aggregate sum; a group without values sums to 0."""
    return F.coalesce(F.sum(column), F.lit(0))


def total(columns: list[Column]) -> Column:
    """Row total that skips missing parts."""
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in columns])


def strict_total(columns: list[Column]) -> Column:
    """Row total that is missing when any part is."""
    return reduce(lambda a, b: a + b, columns)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that is missing instead of failing when the denominator is 0."""
    return F.try_divide(numerator, denominator)


def strict_int(name: str, kind: str = "int") -> Column:
    """Cast to an integer (fractions are cut) and fail on a missing value."""
    column = F.col(name)
    missing = F.raise_error(F.lit(f"missing value in column {name}")).cast(kind)
    return F.when(column.isNull(), missing).otherwise(column.cast(kind)).alias(name)


def decimal_comma(column: Column) -> Column:
    """Text with a decimal comma to double."""
    return F.translate(F.trim(column), ",", ".").cast("double")


def to_number(column: Column) -> Column:
    """Number in a text; text that holds none is missing."""
    return F.trim(column).try_cast("double")
