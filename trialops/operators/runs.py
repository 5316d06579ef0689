"""Sets of whole numbers, such as trials, as runs ``start`` to ``end`` without gaps, one row per run.

A key has as many rows as its set has gaps, however long the runs are; windows see runs only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def to_runs(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """The runs of the ``number``s of each key; repeated and missing ones do not matter."""
    distinct = df.filter(F.col(number).isNotNull()).select(*keys, F.col(number).cast("long").alias("number")).distinct()
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("number"))
    # numbers of one run are as far from their places as each other
    apart = distinct.withColumn("apart", F.col("number") - place)
    runs = apart.groupBy(*keys, "apart").agg(F.min("number").alias("start"), F.max("number").alias("end"))
    return runs.drop("apart")


def subtract(runs: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """The runs of what is in ``runs`` and not in ``others``.

    Borders of both are merged in order: between two neighbouring borders a number is in the one
    set, the other, both or none, and what is in the first alone forms the new runs.  Runs of one
    table may overlap.
    """

    def borders(df: DataFrame, a: int, b: int) -> DataFrame:
        sides = F.array(
            F.struct(F.col("start").alias("at"), F.lit(a).alias("a"), F.lit(b).alias("b")),
            F.struct((F.col("end") + 1).alias("at"), F.lit(-a).alias("a"), F.lit(-b).alias("b")),
        )
        return df.filter("start <= end").select(*keys, F.inline(sides))

    merged = borders(runs, 1, 0).unionByName(borders(others, 0, 1))
    points = merged.groupBy(*keys, "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    in_order = Window.partitionBy(*keys).orderBy("at")
    upto = in_order.rowsBetween(Window.unboundedPreceding, 0)
    alone = (F.sum("a").over(upto) > 0) & (F.sum("b").over(upto) == 0)
    parts = points.select(*keys, "at", alone.alias("alone"), F.lead("at").over(in_order).alias("next"))
    opens = F.col("alone") & ~F.coalesce(F.lag("alone").over(in_order), F.lit(False))
    numbered = parts.withColumn("opens", opens.cast("int")).withColumn("run", F.sum("opens").over(upto))
    kept = numbered.filter("alone").groupBy(*keys, "run")
    return kept.agg(F.min("at").alias("start"), (F.max("next") - 1).alias("end")).drop("run")


def numbers(runs: DataFrame, name: str) -> DataFrame:
    """The members of each run; a row without a run keeps one row without a number."""
    return runs.withColumn(name, F.explode_outer(F.sequence("start", "end"))).drop("start", "end")
