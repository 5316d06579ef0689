"""Score tables as delimited text or Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

EXPONENT = r"^(-?)(\d+)\.(\d+)E(-?\d+)$"


def plain_number(column: Column, infinite: str = "inf") -> Column:
    """The shortest digits of a number without an exponent; NaN is missing, ``infinite`` names +inf."""
    text = column.cast("string")
    sign, lead, rest = (F.regexp_extract(text, EXPONENT, i) for i in (1, 2, 3))
    power = F.regexp_extract(text, EXPONENT, 4).try_cast("int")
    digits = F.concat(lead, F.when(rest == "0", "").otherwise(rest))
    # the point lies ``power`` places behind the first digit
    padded = F.rpad(digits, F.greatest(power + 2, F.length(digits)), "0")
    large = F.concat(F.substr(padded, F.lit(1), power + 1), F.lit("."), F.substr(padded, power + 2))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    return (
        F.when(F.isnan(column), None)
        .when(F.abs(column) == float("inf"), F.concat(F.when(column < 0, "-").otherwise(""), F.lit(infinite)))
        # patterns cost far more than all else here, and few numbers have an exponent
        .when(~text.contains("E"), text)
        .when(power >= 0, F.concat(sign, large))
        .when(power < 0, F.concat(sign, small))
        .otherwise(text)
    )


def as_text(df: DataFrame, decimal: str, infinite: str = "inf") -> DataFrame:
    """Fractions as plain numbers with the wanted decimal sign, arrays joined by blanks."""
    columns = []
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (DoubleType, FloatType)):
            column = F.translate(plain_number(column, infinite), ".", decimal)
        elif isinstance(field.dataType, ArrayType):
            column = F.array_join(column, " ")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def write_scores(
    df: DataFrame,
    path: str,
    decimal: str = ",",
    sep: str = ";",
    infinite: str = "inf",
    order_by: Sequence[str | Column] = (),
) -> None:
    """Delimited files with a header; the folder is made when it is not there.

    With ``order_by`` the rows of the folder are in that order, read file by file in the order of
    the files' names: rows are dealt to files by ranges of it, by sampled bounds, and sorted within
    a file.  Missing values come first.  The order is that of the values, not of their texts.
    """
    rows = df
    if order_by:
        rows = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    as_text(rows, decimal, infinite).write.mode("overwrite").options(sep=sep, header=True).csv(path)


def read_ordered(spark: SparkSession, path: str, sep: str = ";", place: str = "place") -> DataFrame:
    """The text columns of an ordered folder and the ``place`` of each row in it, from 1.

    Rows are counted per file; places within a file and the counts of the files before it give the
    place, so no task holds more than a file.
    """
    lines = spark.read.options(sep=sep, header=True).csv(path)
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    rows = lines.select("*", F.col("_metadata.file_name").alias("_file"), at.alias("_at"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    # a row per file
    sizes = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select("_file", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy("_file").orderBy("_at"))
    placed = rows.withColumn("_within", within).join(offsets, "_file")
    return placed.withColumn(place, F.col("_offset") + F.col("_within")).drop("_file", "_at", "_within", "_offset")


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
