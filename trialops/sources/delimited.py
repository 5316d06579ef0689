"""Delimited recordings: one scan over all files of a folder.

Columns are read as text in the order of the header and converted by name.  A file whose header
has another order fails instead of being misread; with ``by_header`` files are grouped by their
header first, and the groups are read and stacked by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from trialops.functions.nulls import decimal_comma
from trialops.operators.clean import relative_time, text_trial_number
from trialops.sources import schemas
from trialops.sources.headers import header_groups

Columns = dict[str, tuple[str, str]]
REJECTED = "_rejected_line"
#: Texts that mean a missing value in any column of a recording.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)


def _text_schema(spark: SparkSession, path, **options) -> StructType:
    """The header of the first file, every column as text."""
    header = spark.read.options(header=True, **options).csv(path).columns
    return StructType([StructField(name, StringType()) for name in header])


def read_text_columns(
    spark: SparkSession, path, sep: str, glob: str, skip_long: bool = False, by_header: bool = False, **options
) -> DataFrame:
    """All columns as text, plus ``file``, the path of the file: files of one name in two folders
    are two recordings.

    With ``skip_long`` lines with more fields than the header are dropped; short lines are kept
    and padded in any case.  With ``by_header`` files may differ in their columns and the order of
    them; a column that a file does not have is NULL in its rows.
    """
    if by_header:
        groups = header_groups(spark, path, glob)
        if len(groups) > 1:
            return stack(*[read_text_columns(spark, files, sep, glob, skip_long, **options) for files in groups])
    options = {"sep": sep, "pathGlobFilter": glob, **options}
    schema = _text_schema(spark, path, **options)
    if skip_long:
        schema = schema.add(REJECTED, StringType())
    # pruned columns would hide surplus fields from the parser
    reader = spark.read.schema(schema).options(
        header=True,
        enforceSchema=False,
        mode="PERMISSIVE",
        columnNameOfCorruptRecord=REJECTED,
        columnPruning=not skip_long,
        **options,
    )
    rows = reader.csv(path)
    if skip_long:
        fields = F.size(F.split(REJECTED, _outside_quotes(sep)))
        # always true, but Spark does not read the rejected line without a column beside it
        beside = F.length(F.concat_ws("", F.col(f"`{schema.names[0]}`"))) >= 0
        rows = rows.filter((F.col(REJECTED).isNull() | (fields <= len(schema) - 1)) & beside).drop(REJECTED)
    folder = F.regexp_extract("_metadata.file_path", "^(.*/)", 1)
    return rows.withColumn("file", F.concat(folder, "_metadata.file_name"))


def _outside_quotes(sep: str) -> str:
    """Pattern of a separator that is followed by an even number of quotes."""
    return f'[{sep}](?=(?:[^"]*"[^"]*")*[^"]*$)'


def typed(rows: DataFrame, columns: Columns, comma: bool = False) -> DataFrame:
    """Named and typed columns; with ``comma`` numbers have a decimal comma.

    The texts of ``MISSING`` become NULL; any other text that is no number fails in a number column.
    """

    def convert(source: str, name: str, kind: str) -> Column:
        text = F.col(f"`{source}`")
        if kind == "string":
            return F.when(~text.isin(*MISSING), text).alias(name)
        text = F.when(~F.trim(text).isin(*MISSING), text)
        number = decimal_comma(text) if comma else F.trim(text).cast("double")
        return number.cast(kind).alias(name)

    return rows.select("file", *[convert(source, name, kind) for source, (name, kind) in columns.items()])


def subject_from_file(start: int, length: int, file: str = "file") -> Column:
    """Letters of the name of a file that is given by name or path."""
    return F.substring(F.substring_index(file, "/", -1), start, length)


def read_attention(spark: SparkSession, path, by_header: bool = False) -> DataFrame:
    return typed(read_text_columns(spark, path, ";", "*.csv", by_header=by_header), schemas.ATTENTION_COLUMNS)


def read_stop_signal(spark: SparkSession, path, by_header: bool = False) -> DataFrame:
    return typed(read_text_columns(spark, path, ";", "*.csv", by_header=by_header), schemas.STOP_COLUMNS, comma=True)


def read_touch(
    spark: SparkSession, path, columns: Columns = schemas.TOUCH_COLUMNS, by_header: bool = False
) -> DataFrame:
    """Sessions of touchscreen tasks; lines with too many fields are dropped."""
    return typed(read_text_columns(spark, path, ",", "*.csv", skip_long=True, by_header=by_header), columns)


def read_gaze(
    spark: SparkSession,
    path,
    subject: tuple[int, int],
    columns: Columns = schemas.GAP_OVERLAP_COLUMNS,
    by_header: bool = False,
) -> DataFrame:
    """Eye-tracker samples with the time since the start of the trial; ``.`` is missing."""
    text = read_text_columns(spark, path, "\t", "*.txt", by_header=by_header, nullValue=".")
    rows = typed(text, columns, comma=True)
    timed = relative_time(rows, "timestamp", "trial_start", "time")
    return timed.withColumn("subject", subject_from_file(*subject))


def read_visits(spark: SparkSession, path, by_header: bool = False) -> DataFrame:
    """Exported area visits; ``-`` is missing."""
    text = read_text_columns(spark, path, ",", "*.txt", by_header=by_header, nullValue="-")
    rows = typed(text, schemas.VISIT_COLUMNS)
    return rows.withColumn("trial", text_trial_number(F.col("trial_text"))).drop("trial_text")


def read_coded(spark: SparkSession, path, by_header: bool = False) -> DataFrame:
    """Coded video, one file per participant."""
    return typed(read_text_columns(spark, path, ";", "*.csv", by_header=by_header), schemas.CODED_COLUMNS)


def stack(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Tables under each other by column name; absent columns are empty."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first
