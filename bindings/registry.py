"""Registry of bound queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame, doubles: str = "") -> DataFrame:
    """Whole numbers as bigint, fractions and the named columns as doubles with six places."""
    named = set(doubles.split())
    columns = []
    for field in df.schema:
        name = f"`{field.name}`"
        if field.name in named or isinstance(field.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            columns.append(f"round(CAST({name} AS DOUBLE), 6) AS {name}")
        elif isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            columns.append(f"CAST({name} AS BIGINT) AS {name}")
        else:
            columns.append(name)
    return df.selectExpr(*columns)


def out(sql: str, ints: str = "", floats: str = "", texts: str = "") -> str:
    """SQL with the same column types as ``plain``."""
    columns = [f'CAST("{c}" AS BIGINT) AS "{c}"' for c in ints.split()]
    columns += [f'round(CAST("{c}" AS DOUBLE), 6) AS "{c}"' for c in floats.split()]
    columns += [f'CAST("{c}" AS VARCHAR) AS "{c}"' for c in texts.split()]
    return f"SELECT {', '.join(columns)} FROM ({sql}) AS result"


def bind(name: str, sql: str | None = None, doubles: str = ""):
    """Register a query under ``name``; without SQL only its rows are checked.

    ``doubles`` names counts that may be missing; both sides give them as doubles.
    """

    def register(build: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: plain(build(spark, sf_dir), doubles)
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
