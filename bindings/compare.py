"""Run bound queries in Spark and their SQL in DuckDB and compare the rows.

``python -m bindings.compare [sf_dir] [name ...]``
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

import bindings.catalog  # noqa: F401  (registers the queries)
from bindings.registry import ORACLES, QUERIES
from trialops.session import local_session


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for name in frame:
        if frame[name].dtype.kind in "iufb":
            frame[name] = frame[name].astype(float).round(6)
        else:
            frame[name] = frame[name].map(lambda v: None if v is None or v is pd.NA or v != v else str(v))
    return frame.sort_values(list(frame.columns), na_position="last", ignore_index=True)


def kind(column: pd.Series) -> str:
    """Kind of the values; whole numbers of which some are missing may be floats in one frame only."""
    return "f" if column.dtype.kind in "iu" and column.isna().any() else column.dtype.kind


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(set(got.columns) ^ set(want.columns))[:6]}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    kinds = {c: (kind(got[c]), kind(want[c])) for c in got if kind(got[c]) != kind(want[c])}
    got, want = normal(got), normal(want)
    for name in got:
        a, b = got[name], want[name]
        if a.dtype.kind == "f" and b.dtype.kind == "f":
            same = np.array_equal(a.to_numpy(), b.to_numpy(), equal_nan=True)
        else:
            same = a.equals(b) or (a.isna() & b.isna() | (a == b)).all()
        if not same:
            at = int(np.flatnonzero(~((a == b) | (a.isna() & b.isna())).to_numpy())[0])
            return f"values of {name}: {a[at]!r} != {b[at]!r}"
    return f"types of {list(kinds)[:3]}" if kinds else None


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = [n for n in QUERIES if not argv[1:] or any(n.startswith(a) for a in argv[1:])]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    duck = connect(sf_dir)
    failures = 0
    for name in names:
        start = time.perf_counter()
        try:
            got = QUERIES[name](spark, sf_dir).toPandas()
            seconds = time.perf_counter() - start
            problem = difference(got, duck.sql(ORACLES[name]).df()) if name in ORACLES else None
            note = "rows only" if name not in ORACLES else "equal"
        except Exception as error:  # report and go on
            got, seconds, note, problem = [], time.perf_counter() - start, "", str(error).strip()[:700]
        failures += problem is not None
        print(f"{name:36s} {len(got):8d} rows {seconds:6.2f} s  {problem or note}", flush=True)
    print(f"{len(names) - failures} of {len(names)} agree")
    return failures


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
