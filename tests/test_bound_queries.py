"""Every bound query against its SQL on the smallest tables."""

from pathlib import Path

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from bindings.compare import connect, difference

TABLES = "/root/testdata/sf0.001"
#: The smallest tables hold no subject with valid trials in both conditions of the gap-overlap task.
LARGER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(TABLES).is_dir(), reason="tables not present")


@pytest.fixture(scope="module")
def duck():
    return {tables: connect(tables) for tables in (TABLES, LARGER)}


def test_names():
    assert set(oracle_sql()) <= set(queries()) and len(queries()) >= 120


def test_flagship(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    tables = LARGER if name.startswith("t5") else TABLES
    got = queries()[name](spark, tables).toPandas()
    assert len(got) > 0
    if name in oracle_sql():
        assert difference(got, duck[tables].sql(oracle_sql()[name]).df()) is None
