import random

import pytest
from pyspark.sql import functions as F

from trialops.operators import joins
from trialops.operators.intervals import cut_at_interruption
from trialops.operators.reshape import extreme_rows, first_row, last_of
from trialops.operators.runs import numbers, subtract, to_runs


@pytest.fixture
def shuffled(spark):
    """Joins through shuffles only, without adaptive changes to them."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "40"}
    before = {k: spark.conf.get(k) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.set(key, value)


def largest_task(df):
    """The share of the rows that the fullest task holds."""
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes) / sum(sizes)


def test_a_file_with_a_third_of_the_events_is_spread_over_tasks(shuffled):
    third = 6000
    events = shuffled.range(3 * third).select(
        F.when(F.col("id") < third, "hot").otherwise(F.concat(F.lit("f"), F.col("id") % 400)).alias("file"),
        F.lit("Behaviour1").alias("stream"),
        (F.col("id") % 977).cast("double").alias("onset"),
        (F.col("id") % 977 + 5).cast("double").alias("offset"),
        F.col("id").cast("string").alias("code"),
    )
    files = events.select("file").distinct().withColumn("first_irruption_onset", F.lit(500.0))
    joined = joins.spread_join(events, files, "file", rows_per_task=500)
    assert largest_task(joined) <= 0.1
    together = events.join(files.hint("merge"), "file")
    assert largest_task(together) >= 1 / 3
    assert joined.count() == 3 * third and sorted(joined.columns) == sorted(together.columns)
    cut = cut_at_interruption(events, files)
    want = together.filter("onset < 500").select(*events.columns[:3], F.least("offset", F.lit(500.0)).alias("offset"), "code")
    assert cut.select(want.columns).exceptAll(want).count() == 0 and cut.count() == want.count()


def test_tasks_follow_the_rows_of_a_key(shuffled):
    rows = shuffled.createDataFrame([("a",)] * 90 + [("b",)] * 30 + [("c",)] * 5 + [(None,)] * 40, "k string")
    tasks = shuffled.range(1).select(joins.fan_out(rows, ["k"], rows_per_task=10, shares=1000).alias("m")).first().m
    assert sorted(tasks.values()) == [3, 4, 9]
    # no more than a share of all rows in a task, but not more tasks than shares either
    few = shuffled.range(1).select(joins.fan_out(rows, ["k"], rows_per_task=10, shares=3).alias("m")).first().m
    assert sorted(few.values()) == [2]


def test_lookups_keep_rows_without_facts(shuffled):
    rows = shuffled.createDataFrame([("a", i) for i in range(50)] + [("b", 1), (None, 2), (None, 3), ("z", 4)], "k string, n int")
    facts = shuffled.createDataFrame([("a", 1.5), ("b", 2.5), (None, 9.0), ("y", 3.5)], "k string, v double")
    got = joins.lookup(rows, facts, "k", rows_per_task=10)
    assert got.columns == ["k", "n", "v"]
    want = [("a", i, 1.5) for i in range(50)] + [("b", 1, 2.5), (None, 2, None), (None, 3, None), ("z", 4, None)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert joins.lookup(rows.filter("false"), facts, "k").count() == 0


def test_lookup_spreads_a_hot_key(shuffled):
    rows = shuffled.range(9000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), "id")
    facts = rows.select("k").distinct().withColumn("v", F.col("k") * 2)
    got = joins.lookup(rows, facts, ["k"], rows_per_task=200)
    assert largest_task(got) <= 0.1 and got.filter("v = 2 * k").count() == 9000


def test_first_rows_with_ties_missing_orders_and_missing_keys(spark):
    data = [(1, 5, "b"), (1, 3, "z"), (1, 3, "c"), (1, None, "a"), (None, 2, "x"), (None, 1, None), (2, None, "q"), (3, 7, "m"), (3, 7, "m")]
    df = spark.createDataFrame(data, "k int, o int, t string")
    assert {tuple(r) for r in first_row(df, ["k"], "o", ["t"]).collect()} == {(1, 3, "c"), (None, 1, None), (3, 7, "m")}
    assert {tuple(r) for r in extreme_rows(df, ["k"], "o", ["t"], largest=True).collect()} == {(1, 5, "b"), (None, 2, "x"), (3, 7, "m")}
    assert {tuple(r) for r in extreme_rows(df, ["k"], "o", []).collect()} == {(1, 3), (None, 1), (3, 7)}


def test_last_of_takes_the_largest_number_beside_the_largest_order(spark):
    pick = random.Random(3)
    data = [(pick.randint(1, 5), pick.choice([None, 1.0, 2.0, 3.0]), pick.choice([None, 1.0, 5.0, 9.0])) for _ in range(60)]
    df = spark.createDataFrame(data, "k int, o double, n double")
    want = {}
    for k in {k for k, _, _ in data}:
        most = max((o for key, o, _ in data if key == k and o is not None), default=None)
        want[k] = (k, most, max((n for key, o, n in data if key == k and o == most and o is not None and n is not None), default=None))
    got = last_of(df.filter("o IS NOT NULL"), ["k"], "o", "n")
    assert {tuple(r) for r in got.collect()} == {w for w in want.values() if w[1] is not None}


@pytest.mark.parametrize("seed", range(3))
def test_runs_and_their_difference_equal_sets(spark, seed):
    pick = random.Random(seed)
    sets = [{k: {pick.randint(-5, 25) for _ in range(pick.randint(0, 25))} for k in range(12)} for _ in range(2)]
    a, b = (spark.createDataFrame([(k, n) for k, ns in s.items() for n in [*ns, *ns]] + [(0, None)], "k int, n int") for s in sets)
    runs = to_runs(a, ["k"], "n")
    assert runs.count() == sum(len([n for n in s if n - 1 not in s]) for s in sets[0].values())
    left = subtract(runs, to_runs(b, ["k"], "n"), ["k"])
    assert {tuple(r) for r in numbers(left, "n").collect()} == {(k, n) for k in range(12) for n in sets[0][k] - sets[1][k]}
    # runs of a result do not touch
    assert to_runs(numbers(left, "n"), ["k"], "n").count() == left.count()


def test_a_long_set_is_one_row(spark):
    long = spark.range(100_000).selectExpr("1 AS k", "id AS n")
    assert [tuple(r) for r in to_runs(long, ["k"], "n").collect()] == [(1, 0, 99_999)]
    cut = spark.createDataFrame([(1, 10, 19), (1, 15, 30)], "k int, start long, end long")
    assert sorted(tuple(r) for r in subtract(to_runs(long, ["k"], "n"), cut, ["k"]).collect()) == [(1, 0, 9), (1, 31, 99_999)]
