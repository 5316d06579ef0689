"""The physical plans: what is pushed down, read, shuffled and broadcast."""

import re
from pathlib import Path

import pytest

from __spark_entry__ import queries
from bindings.registry import QUERIES

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(TABLES).is_dir(), reason="tables not present")


def plan(spark, name):
    return queries()[name](spark, TABLES)._jdf.queryExecution().executedPlan().toString()


TASKS = [n for n in queries() if n.startswith("t")]
BOUND = list(QUERIES)


@pytest.mark.parametrize("name", TASKS)
def test_tasks_have_no_cross_joins(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize(
    "name, scans, shuffles",
    [
        ("t1_attention_subject", 1, 3),
        ("t3_touch", 1, 3),
        ("t7_g17_j14_subject_statistics", 2, 2),
        ("t8_j12_area_export", 1, 3),
        ("g18_subgroup_statistics", 2, 4),
        ("w4_j3b_first_correct", 2, 2),
    ],
)
def test_scans_and_shuffles(spark, name, scans, shuffles):
    text = plan(spark, name)
    assert text.count("FileScan") == scans
    assert text.count("Exchange hashpartitioning") <= shuffles


def test_only_needed_columns_are_read(spark):
    text = plan(spark, "t7_g17_j14_subject_statistics")
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>" in text
    assert "props" not in text


def test_the_eye_filter_runs_before_the_labels(spark):
    text = plan(spark, "t8_j12_area_export")
    assert "DataFilters: [NOT (((l_linenumber" in text


def final_plan(spark, name):
    df = queries()[name](spark, TABLES)
    df.collect()
    return executed(df._jdf.queryExecution().executedPlan().toString())


def executed(text):
    """The plan without the initial plans of its adaptive parts."""
    kept, skip = [], None
    for line in text.splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        if skip is not None and depth >= skip and "== Final Plan ==" not in line:
            continue
        skip = depth if "== Initial Plan ==" in line else None
        if skip is None:
            kept.append(line)
    return "\n".join(kept)


def test_coded_video_counts_its_files_once(spark):
    """Both sides of the join use one count of the events per file."""
    text = final_plan(spark, "t9_v8_j13_g21f_coded_video")
    assert "ReusedSubquery" in text and plan(spark, "t9_v8_j13_g21f_coded_video").count("Exchange hashpartitioning") <= 5


def test_no_query_sorts_rows_to_aggregate_them(spark):
    for name in BOUND:
        assert "SortAggregate" not in plan(spark, name), name


def test_weights_of_detection_are_computed_once(spark):
    """One shuffle of samples, one of stretches; cut-offs and runs read the same stretches."""
    text = final_plan(spark, "u1_w9_detect_fixations")
    assert text.count("MapInArrow weigh") == 1 and text.count("ReusedExchange") == 1
    assert text.count("FileScan") == 1 and "Python" not in text and "InPandas" not in text


@pytest.mark.parametrize("name, scans", [("g5_median_by_ranges", 1), ("t2_stop_signal_times", 1)])
def test_medians_shuffle_their_counts_once(spark, name, scans):
    text = final_plan(spark, name)
    assert text.count("FileScan") == scans and "ReusedExchange" in text


def test_generated_code_is_small_enough_to_be_compiled(spark):
    """The JVM does not compile methods beyond 8000 bytes."""
    debug = spark.sparkContext._jvm.org.apache.spark.sql.execution.debug.__getattr__("package")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # stages are known before the run
    try:
        for name in TASKS:
            text = debug.codegenString(queries()[name](spark, TABLES)._jdf.queryExecution().executedPlan())
            sizes = [int(size) for size in re.findall(r"maxMethodCodeSize:(\d+)", text)]
            assert sizes and max(sizes) < 8000, name
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_aggregates_combine_before_the_shuffle(spark):
    for name in ("g1_mean_rt_by_sets", "g12_reduce_fixations", "g5_median_by_ranges"):
        assert "partial_" in plan(spark, name)


def test_tasks_broadcast_only_by_checked_size(spark):
    """No forced broadcasts: with the size limit at 0 nothing is broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in TASKS:
            assert "Broadcast" not in plan(spark, name)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_file_facts_do_not_sort_samples(spark):
    assert "SortAggregate" not in plan(spark, "g13_file_facts")


@pytest.mark.parametrize("name", ["t5_j5_gap_overlap", "g11_latency_scores"])
def test_latency_scores_read_their_stored_counts_only(spark, name):
    text = plan(spark, name)
    assert "lineitem.parquet" not in text and text.count("FileScan") == text.count("latencies-")


def test_both_tables_of_the_attention_task_from_one_count(spark, rows):
    from bindings.views import trial_raw
    from trialops.plans import attention_network

    trials = trial_raw(spark, TABLES)
    cues = ["click", "view"]
    lazy, shared = (attention_network.reduce(trials, cues, share=share) for share in (False, True))
    for one, other in zip(lazy, shared, strict=True):
        text = other._jdf.queryExecution().executedPlan().toString()
        assert text.count("FileScan") == 1 and "events.parquet" not in text
        assert one.count() == other.count() > 0 and one.exceptAll(other).count() == 0


def test_shared_tables_are_marked_for_deletion(spark):
    from trialops.session import shared_table

    df = shared_table(spark.range(3).withColumn("k", spark.range(1).selectExpr("1").scalar()), "three", "k")
    assert df.columns == ["id", "k"] and df.count() == 3
