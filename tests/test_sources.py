import pytest
from pyspark.sql import functions as F

from trialops.sources import delimited, schemas, sinks


def write(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)
    return str(folder)


HEADER = "subject_nr,trialType,response_time,correct,datetime\n"


def test_long_lines_go_and_short_ones_stay(spark, tmp_path, rows):
    path = write(tmp_path / "t", "one.csv", HEADER + "1,Alert,300,1,d\n1,Alert,300,1,d,extra\n2,Alert\n3,\"Al,ert\",5,1,d\nx,Alert,300,1,d\n".replace("x,", "4,"))
    df = delimited.read_touch(spark, path)
    assert rows(df, "subject", "condition", "rt") == [(1, "Alert", 300), (2, "Alert", None), (3, "Al,ert", 5), (4, "Alert", 300)]
    assert rows(df, "subject") == [(1,), (2,), (3,), (4,)]  # also when other columns are pruned
    assert df.count() == 4


def test_only_files_with_the_wanted_ending_are_read(spark, tmp_path):
    path = write(tmp_path / "t", "one.csv", HEADER + "1,Alert,300,1,d\n")
    write(tmp_path / "t", "notes.txt", "nothing to see\n")
    assert delimited.read_touch(spark, path).count() == 1


def test_gaze_files(spark, tmp_path):
    names = list(schemas.GAP_OVERLAP_COLUMNS)
    lines = "\t".join(names) + "\n" + "\t".join(["1", "1000,5", "1002,75", ".", "3,5", "-1921", "7", "right"]) + "\n"
    path = write(tmp_path / "g", "0123456789abcdefSUBJECT1.txt", lines)
    r = delimited.read_gaze(spark, path, schemas.GAP_OVERLAP_SUBJECT).first()
    assert (r.subject, r.trial, r.time, r.left_x, r.left_y, r.right_x, r.side) == ("SUBJECT1", 1, 2.25, None, 3.5, -1921.0, "right")


def test_another_header_order_fails_and_groups_can_be_stacked(spark, tmp_path, rows):
    folder = write(tmp_path / "t", "a.csv", HEADER + "1,Alert,300,1,d\n")
    write(tmp_path / "t", "b.csv", "trialType,subject_nr,response_time,correct,datetime\nAlert,2,400,1,d\n")
    with pytest.raises(Exception, match="header does not conform"):
        delimited.read_touch(spark, folder).collect()
    parts = [delimited.read_touch(spark, f"{folder}/{name}.csv") for name in "ab"]
    assert rows(delimited.stack(*parts), "subject", "rt") == [(1, 300), (2, 400)]


def test_dotted_headers(spark, tmp_path, rows):
    path = write(tmp_path / "a", "x.csv", "Subject;BlockList;Trial;Target.RT;Target.ACC;CueCond;Flanker;Other\n1;2;t;300;1;none;congruent;z\n1;5;t;;1;none;congruent;z\n")
    assert rows(delimited.read_attention(spark, path), "subject", "block_number", "rt") == [(1, 2, 300), (1, 5, None)]


def test_dashes_are_missing(spark, tmp_path):
    path = write(tmp_path / "v", "x.txt", ",".join(schemas.VISIT_COLUMNS) + "\nTrial012,s,p,Right,-,-,-,1,5.5,6.5\n")
    r = delimited.read_visits(spark, path).first()
    assert (r.trial, r.aoi, r.entry_ms, r.fix_ms) == (12, None, None, 6.5)


def test_columns_that_are_absent_in_one_table(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3, 4)], "z int, x int")
    assert {tuple(r) for r in delimited.stack(a, b).select("x", "y", "z").collect()} == {(1, 2, None), (4, None, 3)}


@pytest.mark.parametrize("decimal, text", [(",", "1,5"), (".", "1.5")])
def test_score_files(spark, tmp_path, decimal, text):
    df = spark.createDataFrame([(1, 1.5, None, ["a", "b"])], "k int, `m.x` double, n double, toys array<string>")
    path = str(tmp_path / "new" / "folder")
    sinks.write_scores(df, path, decimal)
    back = spark.read.options(header=True, sep=";").csv(path).first()
    assert (back.k, back["m.x"], back.n, back.toys) == ("1", text, None, "a b")
    sinks.write_table(df.select("k"), str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 1


def test_missing_markers(spark):
    from trialops.sources.delimited import typed

    raw = spark.createDataFrame([("a", "1.5", "NA"), ("b", " NaN ", "left"), ("c", "None", "n/a"), ("d", "", None)], "file string, t string, side string")
    rows = typed(raw, {"t": ("time", "double"), "side": ("side", "string")}).orderBy("file").collect()
    assert [(r.time, r.side) for r in rows] == [(1.5, None), (None, "left"), (None, None), (None, None)]
    comma = typed(raw.replace("1.5", "1,5"), {"t": ("time", "double")}, comma=True).orderBy("file").collect()
    assert [r.time for r in comma] == [1.5, None, None, None]


def test_other_texts_in_number_columns_fail(spark):
    from trialops.sources.delimited import typed

    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        typed(spark.createDataFrame([("a", "x1")], "file string, t string"), {"t": ("time", "double")}).collect()


def test_files_of_one_name_in_two_folders_are_two_recordings(spark, tmp_path):
    paths = [write(tmp_path / f"d {i}", "p1.csv", HEADER + f"{i},Alert,300,1,d\n") for i in (1, 2)]
    found = delimited.read_touch(spark, paths).select("file", delimited.subject_from_file(1, 2).alias("s"))
    assert found.distinct().count() == 2 and {r.s for r in found.collect()} == {"p1"}


def test_numbers_of_score_files_have_no_exponent(spark):
    values = [12345678.5, -1e-4, 1.5e22, 1e7, -2.25e-9, 0.0, 3.0, 123456789012.25, float("inf"), float("-inf"), float("nan"), None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i")
    texts = [r.v for r in sinks.as_text(df, ".", "never").collect()]
    assert texts == [
        "12345678.5", "-0.0001", "15000000000000000000000.0", "10000000.0", "-0.00000000225", "0.0", "3.0",
        "123456789012.25", "never", "-never", None, None,
    ]
    assert [r.v for r in sinks.as_text(df.limit(2), ",").collect()] == ["12345678,5", "-0,0001"]


KINDS = (
    "subject_nr,trialType,response_time,correct,datetime\n",
    "datetime,correct,note,subject_nr,response_time\n",
    "trialType,subject_nr,response_time,correct,datetime\n",
)


def mixed_folder(tmp_path):
    folder = write(tmp_path / "t", "a.csv", KINDS[0] + "1,Alert,300,1,d\n1,Alert,300,1,d,extra\n")
    write(tmp_path / "t", "b [1] é.csv", KINDS[1] + 'd,1,"a,b",2,400\n')
    write(tmp_path / "t", "c.csv", KINDS[2] + "NoAlert,3,500,0,d\n")
    write(tmp_path / "t", "d.csv", KINDS[0] + "4,NoAlert,600,1,d\n")
    write(tmp_path / "t", "e.csv", "\n" + KINDS[0] + "5,Alert,700,1,d\n")
    write(tmp_path / "t", "empty.csv", "")
    write(tmp_path / "t", "notes.txt", "other,header\n")
    return folder


def test_files_of_several_headers_are_stacked_by_name(spark, tmp_path, rows):
    df = delimited.read_touch(spark, mixed_folder(tmp_path), by_header=True)
    want = [(1, "Alert", 300, 1), (2, None, 400, 1), (3, "NoAlert", 500, 0), (4, "NoAlert", 600, 1), (5, "Alert", 700, 1)]
    assert rows(df, "subject", "condition", "rt", "acc") == want
    assert df.select(delimited.subject_from_file(1, 5).alias("s")).distinct().count() == 5


def test_scans_follow_the_kinds_of_headers_not_the_files(spark, tmp_path):
    folder = mixed_folder(tmp_path)
    for i in range(20):
        write(tmp_path / "t", f"more{i}.csv", KINDS[i % 3] + "x\n")
    plan = delimited.read_touch(spark, folder, by_header=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 3
    same = write(tmp_path / "u", "a.csv", KINDS[0] + "1,Alert,300,1,d\n")
    write(tmp_path / "u", "b.csv", KINDS[0] + "2,Alert,300,1,d\n")
    one = delimited.read_touch(spark, same, by_header=True)
    assert one._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 1 and one.count() == 2


def test_the_manifest_reads_first_lines_only(spark, tmp_path):
    from trialops.sources.headers import first_lines

    line = "1,Alert,300,1," + "d" * 200 + "\n"
    folder = write(tmp_path / "t", "large.csv", HEADER + line * 50_000)
    write(tmp_path / "t", "small.csv", HEADER + line)
    df = first_lines(spark, folder, "*.csv")
    assert [r.header for r in df.collect()] == [HEADER.strip()] * 2
    # a file is a task, and no task goes on to the rest of its file
    assert df.rdd.getNumPartitions() == 2
    probe = df.sparkSession.conf
    assert probe.get("spark.sql.files.maxPartitionBytes") == "1" and spark.conf.get("spark.sql.files.maxPartitionBytes") != "1"


@pytest.mark.parametrize("ending", ["coded", "gaze"])
def test_other_readers_take_several_headers_too(spark, tmp_path, ending, rows):
    names = list(schemas.CODED_COLUMNS if ending == "coded" else schemas.GAP_OVERLAP_COLUMNS)
    sep, glob = (";", "csv") if ending == "coded" else ("\t", "txt")
    for i, header in enumerate((names, names[::-1], [*names[1:], "extra", names[0]])):
        values = {n: ("7" if n.endswith(("onset", "offset")) or ending == "gaze" else "x") for n in names}
        write(tmp_path / "f", f"file{i}.{glob}", sep.join(header) + "\n" + sep.join(values.get(n, "e") for n in header) + "\n")
    if ending == "coded":
        found = delimited.read_coded(spark, str(tmp_path / "f"), by_header=True)
        assert rows(found, "irruption_onset", "toy1") == [(7.0, "x")] * 3
    else:
        found = delimited.read_gaze(spark, str(tmp_path / "f"), (1, 4), by_header=True)
        assert rows(found, "trial", "time", "left_x", "subject") == [(7, 0.0, 7.0, "file")] * 3


def test_score_files_in_order(spark, tmp_path):
    path = str(tmp_path / "ordered")
    values = [None, 3.5, -1.0, 2.0, 100.0, 9.0, 9.0, -50.5, 1e-7]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values * 20)], "i int, v double").repartition(6)
    sinks.write_scores(df, path, order_by=["v", "i"])
    back = sorted(sinks.read_ordered(spark, path).collect(), key=lambda r: r.place)
    assert [r.place for r in back] == list(range(1, 181))
    want = sorted(((v, i) for i, v in enumerate(values * 20)), key=lambda p: (p[0] is not None, p[0] or 0, p[1]))
    assert [int(r.i) for r in back] == [i for _, i in want]
    down = str(tmp_path / "down")
    sinks.write_scores(df, down, order_by=[F.col("v").desc_nulls_last(), F.col("i")])
    first = min(sinks.read_ordered(spark, down).collect(), key=lambda r: r.place)
    assert (first.v, first.i) == ("100,0", "4")


def test_numbers_without_exponent_meet_no_pattern(spark):
    column = str(sinks.plain_number(F.col("v")))
    assert 0 < column.find("contains") < column.find("regexp_extract")
    values = [0.0, -0.5, 12345.678, 1e7, -2.5e-4, float("nan"), float("inf"), None]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(sinks.plain_number(F.col("v"), "far")).collect()
    assert [r[0] for r in rows] == ["0.0", "-0.5", "12345.678", "10000000.0", "-0.00025", None, "far", None]
