"""Readers and writers: tables written as recordings and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.registry import bind, out, table
from bindings.views import CODED_SQL, TRIAL_SQL, VISIT_SQL, coded, trial_raw, visit
from trialops.functions.nulls import is_true, to_number
from trialops.operators import joins
from trialops.operators.reshape import first_row, label
from trialops.plans import switching
from trialops.session import scratch_path
from trialops.sources import delimited, schemas, sinks


def folder(spark) -> str:
    return scratch_path(spark, "recordings")


def exported(df, columns):
    """The table under the column names of the export."""
    return df.select(*[F.col(name).alias(source) for source, (name, _) in columns.items()])


@bind(
    "s1_s4_s10_semicolon_file",
    out(
        f"WITH {TRIAL_SQL} SELECT subject, block_number, trial, rt, acc, cue, flanker FROM trial_raw",
        "subject block_number acc", "rt", "trial cue flanker",
    ),
    doubles="rt",
)
def semicolon_file(spark, sf_dir):
    path = folder(spark)
    sinks.write_scores(exported(trial_raw(spark, sf_dir), schemas.ATTENTION_COLUMNS), path)
    return delimited.read_attention(spark, path).drop("file")


@bind(
    "s3_s6_skip_long_lines",
    out(
        """SELECT user_id AS subject, event_type AS condition, event_id AS rt, event_id % 2 AS acc, 'day' AS timestamp
        FROM events WHERE event_id % 10 <> 0""",
        "subject rt acc", "", "condition timestamp",
    ),
)
def skip_long_lines(spark, sf_dir):
    """Every tenth line gets a field too many and is dropped by the reader."""
    path = folder(spark)
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("subject_nr"),
        F.col("event_type").alias("trialType"),
        e.alias("response_time"),
        (e % 2).alias("correct"),
        F.when(e % 10 == 0, "day,more").otherwise("day").alias("datetime"),
    )
    rows.write.options(header=True, quote="").csv(path)
    return delimited.read_touch(spark, path).drop("file")


@bind(
    "s2_s5_p5_gaze_file",
    out(
        """SELECT l_orderkey % 24 AS trial, l_extendedprice - l_tax AS time, l_discount AS left_x, l_tax AS left_y,
        CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity + 0.5 END AS right_x, l_quantity AS right_y, l_returnflag AS side
        FROM lineitem""",
        "trial", "time left_x left_y right_x right_y", "side",
    ),
)
def gaze_file(spark, sf_dir):
    path = folder(spark)
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 24).alias("TRIAL_INDEX"),
        F.col("l_tax").alias("TRIAL_START_TIME"),
        F.col("l_extendedprice").alias("TIMESTAMP"),
        F.col("l_discount").alias("LEFT_GAZE_X"),
        F.col("l_tax").alias("LEFT_GAZE_Y"),
        F.when(F.col("l_linenumber") != 1, F.col("l_quantity") + 0.5).alias("RIGHT_GAZE_X"),
        F.col("l_quantity").alias("RIGHT_GAZE_Y"),
        F.col("l_returnflag").alias("SIDE_CONDITION"),
    )
    sinks.as_text(rows, ",").write.options(header=True, sep="\t", nullValue=".", extension="txt").csv(path)
    gaze = delimited.read_gaze(spark, path, schemas.GAP_OVERLAP_SUBJECT)
    return gaze.select("trial", "time", "left_x", "left_y", "right_x", "right_y", "side")


@bind(
    "s7_visit_file",
    out(
        f"WITH {VISIT_SQL} SELECT participant, trial, eye, aoi, stimulus, aoi_group, entry_ms, fix_ms FROM visit", "trial",
        "entry_ms fix_ms", "participant eye aoi stimulus aoi_group",
    ),
)
def visit_file(spark, sf_dir):
    path = folder(spark)
    rows = visit(spark, sf_dir).withColumns(
        {
            "trial_text": F.concat(F.lit("Trial"), F.lpad(F.col("trial").cast("string"), 3, "0")),
            "sequence": F.lit(1),
            "dwell_ms": F.col("fix_ms"),
        }
    )
    exported(rows, schemas.VISIT_COLUMNS).write.options(header=True, nullValue="-", extension="txt").csv(path)
    names = ["participant", "trial", "eye", "aoi", "stimulus", "aoi_group", "entry_ms", "fix_ms"]
    return delimited.read_visits(spark, path).select(*names)


@bind("s8_subject_from_file", out("SELECT 'even' AS subject, count(*) AS n FROM events", "n", "", "subject"))
def subject_from_file(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("file", F.col("_metadata.file_name"))
    return rows.groupBy(delimited.subject_from_file(1, 4).alias("subject")).agg(F.count(F.lit(1)).alias("n"))


@bind(
    "s9_a7_stack",
    out(
        """SELECT user_id AS subject, event_id AS trial, value AS rt, NULL AS acc FROM events
        UNION ALL SELECT c_custkey, c_nationkey, NULL, c_acctbal FROM customer""",
        "subject trial", "rt acc",
    ),
)
def stack(spark, sf_dir):
    first = table(spark, sf_dir, "events").selectExpr("user_id AS subject", "event_id AS trial", "value AS rt")
    second = table(spark, sf_dir, "customer").selectExpr("c_acctbal AS acc", "c_nationkey AS trial", "c_custkey AS subject")
    return delimited.stack(first, second)


@bind(
    "s9_header_groups",
    out(
        """SELECT user_id AS subject, CASE WHEN event_id % 3 <> 1 THEN event_type END AS condition, event_id AS rt, event_id % 2 AS acc,
        'day' AS timestamp FROM events WHERE event_id % 3 <> 0 OR event_id % 10 <> 0""",
        "subject rt acc", "", "condition timestamp",
    ),
)
def header_groups(spark, sf_dir):
    """Sessions of three kinds in one folder: the usual header, one without a condition and with a
    column of its own in another order, one with the columns swapped; some lines of the first are too long."""
    path = folder(spark)
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        e,
        F.col("user_id").alias("subject_nr"),
        F.col("event_type").alias("trialType"),
        e.alias("response_time"),
        (e % 2).alias("correct"),
        F.when((e % 3 == 0) & (e % 10 == 0), "day,more").otherwise("day").alias("datetime"),
        F.lit("x").alias("note"),
    )
    kinds = (
        ("subject_nr", "trialType", "response_time", "correct", "datetime"),
        ("note", "datetime", "correct", "subject_nr", "response_time"),
        ("correct", "datetime", "trialType", "response_time", "subject_nr"),
    )
    for kind, names in enumerate(kinds):
        rows.filter(e % 3 == kind).select(*names).write.mode("append").options(header=True, quote="").csv(path)
    return delimited.read_touch(spark, path, by_header=True).drop("file")


@bind(
    "s4_s11_coded_file",
    out(
        f"WITH {CODED_SQL} SELECT irruption_onset, behaviour_onset, behaviour_offset, behaviour_beh1, toy1 FROM coded", "",
        "irruption_onset behaviour_onset behaviour_offset", "behaviour_beh1 toy1",
    ),
)
def coded_file(spark, sf_dir):
    path = folder(spark)
    sinks.write_scores(exported(coded(spark, sf_dir), schemas.CODED_COLUMNS), path, decimal=".")
    return delimited.read_coded(spark, path).select(
        "irruption_onset", "behaviour_onset", "behaviour_offset", "behaviour_beh1", "toy1"
    )


@bind(
    "s11_decimal_comma",
    out("SELECT replace(CAST(value AS VARCHAR), '.', ',') AS text FROM events", "", "", "text"),
)
def decimal_comma(spark, sf_dir):
    """The number texts of a score file, as written."""
    path = folder(spark)
    sinks.write_scores(table(spark, sf_dir, "events").select("value"), path)
    return spark.read.options(header=True, sep=";").csv(path).withColumnRenamed("value", "text")


@bind("s12_s13_decimal_point", out("SELECT CAST(value AS VARCHAR) AS text FROM events", "", "", "text"))
def decimal_point(spark, sf_dir):
    path = folder(spark)
    sinks.write_scores(table(spark, sf_dir, "events").select("value"), path, decimal=".")
    return spark.read.options(header=True, sep=";").csv(path).withColumnRenamed("value", "text")


@bind(
    "w8_ordered_scores",
    out(
        """SELECT event_id, value, row_number() OVER (ORDER BY value DESC, event_id) AS place FROM
        (SELECT event_id, CASE WHEN event_id % 9 > 0 THEN round(value * 100) / 4 END AS value FROM events) WHERE value IS NOT NULL""",
        "event_id place", "value",
    ),
)
def ordered_scores(spark, sf_dir):
    """Scores written in order, and the order of the files read back."""
    path = folder(spark)
    value = F.when(F.col("event_id") % 9 > 0, F.round(F.col("value") * 100) / 4)
    scores = table(spark, sf_dir, "events").select("event_id", value.alias("value")).filter("value IS NOT NULL")
    sinks.write_scores(scores, path, decimal=".", order_by=[F.col("value").desc(), F.col("event_id")])
    back = sinks.read_ordered(spark, path)
    return back.select(F.col("event_id").cast("long").alias("event_id"), F.col("value").cast("double").alias("value"), "place")


@bind(
    "c23_tag_block",
    out(
        "SELECT l_suppkey AS subject, l_returnflag AS target_side, 'block1' AS block FROM lineitem", "subject", "",
        "target_side block",
    ),
)
def tag_block(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS subject", "l_returnflag AS target_side_1")
    return switching.tag_block(rows, "block1", "target_side_1").drop("target_side_1")


@bind(
    "j6_lookup",
    out(
        """SELECT e.event_id, p.last_event FROM events e LEFT JOIN
        (SELECT user_id, max(event_id) AS last_event FROM events WHERE event_type = 'error' GROUP BY user_id) p
        ON e.user_id = p.user_id""",
        "event_id", "last_event",
    ),
    doubles="last_event",
)
def lookup(spark, sf_dir):
    """A per-subject value mapped onto rows, however many of them a subject has."""
    events = table(spark, sf_dir, "events")
    last = events.filter("event_type = 'error'").groupBy("user_id").agg(F.max("event_id").alias("last_event"))
    return joins.lookup(events.select("user_id", "event_id"), last, "user_id").select("event_id", "last_event")


@bind(
    "p17_numeric_coercion",
    out(
        """SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(event_id AS VARCHAR) END AS DOUBLE) AS number
        FROM events""",
        "event_id", "number",
    ),
)
def numeric_coercion(spark, sf_dir):
    e = F.col("event_id")
    text = F.when(e % 3 == 0, F.col("event_type")).otherwise(e.cast("string"))
    return table(spark, sf_dir, "events").select("event_id", to_number(text).alias("number"))


@bind(
    "w5_first_row",
    out(
        """SELECT user_id, event_id, event_type, value FROM
        (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events) WHERE place = 1""",
        "user_id event_id", "value", "event_type",
    ),
)
def first_rows(spark, sf_dir):
    return first_row(table(spark, sf_dir, "events"), ["user_id"], "event_id", ["event_type", "value"])


@bind(
    "a4_a5_a6_scalar_functions",
    out(
        """SELECT p_partkey, p_brand || '_' || p_size AS name, 1 + p_size // 6 AS bucket, abs(p_size - 25) AS apart,
        CASE WHEN p_name LIKE '%a%' AND p_size IN (1, 2, 3) THEN 1 ELSE 0 END AS hit, substr(p_name, 3, 4) AS cut,
        CASE WHEN p_name LIKE '%d' THEN 1 ELSE 0 END AS ends, trim(' ' || p_type || ' ') AS clean FROM part""",
        "p_partkey bucket apart hit ends", "", "name cut clean",
    ),
)
def scalar_functions(spark, sf_dir):
    name, size = F.col("p_name"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        label("p_brand", "p_size").alias("name"),
        (1 + F.floor(size / 6)).alias("bucket"),
        F.abs(size - 25).alias("apart"),
        F.when(is_true(name.contains("a") & size.isin(1, 2, 3)), 1).otherwise(0).alias("hit"),
        F.substring(name, 3, 4).alias("cut"),
        F.when(is_true(name.endswith("d")), 1).otherwise(0).alias("ends"),
        F.trim(F.concat(F.lit(" "), F.col("p_type"), F.lit(" "))).alias("clean"),
    )
