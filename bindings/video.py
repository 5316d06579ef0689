"""Coded video sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.registry import bind, out
from bindings.views import CODED_SQL, coded
from trialops.operators import intervals as iv
from trialops.operators.reshape import select_like
from trialops.plans import coded_video

CODED = f"WITH {CODED_SQL}"
CODES = ("A", "AB", "L", "P")
OBJECTS = ("object0", "object1", "object2")


@bind(
    "p13_merged_event",
    out(
        f"{CODED} SELECT file, coalesce(irruption_event1, irruption_event2, '.') AS event, count(*) AS n FROM coded GROUP BY ALL",
        "file n", "", "event",
    ),
)
def merged_event(spark, sf_dir):
    event = iv.merged_event(F.col("irruption_event1"), F.col("irruption_event2"))
    return coded(spark, sf_dir).groupBy("file", event.alias("event")).agg(F.count(F.lit(1)).alias("n"))


@bind(
    "p2_select_like",
    out(f"{CODED} SELECT orienting_onset, orienting_offset, orienting_object FROM coded", "", "orienting_onset orienting_offset", "orienting_object"),
)
def columns_like(spark, sf_dir):
    return select_like(coded(spark, sf_dir), "orienting")


@bind("g21c_w7_first_interruption", out(f"{CODED} SELECT * FROM cut", "file", "first_irruption_onset"))
def first_interruption(spark, sf_dir):
    return iv.first_interruption(coded(spark, sf_dir), onset="irruption_onset")


@bind(
    "p19_cut_at_interruption",
    out(f'{CODED} SELECT file, stream, code, onset, "offset", duration FROM kept', "file", "onset offset duration", "stream code"),
)
def cut_at_interruption(spark, sf_dir):
    return coded_video.events(coded(spark, sf_dir)).drop("first_irruption_onset", "toy1", "toy2")


@bind(
    "g21a_g21b_time_per_code",
    out(
        f"""{CODED} SELECT file, stream, code, coalesce(sum(duration), 0) AS total_time, min(onset) AS first_onset FROM kept
        WHERE code IS NOT NULL GROUP BY ALL""",
        "file", "total_time first_onset", "stream code",
    ),
)
def time_per_code(spark, sf_dir):
    return iv.time_per_code(coded_video.events(coded(spark, sf_dir)))


_INF = "CAST('Infinity' AS DOUBLE)"


@bind(
    "g21d_g21g_approaches_and_totals",
    out(
        f"""{CODED} SELECT file, coalesce(min(onset) FILTER (stream = 'Behaviour1' AND code = 'A'), {_INF}) AS first_approach,
        CASE WHEN count(code) FILTER (stream = 'Behaviour1') > 0 THEN
          coalesce(sum(duration) FILTER (stream = 'Behaviour1' AND code NOT LIKE 'A%'), 0) END AS other_time
        FROM kept GROUP BY file""",
        "file", "first_approach other_time",
    ),
)
def approaches(spark, sf_dir):
    return coded_video.events(coded(spark, sf_dir)).groupBy("file").agg(
        iv.first_approach("Behaviour1").alias("first_approach"), iv.time_without_approach("Behaviour1").alias("other_time")
    )


@bind(
    "g21e_a3_toys",
    out(
        f"""{CODED} SELECT file, string_agg(DISTINCT toy1, ',' ORDER BY toy1) AS toy1, string_agg(DISTINCT toy2, ',' ORDER BY toy2) AS toy2
        FROM coded GROUP BY file""",
        "file", "", "toy1 toy2",
    ),
)
def toys(spark, sf_dir):
    found = iv.toys(coded(spark, sf_dir))
    return found.select("file", *[F.nullif(F.array_join(c, ","), F.lit("")).alias(c) for c in ("toy1", "toy2")])


_TIMES = [(s, c) for s in coded_video.CODERS for c in CODES] + [("Orienting", c) for c in OBJECTS]
_TIME_CELLS = ", ".join(
    f"""CASE WHEN count(*) FILTER (stream = '{s}' AND code = '{c}') > 0 THEN
    coalesce(sum(duration) FILTER (stream = '{s}' AND code = '{c}'), 0) END AS "{s}_time_{c}" """
    for s, c in _TIMES
)
_TOTAL_CELLS = ", ".join(
    f"""CASE WHEN count(code) FILTER (stream = '{s}') > 0 THEN
    coalesce(sum(duration) FILTER (stream = '{s}' AND code NOT LIKE 'A%'), 0) END AS "{s}_total_time" """
    for s in coded_video.CODERS
)


@bind(
    "t9_v8_j13_g21f_coded_video",
    out(
        f"""{CODED}, toys AS (SELECT file, string_agg(DISTINCT toy1, ',' ORDER BY toy1) AS toy1,
          string_agg(DISTINCT toy2, ',' ORDER BY toy2) AS toy2 FROM coded GROUP BY file),
        wide AS (SELECT file, {_TIME_CELLS}, {_TOTAL_CELLS},
          coalesce(min(onset) FILTER (stream = 'Behaviour1' AND code = 'A'), {_INF}) AS "Toy1_A_onset",
          coalesce(min(onset) FILTER (stream = 'Behaviour2' AND code = 'A'), {_INF}) AS "Toy2_A_onset" FROM kept GROUP BY file)
        SELECT w.file AS code, first_irruption_onset, w.*,
          coalesce(CASE WHEN "Toy1_A_onset" < "Toy2_A_onset" THEN toy1 ELSE toy2 END, '') AS "Toy_preferred"
        FROM wide w JOIN cut c ON w.file = c.file JOIN toys t ON w.file = t.file""",
        "code",
        "first_irruption_onset Toy1_A_onset Toy2_A_onset " + " ".join(f"{s}_time_{c}" for s, c in _TIMES)
        + " " + " ".join(f"{s}_total_time" for s in coded_video.CODERS),
        "Toy_preferred",
    ),
)
def coded_scores(spark, sf_dir):
    scores = coded_video.reduce(coded(spark, sf_dir), CODES, OBJECTS)
    return scores.withColumn("Toy_preferred", F.array_join("Toy_preferred", ","))
