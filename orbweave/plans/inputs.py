"""Trajectory-shaped inputs derived from the given tables, as DataFrames and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from orbweave.functions import ordered
from orbweave.plans.registry import table

DAY = 86400.0

TRACKS_CTE = """
e AS (SELECT *, user_id % 7 AS game_id, event_id % 4 AS a FROM events),
b AS (SELECT game_id, user_id AS play_id,
        CASE a WHEN 0 THEN 'FL' WHEN 1 THEN 'FR' WHEN 2 THEN 'NL' ELSE 'NR' END AS angle,
        row_number() OVER (PARTITION BY user_id, a ORDER BY ts, event_id) AS frame_idx,
        event_type, value, event_id FROM e),
tracks AS (SELECT game_id, play_id, angle, CAST(frame_idx AS BIGINT) AS frame_idx,
  CAST(frame_idx AS DOUBLE) / 29.97 AS timestamp,
  CASE WHEN play_id % 2 = 0 THEN 'FG_MAKE' ELSE 'FG_MISS' END AS classification,
  CASE WHEN event_type = 'error' THEN NULL ELSE value END AS ball_x,
  CASE WHEN event_type = 'error' THEN NULL ELSE value * 0.5 + frame_idx END AS ball_y,
  CASE WHEN event_type = 'error' THEN NULL
       ELSE CAST(20 + event_id % 3 AS DOUBLE) END AS ball_w,
  CASE WHEN event_type = 'error' THEN NULL ELSE CAST(20 AS DOUBLE) END AS ball_h,
  CASE WHEN event_type = 'error' THEN NULL
       ELSE CAST(event_id % 100 AS DOUBLE) / 100 END AS ball_conf,
  CASE WHEN event_id % 11 = 0 THEN NULL
       ELSE CAST(100 + event_id % 5 AS DOUBLE) END AS rim_x,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(60 AS DOUBLE) END AS rim_y,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(80 AS DOUBLE) END AS rim_w,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(40 AS DOUBLE) END AS rim_h,
  CASE WHEN event_id % 11 = 0 THEN NULL
       ELSE CAST(event_id % 90 AS DOUBLE) / 90 END AS rim_conf
  FROM b)
"""


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-frame ball and rim boxes per (game, play, angle)."""
    a = F.col("event_id") % 4
    ev = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 7).alias("game_id"), F.col("user_id").alias("play_id"),
        F.when(a == 0, "FL").when(a == 1, "FR").when(a == 2, "NL").otherwise("NR").alias("angle"),
        "ts", "event_id", "event_type", "value")
    n = ordered.row_number(ev, ["game_id", "play_id", "angle"], ["ts", "event_id"],
                           ordered.time_bucket("ts", 5 * DAY), "frame_idx")
    seen = F.col("event_type") != "error"
    rim = F.col("event_id") % 11 != 0

    def num(e):
        return e.cast("double")
    return n.select(
        "game_id", "play_id", "angle", "frame_idx",
        (num(F.col("frame_idx")) / F.lit(29.97)).alias("timestamp"),
        F.when(F.col("play_id") % 2 == 0, "FG_MAKE").otherwise("FG_MISS").alias("classification"),
        F.when(seen, F.col("value")).alias("ball_x"),
        F.when(seen, F.col("value") * 0.5 + F.col("frame_idx")).alias("ball_y"),
        F.when(seen, num(20 + F.col("event_id") % 3)).alias("ball_w"),
        F.when(seen, F.lit(20.0)).alias("ball_h"),
        F.when(seen, num(F.col("event_id") % 100) / 100).alias("ball_conf"),
        F.when(rim, num(100 + F.col("event_id") % 5)).alias("rim_x"),
        F.when(rim, F.lit(60.0)).alias("rim_y"),
        F.when(rim, F.lit(80.0)).alias("rim_w"),
        F.when(rim, F.lit(40.0)).alias("rim_h"),
        F.when(rim, num(F.col("event_id") % 90) / 90).alias("rim_conf"))


# 3-D samples: every 24 rows of a user form one throw towards the rim at (2008.7, 713.2, 304.8)
SAMPLES_CTE = """
s0 AS (SELECT user_id, event_id, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events),
samples AS (SELECT user_id % 7 AS game_id, user_id * 1000 + rn // 24 AS shot,
  CAST(rn % 24 AS BIGINT) AS frame, CAST(rn % 24 AS DOUBLE) / 29.97 AS t,
  2008.7 - (18.0 - rn % 24) * (CAST(user_id % 5 AS DOUBLE) * 6.0 + 4.0)
    + CAST(event_id % 9 AS DOUBLE) AS x,
  713.2 + (CAST(user_id % 7 AS DOUBLE) - 3.0) * 9.0 + CAST(event_id % 5 AS DOUBLE) AS y,
  220.0 + 52.0 * (rn % 24) - 2.4 * (rn % 24) * (rn % 24)
    + CAST(user_id % 3 AS DOUBLE) * 20.0 + CAST(event_id % 7 AS DOUBLE) AS z,
  760.0 + value AS nr_x, 700.0 + 16.0 * (rn % 24) + CAST(event_id % 60 AS DOUBLE) AS nr_y
  FROM s0)
"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangulated samples of throws, one row per frame."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    n = ordered.row_number(ev, ["user_id"], ["ts", "event_id"],
                           ordered.time_bucket("ts", 5 * DAY), "rn")
    rn = F.col("rn") - 1
    f = rn % 24

    def num(e):
        return e.cast("double")
    uid, eid = F.col("user_id"), F.col("event_id")
    return n.select(
        (uid % 7).alias("game_id"),
        (uid * 1000 + F.floor(rn / 24)).alias("shot"), f.alias("frame"),
        (num(f) / F.lit(29.97)).alias("t"),
        (F.lit(2008.7) - (F.lit(18.0) - f) * (num(uid % 5) * 6.0 + 4.0) + num(eid % 9)).alias("x"),
        (F.lit(713.2) + (num(uid % 7) - 3.0) * 9.0 + num(eid % 5)).alias("y"),
        (F.lit(220.0) + F.lit(52.0) * f - F.lit(2.4) * f * f + num(uid % 3) * 20.0
         + num(eid % 7)).alias("z"),
        (F.lit(760.0) + F.col("value")).alias("nr_x"),
        (F.lit(700.0) + F.lit(16.0) * f + num(eid % 60)).alias("nr_y"))


SCORED_CTE = """
scored AS (SELECT l.doc_id, l.quality AS label, l.toxic, d.lang AS game_id, d.source,
  d.n_chars, CAST((d.n_chars * 7 + l.quality * 260) % 1000 AS DOUBLE) / 1000 AS prob,
  CAST((d.n_chars * 13 + l.quality * 410 + l.doc_id) % 997 AS DOUBLE) / 997 AS prob2,
  CASE d.lang WHEN 'en' THEN 'FG' WHEN 'fr' THEN '3PT' WHEN 'de' THEN '4PT'
       ELSE 'FREE_THROW' END || CASE WHEN l.quality = 1 THEN '_MAKE' ELSE '_MISS' END
    AS classification
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows with two model scores and a group."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = table(spark, sf_dir, "labels")
    fam = (F.when(F.col("lang") == "en", "FG").when(F.col("lang") == "fr", "3PT")
           .when(F.col("lang") == "de", "4PT").otherwise("FREE_THROW"))
    out = F.when(F.col("quality") == 1, "_MAKE").otherwise("_MISS")
    return lab.join(d, "doc_id").select(
        "doc_id", F.col("quality").alias("label"), "toxic", F.col("lang").alias("game_id"),
        "source", "n_chars",
        (((F.col("n_chars") * 7 + F.col("quality") * 260) % 1000).cast("double") / 1000)
        .alias("prob"),
        (((F.col("n_chars") * 13 + F.col("quality") * 410 + F.col("doc_id")) % 997)
         .cast("double") / 997).alias("prob2"),
        F.concat(fam, out).alias("classification"))


# verdict texts of two systems over lineitem flags
VERDICTS_CTE = """
verdicts AS (SELECT l_orderkey * 10 + l_linenumber AS name_id, l_orderkey, l_linenumber,
  l_suppkey % 20 AS game_id,
  CASE l_suppkey % 4 WHEN 0 THEN 'FG' WHEN 1 THEN '3PT' WHEN 2 THEN '4PT' ELSE 'FREE_THROW' END
    || CASE WHEN l_partkey % 2 = 0 THEN '_MAKE' ELSE '_MISS' END AS gt,
  CASE l_returnflag
    WHEN 'R' THEN CASE WHEN l_partkey % 3 = 0
        THEN 'MAKE (passed through rim plane at r=' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)
          || 'cm, z_min=' || CAST(280 + l_linenumber * 10 AS VARCHAR) || 'cm)'
        WHEN l_partkey % 3 = 1 THEN 'MAKE (gap-stop: ball at z=310cm r='
          || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || 'cm converging on rim, detection lost in net)'
        ELSE 'MAKE (rattled in: bounce=12cm at z=301cm then through rim at r=20cm)' END
    WHEN 'A' THEN CASE WHEN l_partkey % 4 = 0 THEN 'MISS (RIM-OUT: bounce='
          || CAST(l_linenumber + 5 AS VARCHAR) || 'cm at z=300cm, r=30cm)'
        WHEN l_partkey % 4 = 1 THEN 'MISS (crossed rim plane at r='
          || CAST(CAST(l_quantity AS BIGINT) + 60 AS VARCHAR) || 'cm > 40cm: ball outside rim opening)'
        WHEN l_partkey % 4 = 2 THEN 'MISS (z_min=310cm, r=95cm — no clear make signal)  [apex r='
          || CAST(CAST(l_quantity AS BIGINT) * 10 AS VARCHAR) || 'cm, z_peak=500]'
        ELSE 'MISS (CLEAN: apex r=1200cm — never near rim)' END
    ELSE 'UNDECIDED (only 2 clean post-apex samples)' END AS v1,
  CASE WHEN l_linestatus = 'F' AND l_linenumber % 3 = 0 THEN 'UNDECIDED (no samples)'
       WHEN l_linestatus = 'F' THEN 'MAKE (smooth descent to z=320cm at r=12cm, detection lost in net)'
       WHEN l_linenumber % 4 = 0 THEN 'MISS (rim-bounce: ball clipped below rim at r=22cm then bounced back above rim plane)'
       ELSE 'MISS (NR-rebound: cy 1010->880, D=130px)' END AS v2,
  CASE l_linenumber % 5 WHEN 0 THEN 'UND' WHEN 1 THEN 'MAKE' WHEN 2 THEN 'MISS'
       WHEN 3 THEN 'MAKE-weak' ELSE 'MISS-weak' END AS fr,
  CASE l_partkey % 5 WHEN 0 THEN 'UND' WHEN 1 THEN 'MAKE' WHEN 2 THEN 'MISS'
       WHEN 3 THEN 'MAKE-weak' ELSE 'MISS-weak' END AS nr,
  l_discount * 10 AS prob
  FROM lineitem)
"""


def verdicts(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """Verdict texts of two trajectory variants and two single cameras.

    ``together``: rows of one name_id come in order in one part.  What the texts are made of is shuffled and sorted, not the
    texts, and grouping by name_id needs no further shuffle or sort.
    """
    li, name_id = table(spark, sf_dir, "lineitem"), F.col("l_orderkey") * 10 + F.col("l_linenumber")
    if together:
        name_id, li = F.col("name_id"), li.select(
            name_id.alias("name_id"), "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_discount",
            (F.col("l_suppkey") % 20).alias("l_suppkey"), (F.col("l_partkey") % 60).alias("l_partkey"),   # all that is asked of them
        ).repartition("name_id").sortWithinPartitions("name_id")
    fam = (F.when(F.col("l_suppkey") % 4 == 0, "FG").when(F.col("l_suppkey") % 4 == 1, "3PT")
           .when(F.col("l_suppkey") % 4 == 2, "4PT").otherwise("FREE_THROW"))
    q = F.col("l_quantity").cast("long")
    pk, ln = F.col("l_partkey"), F.col("l_linenumber")
    make = (F.when(pk % 3 == 0, F.concat(
        F.lit("MAKE (passed through rim plane at r="), q, F.lit("cm, z_min="), 280 + ln * 10,
        F.lit("cm)")))
        .when(pk % 3 == 1, F.concat(F.lit("MAKE (gap-stop: ball at z=310cm r="), q,
                                    F.lit("cm converging on rim, detection lost in net)")))
        .otherwise("MAKE (rattled in: bounce=12cm at z=301cm then through rim at r=20cm)"))
    miss = (F.when(pk % 4 == 0, F.concat(F.lit("MISS (RIM-OUT: bounce="), ln + 5,
                                         F.lit("cm at z=300cm, r=30cm)")))
            .when(pk % 4 == 1, F.concat(F.lit("MISS (crossed rim plane at r="), q + 60,
                                        F.lit("cm > 40cm: ball outside rim opening)")))
            .when(pk % 4 == 2, F.concat(
                F.lit("MISS (z_min=310cm, r=95cm — no clear make signal)  [apex r="), q * 10,
                F.lit("cm, z_peak=500]")))
            .otherwise("MISS (CLEAN: apex r=1200cm — never near rim)"))
    v1 = (F.when(F.col("l_returnflag") == "R", make).when(F.col("l_returnflag") == "A", miss)
          .otherwise("UNDECIDED (only 2 clean post-apex samples)"))
    done = F.col("l_linestatus") == "F"
    v2 = (F.when(done & (ln % 3 == 0), "UNDECIDED (no samples)")
          .when(done, "MAKE (smooth descent to z=320cm at r=12cm, detection lost in net)")
          .when(ln % 4 == 0, "MISS (rim-bounce: ball clipped below rim at r=22cm then bounced "
                             "back above rim plane)")
          .otherwise("MISS (NR-rebound: cy 1010->880, D=130px)"))

    def cam(e):
        return (F.when(e % 5 == 0, "UND").when(e % 5 == 1, "MAKE").when(e % 5 == 2, "MISS")
                .when(e % 5 == 3, "MAKE-weak").otherwise("MISS-weak"))
    return li.select(
        name_id.alias("name_id"), "l_orderkey", "l_linenumber",
        (F.col("l_suppkey") % 20).alias("game_id"),
        F.concat(fam, F.when(pk % 2 == 0, "_MAKE").otherwise("_MISS")).alias("gt"),
        v1.alias("v1"), v2.alias("v2"), cam(ln).alias("fr"), cam(pk).alias("nr"),
        (F.col("l_discount") * 10).alias("prob"))
