"""End-to-end shot plans: tracks to fused rows, rule verdicts and per-game scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from orbweave.functions import fixed as K, labels as L
from orbweave.operators import evaluate as E, tracks as T


def rule_predictions(tracks: DataFrame) -> DataFrame:
    """Make when some usable camera saw the ball within 1.5 widths and some saw it drop through."""
    det = T.linked(T.detections(tracks))
    # one aggregation gives each shot its best distance and crossing over all cameras
    seen = det.groupBy(*T.SHOT).agg(
        F.min("dist").alias("min_dist_rw_best"),
        F.max(F.coalesce(T.crosses(), F.lit(False)).cast("int")).alias("through_hoop_any"))
    shots = tracks.groupBy(*T.SHOT).agg(F.max("classification").alias("classification"))
    hit = ((F.coalesce("min_dist_rw_best", F.lit(10.0)) <= K.NEAR_RIM_RW)
           & (F.coalesce("through_hoop_any", F.lit(0)) == 1))
    return (shots.join(seen, list(T.SHOT), "left")
            .withColumn("label", L.label_of()).filter(F.col("label").isNotNull())
            .withColumn("pred", hit.cast("int")))


def rule_eval(tracks: DataFrame) -> DataFrame:
    return E.metrics_by_group(rule_predictions(tracks))


def arbiter(first: DataFrame, hires: DataFrame) -> DataFrame:
    """Chosen trajectory verdict of two sample sources (second pass first), agreement and confidence cues.

    Per source: verdict, cues over its in-court rows, count of its raw rows.  Sources with fewer than three raw
    rows have no verdict.  The cues are those of the chosen source; without one they are -1 (``desc_n`` 0).
    """
    from orbweave.operators import trajectory as H
    keys = list(H.SHOT)

    def source(samples, name):
        n = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_raw"))
        j = n.join(H.rescore(samples), keys, "left").join(
            H.descent_stats(samples).withColumnsRenamed({"apex_z": "top_z", "apex_r": "top_r"}), keys, "left")
        return j.select(*keys, F.struct(*[c for c in j.columns if c not in keys]).alias(name))
    j = source(hires, "hr").join(source(first, "l1"), keys, "full")
    ok_hr, ok_l1 = (F.coalesce(F.col(f"{s}.n_raw") >= 3, F.lit(False)) for s in ("hr", "l1"))
    pick = (F.when(ok_hr & (F.col("hr.verdict_class") != "UND"), F.col("hr"))
            .when(ok_l1 & (F.col("l1.verdict_class") != "UND"), F.col("l1"))
            .when(ok_hr, F.col("hr")).when(ok_l1, F.col("l1")))

    def pair(a, b):
        return F.coalesce(ok_hr & ok_l1 & (F.col("l1.verdict_class") == a) & (F.col("hr.verdict_class") == b),
                          F.lit(False))
    j = j.select(*keys, pick.alias("v"), pair("MISS", "MISS").alias("src_agree_miss"),
                 (pair("MISS", "MAKE") | pair("MAKE", "MISS")).alias("src_conflict"),
                 F.coalesce("l1.n_raw", F.lit(0)).alias("n_l1"), F.coalesce("hr.n_raw", F.lit(0)).alias("n_hr"),
                 ok_hr.alias("hr_available"))
    num = {"y_off_stop": "y_off_stop", "cross_r": "cross_r", "cross_y": "cross_y", "z_min": "z_min",
           "bounce_cm": "bounce_cm", "n_post": "n_post", "apex_z": "top_z", "apex_r": "top_r",
           "desc_max_gap": "desc_max_gap", "cross_dt": "cross_dt"}
    return j.select(*[c for c in j.columns if c != "v"], F.coalesce("v.n_raw", F.lit(0)).alias("n_used"),
                    F.coalesce("v.verdict_class", F.lit("UND")).alias("tri_verdict"),
                    F.coalesce("v.rule", F.lit("undecided")).alias("tri_rule"),
                    F.coalesce("v.nr_rebound", F.lit(False)).alias("nr_rebound"),
                    *[F.coalesce(F.col(f"v.{c}"), F.lit(-1)).alias(n) for n, c in num.items()],
                    F.coalesce("v.desc_n", F.lit(0)).alias("desc_n"))


def with_predictions(arbiter_rows: DataFrame, predictions: DataFrame) -> DataFrame:
    """Arbiter rows of predicted shots with label, class and the model's decision and probability.

    ``predictions``: game_id, shot, classification, pred, prob.
    """
    from orbweave.operators import trajectory as H
    p = predictions.select(
        *H.SHOT, F.substring(F.col("game_id").cast("string"), 1, 8).alias("gid"),
        (L.label_of() == 1).alias("gt_make"), F.col("classification").alias("gt_class"),
        (F.col("pred") == 1).alias("fus_make"), F.col("prob").cast("double").alias("fus_prob"))
    return arbiter_rows.join(p, list(H.SHOT)).withColumn("tri_make", F.col("tri_verdict") == "MAKE").withColumn(
        "tri_und", F.col("tri_verdict") == "UND")
