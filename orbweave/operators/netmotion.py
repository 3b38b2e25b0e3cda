"""Motion features below the rim, per camera and fused over cameras."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from orbweave.functions import fixed as K, ordered
from orbweave.functions.quantiles import medians
from orbweave.functions.skew import attach
from orbweave.operators.tracks import SHOT, TRACK, flag

PER_ANGLE = ("nm_fd_peak", "nm_flow_peak", "nm_fd_mean", "nm_fd_tail_max", "nm_fd_tail_mean",
             "nm_flow_tail_mean", "nm_peak_pos", "nm_sustained_frac", "nm_rim_ok_frac",
             "nm_n_frames")


def angle_motion(rows: DataFrame, keys: Sequence[str] = TRACK) -> DataFrame:
    """Peak, mean, last-half tail, peak position and share above the own median per camera.

    ``rows``: keys, frame_idx, framediff_energy, flow_mag, rim_ok.
    """
    keys = list(keys)
    r = ordered.row_number(rows, keys, ["frame_idx"], ordered.frame_bucket(), "rn")
    per = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    per = per.join(medians(rows, keys, ["framediff_energy"])
                   .withColumnRenamed("framediff_energy", "med"), keys)
    r = attach(r, per, keys, ["frame_idx"], "inner")
    i, n = F.col("rn") - 1, F.col("n")
    cut = F.greatest(F.lit(1), F.floor(n / 2))
    tail = (i >= cut) | (n <= cut)
    fd, fl = F.col("framediff_energy"), F.col("flow_mag")
    g = r.groupBy(*keys).agg(
        F.max(fd).alias("nm_fd_peak"), F.max(fl).alias("nm_flow_peak"), F.avg(fd).alias("nm_fd_mean"),
        F.max(F.when(tail, fd)).alias("nm_fd_tail_max"),
        F.avg(F.when(tail, fd)).alias("nm_fd_tail_mean"),
        F.avg(F.when(tail, fl)).alias("nm_flow_tail_mean"),
        F.max_by(i, F.struct(fd.alias("v"), (-i).alias("i"))).alias("_at"), F.max("n").alias("_n"),
        F.avg(flag(fd > F.col("med"))).alias("nm_sustained_frac"),
        F.avg(flag(F.col("rim_ok"))).alias("nm_rim_ok_frac"))
    return g.select(*keys, *[c for c in PER_ANGLE if c not in ("nm_peak_pos", "nm_n_frames")],
                    F.when(F.col("_n") > 1, F.col("_at") / (F.col("_n") - 1)).otherwise(0.0)
                    .alias("nm_peak_pos"), F.col("_n").cast("double").alias("nm_n_frames"))


def fused_motion(per_angle: DataFrame, keys: Sequence[str] = SHOT) -> DataFrame:
    """Wide per-camera columns plus max, mean over present cameras, quality-weighted mean, agreement."""
    wide = per_angle.groupBy(*keys).agg(*[
        F.max(F.when(F.col("angle") == a, F.col(c))).alias(f"{c}_{a}")
        for c in PER_ANGLE for a in K.ANGLES])

    def vals(c):
        return F.filter(F.array(*[F.col(f"{c}_{a}") for a in K.ANGLES]), lambda x: x.isNotNull())

    def total(arr):
        return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)
    out = []
    for c in ("nm_fd_peak", "nm_flow_peak", "nm_fd_tail_max"):
        v = vals(c)
        num = sum((F.coalesce(F.col(f"{c}_{a}"), F.lit(0.0))
                   * F.coalesce(F.col(f"nm_rim_ok_frac_{a}"), F.lit(0.0)) for a in K.ANGLES),
                  F.lit(0.0))
        den = sum((F.coalesce(F.col(f"nm_rim_ok_frac_{a}"), F.lit(0.0)) for a in K.ANGLES),
                  F.lit(0.0))
        out += [F.array_max(v).alias(f"{c}_max"),
                F.when(F.size(v) > 0, total(v) / F.size(v)).alias(f"{c}_mean"),
                F.when(den != 0, num / den).otherwise(0.0).alias(f"{c}_qw")]
    s = F.array_sort(vals("nm_fd_peak"))
    k = F.size(s)
    med = (F.element_at(s, (F.floor((k + 1) / 2)).cast("int"))
           + F.element_at(s, (F.floor(k / 2) + 1).cast("int"))) / 2
    w = wide.withColumn("_med", F.when(k > 0, med))
    agree = sum((flag(F.col(f"nm_fd_peak_{a}") > F.col("_med")) for a in K.ANGLES), F.lit(0.0))
    return w.select("*", *out, agree.cast("long").alias("nm_agree_high")).drop("_med")
