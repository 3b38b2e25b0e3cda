"""Cross-camera fusion: long-to-wide pivot, usable-angle aggregates, quality weighting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from orbweave.functions import fixed as K
from orbweave.operators.tracks import PER_ANGLE, SHOT, flag

CLEAN_KEYS = (
    "cln_arc_ok", "cln_arc_entry_angle_deg", "cln_arc_vy_at_rim", "cln_arc_curvature",
    "cln_arc_fit_resid", "cln_arc_apex_dx_rw", "cln_arc_apex_above_rim_rh", "cln_bo_any",
    "cln_bo_conf", "cln_bo_frames_to_reappear", "cln_bo_outward_disp", "cln_bo_then_rises",
    "cln_min_dist_rw", "cln_through_hoop", "cln_frac_inside_rim", "imp_frac", "n_imputed",
    "n_rejected_outlier", "track_quality", "jitter_raw", "jitter_clean", "jitter_reduction",
    "n_cleaned_points",
)


def pivot_angles(feats: DataFrame, cols: Sequence[str], keys: Sequence[str] = SHOT,
                 angle: str = "angle") -> DataFrame:
    """One row per shot with ``<col>_<angle>`` columns; missing cameras get the sentinel.

    Conditional max per camera: one map-side combined aggregation, no pivot job.
    """
    return feats.groupBy(*keys).agg(*[
        F.coalesce(F.max(F.when(F.col(angle) == a, F.col(c).cast("double"))),
                   F.lit(K.SENTINELS.get(c, 0.0))).alias(f"{c}_{a}")
        for c in cols for a in K.ANGLES])


def with_usable(wide: DataFrame) -> DataFrame:
    """angle_usable_*, n_usable_angles, and the far-camera quality zeroing."""
    out = wide
    for a in K.ANGLES:
        out = out.withColumn(f"angle_usable_{a}", flag(
            (F.col(f"rim_detected_{a}") >= 1.0) & (F.col(f"ball_frac_{a}") > 0.0)))
    for a in K.FAR_ANGLES:
        lost = F.col(f"post_min_rebound_{a}") >= K.FAR_LEFT_FRAME_RW
        out = (out.withColumn(f"far_cam_left_frame_{a}", flag(lost))
               .withColumn(f"q_quality_{a}", F.when(lost, 0.0).otherwise(F.col(f"q_quality_{a}"))))
    return out.withColumn("n_usable_angles", sum_of([F.col(f"angle_usable_{a}") for a in K.ANGLES]))


def sum_of(cols: Sequence[Column]) -> Column:
    e = cols[0]
    for c in cols[1:]:
        e = e + c
    return e


def every(key: str, angles=K.ANGLES) -> list[Column]:
    """The key's column on all cameras, sentinels included."""
    return [F.col(f"{key}_{a}") for a in angles]


def usable(key: str, angles=K.ANGLES, f=lambda c: c) -> list[Column]:
    """The key's column where the camera is usable, else null (least/greatest skip nulls)."""
    return [F.when(F.col(f"angle_usable_{a}") >= 1.0, f(F.col(f"{key}_{a}"))) for a in angles]


def u_sum(key: str, angles=K.ANGLES, f=lambda c: c) -> Column:
    return sum_of([F.coalesce(c, F.lit(0.0)) for c in usable(key, angles, f)])


def u_min(key: str, default: float, angles=K.ANGLES, f=lambda c: c) -> Column:
    return F.coalesce(F.least(*usable(key, angles, f)), F.lit(default))


def u_max(key: str, default: float, angles=K.ANGLES, f=lambda c: c) -> Column:
    return F.coalesce(F.greatest(*usable(key, angles, f)), F.lit(default))


def u_mean(key: str, default: float) -> Column:
    return F.when(F.col("n_usable_angles") > 0, u_sum(key) / F.col("n_usable_angles")) \
        .otherwise(F.lit(default))


def u_votes(test) -> Column:
    """Number of usable cameras whose row passes ``test(angle)``."""
    return sum_of([flag((F.col(f"angle_usable_{a}") >= 1.0) & test(a)) for a in K.ANGLES])


def conf_weighted(key: str = "min_dist_rw", weight: str = "min_dist_conf",
                  default: float = 10.0) -> Column:
    """Mean over usable cameras weighted by confidence, weights at least 1e-3."""
    num = sum_of([F.coalesce(F.when(F.col(f"angle_usable_{a}") >= 1.0, F.greatest(
        F.col(f"{weight}_{a}"), F.lit(1e-3)) * F.col(f"{key}_{a}")), F.lit(0.0)) for a in K.ANGLES])
    den = u_sum(weight, f=lambda c: F.greatest(c, F.lit(1e-3)))
    return F.when(F.col("n_usable_angles") > 0, num / den).otherwise(F.lit(default))


def quality_weighted(key: str, default: float) -> Column:
    """Mean over usable cameras weighted by q_quality; uniform when all weights are zero."""
    wsum = u_sum("q_quality", f=lambda c: F.greatest(c, F.lit(0.0)))
    num = sum_of([F.coalesce(F.when(F.col(f"angle_usable_{a}") >= 1.0, F.greatest(
        F.col(f"q_quality_{a}"), F.lit(0.0)) * F.col(f"{key}_{a}")), F.lit(0.0)) for a in K.ANGLES])
    return (F.when(F.col("n_usable_angles") == 0, F.lit(default))
            .when(wsum <= 1e-9, u_sum(key) / F.col("n_usable_angles")).otherwise(num / wsum))


def fused_raw() -> list[Column]:
    """Shot-level aggregates of the raw per-camera features."""
    out = [
        u_min("min_dist_rw", 10.0).alias("min_dist_rw_best"),
        u_mean("min_dist_rw", 10.0).alias("min_dist_rw_mean"),
        flag(F.greatest(*every("through_hoop")) >= 1.0).alias("through_hoop_any"),
        u_sum("through_hoop").alias("through_hoop_votes"),
        F.greatest(*every("through_hoop_count")).alias("through_hoop_count_max"),
        u_max("through_hoop_conf", 0.0).alias("through_hoop_conf_max"),
        u_sum("enters_rim_box").alias("enters_rim_votes"),
        u_max("frac_inside_rim", 0.0).alias("frac_inside_rim_max"),
        u_max("post_min_rebound", 0.0).alias("post_min_rebound_max"),
        u_sum("vy_sign_change_near_rim").alias("vy_sign_change_votes"),
        conf_weighted().alias("min_dist_rw_confw"),
    ]
    for grp, angs in (("near", K.NEAR_ANGLES), ("far", K.FAR_ANGLES)):
        out.append(u_min("min_dist_rw", 10.0, angs).alias(f"min_dist_rw_{grp}_best"))
        out.append(flag(u_max("through_hoop", 0.0, angs) >= 1.0).alias(f"through_hoop_{grp}_any"))
    wsum = u_sum("q_quality", f=lambda c: F.greatest(c, F.lit(0.0)))
    out += [
        (sum_of(every("ball_frac")) / 4.0).alias("ball_frac_mean"),
        F.greatest(*every("ball_conf_max")).alias("ball_conf_max_overall"),
        flag(F.col("n_usable_angles") > 0).alias("any_angle_usable"),
        F.greatest(*every("q_quality")).alias("q_quality_max"),
        F.when(F.col("n_usable_angles") == 0, 0.0)
        .when(wsum <= 1e-9, F.col("n_usable_angles")).otherwise(wsum).alias("q_quality_sum_usable"),
        quality_weighted("min_dist_rw", 10.0).alias("min_dist_rw_qw"),
        quality_weighted("arc_entry_angle_deg", 0.0).alias("arc_entry_angle_qw"),
        quality_weighted("arc_vy_at_rim", 0.0).alias("arc_vy_at_rim_qw"),
    ]
    close = u_votes(lambda a: F.col(f"min_dist_rw_{a}") <= K.NEAR_RIM_RW)
    th = u_votes(lambda a: F.col(f"through_hoop_{a}") >= 1.0)
    clean = u_votes(lambda a: (F.col(f"bo_any_{a}") >= 1.0) & (F.col(f"bo_then_rises_{a}") >= 1.0))
    out += [
        close.alias("close_agree_votes"), flag(close >= 2).alias("agree_make_like"),
        flag(th >= 2).alias("through_hoop_agree2"),
        flag(u_max("bo_any", 0.0) >= 1.0).alias("bo_any_fused"), u_sum("bo_any").alias("bo_votes"),
        quality_weighted("bo_conf", 0.0).alias("bo_conf_fused"),
        u_max("bo_outward_disp", 0.0).alias("bo_outward_disp_max"),
        flag(u_max("bo_then_rises", 0.0) >= 1.0).alias("bo_then_rises_any"),
        clean.alias("bo_clean_votes"), flag(clean >= 1).alias("bo_clean_any"),
        flag(u_max("arc_ok", 0.0) >= 1.0).alias("arc_ok_any"), u_sum("arc_ok").alias("arc_ok_votes"),
        u_min("arc_fit_resid", 5.0).alias("arc_fit_resid_min"),
        u_max("arc_entry_angle_deg", 0.0).alias("arc_entry_angle_max"),
        u_max("arc_apex_above_rim_rh", 0.0).alias("arc_apex_above_rim_rh_max"),
        u_min("arc_apex_dx_rw", 5.0, f=F.abs).alias("arc_apex_dx_rw_min"),
        u_max("arc_vy_at_rim", 0.0).alias("arc_vy_at_rim_max"),
    ]
    return out


def fused_clean() -> list[Column]:
    """Shot-level aggregates of the cleaned-track features."""
    clean = u_votes(lambda a: (F.col(f"cln_bo_any_{a}") >= 1.0)
                    & (F.col(f"cln_bo_then_rises_{a}") >= 1.0))
    return [
        u_min("cln_min_dist_rw", 10.0).alias("cln_min_dist_rw_best"),
        flag(u_max("cln_through_hoop", 0.0) >= 1.0).alias("cln_through_hoop_any"),
        u_sum("cln_through_hoop").alias("cln_through_hoop_votes"),
        u_max("cln_frac_inside_rim", 0.0).alias("cln_frac_inside_rim_max"),
        flag(u_max("cln_bo_any", 0.0) >= 1.0).alias("cln_bo_any_fused"),
        u_sum("cln_bo_any").alias("cln_bo_votes"), flag(clean >= 1).alias("cln_bo_clean_any"),
        u_max("cln_bo_outward_disp", 0.0).alias("cln_bo_outward_disp_max"),
        u_sum("cln_arc_ok").alias("cln_arc_ok_votes"),
        u_min("cln_arc_fit_resid", 5.0).alias("cln_arc_fit_resid_min"),
        u_max("cln_arc_entry_angle_deg", 0.0).alias("cln_arc_entry_angle_max"),
        u_max("cln_arc_apex_above_rim_rh", 0.0).alias("cln_arc_apex_above_rim_rh_max"),
        u_min("cln_arc_apex_dx_rw", 5.0, f=F.abs).alias("cln_arc_apex_dx_rw_min"),
        u_max("cln_arc_vy_at_rim", 0.0).alias("cln_arc_vy_at_rim_max"),
        (sum_of(every("track_quality")) / 4.0).alias("track_quality_mean"),
        F.greatest(*every("track_quality")).alias("track_quality_max"),
        (sum_of(every("imp_frac")) / 4.0).alias("imp_frac_mean"),
        u_min("imp_frac", 1.0).alias("imp_frac_min_usable"),
        sum_of(every("n_rejected_outlier")).alias("n_rejected_outlier_total"),
        (sum_of(every("jitter_reduction")) / 4.0).alias("jitter_reduction_mean"),
    ]


def fuse(feats: DataFrame, keys: Sequence[str] = SHOT, clean: bool = False) -> DataFrame:
    """Dense shot row: per-camera columns plus fused aggregates."""
    cols = [*PER_ANGLE, *(CLEAN_KEYS if clean else ())]
    wide = with_usable(pivot_angles(feats, cols, keys))
    return wide.select("*", *fused_raw(), *(fused_clean() if clean else ()))


def collapse_sides(df: DataFrame, is_left: Column, pairwise: bool = False) -> DataFrame:
    """Replace per-camera columns by the far and near camera of the shot's side.

    Families need all four suffixes; ``pairwise`` accepts a lone FL+FR or NL+NR pair.
    """
    families: dict[str, set[str]] = {}
    for c in df.columns:
        base, _, suffix = c.rpartition("_")
        if base and suffix in K.ANGLES:
            families.setdefault(base, set()).add(suffix)
    drop, new = set(), []
    for base, have in families.items():
        far, near = {"FL", "FR"} <= have, {"NL", "NR"} <= have
        if not pairwise and not (far and near):
            continue
        for ok, left, right, side in ((far, "FL", "FR", "FARSIDE"), (near, "NL", "NR", "NEARSIDE")):
            if ok:
                new.append(F.when(is_left, F.col(f"{base}_{left}"))
                           .otherwise(F.col(f"{base}_{right}")).alias(f"{base}_{side}"))
                drop |= {f"{base}_{left}", f"{base}_{right}"}
    return df.select(*[c for c in df.columns if c not in drop], *new,
                     is_left.cast("int").alias("side_is_left"))


def align_columns(df: DataFrame, template: Sequence[str], strict: bool = False) -> DataFrame:
    """Columns exactly as in ``template``: missing ones null, extra ones dropped."""
    missing = [c for c in template if c not in df.columns]
    extra = [c for c in df.columns if c not in template]
    if strict and (missing or extra):
        raise ValueError(f"column set mismatch: missing={missing} extra={extra}")
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c)
                       for c in template])


def add_interactions(df: DataFrame) -> DataFrame:
    """Net-motion by trajectory products and ratios; absent inputs count as 0."""
    def col(name):
        return F.col(name).cast("double") if name in df.columns else F.lit(0.0)
    peak, frac, thru = col("nm_fd_peak_max"), col("frac_inside_rim_max"), col("through_hoop_conf_max")
    eps = F.lit(0.01)
    return df.select(
        "*", (frac * peak).alias("ix_frac_x_nmpeak"), (thru * peak).alias("ix_thru_x_nmpeak"),
        (col("arc_entry_angle_qw") * col("nm_fd_peak_qw")).alias("ix_arc_x_nmpeak_qw"),
        (peak / (frac + eps)).alias("ix_nmpeak_div_frac"),
        (peak / (thru + eps)).alias("ix_nmpeak_div_thru"),
        (F.lit(1.0) / (col("min_dist_rw_near_best") + F.lit(0.5)) * peak)
        .alias("ix_close_x_nmpeak"),
        (col("nm_agree_high") * peak).alias("ix_agree_x_nmpeak"),
        (col("nm_agree_high") * thru).alias("ix_agree_x_thru"),
        (col("nm_fd_tail_max_max") / (peak + eps)).alias("ix_tail_over_peak"),
        (col("nm_flow_peak_max") / (peak + eps)).alias("ix_flow_over_fd"))
