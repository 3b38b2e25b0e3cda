"""Per-track features: reference box, coverage, closest approach, crossings, bounce-out, arc."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from orbweave.functions import boxes as B, fixed as K, ordered
from orbweave.functions.lineage import cut
from orbweave.functions.quantiles import medians
from orbweave.functions.skew import attach

TRACK = ("game_id", "play_id", "angle")
SHOT = ("game_id", "play_id")


def flag(cond: Column) -> Column:
    """1.0 / 0.0, with null counted as false."""
    return F.coalesce(cond, F.lit(False)).cast("double")


def any_of(cond: Column) -> Column:
    return F.max(flag(cond))


def reference_box(tracks: DataFrame, keys: Sequence[str] = TRACK) -> DataFrame:
    """Median rim box per track over rows with a whole rim box; null box when degenerate."""
    m = medians(tracks.filter(B.present("rim")), keys, ["rim_x", "rim_y", "rim_w", "rim_h"])
    ok = (F.col("rim_w") > 1.0) & (F.col("rim_h") > 1.0)
    return m.select(*keys, *[F.when(ok, F.col(f"rim_{c}")).alias(f"ref_{c}") for c in "xywh"])


def width_ruler(tracks: DataFrame, keys: Sequence[str] = TRACK) -> DataFrame:
    """Median rim width over widths above one pixel."""
    m = medians(tracks.filter(F.col("rim_w") > 1.0), keys, ["rim_w"])
    return m.withColumnRenamed("rim_w", "ruler")


def coverage(tracks: DataFrame, keys: Sequence[str] = TRACK) -> DataFrame:
    """Frames, detection fractions and ball confidence per track."""
    some = F.max(B.present("ball").cast("int")) == 1
    return tracks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_frames"),
        F.avg(B.present("ball").cast("double")).alias("ball_frac"),
        F.avg(F.col("rim_conf").isNotNull().cast("double")).alias("rim_frac"),
        F.when(some, F.coalesce(F.avg("ball_conf"), F.lit(0.0))).otherwise(0.0)
        .alias("ball_conf_mean"),
        F.when(some, F.coalesce(F.max("ball_conf"), F.lit(0.0))).otherwise(0.0)
        .alias("ball_conf_max"))


def detections(tracks: DataFrame, ref: DataFrame | None = None,
               keys: Sequence[str] = TRACK) -> DataFrame:
    """Ball rows of tracks with a reference box, with distances in reference widths."""
    ref = reference_box(tracks, keys) if ref is None else ref
    rows = tracks.filter(B.present("ball")).select(
        *keys, "frame_idx", B.center_x("ball").alias("cx"), B.center_y("ball").alias("cy"),
        F.coalesce("ball_conf", F.lit(0.0)).alias("conf"))
    d = attach(rows, ref.filter(F.col("ref_w").isNotNull()), keys, ["frame_idx"], "inner")
    rcx = F.col("ref_x") + F.col("ref_w") / 2.0
    rcy = F.col("ref_y") + F.col("ref_h") / 2.0
    d = d.withColumn("rcx", rcx).withColumn("rcy", rcy)
    dist = B.distance(F.col("cx") - F.col("rcx"), F.col("cy") - F.col("rcy")) / F.col("ref_w")
    return (d.withColumn("dist", dist)
            .withColumn("inside", B.in_box("cx", "cy", "ref_x", "ref_y",
                                           F.col("ref_x") + F.col("ref_w"),
                                           F.col("ref_y") + F.col("ref_h")))
            .withColumn("above", F.col("cy") <= F.col("rcy"))
            .withColumn("level", F.abs(F.col("cx") - F.col("rcx"))
                        <= F.lit(K.THROUGH_X_TOL_RW) * F.col("ref_w"))
            .withColumn("near", F.col("dist") <= K.NEAR_RIM_RW))


def linked(det: DataFrame, keys: Sequence[str] = TRACK) -> DataFrame:
    """Detected rows with their previous and next row, split by frame bucket."""
    return ordered.neighbours(det, keys, ["frame_idx"], ["cx", "cy", "conf", "above", "level", "near"],
                              ordered.frame_bucket())


def numbered(det: DataFrame, keys: Sequence[str] = TRACK) -> DataFrame:
    """``linked`` rows that also carry their row number, for windows around a row."""
    return linked(ordered.row_number(det, keys, ["frame_idx"], ordered.frame_bucket(), "rn"), keys)


def closest(det: DataFrame, keys: Sequence[str] = TRACK) -> DataFrame:
    """Closest approach: distance, its confidence and its relative time (first row on ties)."""
    best = F.min_by(F.struct("dist", "conf", "frame_idx"), F.struct("dist", "frame_idx"))
    g = det.groupBy(*keys).agg(best.alias("best"), F.min("frame_idx").alias("f0"),
                               F.max("frame_idx").alias("f1"))
    span = F.greatest(F.col("f1") - F.col("f0"), F.lit(1))
    return g.select(*keys, F.col("best.dist").alias("min_dist_rw"),
                    F.col("best.conf").alias("min_dist_conf"),
                    F.col("best.frame_idx").alias("min_dist_frame"),
                    ((F.col("best.frame_idx") - F.col("f0")) / span).alias("min_dist_frac_time"))


def rebound(det: DataFrame, keys: Sequence[str] = TRACK) -> DataFrame:
    """Distance lost from the first row to the closest one, and regained after it."""
    near = closest(det, keys).select(*keys, "min_dist_rw", "min_dist_frame")
    rows = attach(det, near, keys, ["frame_idx"], "inner")
    g = rows.groupBy(*keys).agg(
        F.min_by("dist", "frame_idx").alias("first_dist"), F.max("min_dist_rw").alias("m"),
        F.max(F.when(F.col("frame_idx") > F.col("min_dist_frame"), F.col("dist"))).alias("post"))
    return g.select(*keys, F.greatest(F.col("first_dist") - F.col("m"), F.lit(0.0))
                    .alias("approach_drop"),
                    F.coalesce(F.greatest(F.col("post") - F.col("m"), F.lit(0.0)), F.lit(0.0))
                    .alias("post_min_rebound"))


def crosses() -> Column:
    """The row and its predecessor straddle the reference plane downwards, both level with it."""
    return F.col("prev.above") & ~F.col("above") & F.col("prev.level") & F.col("level")


def plane_crossings(det_n: DataFrame, keys: Sequence[str] = TRACK) -> DataFrame:
    """Downward crossings of the reference plane between consecutive detected rows."""
    conf = F.lit(0.5) * (F.col("prev.conf") + F.col("conf"))
    g = det_n.groupBy(*keys).agg(
        F.sum(F.coalesce(crosses(), F.lit(False)).cast("long")).alias("through_hoop_count"),
        F.coalesce(F.avg(F.when(crosses(), conf)), F.lit(0.0)).alias("through_hoop_conf"))
    return g.withColumn("through_hoop", flag(F.col("through_hoop_count") > 0))


def direction_flip(det_n: DataFrame, keys: Sequence[str] = TRACK) -> DataFrame:
    """1 when the vertical direction flips between consecutive near-rim steps, zeros skipped."""
    step = F.signum(F.col("cy") - F.col("prev.cy"))
    moves = (det_n.filter(F.col("near") & F.col("prev.near"))
             .select(*keys, "frame_idx", step.alias("s")).filter(F.col("s") != 0))
    m = ordered.neighbours(moves, keys, ["frame_idx"], ["s"], ordered.frame_bucket(), "p", None)
    flips = m.groupBy(*keys).agg(any_of(F.col("p.s") != F.col("s")).alias("flip"))
    n_near = det_n.groupBy(*keys).agg(F.sum(F.col("near").cast("long")).alias("n_near"))
    return (n_near.join(flips, list(keys), "left")
            .select(*keys, flag((F.col("n_near") >= 3) & (F.col("flip") > 0))
                    .alias("vy_sign_change_near_rim")))


def second_difference(rows: DataFrame, value: str, keys: Sequence[str] = TRACK,
                      order: str = "frame_idx", bucket: Column | None = None) -> DataFrame:
    """|second difference| of ``value`` at each interior non-null row."""
    v = rows.filter(F.col(value).isNotNull()).select(*keys, order, value)
    n = ordered.neighbours(v, keys, [order], [value],
                           ordered.frame_bucket(order) if bucket is None else bucket)
    return (n.filter(F.col("prev").isNotNull() & F.col("next").isNotNull())
            .withColumn("d2", F.abs((F.col(f"next.{value}") - F.col(value))
                                    - (F.col(value) - F.col(f"prev.{value}")))))


def jitter(rows: DataFrame, value: str, keys: Sequence[str] = TRACK, name: str = "jitter",
           order: str = "frame_idx") -> DataFrame:
    """Median |second difference|; tracks with fewer than three values have no row."""
    return medians(second_difference(rows, value, keys, order), keys, ["d2"]) \
        .withColumnRenamed("d2", name)


def bounce_out(det_n: DataFrame, best: DataFrame, keys: Sequence[str] = TRACK) -> DataFrame:
    """Sustained climb after the deepest point that follows the closest approach.

    ``best`` holds per track the row number, distance and frame of the closest approach and the
    number of detected rows.  Only 19 rows per track take part.
    """
    med3 = F.when(F.col("prev").isNotNull() & F.col("next").isNotNull(),
                  F.array_sort(F.array("prev.cy", "cy", "next.cy"))[1]).otherwise(F.col("cy"))
    rows = attach(det_n.withColumn("sy", med3), best, keys, ["frame_idx"], "inner")
    seg = rows.filter((F.col("rn") >= F.col("j")) & (F.col("rn") <= F.col("j") + K.BOUNCE_WINDOW_ROWS)
                      & (F.col("n_det") >= 5) & (F.col("j") < F.col("n_det") - 1)
                      & (F.col("j_dist") <= K.NEAR_RIM_RW))
    g = seg.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("rn", "sy", "cx", "conf", "frame_idx"))).alias("a"),
        F.max("j").alias("j"), F.max("n_det").alias("n_det"), F.max("rcx").alias("rcx"),
        F.max("ref_w").alias("rw"), F.max("ref_h").alias("rh"), F.max("j_frame").alias("jf"))
    low = F.array_max(F.transform("a", lambda r: F.struct(
        r["sy"].alias("y"), (-r["rn"]).alias("m"), r["frame_idx"].alias("f"))))
    g = g.filter(F.size("a") >= 3).withColumn("low", low)
    g = g.withColumn("after", F.filter("a", lambda r: r["rn"] > -F.col("low.m")))
    top = F.array_min(F.transform("after", lambda r: F.struct(
        r["sy"].alias("y"), r["rn"].alias("rn"), r["cx"].alias("cx"), r["conf"].alias("conf"))))
    g = g.withColumn("top", top)
    fires = ((F.size("after") > 0)
             & ((F.col("low.y") - F.col("top.y")) / F.col("rh") >= K.BOUNCE_MIN_RH)
             & (F.col("low.y") > F.col("a")[0]["sy"] + F.lit(K.BOUNCE_DROP_RH) * F.col("rh")))
    g = g.filter(fires)
    kick = F.array_max(F.transform(
        F.filter("a", lambda r: r["rn"] >= -F.col("low.m")),
        lambda r: F.abs(r["cx"] - F.col("rcx")))) / F.col("rw")
    return g.select(
        *keys, F.lit(1.0).alias("bo_any"), F.col("top.conf").alias("bo_conf"),
        (F.col("low.f") - F.col("jf")).cast("double").alias("bo_frames_to_reappear"),
        (F.abs(F.col("top.cx") - F.col("rcx")) / F.col("rw")).alias("bo_outward_disp"),
        flag(kick > K.BOUNCE_KICK_RW).alias("bo_then_rises"))


def _quad(p: str) -> tuple[Column, Column, Column, Column]:
    """Least-squares a,b,c of y = a u^2 + b u + c from moment sums prefixed ``p``; and det."""
    n, s1, s2, s3, s4 = (F.col(f"{p}{k}") for k in ("n", "s1", "s2", "s3", "s4"))
    y0, y1, y2 = (F.col(f"{p}{k}") for k in ("y0", "y1", "y2"))
    det = s4 * (s2 * n - s1 * s1) - s3 * (s3 * n - s1 * s2) + s2 * (s3 * s1 - s2 * s2)
    a = (y2 * (s2 * n - s1 * s1) - s3 * (y1 * n - s1 * y0) + s2 * (y1 * s1 - s2 * y0)) / det
    b = (s4 * (y1 * n - s1 * y0) - y2 * (s3 * n - s1 * s2) + s2 * (s3 * y0 - y1 * s2)) / det
    c = (s4 * (s2 * y0 - s1 * y1) - s3 * (s3 * y0 - y1 * s2) + y2 * (s3 * s1 - s2 * s2)) / det
    return a, b, c, det


def moments(u: Column, y: Column, p: str) -> list[Column]:
    """Moment sums for a quadratic fit of y over u."""
    return [F.count(u).alias(f"{p}n"), F.sum(u).alias(f"{p}s1"), F.sum(u * u).alias(f"{p}s2"),
            F.sum(u * u * u).alias(f"{p}s3"), F.sum(u * u * u * u).alias(f"{p}s4"),
            F.sum(y).alias(f"{p}y0"), F.sum(u * y).alias(f"{p}y1"),
            F.sum(u * u * y).alias(f"{p}y2"), F.sum(y * y).alias(f"{p}yy")]


def arc(det_n: DataFrame, best: DataFrame, keys: Sequence[str] = TRACK) -> DataFrame:
    """Parabola features in +-12 detected rows around the closest approach.

    y(x), y(t) and x(t) are fitted by moment sums over coordinates scaled by the reference box
    and time centred on the closest approach, so one aggregation pass serves all three.
    """
    rows = attach(det_n, best, keys, ["frame_idx"], "inner").filter(
        F.abs(F.col("rn") - F.col("j")) <= K.ARC_HALF_ROWS)
    u = (F.col("cx") - F.col("rcx")) / F.col("ref_w")
    v = (F.col("cy") - F.col("rcy")) / F.col("ref_h")
    t = (F.col("frame_idx") - F.col("j_frame")).cast("double")
    rows = rows.withColumn("u", u).withColumn("v", v).withColumn("tt", t)
    g = rows.groupBy(*keys).agg(
        *moments(F.col("u"), F.col("v"), "g_"), *moments(F.col("tt"), F.col("v"), "k_"),
        F.regr_slope("u", "tt").alias("x_slope"),
        (F.max("cx") - F.min("cx")).alias("x_span"), (F.max("tt") - F.min("tt")).alias("t_span"),
        F.max("ref_w").alias("rw"), F.max("ref_h").alias("rh"))
    g = g.filter(F.col("g_n") >= K.ARC_MIN_POINTS)
    a, b, c, det = _quad("g_")
    ka, kb, _, kdet = _quad("k_")
    wide = (F.col("x_span") > 1e-3) & (F.abs(det) > 1e-12)
    timed = (F.col("t_span") > 1e-3) & (F.abs(kdet) > 1e-12)
    g = (g.withColumn("a", F.when(wide, a)).withColumn("b", F.when(wide, b))
         .withColumn("c", F.when(wide, c)).withColumn("kb", F.when(timed, kb)))
    sse = (F.col("g_yy") - F.col("a") * F.col("g_y2") - F.col("b") * F.col("g_y1")
           - F.col("c") * F.col("g_y0"))
    rms = F.sqrt(F.greatest(sse, F.lit(0.0)) / F.col("g_n")) * F.col("rh") / F.col("rw")
    curved = F.abs(F.col("a") * F.col("rh") / (F.col("rw") * F.col("rw"))) > 1e-9
    apex_u = -F.col("b") / (F.lit(2.0) * F.col("a"))
    apex_v = F.col("c") - F.col("b") * F.col("b") / (F.lit(4.0) * F.col("a"))
    vy = F.col("kb") * F.col("rh")
    vx = F.when(F.col("x_span") > 1e-3, F.col("x_slope") * F.col("rw")).otherwise(0.0)
    return g.select(
        *keys, F.lit(1.0).alias("arc_ok"),
        F.coalesce(F.degrees(F.atan2(F.abs(vy), F.abs(vx) + F.lit(1e-6))), F.lit(0.0))
        .alias("arc_entry_angle_deg"),
        F.coalesce("kb", F.lit(0.0)).alias("arc_vy_at_rim"),
        F.coalesce(F.col("a") * F.col("rh") / F.col("rw"), F.lit(0.0)).alias("arc_curvature"),
        F.coalesce(rms, F.lit(5.0)).alias("arc_fit_resid"),
        F.coalesce(F.when(curved, apex_u), F.lit(5.0)).alias("arc_apex_dx_rw"),
        F.coalesce(F.when(curved, -apex_v), F.lit(0.0)).alias("arc_apex_above_rim_rh"))


def best_rows(det_n: DataFrame, keys: Sequence[str] = TRACK) -> DataFrame:
    """Row number, frame and distance of the closest approach, and the detected-row count."""
    g = det_n.groupBy(*keys).agg(
        F.min_by(F.struct("rn", "frame_idx", "dist", "conf"), F.struct("dist", "frame_idx"))
        .alias("b"), F.count(F.lit(1)).alias("n_det"))
    return g.select(*keys, F.col("b.rn").alias("j"), F.col("b.frame_idx").alias("j_frame"),
                    F.col("b.dist").alias("j_dist"), F.col("b.conf").alias("j_conf"), "n_det")


PER_ANGLE = (
    "n_frames", "ball_frac", "ball_conf_mean", "ball_conf_max", "rim_frac", "rim_detected",
    "min_dist_rw", "min_dist_frac_time", "enters_rim_box", "frac_inside_rim", "through_hoop",
    "through_hoop_count", "through_hoop_conf", "vy_sign_change_near_rim", "min_dist_conf",
    "approach_drop", "post_min_rebound", "bo_any", "bo_conf", "bo_frames_to_reappear",
    "bo_outward_disp", "bo_then_rises", "arc_ok", "arc_entry_angle_deg", "arc_vy_at_rim",
    "arc_curvature", "arc_fit_resid", "arc_apex_dx_rw", "arc_apex_above_rim_rh", "q_quality",
)


def angle_features(tracks: DataFrame, keys: Sequence[str] = TRACK) -> DataFrame:
    """All raw per-camera features of each track, missing values filled by their sentinel."""
    keys = list(keys)
    ref = reference_box(tracks, keys)
    det_n = cut(numbered(detections(tracks, ref, keys), keys))
    inside = det_n.groupBy(*keys).agg(
        any_of(F.col("inside")).alias("enters_rim_box"),
        F.avg(F.col("inside").cast("double")).alias("frac_inside_rim"))
    best = best_rows(det_n, keys)
    out = coverage(tracks, keys).join(
        ref.select(*keys, flag(F.col("ref_w").isNotNull()).alias("rim_detected")), keys, "left")
    for part in (closest(det_n, keys).drop("min_dist_frame"), inside,
                 plane_crossings(det_n, keys), direction_flip(det_n, keys),
                 rebound(det_n, keys), bounce_out(det_n, best, keys), arc(det_n, best, keys)):
        out = out.join(part, keys, "left")
    out = fill_sentinels(out, keys)
    q = F.col("ball_frac") * F.col("rim_frac")
    seen = (F.col("rim_detected") >= 1.0) & (F.col("ball_frac") > 0)
    return out.withColumn("q_quality", F.when(seen, F.greatest(
        F.lit(0.0), F.least(F.lit(1.0), q))).otherwise(0.0)).select(*keys, *PER_ANGLE)


def fill_sentinels(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every non-key column as a double, nulls replaced by the column family's sentinel."""
    return df.select(*keys, *[
        F.coalesce(F.col(c).cast("double"), F.lit(K.SENTINELS.get(c, 0.0))).alias(c)
        for c in df.columns if c not in keys])
