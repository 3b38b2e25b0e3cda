"""Rim-relative features from the boxes of each frame: geometry block, size ratios, sync, quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from orbweave.functions import boxes as B, fixed as K, labels as L, ordered
from orbweave.functions.quantiles import medians
from orbweave.operators.evaluate import count_if
from orbweave.operators.temporal import nearest
from orbweave.operators.tracks import SHOT, TRACK, any_of, flag


def both(tracks: DataFrame) -> DataFrame:
    """Rows with a whole ball box and a whole rim box, with offsets in pixels and the size ratio."""
    r = tracks.filter(B.present("ball") & B.present("rim"))
    return (r.withColumn("dx", B.center_x("ball") - B.center_x("rim"))
            .withColumn("dy", B.center_y("ball") - B.center_y("rim"))
            .withColumn("ratio", F.col("ball_w") / (F.col("rim_w") + F.lit(1e-6)))
            .withColumn("is_near", B.near_rim()).withColumn("is_over", B.over_rim())
            .withColumn("is_cross", B.at_crossing()))


def angle_geometry(tracks: DataFrame, keys: Sequence[str] = TRACK) -> DataFrame:
    """Per camera: detection rate, closest distance and share inside, from each frame's own box."""
    ok = B.present("ball") & B.present("rim")
    return tracks.groupBy(*keys).agg(
        F.avg(B.present("ball").cast("double")).alias("bdet"),
        F.coalesce(F.min(F.when(ok, B.distance_rw())), F.lit(10.0)).alias("dmin"),
        F.coalesce(F.avg(F.when(ok, B.ball_in_rim().cast("double"))), F.lit(0.0))
        .alias("frac_inside"))


def geometry_block(tracks: DataFrame, keys: Sequence[str] = SHOT) -> DataFrame:
    """Shot-level geometry: trusted closest distance per side, inside shares, far-says-miss."""
    a = angle_geometry(tracks, [*keys, "angle"])

    def side(angles):
        return F.col("angle").isin(*angles)

    def dmin(angles):
        trusted = F.min(F.when(side(angles) & (F.col("bdet") > 0.5), F.col("dmin")))
        # cameras without rows count as far away (10) when no camera is trusted
        plain = F.min(F.when(side(angles), F.col("dmin")))
        return F.coalesce(trusted, F.least(plain, F.lit(10.0)), F.lit(10.0))

    def top(col, angles):
        return F.coalesce(F.max(F.when(side(angles), F.col(col))), F.lit(0.0))
    g = a.groupBy(*keys).agg(
        dmin(K.FAR_ANGLES).alias("g_far_dmin"),
        dmin(K.NEAR_ANGLES).alias("g_near_dmin"),
        top("frac_inside", K.FAR_ANGLES).alias("g_far_inside"),
        top("frac_inside", K.NEAR_ANGLES).alias("g_near_inside"),
        top("bdet", K.FAR_ANGLES).alias("g_far_bdet"))
    return g.select("*", ((F.col("g_far_dmin") > 2.0) & (F.col("g_far_bdet") > 0.6)).cast("int")
                    .alias("g_far_says_miss"),
                    (F.col("g_near_inside") - F.col("g_far_inside")).alias("g_nf_inside_gap"),
                    F.least("g_far_dmin", "g_near_dmin").alias("g_all_dmin"))


def far_verdict(pairs: DataFrame, frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Single-pass far verdict from all box pairs of a frame.

    ``pairs``: keys, frame, ball box and the frame's biggest rim; ``frames``: one row per frame
    with ``has_ball``.
    """
    d = pairs.filter(F.col("rim_w") > 1).groupBy(*keys).agg(F.min(B.distance_rw()).alias("d"))
    n = frames.groupBy(*keys).agg(F.avg(flag(F.col("has_ball"))).alias("bdet"))
    j = n.join(d, list(keys), "left")
    dmin = F.coalesce("d", F.lit(10.0))
    return j.select(*keys, dmin.alias("dmin"), "bdet",
                    ((dmin > 2.0) & (F.col("bdet") > 0.6)).cast("int").alias("says_miss"))


def _first_by(value: Column, rank: Column, when: Column) -> Column:
    return F.min_by(value, F.when(when, F.struct(rank.alias("r"), F.col("frame_idx").alias("f"))))


def crossing_sizes(tracks: DataFrame, keys: Sequence[str] = TRACK) -> DataFrame:
    """Ball/rim size ratio at the rim crossing and vertical passage over the hoop."""
    r = both(tracks)
    dr = F.col("ball_w") / (F.col("rim_w") * F.lit(9.5 / 18.0) + F.lit(1e-6))
    over, cross, near = F.col("is_over"), F.col("is_cross"), F.col("is_near")
    g = r.groupBy(*keys).agg(
        count_if(cross).alias("nd_atcross_n"),
        F.max(F.when(cross, F.col("ratio"))).alias("nd_atcross_ratio_max"),
        _first_by(F.col("ratio"), F.abs("dy"), cross).alias("nd_atcross_ratio_closest"),
        F.avg(F.when(near, over.cast("double"))).alias("nd_inside_frac"),
        _first_by(dr, F.abs("dy"), near).alias("nd_dr_closest"),
        count_if(over).alias("_no"), F.min(F.when(over, F.col("dy"))).alias("_lo"),
        F.max(F.when(over, F.col("dy"))).alias("_hi"),
        F.avg(F.when(over, F.col("rim_h"))).alias("_rh"))
    med = medians(r.filter("is_cross"), keys, ["ratio"]) \
        .withColumnRenamed("ratio", "nd_atcross_ratio_med")
    some, thr = F.col("_no") >= 2, F.lit(0.2) * F.col("_rh")
    out = tracks.select(*keys).distinct().join(g, list(keys), "left").join(med, list(keys), "left")
    return out.select(
        *keys, F.coalesce("nd_atcross_n", F.lit(0)).alias("nd_atcross_n"), "nd_atcross_ratio_med",
        "nd_atcross_ratio_max", "nd_atcross_ratio_closest", "nd_inside_frac",
        flag(some & (F.col("_lo") < -thr) & (F.col("_hi") > thr)).cast("int").alias("nd_vcross"),
        flag(some & (F.col("_hi") > F.lit(0.5) * F.col("_rh"))).cast("int")
        .alias("nd_below_after_inside"), "nd_dr_closest")


def approach_sizes(tracks: DataFrame, keys: Sequence[str] = TRACK) -> DataFrame:
    """Extended size features: trend over the approach, medians above/below, vertical span."""
    r = both(tracks)
    near, over, cross = F.col("is_near"), F.col("is_over"), F.col("is_cross")
    g = r.groupBy(*keys).agg(
        F.avg(F.when(near, over.cast("double"))).alias("nd2_inside_frac"),
        F.min(F.when(near, B.distance(F.col("dx"), F.col("dy")) / F.col("rim_w")))
        .alias("nd2_min_centerdist"),
        count_if(near).alias("_nn"),
        F.regr_slope(F.when(near, F.col("ratio")), F.when(near, F.col("frame_idx").cast("double")))
        .alias("_slope"),
        count_if(cross).alias("nd2_n_atcross"),
        F.max(F.when(cross, F.col("ratio"))).alias("nd2_atcross_ratio_max"),
        count_if(over).alias("_no"), F.min(F.when(over, F.col("dy"))).alias("_lo"),
        F.max(F.when(over, F.col("dy"))).alias("_hi"),
        F.avg(F.when(over, F.col("rim_h"))).alias("_rh"))
    parts = r.select(*keys, F.when(cross, F.col("ratio")).alias("nd2_atcross_ratio_med"),
                     F.when(near & (F.col("dy") < 0), F.col("ratio")).alias("nd2_ratio_above"),
                     F.when(near & (F.col("dy") > 0), F.col("ratio")).alias("nd2_ratio_below"))
    med = medians(parts, keys, ["nd2_atcross_ratio_med", "nd2_ratio_above", "nd2_ratio_below"])
    some, thr = F.col("_no") >= 2, F.lit(0.2) * F.col("_rh")
    out = tracks.select(*keys).distinct().join(g, list(keys), "left").join(med, list(keys), "left")
    return out.select(
        *keys, F.coalesce("nd2_n_atcross", F.lit(0)).alias("nd2_n_atcross"),
        "nd2_atcross_ratio_med", "nd2_atcross_ratio_max",
        F.when(F.col("_nn") >= 3, F.col("_slope")).alias("nd2_ratio_trend"),
        "nd2_ratio_above", "nd2_ratio_below", "nd2_min_centerdist",
        F.when(some, (F.col("_hi") - F.col("_lo")) / F.col("_rh")).alias("nd2_y_span_inside"),
        "nd2_inside_frac",
        flag(some & (F.col("_lo") < -thr) & (F.col("_hi") > thr)).cast("int").alias("nd2_vcross"))


def event_frames(tracks: DataFrame, keys: Sequence[str] = TRACK) -> DataFrame:
    """Frame at the rim plane: among at-rim rows the one vertically closest to the rim centre."""
    return (both(tracks).filter("is_cross").groupBy(*keys)
            .agg(F.min_by("frame_idx", F.struct(F.abs("dy"), "frame_idx")).alias("event_frame")))


def side_events(tracks: DataFrame, side: Column, keys: Sequence[str] = SHOT) -> DataFrame:
    """Far and near event frame of each shot on its own side; missing ones null."""
    e = event_frames(tracks, [*keys, "angle"]).withColumn("side", side)
    far = F.col("angle") == L.far_camera(F.col("side"))
    near = F.col("angle") == L.near_camera(F.col("side"))
    return e.groupBy(*keys, "side").agg(
        F.max(F.when(far, F.col("event_frame"))).alias("f_far"),
        F.max(F.when(near, F.col("event_frame"))).alias("f_near"))


def camera_offsets(events: DataFrame, game: str = "game_id") -> DataFrame:
    """Frame offset near-minus-far per game and side: truncated median, count, population std."""
    d = (events.filter(F.col("f_far").isNotNull() & F.col("f_near").isNotNull())
         .withColumn("diff", (F.col("f_near") - F.col("f_far")).cast("double")))
    g = d.groupBy(game, "side").agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("diff").alias("_s"))
    return (g.join(medians(d, [game, "side"], ["diff"]), [game, "side"])
            .select(game, "side", F.col("diff").cast("int").alias("offset"), "n",
                    F.when(F.col("n") >= 2, F.col("_s")).alias("std")))


def sync_agreement(tracks: DataFrame, side: Column, offsets: DataFrame) -> DataFrame:
    """Does each side camera see the ball inside at the other camera's event, offset applied?

    Ten columns per shot; the row used is the nearest one within one frame.
    """
    keys = list(SHOT)
    ev = side_events(tracks, side).join(offsets.select("game_id", "side", "offset"),
                                        ["game_id", "side"], "left")
    rows = both(tracks).withColumn("side", side).select(
        *keys, "angle", "side", F.col("frame_idx").alias("rf"),
        (F.col("dx") / F.col("rim_w")).alias("dxr"), (F.col("dy") / F.col("rim_h")).alias("dyr"),
        F.col("is_cross").alias("ins"))
    cols = ["dxr", "dyr", "ins"]

    def at(event, cam, sign):
        want = ev.filter(F.col(event).isNotNull() & F.col("offset").isNotNull()).select(
            *keys, (F.col(event) + sign * F.col("offset")).alias("want"))
        mine = rows.filter(F.col("angle") == cam(F.col("side"))).drop("angle", "side")
        m = nearest(want, mine, keys, "want", "rf", cols, lambda c: ordered.frame_bucket(c), 1)
        return m.filter(F.col("match_t").isNotNull())
    n = at("f_far", L.near_camera, 1).select(
        *keys, F.abs("match_dxr").alias("sa_near_dx_at_far_sync"),
        F.abs("match_dyr").alias("sa_near_dy_at_far_sync"),
        F.col("match_ins").cast("int").alias("sa_near_inside_at_far_sync"))
    f = at("f_near", L.far_camera, -1).select(
        *keys, F.abs("match_dxr").alias("sa_far_dx_at_near_sync"),
        F.abs("match_dyr").alias("sa_far_dy_at_near_sync"),
        F.col("match_ins").cast("int").alias("sa_far_inside_at_near_sync"))
    shots = tracks.select(*keys).distinct()
    j = shots.join(ev, keys, "left").join(n, keys, "left").join(f, keys, "left")
    known = F.col("offset").isNotNull()

    def disagree(c):
        return F.coalesce((F.col(c) == 0).cast("int"), F.lit(0))
    return j.select(
        *keys, flag(known & F.col("f_far").isNotNull()).cast("int").alias("sa_far_event"),
        flag(known & F.col("f_near").isNotNull()).cast("int").alias("sa_near_event"),
        F.coalesce("sa_near_inside_at_far_sync", F.lit(0)).alias("sa_near_inside_at_far_sync"),
        F.coalesce("sa_far_inside_at_near_sync", F.lit(0)).alias("sa_far_inside_at_near_sync"),
        "sa_near_dx_at_far_sync", "sa_near_dy_at_far_sync", "sa_far_dx_at_near_sync",
        "sa_far_dy_at_near_sync",
        disagree("sa_near_inside_at_far_sync").alias("sa_disagree_far_to_near"),
        disagree("sa_far_inside_at_near_sync").alias("sa_disagree_near_to_far"))


def detection_quality(tracks: DataFrame, side: Column) -> DataFrame:
    """Per game and overall: detection rates of the side cameras, shots seen at the rim, blind shots."""
    keys = list(SHOT)
    t = tracks.withColumn("side", side)
    near_rows = B.present("ball") & B.present("rim") & B.near_rim()
    g = t.groupBy(*keys, "side", "angle").agg(
        F.avg(flag(F.col("ball_x").isNotNull())).alias("ball"),
        F.avg(flag(F.col("rim_x").isNotNull())).alias("rim"), count_if(near_rows).alias("n_at"))

    def cam(which, col):
        return F.coalesce(F.max(F.when(F.col("angle") == which(F.col("side")), F.col(col))),
                          F.lit(0.0))
    shot = g.groupBy(*keys, "side").agg(
        *[cam(w, c).alias(f"{p}_{c}") for p, w in (("near", L.near_camera), ("far", L.far_camera))
          for c in ("ball", "rim", "n_at")])
    shot = (shot.withColumn("near_at", F.col("near_n_at") >= 2)
            .withColumn("far_at", F.col("far_n_at") >= 2))
    r = shot.rollup("game_id").agg(
        F.count(F.lit(1)).alias("shots"), F.avg("near_ball").alias("near_ball"),
        F.avg("near_rim").alias("near_rim"), F.avg("far_ball").alias("far_ball"),
        F.avg("far_rim").alias("far_rim"), F.avg(flag(F.col("near_at"))).alias("near_at_rim"),
        F.avg(flag(F.col("far_at"))).alias("far_at_rim"), count_if(~F.col("near_at")).alias("blind"),
        count_if(~F.col("near_at") & F.col("far_at")).alias("blind_far_sees"),
        count_if(~F.col("near_at") & ~F.col("far_at")).alias("blind_both"),
        F.grouping("game_id").alias("_all"))
    return r.withColumn("game", F.when(F.col("_all") == 1, "OVERALL").otherwise(
        F.col("game_id").cast("string"))).drop("_all", "game_id")


def passage(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Through-hoop sequence per shot over a fixed reference.

    ``rows``: one ball per frame with t, dx_w (widths), dy_h (heights), inside, ratio.
    """
    over = F.abs(F.col("dx_w")) < 0.6
    up, down = over & (F.col("dy_h") < -0.4), over & (F.col("dy_h") > 0.4)
    g = rows.groupBy(*keys).agg(
        count_if(F.col("inside")).alias("n_inside"),
        F.min(F.when(up, F.col("t"))).alias("_a"), F.max(F.when(down, F.col("t"))).alias("_b"),
        F.min_by("ratio", F.when(over, F.struct(F.abs("dy_h"), "t"))).alias("ratio"),
        (F.max("dy_h") - F.min("dy_h")).alias("vspan"))
    return g.select(*keys, "n_inside", flag(F.col("_a") < F.col("_b")).cast("int").alias("passed"),
                    F.col("_b").isNotNull().cast("int").alias("went_below"), "ratio", "vspan")


def crossing_map(rows: DataFrame, keys: Sequence[str] = TRACK, clip: float = 1.15) -> DataFrame:
    """Normalised offsets of the ball row nearest the rim centre, clipped; (0, 0) when none."""
    r = both(rows)
    best = F.min_by(F.struct((F.col("dx") / (F.col("rim_w") / 2)).alias("x"),
                             (F.col("dy") / (F.col("rim_h") / 2)).alias("y")),
                    F.struct((F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")), "frame_idx"))
    g = r.groupBy(*keys).agg(best.alias("b"))

    def cl(c):
        return F.greatest(F.lit(-clip), F.least(F.lit(clip), F.coalesce(F.col(c), F.lit(0.0))))
    return (rows.select(*keys).distinct().join(g, list(keys), "left")
            .select(*keys, cl("b.x").alias("cross_x"), cl("b.y").alias("cross_y")))


def descent_angle(rows: DataFrame, keys: Sequence[str] = TRACK, lo: float = 33.0, hi: float = 58.0,
                  default: float = 46.0) -> DataFrame:
    """Angle of a fitted parabola y(x) at the rim centre column, clipped; default below 5 points."""
    from orbweave.operators.tracks import _quad, moments
    r = both(rows)
    u, v = F.col("dx") / 100.0, F.col("dy") / 100.0
    g = r.groupBy(*keys).agg(*moments(u, v, "q_"))
    _, b, _, det = _quad("q_")
    ang = F.degrees(F.atan(b))
    ok = (F.col("q_n") >= 5) & (F.abs(det) > 1e-9)
    val = F.least(F.lit(hi), F.greatest(F.lit(lo), F.abs(ang)))
    return (rows.select(*keys).distinct().join(g, list(keys), "left")
            .select(*keys, F.when(ok, val).otherwise(F.lit(default)).alias("descent_angle")))


def crossing_bias(cross: DataFrame, cat: str = "cat") -> DataFrame:
    """Crossing-offset bias by outcome: count, mean, median and population std of dx and dy."""
    g = cross.groupBy(cat).agg(
        F.count(F.lit(1)).alias("n"), F.avg("dx").alias("dx_mean"), F.avg("dy").alias("dy_mean"),
        F.stddev_pop("dx").alias("dx_sd"), F.stddev_pop("dy").alias("dy_sd"))
    m = medians(cross, [cat], ["dx", "dy"]).withColumnsRenamed({"dx": "dx_med", "dy": "dy_med"})
    return g.join(m, [cat])


def occupancy(tracks: DataFrame, keys: Sequence[str] = TRACK) -> DataFrame:
    """Time in zone, oscillation count, speed ratio, size ratio at plane, low-detection share."""
    r = both(tracks).select(*keys, "frame_idx", "timestamp", "dx", "dy", "rim_w", "rim_h", "ratio",
                            "is_near", "is_cross")
    n = ordered.neighbours(r, keys, ["frame_idx"], ["dx", "dy", "timestamp", "is_near"],
                           ordered.frame_bucket())
    dt = F.col("timestamp") - F.col("prev.timestamp")
    speed = B.distance(F.col("dx") - F.col("prev.dx"), F.col("dy") - F.col("prev.dy")) \
        / F.col("rim_w") / dt
    turn = ((F.col("dy") - F.col("prev.dy")) * (F.col("next.dy") - F.col("dy")) < 0)
    g = n.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("is_near") & F.col("prev.is_near"), dt)), F.lit(0.0))
        .alias("time_in_zone"),
        count_if(F.col("is_near") & turn).alias("oscillations"),
        F.avg(F.when(F.col("dy") < 0, speed)).alias("_in"),
        F.avg(F.when(F.col("dy") >= 0, speed)).alias("_out"),
        _first_by(F.col("ratio"), F.abs("dy"), F.col("is_cross")).alias("size_ratio_at_plane"),
        any_of(F.col("is_cross")).alias("says_make"))
    occ = tracks.groupBy(*keys).agg(F.avg(flag(F.col("ball_conf").isNull()
                                               | (F.col("ball_conf") < 0.2))).alias("occlusion"),
                                    F.count("ball_x").alias("n_tracked"))
    return occ.join(g, list(keys), "left").select(
        *keys, "occlusion", "n_tracked", F.coalesce("time_in_zone", F.lit(0.0)).alias("time_in_zone"),
        F.coalesce("oscillations", F.lit(0)).alias("oscillations"),
        F.when(F.col("_in") > 0, F.col("_out") / F.col("_in")).alias("speed_ratio"),
        "size_ratio_at_plane", F.coalesce("says_make", F.lit(0.0)).alias("says_make"))


def camera_agreement(occ: DataFrame, keys: Sequence[str] = SHOT) -> DataFrame:
    """Near/far agreement of the per-camera verdicts and the camera with least occlusion."""
    near, far = F.col("angle").isin(*K.NEAR_ANGLES), F.col("angle").isin(*K.FAR_ANGLES)
    g = occ.groupBy(*keys).agg(
        F.max(F.when(near, F.col("says_make"))).alias("_n"),
        F.max(F.when(far, F.col("says_make"))).alias("_f"),
        F.min_by("angle", F.struct("occlusion", -F.col("n_tracked"), "angle"))
        .alias("best_angle_hint"))
    return g.select(*keys, F.col("_n").isNotNull().alias("near_present"),
                    F.col("_f").isNotNull().alias("far_present"),
                    (F.col("_n") == F.col("_f")).alias("near_far_agree"), "best_angle_hint")
