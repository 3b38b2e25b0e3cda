"""Registered queries: cleaned tracks, 3-D fits, walks, verdicts, attempts, triangulation."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbweave.functions import boxes as B, fixed as K
from orbweave.functions.lineage import cut
from orbweave.operators import clean as C, decide as D, evaluate as E, fuse as U, selection as Z, \
    sequence as S, temporal as M, tracks as T, trajectory as H
from orbweave.plans.inputs import SAMPLES_CTE, TRACKS_CTE, samples, tracks
from orbweave.plans.registry import query

K2 = "game_id, shot"
R = "sqrt(pow({x} - 2008.7, 2) + pow({y} - 713.2, 2))"


@query("court_bounds", f"""WITH {SAMPLES_CTE} SELECT {K2}, frame, x, y, z FROM samples
WHERE x > 800 AND x < 2600 AND y > 0 AND y < 1430 AND z > -50 AND z < 1100""", {6: "x y z"})
def _(s, d):
    return H.in_court(samples(s, d)).select("game_id", "shot", "frame", "x", "y", "z")


FIT_CTE = SAMPLES_CTE + f""",
zc AS (SELECT *, z + 0.5*980.665*t*t AS zz FROM samples),
f0 AS (SELECT {K2}, count(*) AS n, regr_slope(x,t) AS vx, regr_intercept(x,t) AS x0, regr_slope(y,t) AS vy,
 regr_intercept(y,t) AS y0, regr_slope(zz,t) AS vz, regr_intercept(zz,t) AS z0, min(t) AS t_min,
 max(t) AS t_max FROM zc GROUP BY {K2} HAVING count(*) > 1),
fr AS (SELECT s.game_id, s.shot, sqrt(avg(pow(x0+vx*t-x,2)+pow(y0+vy*t-y,2)+pow(z0+vz*t-zz,2))) AS rms_cm
 FROM zc s JOIN f0 USING ({K2}) GROUP BY s.game_id, s.shot)
"""


@query("parabola_lsq", f"WITH {FIT_CTE} SELECT {K2}, n, x0, y0, z0, vx, vy, vz, rms_cm FROM f0 JOIN fr "
       f"USING ({K2})", {4: "x0 y0 z0 vx vy vz rms_cm"})
def _(s, d):
    return H.parabola(samples(s, d))


@query("rim_crossings", f"""WITH {FIT_CTE},
q AS (SELECT *, vz*vz + 2*980.665*(z0-304.8) AS disc FROM f0),
r AS (SELECT *, unnest([(-vz + sqrt(disc)) / -980.665, (-vz - sqrt(disc)) / -980.665]) AS t_cross FROM q
 WHERE disc > 0),
c AS (SELECT {K2}, t_cross, x0+vx*t_cross AS x_cross, y0+vy*t_cross AS y_cross FROM r
 WHERE t_cross BETWEEN t_min AND t_max + 1)
SELECT *, {R.format(x='x_cross', y='y_cross')} AS r_cross,
 {R.format(x='x_cross', y='y_cross')} <= 34.86 AS inside_rim FROM c""",
       {4: "t_cross x_cross y_cross r_cross"})
def _(s, d):
    x = samples(s, d)
    span = x.groupBy(*H.SHOT).agg(F.min("t").alias("t_min"), F.max("t").alias("t_max"))
    return H.rim_crossings(H.parabola(x), span)


@query("arc_window", f"""WITH {SAMPLES_CTE},
g AS (SELECT {K2}, count(*) AS n, arg_max(t, (z, -frame)) FILTER (WHERE z>=240 AND x BETWEEN 1500 AND 2200)
 AS ft, arg_max(t, (z, -frame)) AS gt, max(z) AS gz FROM samples GROUP BY {K2}),
a AS (SELECT {K2}, CASE WHEN n >= 6 THEN coalesce(ft, CASE WHEN gz >= 240 THEN gt END) END AS ta FROM g)
SELECT {K2}, frame FROM samples JOIN a USING ({K2})
WHERE ta IS NULL OR t BETWEEN ta - 0.8 AND ta + 0.15""")
def _(s, d):
    return H.arc_window(samples(s, d)).select("game_id", "shot", "frame")


@query("plane_crossing_3d", f"""WITH {SAMPLES_CTE},
n AS (SELECT *, lead(z) OVER w AS nz, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(t) OVER w AS nt
 FROM samples WINDOW w AS (PARTITION BY {K2} ORDER BY frame)),
c AS (SELECT {K2}, frame, x+(z-304.8)/greatest(z-nz,1e-3)*(nx-x) AS cross_x,
 y+(z-304.8)/greatest(z-nz,1e-3)*(ny-y) AS cross_y, nt-t AS cross_dt FROM n WHERE z>=304.8 AND nz<304.8
 QUALIFY row_number() OVER (PARTITION BY {K2} ORDER BY frame) = 1)
SELECT *, {R.format(x='cross_x', y='cross_y')} AS cross_r FROM c""",
       {6: "cross_x cross_y cross_dt cross_r"})
def _(s, d):
    return H.first_plane_crossing(samples(s, d))


@query("contact_bounce", f"""WITH {SAMPLES_CTE},
n AS (SELECT *, max(z) OVER (PARTITION BY {K2} ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) - z
 AS rise FROM samples)
SELECT {K2}, frame AS contact_frame, rise AS bounce_cm, z AS z_at_contact, {R.format(x='x', y='y')}
 AS r_at_contact FROM n WHERE z BETWEEN 290 AND 360 AND rise >= 5
QUALIFY row_number() OVER (PARTITION BY {K2} ORDER BY frame) = 1""",
       {6: "bounce_cm z_at_contact r_at_contact"})
def _(s, d):
    return H.contact_bounce(samples(s, d))


@query("apex_candidates", f"""WITH {SAMPLES_CTE},
m AS (SELECT *, CASE WHEN lag(z) OVER w IS NULL THEN avg(z) OVER f WHEN lead(z) OVER w IS NULL
  THEN avg(z) OVER b ELSE avg(z) OVER c END AS zs FROM samples
 WINDOW w AS (PARTITION BY {K2} ORDER BY frame),
 f AS (PARTITION BY {K2} ORDER BY frame ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING),
 b AS (PARTITION BY {K2} ORDER BY frame ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
 c AS (PARTITION BY {K2} ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
n AS (SELECT *, lag(zs) OVER w AS p, lead(zs) OVER w AS q,
 min(zs) OVER (PARTITION BY {K2} ORDER BY frame ROWS BETWEEN 25 PRECEDING AND 1 PRECEDING) AS lo,
 min(zs) OVER (PARTITION BY {K2} ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING) AS hi FROM m
 WINDOW w AS (PARTITION BY {K2} ORDER BY frame))
SELECT {K2}, frame, t, x, y, z, zs FROM n WHERE zs>=300 AND x BETWEEN 1500 AND 2200 AND zs>=p AND zs>=q
 AND zs-lo>=50 AND zs-hi>=50""", {6: "t x y z zs"})
def _(s, d):
    return H.apex_candidates(samples(s, d))


@query("descent_stats", f"""WITH {SAMPLES_CTE},
ct AS (SELECT * FROM samples WHERE x>800 AND x<2600 AND y>0 AND y<1430 AND z>-50 AND z<1100),
a AS (SELECT {K2}, arg_max(frame,(z,-frame)) AS af, arg_max(t,(z,-frame)) AS at_, max(z) AS apex_z,
 arg_max({R.format(x='x', y='y')},(z,-frame)) AS apex_r FROM ct GROUP BY {K2}),
n AS (SELECT *, lead(t) OVER w AS nt, lead(z) OVER w AS nz FROM ct
 WINDOW w AS (PARTITION BY {K2} ORDER BY frame))
SELECT {K2}, max(apex_z) AS apex_z, max(apex_r) AS apex_r, count(*) FILTER (WHERE t BETWEEN at_ AND at_+1.2)
 AS desc_n, coalesce(max(nt-t) FILTER (WHERE t>=at_ AND nt<=at_+1.2), -1) AS desc_max_gap,
 coalesce(arg_min(nt-t, frame) FILTER (WHERE frame>=af AND z>=304.8 AND nz<304.8), -1) AS cross_dt
FROM n JOIN a USING ({K2}) GROUP BY {K2}""", {6: "apex_z apex_r desc_max_gap cross_dt"})
def _(s, d):
    return H.descent_stats(samples(s, d))


@query("reappearance_counts", f"""WITH {SAMPLES_CTE},
ct AS (SELECT * FROM samples WHERE x>800 AND x<2600 AND y>0 AND y<1430 AND z>-50 AND z<1100),
st AS (SELECT {K2}, arg_max(t,(z,-frame)) AS stop_t FROM samples GROUP BY {K2})
SELECT {K2}, count(*) FILTER (WHERE t-stop_t>1e-9 AND t-stop_t<=1.2 AND z>250 AND z<420
  AND {R.format(x='x', y='y')}>60) AS reappear_rim_h,
 count(*) FILTER (WHERE t-stop_t>1e-9 AND t-stop_t<=1.2 AND z>304.8) AS reappear_any,
 count(*) FILTER (WHERE t-stop_t>0 AND t-stop_t<=0.3) AS gap_raw_n FROM ct JOIN st USING ({K2})
GROUP BY {K2}""")
def _(s, d):
    x = samples(s, d)
    stop = x.groupBy(*H.SHOT).agg(F.max_by("t", F.struct("z", -F.col("frame"))).alias("stop_t"))
    return H.reappearance(x, stop)


@query("single_camera_verdict", f"""WITH {SAMPLES_CTE},
dp AS (SELECT *, nr_x BETWEEN 714 AND 1138 AND nr_y BETWEEN 953 AND 1110 AS deep FROM samples),
t0 AS (SELECT {K2}, min(t) FILTER (WHERE deep) AS t0 FROM dp GROUP BY {K2}),
mx AS (SELECT {K2}, max(nr_y) FILTER (WHERE deep AND t-t0<=1) AS my, arg_max(t,(nr_y,-t))
 FILTER (WHERE deep AND t-t0<=1) AS mt, count(*) FILTER (WHERE deep AND t-t0<=1) AS n_deep
 FROM dp JOIN t0 USING ({K2}) GROUP BY {K2}),
bk AS (SELECT {K2}, max(my) AS my, max(n_deep) AS n_deep, min(nr_y) FILTER (WHERE t>mt AND t-mt<=0.4
 AND nr_x BETWEEN 514 AND 1338 AND nr_y>=776) AS b FROM dp JOIN mx USING ({K2}) GROUP BY {K2}),
dl AS (SELECT *, my - least(my, coalesce(b, my)) AS dl FROM bk)
SELECT {K2}, CASE WHEN n_deep=0 THEN 'UND' WHEN dl>=150 THEN 'MISS' WHEN n_deep>=5 AND dl<40 THEN 'MAKE'
 WHEN dl>=60 THEN 'MISS-weak' ELSE 'MAKE-weak' END AS camera_verdict, my AS max_cy, dl AS rebound_px, n_deep
FROM dl""", {6: "max_cy rebound_px"})
def _(s, d):
    x = samples(s, d).withColumnsRenamed({"nr_x": "px", "nr_y": "py"})
    return H.single_camera(x, H.SHOT, K.NEAR_HOOP_BOX)


@query("approach_extrapolation", f"""WITH {SAMPLES_CTE},
ap AS (SELECT {K2}, frame, t, nr_x AS cx, nr_y + 0.4 * frame * frame AS cy, z / 10 AS bw, 1000.0 + shot % 50 AS ry FROM samples
 WHERE abs(nr_x - 900) <= 400 AND nr_y + 0.4 * frame * frame <= 1000.0 + shot % 50 + 300),
ao AS (SELECT *, t - first_value(t) OVER (PARTITION BY {K2} ORDER BY frame) AS u FROM ap),
am AS (SELECT {K2}, count(*) AS n, sum(u) AS s1, sum(u*u) AS s2, sum(u*u*u) AS s3, sum(u*u*u*u) AS s4, sum(cy-ry) AS y0,
 sum(u*(cy-ry)) AS y1, sum(u*u*(cy-ry)) AS y2, CASE WHEN count(*) > 1 THEN regr_slope(cx, u) END AS m,
 CASE WHEN count(*) > 1 THEN regr_intercept(cx, u) END AS q FROM ao GROUP BY {K2}),
af AS (SELECT *, n*(s2*s4-s3*s3) - s1*(s1*s4-s2*s3) + s2*(s1*s3-s2*s2) AS w FROM am),
ag AS (SELECT *, (y0*(s2*s4-s3*s3) - s1*(y1*s4-s3*y2) + s2*(y1*s3-s2*y2)) / nullif(w, 0) AS c,
 (n*(y1*s4-s3*y2) - y0*(s1*s4-s2*s3) + s2*(s1*y2-s2*y1)) / nullif(w, 0) AS b,
 (n*(s2*y2-s3*y1) - s1*(s1*y2-s2*y1) + y0*(s1*s3-s2*s2)) / nullif(w, 0) AS a FROM af),
ah AS (SELECT {K2}, n, m, q, CASE WHEN n >= 5 AND a > 0 AND b*b - 4*a*c > 0 THEN (sqrt(b*b - 4*a*c) - b) / (2*a) END AS t_cross FROM ag),
ab AS (SELECT {K2}, arg_min(bw, (abs(u - t_cross), frame)) AS bw FROM ao JOIN ah USING ({K2}) GROUP BY {K2})
SELECT {K2}, n, CAST(t_cross IS NOT NULL AS INTEGER) AS crossing, t_cross, abs(q + m * t_cross - 900) / (100 + 1e-6) AS lateral,
 CASE WHEN t_cross IS NOT NULL THEN bw / (200 + 1e-6) END AS depth FROM ah JOIN ab USING ({K2})""", {4: "t_cross lateral depth"})
def _(s, d):
    x, f = samples(s, d), F.col("frame")
    rows = x.select(*H.SHOT, "frame", "t", F.col("nr_x").alias("cx"), (F.col("nr_y") + 0.4 * f * f).alias("cy"), (F.col("z") / 10).alias("bw"),
                    F.lit(900.0).alias("rim_cx"), (F.col("shot") % 50 + 1000.0).alias("rim_cy"), F.lit(200.0).alias("rim_w"), F.lit(150.0).alias("rim_h"))
    return H.approach_extrapolation(rows)


WALK_CTE = f"""WITH RECURSIVE {SAMPLES_CTE},
cn AS (SELECT *, row_number() OVER (PARTITION BY {K2} ORDER BY frame) AS pos FROM samples
 WHERE x > 800 AND x < 2600 AND y > 0 AND y < 1430 AND z > -50 AND z < 1100),
ca AS (SELECT {K2}, arg_max(pos, (z, -pos)) AS top FROM cn GROUP BY {K2}),
cr AS MATERIALIZED (SELECT {K2}, pos, pos - top AS k, t, x, y, z, {R.format(x='x', y='y')} AS r FROM cn JOIN ca USING ({K2})
 WHERE pos >= top AND pos - top <= 271),
wk AS (SELECT {K2}, k, pos, t, x, y, z, [r] AS rr, 0 AS noise, 1 AS n, CAST(NULL AS VARCHAR) AS fin, true AS acc FROM cr WHERE k = 0
 UNION ALL
 SELECT game_id, shot, k, CASE WHEN acc THEN pos ELSE ppos END, CASE WHEN acc THEN t ELSE pt END,
  CASE WHEN acc THEN x ELSE px END, CASE WHEN acc THEN y ELSE py END, CASE WHEN acc THEN z ELSE pz END,
  CASE WHEN acc THEN list_concat(rr, [r])[-4:] ELSE rr END, CASE WHEN acc THEN 0 WHEN lost THEN noise ELSE noise + 1 END,
  CASE WHEN acc THEN n + 1 ELSE n END,
  CASE WHEN lost THEN 'gap' WHEN noisy AND noise + 1 > 8 THEN 'noise'
   WHEN acc AND ((z < 284.8 AND r < 60) OR n + 1 >= 30) THEN 'done' END, acc
 FROM (SELECT *, NOT lost AND NOT noisy AS acc FROM (SELECT *,
   dt > 0.15 AND pz < 360 AND rr[-1] < 45 AND (len(rr) < 4 OR list_sort([rr[2]-rr[1], rr[3]-rr[2], rr[4]-rr[3]])[2] <= 1.5) AS lost,
   hop > 250 OR hop / dt > 2500 AS noisy
  FROM (SELECT c.*, w.pos AS ppos, w.t AS pt, w.x AS px, w.y AS py, w.z AS pz, w.rr, w.noise, w.n,
    greatest(c.t - w.t, 1.0 / 29.97) AS dt, sqrt(pow(c.x - w.x, 2) + pow(c.y - w.y, 2)) AS hop
   FROM wk w JOIN cr c ON c.game_id = w.game_id AND c.shot = w.shot AND c.k = w.k + 1 WHERE w.fin IS NULL))))
"""


@query("descent_walk", WALK_CTE + f"""SELECT {K2}, pos, CAST(sum(CASE WHEN acc THEN 1 ELSE 0 END) OVER (PARTITION BY {K2} ORDER BY k)
 AS BIGINT) AS seq, bool_or(coalesce(fin = 'gap', false)) OVER (PARTITION BY {K2}) AS gap_stop FROM wk QUALIFY acc""")
def _(s, d):
    """Rows that the walk after the apex accepts, as a native fold."""
    return H.descent_walk(H.rows_after_apex(samples(s, d)), H.SHOT, H.DescentRules()).select(*H.SHOT, "pos", "seq", "gap_stop")


@query("descent_verdict")
def _(s, d):
    """Typed trajectory verdict of every throw."""
    return H.rescore(samples(s, d))


@query("descent_verdict_tally")
def _(s, d):
    """Verdicts of three parameter sets, counted per rule."""
    sets = {"production": H.DescentRules(), "no_guard": H.DescentRules(y_guard=False),
            "strict_walk": H.DescentRules(skip_noisy=False)}
    return H.rescore_all(samples(s, d), sets).groupBy("rule", "verdict_class", "params").agg(
        F.count(F.lit(1)).alias("n")).select("rule", "verdict_class", "n", "params")


@query("ransac_parabola")
def _(s, d):
    """Robust parabola of every throw's arc."""
    return H.ransac_parabola(H.arc_window(samples(s, d)))


@query("attempts")
def _(s, d):
    """Attempts per window with the verdict of the first and the last."""
    return H.attempt_summary(H.attempt_verdicts(samples(s, d)))


@query("clean_track")
def _(s, d):
    """Cleaned centre of every frame with provenance."""
    return C.clean_tracks(tracks(s, d))


@query("clean_track_features")
def _(s, d):
    """Cleaned-track features per camera."""
    return C.clean_features(tracks(s, d))


@query("smooth_velocity")
def _(s, d):
    """Gated constant-velocity smoother per camera track."""
    t = tracks(s, d)
    return C.smooth_velocity(t.select(*T.TRACK, "frame_idx", F.col("timestamp").alias("t"),
                                      B.center_x("ball").alias("px"), B.center_y("ball").alias("py")))


@query("continuity_picks")
def _(s, d):
    """One ball per frame and play by continuity over the four cameras' candidates."""
    t = tracks(s, d).filter("ball_x IS NOT NULL")
    c = t.select("game_id", "play_id", "frame_idx", F.ascii("angle").alias("_a"), B.center_x("ball")
                 .alias("cx"), B.center_y("ball").alias("cy"), F.col("ball_conf").alias("conf"),
                 (F.col("angle") == "NR").alias("preferred"), F.xxhash64("angle").alias("box_id"))
    return Z.continuity_picks(c.drop("_a"), T.SHOT)


def cameras(df):
    """Two fixed projection matrices whose view covers the sample volume."""
    pa = [1000.0, 0.0, 200.0, 5e5, 0.0, 1000.0, 300.0, 2e5, 0.0, 0.0, 1.0, 2000.0]
    pb = [900.0, 300.0, 100.0, 4e5, -200.0, 950.0, 250.0, 6e5, 0.1, 0.2, 0.9, 2500.0]
    return df.withColumn("P_fr", F.array(*[F.lit(v) for v in pa])) \
        .withColumn("P_nr", F.array(*[F.lit(v) for v in pb]))


def project(p, x="x", y="y", z="z"):
    """Pixel of a world point under a 12-entry projection matrix column."""
    def row(i):
        return sum((F.col(p)[4 * i + j] * c for j, c in enumerate((F.col(x), F.col(y), F.col(z)))),
                   F.col(p)[4 * i + 3])
    return row(0) / row(2), row(1) / row(2)


def landmarks(s, d):
    c = cameras(samples(s, d).select("game_id", "shot", "frame", "t", F.col("x").alias("wx"),
                                     F.col("y").alias("wy"), F.col("z").alias("wz")))
    fx, fy = project("P_fr", "wx", "wy", "wz")
    nx, ny = project("P_nr", "wx", "wy", "wz")
    return c.withColumn("fr_x", fx).withColumn("fr_y", fy).withColumn("nr_x", nx).withColumn("nr_y", ny)


@query("triangulate", f"WITH {SAMPLES_CTE} SELECT {K2}, frame, x, y, z FROM samples", {3: "x y z"})
def _(s, d):
    return H.triangulate_pairs(landmarks(s, d)).select("game_id", "shot", "frame", "x", "y", "z")


@query("calibration_check", f"""WITH {SAMPLES_CTE} SELECT game_id, 0.0::DOUBLE AS mean_error_cm,
 0.0::DOUBLE AS max_error_cm, count(*) AS n FROM samples GROUP BY game_id""",
       {3: "mean_error_cm max_error_cm"})
def _(s, d):
    return H.calibration_check(landmarks(s, d), "game_id")


@query("offset_sweep")
def _(s, d):
    """Best camera offset per throw over the candidate offsets 0 to 25, truncated median per game."""
    lm = landmarks(s, d)
    a = lm.select("game_id", "shot", "frame", F.col("fr_x").alias("px"), F.col("fr_y").alias("py"))
    b = lm.select("game_id", "shot", (F.col("frame") + 2).alias("frame"), F.col("nr_x").alias("px"),
                  F.col("nr_y").alias("py"))
    cal = cameras(lm.select("game_id").distinct())
    best = H.offset_sweep(a, b, cal, ["game_id", "shot"], range(0, 26))
    from orbweave.functions.quantiles import medians
    n = best.groupBy("game_id").agg(F.count(F.lit(1)).alias("n_shots"))
    m = medians(best, ["game_id"], ["offset"])
    return m.join(n, "game_id").withColumn("offset", F.col("offset").cast("int"))


@query("crossing_bias", f"""WITH {SAMPLES_CTE},
n AS (SELECT *, lead(z) OVER w AS nz, lead(x) OVER w AS nx, lead(y) OVER w AS ny
 FROM samples WINDOW w AS (PARTITION BY {K2} ORDER BY frame)),
c AS (SELECT {K2}, frame, x+(z-304.8)/greatest(z-nz,1e-3)*(nx-x)-2008.7 AS dx,
 y+(z-304.8)/greatest(z-nz,1e-3)*(ny-y)-713.2 AS dy FROM n WHERE z>=304.8 AND nz<304.8
 QUALIFY row_number() OVER (PARTITION BY {K2} ORDER BY frame) = 1)
SELECT CASE WHEN shot % 2 = 0 THEN 'TP' ELSE 'FN' END AS cat, count(*) AS n, avg(dx) AS dx_mean,
 avg(dy) AS dy_mean, stddev_pop(dx) AS dx_sd, stddev_pop(dy) AS dy_sd, median(dx) AS dx_med,
 median(dy) AS dy_med FROM c GROUP BY 1""", {4: "dx_mean dy_mean dx_sd dy_sd dx_med dy_med"})
def _(s, d):
    from orbweave.operators.rim import crossing_bias
    c = H.first_plane_crossing(samples(s, d)).select(
        F.when(F.col("shot") % 2 == 0, "TP").otherwise("FN").alias("cat"),
        (F.col("cross_x") - K.RIM_X).alias("dx"), (F.col("cross_y") - K.RIM_Y).alias("dy"))
    return crossing_bias(c)


@query("arbiter_table")
def _(s, d):
    """Trajectory verdict of two sample sources, confidence cues and agreement per throw."""
    x = cut(samples(s, d))
    from orbweave.plans.shots import arbiter
    return arbiter(x.filter("nr_y > 760"), x)   # the first pass misses the ball high in the near view


@query("shot_feature_rows_clean")
def _(s, d):
    """Fused rows with the raw and the cleaned-track feature families."""
    t = tracks(s, d)
    raw, cl = T.angle_features(t), C.clean_features(t)
    both = T.fill_sentinels(raw.join(cl, list(T.TRACK), "left"), T.TRACK)
    return U.fuse(both, clean=True)


@query("cleaning_summary")
def _(s, d):
    return C.cleaning_summary(C.clean_features(tracks(s, d)))


@query("cleaning_auc")
def _(s, d):
    """Best arc column alone, from raw and from cleaned tracks, and whether cleaning separates better."""
    t = tracks(s, d)
    raw = T.angle_features(t)
    r = raw.join(C.clean_features(t), list(T.TRACK), "left").join(
        t.groupBy(*T.TRACK).agg(F.first("classification").alias("_c")), list(T.TRACK)).withColumn(
        "label", F.col("_c").endswith("_MAKE").cast("int"))
    return C.cleaning_auc(r)


@query("data_health")
def _(s, d):
    """Track quality per game and camera against the corpus."""
    return E.data_health(cut(S.track_quality(C.marked_tracks(tracks(s, d)))))   # the smoothed positions have no part in it
