"""Registered queries: rim-relative, sync, quality and motion features, and their fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbweave.functions import boxes as B, fixed as K, labels as L
from orbweave.operators import fuse as U, netmotion as N, rim as R, tracks as T
from orbweave.plans.catalog_tracks import DET_CTE
from orbweave.plans.inputs import TRACKS_CTE, tracks
from orbweave.plans.registry import query

K3 = "game_id, play_id, angle"
K2 = "game_id, play_id"
BOTH_CTE = TRACKS_CTE + """,
bt0 AS (SELECT *, ball_x+ball_w/2-rim_x-rim_w/2 AS dx, ball_y+ball_h/2-rim_y-rim_h/2 AS dy,
  ball_w/(rim_w+1e-6) AS ratio FROM tracks WHERE ball_x IS NOT NULL AND rim_x IS NOT NULL),
bt AS (SELECT *, abs(dx) < 1.5*rim_w AND abs(dy) < 2.0*rim_h AS nr, abs(dx) < 0.6*rim_w AS ov,
  abs(dx) < 0.6*rim_w AND abs(dy) < 0.6*rim_h AS cr FROM bt0),
keys3 AS (SELECT DISTINCT game_id, play_id, angle FROM tracks)
"""
GEO_CTE = TRACKS_CTE + f""",
ag AS (SELECT {K3}, avg(CASE WHEN ball_x IS NULL THEN 0.0 ELSE 1.0 END) AS bdet,
  coalesce(min(sqrt(pow(ball_x+ball_w/2-rim_x-rim_w/2,2)+pow(ball_y+ball_h/2-rim_y-rim_h/2,2))
    / rim_w), 10) AS dmin,
  coalesce(avg(CASE WHEN ball_x IS NULL OR rim_x IS NULL THEN NULL
    WHEN ball_x+ball_w/2 BETWEEN rim_x AND rim_x+rim_w AND ball_y+ball_h/2 BETWEEN rim_y AND rim_y+rim_h
    THEN 1.0 ELSE 0.0 END), 0) AS fin FROM tracks GROUP BY {K3}),
ge AS (SELECT {K2},
  coalesce(min(dmin) FILTER (WHERE angle IN ('FL','FR') AND bdet > 0.5),
    min(dmin) FILTER (WHERE angle IN ('FL','FR')), 10) AS g_far_dmin,
  coalesce(min(dmin) FILTER (WHERE angle IN ('NL','NR') AND bdet > 0.5),
    min(dmin) FILTER (WHERE angle IN ('NL','NR')), 10) AS g_near_dmin,
  coalesce(max(fin) FILTER (WHERE angle IN ('FL','FR')), 0) AS g_far_inside,
  coalesce(max(fin) FILTER (WHERE angle IN ('NL','NR')), 0) AS g_near_inside,
  coalesce(max(bdet) FILTER (WHERE angle IN ('FL','FR')), 0) AS g_far_bdet FROM ag GROUP BY {K2}),
geo AS (SELECT *, CASE WHEN g_far_dmin > 2 AND g_far_bdet > 0.6 THEN 1 ELSE 0 END AS g_far_says_miss,
  g_near_inside - g_far_inside AS g_nf_inside_gap, least(g_far_dmin, g_near_dmin) AS g_all_dmin FROM ge)
"""


def side():
    return F.when(F.col("play_id") % 2 == 0, "LEFT").otherwise("RIGHT")


@query("geometry_block", f"WITH {GEO_CTE} SELECT * FROM geo",
       {6: "g_far_dmin g_near_dmin g_far_inside g_near_inside g_far_bdet g_nf_inside_gap g_all_dmin"})
def _(s, d):
    return R.geometry_block(tracks(s, d))


@query("far_verdict", f"""WITH {TRACKS_CTE},
f AS (SELECT {K2}, avg(CASE WHEN ball_x IS NULL THEN 0.0 ELSE 1.0 END) AS bdet,
  coalesce(min(CASE WHEN rim_w > 1 THEN sqrt(pow(ball_x+ball_w/2-rim_x-rim_w/2,2)
   +pow(ball_y+ball_h/2-rim_y-rim_h/2,2)) / rim_w END), 10) AS dmin
  FROM tracks WHERE angle IN ('FL','FR') GROUP BY {K2})
SELECT {K2}, dmin, bdet, CASE WHEN dmin > 2 AND bdet > 0.6 THEN 1 ELSE 0 END AS says_miss FROM f""",
       {6: "dmin bdet"})
def _(s, d):
    t = tracks(s, d).filter(F.col("angle").isin(*K.FAR_ANGLES))
    frames = t.select(*T.SHOT, "frame_idx", B.present("ball").alias("has_ball"))
    return R.far_verdict(t.filter(B.present("ball") & B.present("rim")), frames, T.SHOT)


@query("crossing_sizes", f"""WITH {BOTH_CTE},
g AS (SELECT {K3}, count(*) FILTER (WHERE cr) AS n, median(ratio) FILTER (WHERE cr) AS med,
  max(ratio) FILTER (WHERE cr) AS mx, arg_min(ratio, (abs(dy), frame_idx)) FILTER (WHERE cr) AS cl,
  avg(CASE WHEN ov THEN 1.0 ELSE 0.0 END) FILTER (WHERE nr) AS fr,
  arg_min(ball_w / (rim_w * (9.5/18.0) + 1e-6), (abs(dy), frame_idx)) FILTER (WHERE nr) AS dr,
  count(*) FILTER (WHERE ov) AS no, min(dy) FILTER (WHERE ov) AS lo, max(dy) FILTER (WHERE ov) AS hi,
  avg(rim_h) FILTER (WHERE ov) AS rh FROM bt GROUP BY {K3})
SELECT {K3}, coalesce(n, 0) AS nd_atcross_n, med AS nd_atcross_ratio_med,
  mx AS nd_atcross_ratio_max, cl AS nd_atcross_ratio_closest, fr AS nd_inside_frac,
  CASE WHEN no >= 2 AND lo < -0.2*rh AND hi > 0.2*rh THEN 1 ELSE 0 END AS nd_vcross,
  CASE WHEN no >= 2 AND hi > 0.5*rh THEN 1 ELSE 0 END AS nd_below_after_inside, dr AS nd_dr_closest
FROM keys3 LEFT JOIN g USING ({K3})""",
       {6: "nd_atcross_ratio_med nd_atcross_ratio_max nd_atcross_ratio_closest nd_inside_frac "
           "nd_dr_closest"})
def _(s, d):
    return R.crossing_sizes(tracks(s, d))


@query("approach_sizes", f"""WITH {BOTH_CTE},
g AS (SELECT {K3}, count(*) FILTER (WHERE cr) AS n, median(ratio) FILTER (WHERE cr) AS med,
  max(ratio) FILTER (WHERE cr) AS mx, avg(CASE WHEN ov THEN 1.0 ELSE 0.0 END) FILTER (WHERE nr) AS fr,
  count(*) FILTER (WHERE nr) AS nn, regr_slope(ratio, frame_idx) FILTER (WHERE nr) AS sl,
  min(sqrt(dx*dx+dy*dy)/rim_w) FILTER (WHERE nr) AS cd,
  median(ratio) FILTER (WHERE nr AND dy < 0) AS ab, median(ratio) FILTER (WHERE nr AND dy > 0) AS bl,
  count(*) FILTER (WHERE ov) AS no, min(dy) FILTER (WHERE ov) AS lo, max(dy) FILTER (WHERE ov) AS hi,
  avg(rim_h) FILTER (WHERE ov) AS rh FROM bt GROUP BY {K3})
SELECT {K3}, coalesce(n, 0) AS nd2_n_atcross, med AS nd2_atcross_ratio_med,
  mx AS nd2_atcross_ratio_max, CASE WHEN nn >= 3 THEN sl END AS nd2_ratio_trend,
  ab AS nd2_ratio_above, bl AS nd2_ratio_below, cd AS nd2_min_centerdist,
  CASE WHEN no >= 2 THEN (hi - lo) / rh END AS nd2_y_span_inside, fr AS nd2_inside_frac,
  CASE WHEN no >= 2 AND lo < -0.2*rh AND hi > 0.2*rh THEN 1 ELSE 0 END AS nd2_vcross
FROM keys3 LEFT JOIN g USING ({K3})""",
       {6: "nd2_atcross_ratio_med nd2_atcross_ratio_max nd2_ratio_trend nd2_ratio_above "
           "nd2_ratio_below nd2_min_centerdist nd2_y_span_inside nd2_inside_frac"})
def _(s, d):
    return R.approach_sizes(tracks(s, d))


EVF_CTE = BOTH_CTE + f""",
evf AS (SELECT {K3}, arg_min(frame_idx, (abs(dy), frame_idx)) AS event_frame FROM bt WHERE cr
  GROUP BY {K3}),
sev AS (SELECT {K2}, CASE WHEN play_id % 2 = 0 THEN 'LEFT' ELSE 'RIGHT' END AS side,
  max(event_frame) FILTER (WHERE angle = CASE WHEN play_id % 2 = 0 THEN 'FL' ELSE 'FR' END) AS f_far,
  max(event_frame) FILTER (WHERE angle = CASE WHEN play_id % 2 = 0 THEN 'NL' ELSE 'NR' END) AS f_near
  FROM evf GROUP BY {K2}),
offs AS (SELECT game_id, side, CAST(trunc(median(f_near - f_far)) AS INTEGER) AS "offset",
  count(*) AS n, CASE WHEN count(*) >= 2 THEN stddev_pop(f_near - f_far) END AS std
  FROM sev WHERE f_far IS NOT NULL AND f_near IS NOT NULL GROUP BY game_id, side)
"""


@query("event_frames", f"WITH {EVF_CTE} SELECT * FROM evf")
def _(s, d):
    return R.event_frames(tracks(s, d))


@query("camera_offset", f"WITH {EVF_CTE} SELECT * FROM offs", {6: "std"})
def _(s, d):
    return R.camera_offsets(R.side_events(tracks(s, d), side()))


def _at_sql(name, event, cam_left, cam_right, sign):
    return f"""{name} AS (SELECT s.game_id, s.play_id,
  arg_min({{'dx': abs(dx/rim_w), 'dy': abs(dy/rim_h), 'c': cr}},
    (abs(b.frame_idx - (s.{event} {sign} o."offset")), b.frame_idx)) AS r
  FROM sev s JOIN offs o ON s.game_id = o.game_id AND s.side = o.side JOIN bt b
  ON b.game_id = s.game_id AND b.play_id = s.play_id
  AND b.angle = CASE WHEN s.side = 'LEFT' THEN '{cam_left}' ELSE '{cam_right}' END
  AND abs(b.frame_idx - (s.{event} {sign} o."offset")) <= 1 GROUP BY s.game_id, s.play_id)"""


@query("sync_agreement", f"""WITH {EVF_CTE},
{_at_sql('na', 'f_far', 'NL', 'NR', '+')}, {_at_sql('fa', 'f_near', 'FL', 'FR', '-')},
sh AS (SELECT DISTINCT {K2} FROM tracks)
SELECT sh.game_id, sh.play_id,
  CASE WHEN o.n IS NOT NULL AND f_far IS NOT NULL THEN 1 ELSE 0 END AS sa_far_event,
  CASE WHEN o.n IS NOT NULL AND f_near IS NOT NULL THEN 1 ELSE 0 END AS sa_near_event,
  CASE WHEN na.r.c THEN 1 ELSE 0 END AS sa_near_inside_at_far_sync,
  CASE WHEN fa.r.c THEN 1 ELSE 0 END AS sa_far_inside_at_near_sync,
  na.r.dx AS sa_near_dx_at_far_sync, na.r.dy AS sa_near_dy_at_far_sync,
  fa.r.dx AS sa_far_dx_at_near_sync, fa.r.dy AS sa_far_dy_at_near_sync,
  CASE WHEN NOT na.r.c THEN 1 ELSE 0 END AS sa_disagree_far_to_near,
  CASE WHEN NOT fa.r.c THEN 1 ELSE 0 END AS sa_disagree_near_to_far
FROM sh LEFT JOIN sev USING ({K2}) LEFT JOIN offs o ON o.game_id = sev.game_id AND o.side = sev.side
LEFT JOIN na ON na.game_id = sh.game_id AND na.play_id = sh.play_id
LEFT JOIN fa ON fa.game_id = sh.game_id AND fa.play_id = sh.play_id""",
       {6: "sa_near_dx_at_far_sync sa_near_dy_at_far_sync sa_far_dx_at_near_sync "
           "sa_far_dy_at_near_sync"})
def _(s, d):
    t = tracks(s, d)
    return R.sync_agreement(t, side(), R.camera_offsets(R.side_events(t, side())))


@query("detection_quality", f"""WITH {TRACKS_CTE},
c AS (SELECT {K3}, avg(CASE WHEN ball_x IS NULL THEN 0.0 ELSE 1.0 END) AS ball,
  avg(CASE WHEN rim_x IS NULL THEN 0.0 ELSE 1.0 END) AS rim,
  count(*) FILTER (WHERE abs(ball_x+ball_w/2-rim_x-rim_w/2) < 1.5*rim_w
    AND abs(ball_y+ball_h/2-rim_y-rim_h/2) < 2.0*rim_h) AS na FROM tracks GROUP BY {K3}),
s AS (SELECT {K2},
  coalesce(max(ball) FILTER (WHERE angle = CASE WHEN play_id%2=0 THEN 'NL' ELSE 'NR' END), 0) AS nb,
  coalesce(max(rim) FILTER (WHERE angle = CASE WHEN play_id%2=0 THEN 'NL' ELSE 'NR' END), 0) AS nr,
  coalesce(max(na) FILTER (WHERE angle = CASE WHEN play_id%2=0 THEN 'NL' ELSE 'NR' END), 0) >= 2 AS nat,
  coalesce(max(ball) FILTER (WHERE angle = CASE WHEN play_id%2=0 THEN 'FL' ELSE 'FR' END), 0) AS fb,
  coalesce(max(rim) FILTER (WHERE angle = CASE WHEN play_id%2=0 THEN 'FL' ELSE 'FR' END), 0) AS fr,
  coalesce(max(na) FILTER (WHERE angle = CASE WHEN play_id%2=0 THEN 'FL' ELSE 'FR' END), 0) >= 2 AS fat
  FROM c GROUP BY {K2})
SELECT coalesce(CAST(game_id AS VARCHAR), 'OVERALL') AS game, count(*) AS shots,
  avg(nb) AS near_ball, avg(nr) AS near_rim, avg(fb) AS far_ball, avg(fr) AS far_rim,
  avg(CASE WHEN nat THEN 1.0 ELSE 0.0 END) AS near_at_rim,
  avg(CASE WHEN fat THEN 1.0 ELSE 0.0 END) AS far_at_rim, count(*) FILTER (WHERE NOT nat) AS blind,
  count(*) FILTER (WHERE NOT nat AND fat) AS blind_far_sees,
  count(*) FILTER (WHERE NOT nat AND NOT fat) AS blind_both FROM s GROUP BY ROLLUP(game_id)""",
       {6: "near_ball near_rim far_ball far_rim near_at_rim far_at_rim"})
def _(s, d):
    return R.detection_quality(tracks(s, d), side())


@query("passage_sequence", f"""WITH {BOTH_CTE},
r AS (SELECT {K2}, angle, frame_idx AS t, dx/rim_w AS dxw, dy/rim_h AS dyh, abs(dx) <= rim_w/2
  AND abs(dy) <= rim_h/2 AS ins, ratio FROM bt)
SELECT {K3}, count(*) FILTER (WHERE ins) AS n_inside,
  CASE WHEN min(t) FILTER (WHERE abs(dxw) < 0.6 AND dyh < -0.4)
     < max(t) FILTER (WHERE abs(dxw) < 0.6 AND dyh > 0.4) THEN 1 ELSE 0 END AS passed,
  CASE WHEN count(*) FILTER (WHERE abs(dxw) < 0.6 AND dyh > 0.4) > 0 THEN 1 ELSE 0 END AS went_below,
  arg_min(ratio, (abs(dyh), t)) FILTER (WHERE abs(dxw) < 0.6) AS ratio, max(dyh) - min(dyh) AS vspan
FROM r GROUP BY {K3}""", {6: "ratio vspan"})
def _(s, d):
    r = R.both(tracks(s, d)).select(
        *T.TRACK, F.col("frame_idx").alias("t"), (F.col("dx") / F.col("rim_w")).alias("dx_w"),
        (F.col("dy") / F.col("rim_h")).alias("dy_h"), "ratio",
        ((F.abs("dx") <= F.col("rim_w") / 2) & (F.abs("dy") <= F.col("rim_h") / 2)).alias("inside"))
    return R.passage(r, T.TRACK)


@query("crossing_map", f"""WITH {BOTH_CTE},
g AS (SELECT {K3}, arg_min({{'x': dx/(rim_w/2), 'y': dy/(rim_h/2)}}, (dx*dx+dy*dy, frame_idx)) AS b
  FROM bt GROUP BY {K3})
SELECT {K3}, greatest(-1.15, least(1.15, coalesce(b.x, 0.0))) AS cross_x,
  greatest(-1.15, least(1.15, coalesce(b.y, 0.0))) AS cross_y FROM keys3 LEFT JOIN g USING ({K3})""",
       {6: "cross_x cross_y"})
def _(s, d):
    return R.crossing_map(tracks(s, d))


from orbweave.plans.catalog_tracks import _cramer  # noqa: E402

_, _QB, _ = _cramer("n", "s1", "s2", "s3", "s4", "y0", "y1", "y2")


@query("descent_angle", f"""WITH {BOTH_CTE},
r AS (SELECT {K3}, dx/100.0 AS u, dy/100.0 AS v FROM bt),
g AS (SELECT {K3}, CAST(count(*) AS DOUBLE) AS n, sum(u) AS s1, sum(u*u) AS s2, sum(u*u*u) AS s3,
   sum(u*u*u*u) AS s4, sum(v) AS y0, sum(u*v) AS y1, sum(u*u*v) AS y2 FROM r GROUP BY {K3})
SELECT {K3}, CASE WHEN n >= 5 THEN least(58, greatest(33, abs(degrees(atan({_QB}))))) ELSE 46 END
  AS descent_angle FROM keys3 LEFT JOIN g USING ({K3})""", {4: "descent_angle"})
def _(s, d):
    return R.descent_angle(tracks(s, d))


OCC_CTE = BOTH_CTE + f""",
nb AS (SELECT *, dy - lag(dy) OVER w AS d0, lead(dy) OVER w - dy AS d1, dx - lag(dx) OVER w AS x0,
  timestamp - lag(timestamp) OVER w AS dt, lag(nr) OVER w AS pn FROM bt
  WINDOW w AS (PARTITION BY {K3} ORDER BY frame_idx)),
oc AS (SELECT {K3}, avg(CASE WHEN ball_conf IS NULL OR ball_conf < 0.2 THEN 1.0 ELSE 0.0 END)
   AS occlusion, count(ball_x) AS n_tracked FROM tracks GROUP BY {K3}),
og AS (SELECT {K3}, sum(CASE WHEN nr AND pn THEN dt END) AS tz,
  count(*) FILTER (WHERE nr AND d0*d1 < 0) AS osc, avg(CASE WHEN dy < 0 THEN sqrt(x0*x0+d0*d0)/rim_w/dt
  END) AS sin, avg(CASE WHEN dy >= 0 THEN sqrt(x0*x0+d0*d0)/rim_w/dt END) AS sout,
  arg_min(ratio, (abs(dy), frame_idx)) FILTER (WHERE cr) AS sr, max(CASE WHEN cr THEN 1.0 ELSE 0.0 END)
  AS mk FROM nb GROUP BY {K3}),
occ AS (SELECT {K3}, occlusion, n_tracked, coalesce(tz, 0.0) AS time_in_zone,
  coalesce(osc, 0) AS oscillations, CASE WHEN sin > 0 THEN sout / sin END AS speed_ratio,
  sr AS size_ratio_at_plane, CAST(coalesce(mk, 0.0) AS DOUBLE) AS says_make
  FROM oc LEFT JOIN og USING ({K3}))
"""


@query("zone_occupancy", f"WITH {OCC_CTE} SELECT * FROM occ",
       {6: "occlusion time_in_zone speed_ratio size_ratio_at_plane"})
def _(s, d):
    return R.occupancy(tracks(s, d))


@query("camera_agreement", f"""WITH {OCC_CTE},
q AS (SELECT {K2}, max(says_make) FILTER (WHERE angle IN ('NL','NR')) AS n,
  max(says_make) FILTER (WHERE angle IN ('FL','FR')) AS f,
  arg_min(angle, (occlusion, -n_tracked, angle)) AS best_angle_hint FROM occ GROUP BY {K2})
SELECT {K2}, n IS NOT NULL AS near_present, f IS NOT NULL AS far_present, n = f AS near_far_agree,
  best_angle_hint FROM q""")
def _(s, d):
    return R.camera_agreement(R.occupancy(tracks(s, d)))


# ---- motion -------------------------------------------------------------------
NM_CTE = TRACKS_CTE + f""",
nm AS (SELECT {K3}, frame_idx, coalesce(ball_x, 1.0) / 7 AS fd, coalesce(ball_y, 2.0) / 9 AS fl,
  rim_x IS NOT NULL AS ok FROM tracks),
n1 AS (SELECT *, frame_idx - 1 AS i, count(*) OVER (PARTITION BY {K3}) AS n,
  median(fd) OVER (PARTITION BY {K3}) AS med FROM nm),
na AS (SELECT {K3}, max(fd) AS nm_fd_peak, max(fl) AS nm_flow_peak, avg(fd) AS nm_fd_mean,
  max(CASE WHEN i >= greatest(1, n // 2) OR n <= greatest(1, n // 2) THEN fd END) AS nm_fd_tail_max,
  avg(CASE WHEN i >= greatest(1, n // 2) OR n <= greatest(1, n // 2) THEN fd END) AS nm_fd_tail_mean,
  avg(CASE WHEN i >= greatest(1, n // 2) OR n <= greatest(1, n // 2) THEN fl END) AS nm_flow_tail_mean,
  CASE WHEN max(n) > 1 THEN CAST(arg_max(i, (fd, -i)) AS DOUBLE) / (max(n) - 1) ELSE 0 END AS nm_peak_pos,
  avg(CASE WHEN fd > med THEN 1.0 ELSE 0.0 END) AS nm_sustained_frac,
  avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS nm_rim_ok_frac, CAST(max(n) AS DOUBLE) AS nm_n_frames
  FROM n1 GROUP BY {K3})
"""


def motion(s, d):
    return tracks(s, d).select(
        *T.TRACK, "frame_idx", (F.coalesce("ball_x", F.lit(1.0)) / 7).alias("framediff_energy"),
        (F.coalesce("ball_y", F.lit(2.0)) / 9).alias("flow_mag"),
        F.col("rim_x").isNotNull().alias("rim_ok"))


@query("net_motion_angle", f"WITH {NM_CTE} SELECT * FROM na", {6: " ".join(
    c for c in N.PER_ANGLE if c != "nm_n_frames")})
def _(s, d):
    return N.angle_motion(motion(s, d))


def _wide_sql(c):
    return ", ".join(f"max({c}) FILTER (WHERE angle = '{a}') AS {c}_{a}" for a in K.ANGLES)


def _fused_sql(c):
    v = ", ".join(f"{c}_{a}" for a in K.ANGLES)
    num = " + ".join(f"coalesce({c}_{a}, 0) * coalesce(nm_rim_ok_frac_{a}, 0)" for a in K.ANGLES)
    den = " + ".join(f"coalesce(nm_rim_ok_frac_{a}, 0)" for a in K.ANGLES)
    return (f"greatest({v}) AS {c}_max, list_avg([{v}]) AS {c}_mean, "
            f"CASE WHEN {den} <> 0 THEN ({num}) / ({den}) ELSE 0 END AS {c}_qw")


_NMW = "nm_fd_peak nm_flow_peak nm_fd_tail_max".split()
NMF_CTE = NM_CTE + f""",
nw AS (SELECT {K2}, {', '.join(_wide_sql(c) for c in N.PER_ANGLE)} FROM na GROUP BY {K2}),
nmed AS (SELECT {K2}, median(nm_fd_peak) AS med FROM na GROUP BY {K2}),
nagr AS (SELECT na.game_id, na.play_id, count(*) FILTER (WHERE nm_fd_peak > med) AS nm_agree_high
  FROM na JOIN nmed USING ({K2}) GROUP BY na.game_id, na.play_id),
nmf AS (SELECT nw.*, {', '.join(_fused_sql(c) for c in _NMW)}, nm_agree_high
  FROM nw JOIN nagr USING ({K2}))
"""


@query("net_motion_fused", f"WITH {NMF_CTE} SELECT * FROM nmf", {6: " ".join(
    [f"{c}_{a}" for c in N.PER_ANGLE if c != "nm_n_frames" for a in K.ANGLES]
    + [f"{c}_{x}" for c in _NMW for x in ("max", "mean", "qw")])})
def _(s, d):
    return N.fused_motion(N.angle_motion(motion(s, d)))


# ---- fusion -------------------------------------------------------------------
FEAT_CTE = DET_CTE + f""",
cov AS (SELECT {K3}, count(*) AS n_frames, avg(CASE WHEN ball_x IS NULL THEN 0.0 ELSE 1.0 END) AS ball_frac,
  avg(CASE WHEN rim_conf IS NULL THEN 0.0 ELSE 1.0 END) AS rim_frac, coalesce(max(ball_conf), 0)
  AS ball_conf_max FROM tracks GROUP BY {K3}),
dg AS (SELECT {K3}, min(dist) AS md, arg_min(conf, (dist, frame_idx)) AS mc,
  arg_min(frame_idx, (dist, frame_idx)) AS mf, max(CASE WHEN inside THEN 1.0 ELSE 0.0 END) AS ent,
  avg(CASE WHEN inside THEN 1.0 ELSE 0.0 END) AS fin,
  max(CASE WHEN p_above AND NOT above AND p_lvl AND lvl THEN 1.0 ELSE 0.0 END) AS th,
  sum(CASE WHEN p_above AND NOT above AND p_lvl AND lvl THEN 1.0 ELSE 0.0 END) AS thn,
  coalesce(avg(CASE WHEN p_above AND NOT above AND p_lvl AND lvl THEN 0.5*(p_conf+conf) END), 0) AS thc
  FROM det GROUP BY {K3}),
pr AS (SELECT d.game_id, d.play_id, d.angle, max(dist) AS post FROM det d JOIN dg
  ON d.game_id = dg.game_id AND d.play_id = dg.play_id AND d.angle = dg.angle AND frame_idx > mf
  GROUP BY d.game_id, d.play_id, d.angle),
feat AS (SELECT {K3}, CAST(n_frames AS DOUBLE) AS n_frames, ball_frac, ball_conf_max,
  CASE WHEN ref_w IS NULL THEN 0 ELSE 1 END AS rim_detected, coalesce(md, 10) AS min_dist_rw,
  coalesce(mc, 0) AS min_dist_conf, coalesce(ent, 0) AS enters_rim_box,
  coalesce(fin, 0) AS frac_inside_rim, coalesce(th, 0) AS through_hoop,
  coalesce(thn, 0) AS through_hoop_count, coalesce(thc, 0) AS through_hoop_conf,
  coalesce(greatest(post - md, 0), 0) AS post_min_rebound,
  CASE WHEN ref_w IS NOT NULL AND ball_frac > 0 THEN ball_frac * rim_frac ELSE 0 END AS q0
  FROM cov LEFT JOIN ref USING ({K3}) LEFT JOIN dg USING ({K3}) LEFT JOIN pr USING ({K3})),
fq AS (SELECT *, CASE WHEN angle IN ('FL','FR') AND post_min_rebound >= 6 THEN 0 ELSE q0 END AS q,
  rim_detected = 1 AND ball_frac > 0 AS us FROM feat),
fz AS (SELECT {K2}, count(*) FILTER (WHERE us) AS nu,
  sum(q) FILTER (WHERE us) AS wq, sum(q * min_dist_rw) FILTER (WHERE us) AS wd,
  avg(min_dist_rw) FILTER (WHERE us) AS wm,
  coalesce(min(min_dist_rw) FILTER (WHERE us), 10) AS min_dist_rw_best,
  coalesce(avg(min_dist_rw) FILTER (WHERE us), 10) AS min_dist_rw_mean,
  max(through_hoop) AS through_hoop_any,
  coalesce(sum(through_hoop) FILTER (WHERE us), 0) AS through_hoop_votes,
  max(through_hoop_count) AS through_hoop_count_max,
  coalesce(max(through_hoop_conf) FILTER (WHERE us), 0) AS through_hoop_conf_max,
  coalesce(sum(enters_rim_box) FILTER (WHERE us), 0) AS enters_rim_votes,
  coalesce(max(frac_inside_rim) FILTER (WHERE us), 0) AS frac_inside_rim_max,
  coalesce(max(post_min_rebound) FILTER (WHERE us), 0) AS post_min_rebound_max,
  coalesce(sum(greatest(min_dist_conf, 1e-3) * min_dist_rw) FILTER (WHERE us)
    / sum(greatest(min_dist_conf, 1e-3)) FILTER (WHERE us), 10) AS min_dist_rw_confw,
  coalesce(min(min_dist_rw) FILTER (WHERE us AND angle IN ('NL','NR')), 10) AS min_dist_rw_near_best,
  coalesce(max(through_hoop) FILTER (WHERE us AND angle IN ('NL','NR')), 0) AS through_hoop_near_any,
  coalesce(min(min_dist_rw) FILTER (WHERE us AND angle IN ('FL','FR')), 10) AS min_dist_rw_far_best,
  coalesce(max(through_hoop) FILTER (WHERE us AND angle IN ('FL','FR')), 0) AS through_hoop_far_any,
  sum(ball_frac) / 4.0 AS ball_frac_mean, max(ball_conf_max) AS ball_conf_max_overall,
  max(q) AS q_quality_max, count(*) FILTER (WHERE us AND min_dist_rw <= 1.5) AS close_agree_votes,
  count(*) FILTER (WHERE us AND through_hoop >= 1) AS tv FROM fq GROUP BY {K2})
"""
_FUSED = ("min_dist_rw_best min_dist_rw_mean through_hoop_any through_hoop_votes "
          "through_hoop_count_max through_hoop_conf_max enters_rim_votes frac_inside_rim_max "
          "post_min_rebound_max min_dist_rw_confw min_dist_rw_near_best through_hoop_near_any "
          "min_dist_rw_far_best through_hoop_far_any ball_frac_mean ball_conf_max_overall "
          "q_quality_max close_agree_votes").split()


@query("fused_shot_features", f"""WITH {FEAT_CTE}
SELECT {K2}, CAST(nu AS DOUBLE) AS n_usable_angles,
  {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _FUSED)},
  CASE WHEN nu > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS any_angle_usable,
  CAST(CASE WHEN nu = 0 THEN 0 WHEN wq <= 1e-9 THEN nu ELSE wq END AS DOUBLE) AS q_quality_sum_usable,
  CASE WHEN nu = 0 THEN 10 WHEN wq <= 1e-9 THEN wm ELSE wd / wq END AS min_dist_rw_qw,
  CASE WHEN close_agree_votes >= 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS agree_make_like,
  CASE WHEN tv >= 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS through_hoop_agree2 FROM fz""",
       {6: " ".join(_FUSED) + " q_quality_sum_usable min_dist_rw_qw"})
def _(s, d):
    f = U.fuse(T.angle_features(tracks(s, d)))
    return f.select(*T.SHOT, "n_usable_angles", *_FUSED, "any_angle_usable", "q_quality_sum_usable",
                    "min_dist_rw_qw", "agree_make_like", "through_hoop_agree2")


@query("shot_feature_rows")
def _(s, d):
    """Whole fused row: 120+ per-camera columns and every shot-level aggregate."""
    return U.fuse(T.angle_features(tracks(s, d)))


PIV_CTE = TRACKS_CTE + f""",
pa AS (SELECT {K3}, count(*) AS nf, max(ball_conf) AS bc FROM tracks GROUP BY {K3}),
pw AS (SELECT {K2}, """ + ", ".join(
    f"CAST(coalesce(max({e}) FILTER (WHERE angle = '{a}'), 0) AS DOUBLE) AS {n}_{a}"
    for e, n in (("nf", "n_frames"), ("bc", "conf")) for a in K.ANGLES) + f" FROM pa GROUP BY {K2})"


def _pivoted(s, d):
    f = tracks(s, d).groupBy(*T.TRACK).agg(F.count(F.lit(1)).alias("n_frames"),
                                           F.max("ball_conf").alias("conf"))
    return U.pivot_angles(f, ["n_frames", "conf"])


@query("angle_pivot", f"WITH {PIV_CTE} SELECT * FROM pw")
def _(s, d):
    return _pivoted(s, d)


@query("side_collapse", f"""WITH {PIV_CTE}
SELECT {K2}, CASE WHEN play_id % 2 = 0 THEN n_frames_FL ELSE n_frames_FR END AS "n_frames_FARSIDE",
 CASE WHEN play_id % 2 = 0 THEN n_frames_NL ELSE n_frames_NR END AS "n_frames_NEARSIDE",
 CASE WHEN play_id % 2 = 0 THEN conf_FL ELSE conf_FR END AS "conf_FARSIDE",
 CASE WHEN play_id % 2 = 0 THEN conf_NL ELSE conf_NR END AS "conf_NEARSIDE",
 CASE WHEN play_id % 2 = 0 THEN 1 ELSE 0 END AS side_is_left FROM pw""")
def _(s, d):
    return U.collapse_sides(_pivoted(s, d), F.col("play_id") % 2 == 0)


@query("side_collapse_pairs", f"""WITH {PIV_CTE}
SELECT {K2}, n_frames_NL, CASE WHEN play_id % 2 = 0 THEN n_frames_FL ELSE n_frames_FR END
 AS "n_frames_FARSIDE", CASE WHEN play_id % 2 = 0 THEN 1 ELSE 0 END AS side_is_left FROM pw""")
def _(s, d):
    p = _pivoted(s, d).select(*T.SHOT, "n_frames_FL", "n_frames_FR", "n_frames_NL")
    return U.collapse_sides(p, F.col("play_id") % 2 == 0, pairwise=True)


@query("schema_align", f"""WITH {PIV_CTE}
SELECT play_id, conf_FL, CAST(NULL AS DOUBLE) AS extra_feature, n_frames_NR FROM pw""")
def _(s, d):
    return U.align_columns(_pivoted(s, d), ["play_id", "conf_FL", "extra_feature", "n_frames_NR"])


@query("interactions", f"""WITH {NMF_CTE},
z AS (SELECT *, nm_fd_peak_max AS pk, nm_rim_ok_frac_FL AS fr FROM nmf)
SELECT {K2}, coalesce(fr, 0) * pk AS ix_frac_x_nmpeak, 0.0 AS ix_thru_x_nmpeak,
 0.0 AS ix_arc_x_nmpeak_qw, pk / (coalesce(fr, 0) + 0.01) AS ix_nmpeak_div_frac,
 pk / 0.01 AS ix_nmpeak_div_thru, 1.0 / 0.5 * pk AS ix_close_x_nmpeak,
 nm_agree_high * pk AS ix_agree_x_nmpeak, 0.0 AS ix_agree_x_thru,
 nm_fd_tail_max_max / (pk + 0.01) AS ix_tail_over_peak,
 nm_flow_peak_max / (pk + 0.01) AS ix_flow_over_fd FROM z""",
       {6: "ix_frac_x_nmpeak ix_thru_x_nmpeak ix_arc_x_nmpeak_qw ix_nmpeak_div_frac "
           "ix_nmpeak_div_thru ix_close_x_nmpeak ix_agree_x_nmpeak ix_agree_x_thru "
           "ix_tail_over_peak ix_flow_over_fd"})
def _(s, d):
    f = N.fused_motion(N.angle_motion(motion(s, d)))
    f = f.withColumn("frac_inside_rim_max", F.coalesce("nm_rim_ok_frac_FL", F.lit(0.0)))
    out = U.add_interactions(f)
    return out.select(*T.SHOT, *[c for c in out.columns if c.startswith("ix_")])
