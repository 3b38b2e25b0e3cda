"""Registered queries over the per-camera tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbweave.functions import boxes as B, fixed as K, labels as L
from orbweave.operators import fuse as U, tracks as T
from orbweave.plans.inputs import TRACKS_CTE, tracks
from orbweave.plans.registry import query

REF_CTE = TRACKS_CTE + """,
ref0 AS (SELECT game_id, play_id, angle, median(rim_x) AS x, median(rim_y) AS y,
    median(rim_w) AS w, median(rim_h) AS h FROM tracks
  WHERE rim_x IS NOT NULL AND rim_y IS NOT NULL AND rim_w IS NOT NULL AND rim_h IS NOT NULL
  GROUP BY game_id, play_id, angle),
ref AS (SELECT game_id, play_id, angle,
    CASE WHEN w > 1 AND h > 1 THEN x END AS ref_x, CASE WHEN w > 1 AND h > 1 THEN y END AS ref_y,
    CASE WHEN w > 1 AND h > 1 THEN w END AS ref_w, CASE WHEN w > 1 AND h > 1 THEN h END AS ref_h
  FROM ref0)
"""
DET_CTE = REF_CTE + """,
det0 AS (SELECT t.game_id, t.play_id, t.angle, t.frame_idx, ball_x + ball_w / 2 AS cx,
    ball_y + ball_h / 2 AS cy, coalesce(ball_conf, 0) AS conf, ref_x, ref_y, ref_w, ref_h,
    ref_x + ref_w / 2 AS rcx, ref_y + ref_h / 2 AS rcy
  FROM tracks t JOIN ref r ON t.game_id = r.game_id AND t.play_id = r.play_id AND t.angle = r.angle
  WHERE ball_x IS NOT NULL AND ball_y IS NOT NULL AND ball_w IS NOT NULL AND ball_h IS NOT NULL
    AND ref_w IS NOT NULL),
det1 AS (SELECT *, sqrt((cx - rcx) * (cx - rcx) + (cy - rcy) * (cy - rcy)) / ref_w AS dist,
    cx >= ref_x AND cx <= ref_x + ref_w AND cy >= ref_y AND cy <= ref_y + ref_h AS inside,
    cy <= rcy AS above, abs(cx - rcx) <= 1.0 * ref_w AS lvl FROM det0),
det AS (SELECT *, dist <= 1.5 AS near,
    row_number() OVER w AS rn, lag(cx) OVER w AS p_cx, lag(cy) OVER w AS p_cy,
    lead(cy) OVER w AS n_cy, lag(conf) OVER w AS p_conf, lag(above) OVER w AS p_above,
    lag(lvl) OVER w AS p_lvl, lag(dist <= 1.5) OVER w AS p_near
  FROM det1 WINDOW w AS (PARTITION BY game_id, play_id, angle ORDER BY frame_idx))
"""
K3 = "game_id, play_id, angle"


@query("reference_box", f"WITH {REF_CTE} SELECT * FROM ref", {6: "ref_x ref_y ref_w ref_h"})
def _(s, d):
    return T.reference_box(tracks(s, d))


@query("width_ruler", f"WITH {TRACKS_CTE} SELECT {K3}, median(rim_w) AS ruler FROM tracks "
       f"WHERE rim_w > 1 GROUP BY {K3}", {6: "ruler"})
def _(s, d):
    return T.width_ruler(tracks(s, d))


@query("coverage", f"""WITH {TRACKS_CTE}
SELECT {K3}, count(*) AS n_frames,
  avg(CASE WHEN ball_x IS NULL THEN 0.0 ELSE 1.0 END) AS ball_frac,
  avg(CASE WHEN rim_conf IS NULL THEN 0.0 ELSE 1.0 END) AS rim_frac,
  coalesce(avg(ball_conf), 0) AS ball_conf_mean, coalesce(max(ball_conf), 0) AS ball_conf_max
FROM tracks GROUP BY {K3}""", {6: "ball_frac rim_frac ball_conf_mean ball_conf_max"})
def _(s, d):
    return T.coverage(tracks(s, d))


@query("closest_approach", f"""WITH {DET_CTE},
g AS (SELECT {K3}, arg_min({{'d': dist, 'c': conf, 'f': frame_idx}}, (dist, frame_idx)) AS best,
   min(frame_idx) AS f0, max(frame_idx) AS f1 FROM det GROUP BY {K3})
SELECT {K3}, best.d AS min_dist_rw, best.c AS min_dist_conf, best.f AS min_dist_frame,
  CAST(best.f - f0 AS DOUBLE) / greatest(f1 - f0, 1) AS min_dist_frac_time FROM g""",
       {6: "min_dist_rw min_dist_conf min_dist_frac_time"})
def _(s, d):
    return T.closest(T.detections(tracks(s, d)))


@query("approach_rebound", f"""WITH {DET_CTE},
g AS (SELECT {K3}, min(dist) AS m, arg_min(frame_idx, (dist, frame_idx)) AS f,
   arg_min(dist, frame_idx) AS fd FROM det GROUP BY {K3}),
p AS (SELECT det.game_id, det.play_id, det.angle, max(dist) AS post FROM det JOIN g
   ON det.game_id = g.game_id AND det.play_id = g.play_id AND det.angle = g.angle
   AND frame_idx > f GROUP BY det.game_id, det.play_id, det.angle)
SELECT g.game_id, g.play_id, g.angle, greatest(fd - m, 0) AS approach_drop,
  coalesce(greatest(post - m, 0), 0) AS post_min_rebound
FROM g LEFT JOIN p ON p.game_id = g.game_id AND p.play_id = g.play_id AND p.angle = g.angle""",
       {6: "approach_drop post_min_rebound"})
def _(s, d):
    return T.rebound(T.detections(tracks(s, d)))


@query("plane_crossings", f"""WITH {DET_CTE},
c AS (SELECT *, coalesce(p_above AND NOT above AND p_lvl AND lvl, false) AS x FROM det)
SELECT {K3}, CAST(sum(CASE WHEN x THEN 1 ELSE 0 END) AS BIGINT) AS through_hoop_count,
  coalesce(avg(CASE WHEN x THEN 0.5 * (p_conf + conf) END), 0) AS through_hoop_conf,
  CASE WHEN sum(CASE WHEN x THEN 1 ELSE 0 END) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
    AS through_hoop FROM c GROUP BY {K3}""", {6: "through_hoop_conf"})
def _(s, d):
    return T.plane_crossings(T.linked(T.detections(tracks(s, d))))


@query("direction_flip", f"""WITH {DET_CTE},
m AS (SELECT {K3}, frame_idx, sign(cy - p_cy) AS s FROM det WHERE near AND p_near AND cy <> p_cy),
m2 AS (SELECT *, lag(s) OVER (PARTITION BY {K3} ORDER BY frame_idx) AS ps FROM m),
f AS (SELECT {K3}, max(CASE WHEN ps <> s THEN 1 ELSE 0 END) AS flip FROM m2 GROUP BY {K3}),
n AS (SELECT {K3}, sum(CASE WHEN near THEN 1 ELSE 0 END) AS nn FROM det GROUP BY {K3})
SELECT n.game_id, n.play_id, n.angle,
  CASE WHEN nn >= 3 AND flip = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS vy_sign_change_near_rim
FROM n LEFT JOIN f ON n.game_id = f.game_id AND n.play_id = f.play_id AND n.angle = f.angle""")
def _(s, d):
    return T.direction_flip(T.linked(T.detections(tracks(s, d))))


@query("jitter", f"""WITH {TRACKS_CTE},
v AS (SELECT {K3}, frame_idx, ball_y + ball_h / 2 AS cy FROM tracks WHERE ball_y IS NOT NULL),
w AS (SELECT {K3}, lag(cy) OVER q AS p, cy, lead(cy) OVER q AS n FROM v
   WINDOW q AS (PARTITION BY {K3} ORDER BY frame_idx))
SELECT {K3}, median(abs((n - cy) - (cy - p))) AS jitter FROM w
WHERE p IS NOT NULL AND n IS NOT NULL GROUP BY {K3}""", {6: "jitter"})
def _(s, d):
    return T.jitter(tracks(s, d).withColumn("cy", B.center_y("ball")), "cy")


BO_CTE = DET_CTE + f""",
best AS (SELECT {K3}, arg_min(rn, (dist, frame_idx)) AS j, arg_min(frame_idx, (dist, frame_idx)) AS jf,
   min(dist) AS jd, count(*) AS n FROM det GROUP BY {K3}),
seg AS (SELECT d.*, j, jf, jd, n, CASE WHEN p_cy IS NULL OR n_cy IS NULL THEN cy ELSE
     p_cy + cy + n_cy - greatest(p_cy, cy, n_cy) - least(p_cy, cy, n_cy) END AS sy0,
     CASE WHEN p_cy IS NULL OR n_cy IS NULL THEN cy
      ELSE list_sort([p_cy, cy, n_cy])[2] END AS sy
  FROM det d JOIN best b ON d.game_id = b.game_id AND d.play_id = b.play_id AND d.angle = b.angle
  WHERE rn BETWEEN j AND j + 18 AND n >= 5 AND j < n - 1 AND jd <= 1.5)"""


@query("bounce_out", f"""WITH {BO_CTE},
lo AS (SELECT {K3}, arg_max(rn, (sy, -rn)) AS klow, max(sy) AS ylow, arg_min(sy, rn) AS y0,
   arg_max(frame_idx, (sy, -rn)) AS flow, count(*) AS m, max(jf) AS jf FROM seg GROUP BY {K3}),
hi AS (SELECT s.game_id, s.play_id, s.angle, min(sy) AS ytop, arg_min(cx, (sy, rn)) AS cxt,
   arg_min(conf, (sy, rn)) AS ct FROM seg s JOIN lo l ON s.game_id = l.game_id
   AND s.play_id = l.play_id AND s.angle = l.angle AND s.rn > klow
   GROUP BY s.game_id, s.play_id, s.angle),
lat AS (SELECT s.game_id, s.play_id, s.angle, max(abs(cx - rcx)) / max(ref_w) AS lat,
   max(rcx) AS rcx, max(ref_w) AS rw, max(ref_h) AS rh FROM seg s JOIN lo l
   ON s.game_id = l.game_id AND s.play_id = l.play_id AND s.angle = l.angle AND s.rn >= klow
   GROUP BY s.game_id, s.play_id, s.angle)
SELECT lo.game_id, lo.play_id, lo.angle, 1.0::DOUBLE AS bo_any, ct AS bo_conf,
  CAST(flow - jf AS DOUBLE) AS bo_frames_to_reappear, abs(cxt - rcx) / rw AS bo_outward_disp,
  CASE WHEN lat > 0.75 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS bo_then_rises
FROM lo JOIN hi ON lo.game_id = hi.game_id AND lo.play_id = hi.play_id AND lo.angle = hi.angle
JOIN lat ON lo.game_id = lat.game_id AND lo.play_id = lat.play_id AND lo.angle = lat.angle
WHERE m >= 3 AND (ylow - ytop) / rh >= 0.6 AND ylow > y0 + 0.2 * rh""",
       {6: "bo_conf bo_outward_disp"})
def _(s, d):
    det = T.numbered(T.detections(tracks(s, d)))
    return T.bounce_out(det, T.best_rows(det))


def _cramer(n, s1, s2, s3, s4, y0, y1, y2):
    """SQL text of the three coefficients of a least-squares parabola."""
    det = f"({s4}*({s2}*{n}-{s1}*{s1})-{s3}*({s3}*{n}-{s1}*{s2})+{s2}*({s3}*{s1}-{s2}*{s2}))"
    a = f"({y2}*({s2}*{n}-{s1}*{s1})-{s3}*({y1}*{n}-{s1}*{y0})+{s2}*({y1}*{s1}-{s2}*{y0}))/{det}"
    b = f"({s4}*({y1}*{n}-{s1}*{y0})-{y2}*({s3}*{n}-{s1}*{s2})+{s2}*({s3}*{y0}-{y1}*{s2}))/{det}"
    c = f"({s4}*({s2}*{y0}-{s1}*{y1})-{s3}*({s3}*{y0}-{y1}*{s2})+{y2}*({s3}*{s1}-{s2}*{s2}))/{det}"
    return a, b, c


_GA, _GB, _GC = _cramer("n", "s1", "s2", "s3", "s4", "y0", "y1", "y2")
_KA, _KB, _KC = _cramer("n", "t1", "t2", "t3", "t4", "y0", "ty", "tty")


@query("arc_features", f"""WITH {DET_CTE},
best AS (SELECT {K3}, arg_min(rn, (dist, frame_idx)) AS j,
   arg_min(frame_idx, (dist, frame_idx)) AS jf FROM det GROUP BY {K3}),
r AS (SELECT d.*, (cx - rcx) / ref_w AS u, (cy - rcy) / ref_h AS v,
   CAST(frame_idx - jf AS DOUBLE) AS t FROM det d JOIN best b ON d.game_id = b.game_id
   AND d.play_id = b.play_id AND d.angle = b.angle WHERE abs(rn - j) <= 12),
g AS (SELECT {K3}, CAST(count(*) AS DOUBLE) AS n, sum(u) AS s1, sum(u*u) AS s2, sum(u*u*u) AS s3,
   sum(u*u*u*u) AS s4, sum(v) AS y0, sum(u*v) AS y1, sum(u*u*v) AS y2,
   sum(t) AS t1, sum(t*t) AS t2, sum(t*t*t) AS t3, sum(t*t*t*t) AS t4, sum(t*v) AS ty,
   sum(t*t*v) AS tty, regr_slope(u, t) AS xs, max(ref_w) AS rw, max(ref_h) AS rh
   FROM r GROUP BY {K3} HAVING count(*) >= 5),
f AS (SELECT *, {_GA} AS fa, {_GB} AS fb, {_GC} AS fc, {_KB} AS kb FROM g),
er AS (SELECT r.game_id, r.play_id, r.angle,
   sqrt(avg((v - (fa*u*u + fb*u + fc)) * (v - (fa*u*u + fb*u + fc)))) AS rms FROM r JOIN f
   ON r.game_id = f.game_id AND r.play_id = f.play_id AND r.angle = f.angle
   GROUP BY r.game_id, r.play_id, r.angle)
SELECT f.game_id, f.play_id, f.angle, 1.0::DOUBLE AS arc_ok,
  degrees(atan2(abs(kb * rh), abs(xs * rw) + 1e-6)) AS arc_entry_angle_deg, kb AS arc_vy_at_rim,
  fa * rh / rw AS arc_curvature, rms * rh / rw AS arc_fit_resid,
  -fb / (2 * fa) AS arc_apex_dx_rw, -(fc - fb * fb / (4 * fa)) AS arc_apex_above_rim_rh
FROM f JOIN er ON f.game_id = er.game_id AND f.play_id = er.play_id AND f.angle = er.angle""",
       {4: "arc_entry_angle_deg arc_vy_at_rim arc_curvature arc_fit_resid arc_apex_dx_rw "
           "arc_apex_above_rim_rh"})
def _(s, d):
    det = T.numbered(T.detections(tracks(s, d)))
    return T.arc(det, T.best_rows(det))


# ---- flagship ---------------------------------------------------------------
@query("shot_rule_eval", f"""WITH {DET_CTE},
ang AS (SELECT {K3}, min(dist) AS md,
   max(CASE WHEN p_above AND NOT above AND p_lvl AND lvl THEN 1 ELSE 0 END) AS th
   FROM det GROUP BY {K3}),
shots AS (SELECT game_id, play_id, max(classification) AS classification FROM tracks
   GROUP BY game_id, play_id),
f AS (SELECT s.game_id, s.play_id, CASE WHEN classification LIKE '%MAKE' THEN 1 ELSE 0 END AS label,
   coalesce(min(md), 10) AS md, coalesce(max(th), 0) AS th FROM shots s LEFT JOIN ang a
   ON s.game_id = a.game_id AND s.play_id = a.play_id GROUP BY s.game_id, s.play_id, classification),
p AS (SELECT *, CASE WHEN md <= 1.5 AND th = 1 THEN 1 ELSE 0 END AS pred FROM f),
g AS (SELECT coalesce(CAST(game_id AS VARCHAR), 'ALL') AS game, count(*) AS n,
   sum(CASE WHEN label=1 AND pred=1 THEN 1 ELSE 0 END) AS tp,
   sum(CASE WHEN label=0 AND pred=0 THEN 1 ELSE 0 END) AS tn,
   sum(CASE WHEN label=0 AND pred=1 THEN 1 ELSE 0 END) AS fp,
   sum(CASE WHEN label=1 AND pred=0 THEN 1 ELSE 0 END) AS fn FROM p GROUP BY ROLLUP(game_id))
SELECT game, n, CAST(tp AS BIGINT) AS tp, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp,
  CAST(fn AS BIGINT) AS fn, CAST(tp + tn AS DOUBLE) / n AS accuracy,
  CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END AS precision,
  CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM g""",
       {6: "accuracy precision recall f1"})
def _(s, d):
    from orbweave.plans.shots import rule_eval
    return rule_eval(tracks(s, d))
