"""Registered queries: temporal joins, event clustering and ordered-row operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbweave.functions import boxes as B, ordered
from orbweave.operators import sequence as S, temporal as M, tracks as T
from orbweave.plans.inputs import TRACKS_CTE, tracks
from orbweave.plans.registry import query, table

K3 = "game_id, play_id, angle"

# hits: detections in the arrival zone; windows: labelled events, seconds
HITS_CTE = """
ev AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) // 1000000 AS t FROM events),
hits AS (SELECT user_id, event_id, t, value AS dist, (event_id * 31) % 101 AS y
  FROM ev WHERE value <= 60 AND event_type <> 'purchase'),
wins AS (SELECT user_id, event_id AS win_id, t AS t1, t - 7200 AS lo, t + 9000 AS hi
  FROM ev WHERE event_type = 'purchase')
"""
EVENTS_CTE = HITS_CTE + """,
o AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR t - lag(t) OVER w > 7200 THEN 1 ELSE 0 END AS nw
  FROM hits WINDOW w AS (PARTITION BY user_id ORDER BY t)),
c AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY t) AS cid FROM o),
spot AS (SELECT user_id, min(t) AS t_first, max(t) AS t_last, count(*) AS n_hits,
   arg_min(t, (dist, t)) AS event_t, min(dist) AS min_dist, arg_min(y, t) AS y_start,
   arg_min(y, (dist, t)) AS y_event FROM c GROUP BY user_id, cid HAVING count(*) >= 2)
"""
DAY = 86400


def ev(s, d):
    e = table(s, d, "events")
    return e.select("user_id", "event_id", "event_type", "value",
                    F.floor(ordered.micros("ts") / 1_000_000).alias("t"))


def hits(s, d):
    return ev(s, d).filter((F.col("value") <= 60) & (F.col("event_type") != "purchase")).select(
        "user_id", "event_id", "t", F.col("value").alias("dist"),
        ((F.col("event_id") * 31) % 101).alias("y"))


def wins(s, d):
    return ev(s, d).filter(F.col("event_type") == "purchase").select(
        "user_id", F.col("event_id").alias("win_id"), F.col("t").alias("t1"),
        (F.col("t") - 7200).alias("lo"), (F.col("t") + 9000).alias("hi"))


def day(c):
    return ordered.value_bucket(c, DAY)


def spotted(s, d):
    return M.events_from_hits(hits(s, d), ["user_id"], "t", 7200, day("t"), y="y")


@query("event_clusters", f"""WITH {EVENTS_CTE}
SELECT *, event_t = t_first OR y_event >= y_start AS descends FROM spot""")
def _(s, d):
    return spotted(s, d)


@query("event_median_time", f"""WITH {EVENTS_CTE}
SELECT user_id, min(t) AS t_first, median(t) AS event_t, count(*) AS n_hits FROM c
GROUP BY user_id, cid HAVING count(*) >= 2""", {3: "event_t"})
def _(s, d):
    from orbweave.functions.quantiles import medians
    c = ordered.cluster_rows(hits(s, d), ["user_id"], "t", 7200, day("t")) \
        .withColumnRenamed("cluster_start", "t_first").withColumnRenamed("t", "event_t")
    key = ["user_id", "t_first"]
    n = c.groupBy(*key).agg(F.count(F.lit(1)).alias("n_hits")).filter("n_hits >= 2")
    return medians(c, key, ["event_t"]).join(n, key)


MATCH_CTE = EVENTS_CTE + """,
m AS (SELECT s.user_id, s.event_t, min(lo) AS best FROM spot s JOIN wins w
   ON s.user_id = w.user_id AND event_t BETWEEN lo AND hi GROUP BY s.user_id, s.event_t),
matched AS (SELECT s.user_id, s.event_t, s.min_dist, w.win_id, w.t1 AS win_t1 FROM spot s
   LEFT JOIN (SELECT m.user_id, m.event_t, min(win_id) AS win_id FROM m JOIN wins w
     ON m.user_id = w.user_id AND m.best = w.lo GROUP BY m.user_id, m.event_t) x
   ON s.user_id = x.user_id AND s.event_t = x.event_t
   LEFT JOIN wins w ON x.win_id = w.win_id)
"""


def matched(s, d):
    e = spotted(s, d).select("user_id", "event_t", "min_dist")
    return M.match_windows(e, wins(s, d), ["user_id"], "event_t", "lo", "hi", ["lo", "win_id"],
                           ["event_t"], ["win_id", "t1"], 16200.0)


@query("event_window_match", f"""WITH {MATCH_CTE}
SELECT user_id, event_t, min_dist, win_id AS win_win_id, win_t1 FROM matched""")
def _(s, d):
    return matched(s, d)


@query("one_event_per_window", f"""WITH {MATCH_CTE}
SELECT user_id, win_id AS win_win_id, win_t1, count(*) AS n_events,
  arg_min(event_t, (abs(event_t - win_t1), event_t)) AS event_t,
  arg_min(min_dist, (abs(event_t - win_t1), event_t)) AS min_dist
FROM matched WHERE win_id IS NOT NULL GROUP BY user_id, win_id, win_t1""")
def _(s, d):
    return M.one_per_window(matched(s, d), ["user_id", "win_win_id", "win_t1"], "event_t",
                            "win_t1", ["min_dist"])


@query("windows_hit", f"""WITH {EVENTS_CTE}
SELECT w.*, EXISTS (SELECT 1 FROM spot s WHERE s.user_id = w.user_id
   AND s.event_t BETWEEN w.lo AND w.hi) AS hit FROM wins w""")
def _(s, d):
    return M.windows_hit(spotted(s, d), wins(s, d), ["user_id"], "event_t", "lo", "hi", day)[0]


@query("events_matched", f"""WITH {EVENTS_CTE}
SELECT s.user_id, s.event_t, EXISTS (SELECT 1 FROM wins w WHERE s.user_id = w.user_id
   AND s.event_t BETWEEN w.lo AND w.hi) AS matched FROM spot s""")
def _(s, d):
    e = spotted(s, d).select("user_id", "event_t")
    return M.windows_hit(e, wins(s, d), ["user_id"], "event_t", "lo", "hi", day)[1]


@query("spot_metrics", f"""WITH {EVENTS_CTE},
w AS (SELECT w.user_id, count(*) AS n_gt, sum(CASE WHEN EXISTS (SELECT 1 FROM spot s
   WHERE s.user_id = w.user_id AND s.event_t BETWEEN w.lo AND w.hi) THEN 1 ELSE 0 END) AS hit
   FROM wins w GROUP BY w.user_id),
v AS (SELECT s.user_id, count(*) AS n_ev, sum(CASE WHEN EXISTS (SELECT 1 FROM wins w
   WHERE s.user_id = w.user_id AND s.event_t BETWEEN w.lo AND w.hi) THEN 1 ELSE 0 END) AS ok
   FROM spot s GROUP BY s.user_id)
SELECT user_id, coalesce(n_gt, 0) AS n_gt, coalesce(n_ev, 0) AS n_ev,
  CASE WHEN n_gt > 0 THEN CAST(hit AS DOUBLE) / n_gt ELSE 0 END AS recall,
  CASE WHEN n_ev > 0 THEN CAST(ok AS DOUBLE) / n_ev ELSE 0 END AS precision,
  CAST(coalesce(n_ev - ok, 0) AS BIGINT) AS n_false FROM w FULL JOIN v USING (user_id)""",
       {6: "recall precision"})
def _(s, d):
    from orbweave.operators.spotting import spot_scores
    return spot_scores(spotted(s, d).select("user_id", "event_t"), wins(s, d), ["user_id"],
                       "event_t", "lo", "hi", day)


@query("camera_offset_pairs", f"""WITH {TRACKS_CTE}
SELECT a.game_id, a.play_id, a.frame_idx, a.ball_x, b.ball_x AS b_ball_x, b.frame_idx AS b_frame_idx
FROM tracks a JOIN tracks b ON a.game_id = b.game_id AND a.play_id = b.play_id
 AND a.frame_idx + 1 = b.frame_idx WHERE a.angle = 'FR' AND b.angle = 'NR'
 AND a.ball_x IS NOT NULL AND b.ball_x IS NOT NULL""")
def _(s, d):
    t = tracks(s, d).filter("ball_x IS NOT NULL")
    cols = ["game_id", "play_id", "frame_idx", "ball_x"]
    return M.offset_pairs(t.filter("angle = 'FR'").select(*cols),
                          t.filter("angle = 'NR'").select(*cols), T.SHOT, "frame_idx", 1)


NEAR_SQL = """WITH {cte},
l AS (SELECT user_id, event_id, t FROM ev WHERE event_type = 'click'),
r AS (SELECT user_id, t, min(value) AS value FROM ev WHERE event_type = 'view' GROUP BY user_id, t),
j AS (SELECT l.user_id, l.event_id, l.t, arg_min(r.t, (abs(r.t - l.t), r.t)) AS mt,
   arg_min(r.value, (abs(r.t - l.t), r.t)) AS mv FROM l JOIN r ON l.user_id = r.user_id
   AND abs(r.t - l.t) <= {tol} GROUP BY l.user_id, l.event_id, l.t)
SELECT l.user_id, l.event_id, l.t, mt AS match_t, mv AS match_value FROM l
LEFT JOIN j ON l.event_id = j.event_id"""


def _near(s, d, tol):
    e = ev(s, d)
    right = (e.filter("event_type = 'view'").groupBy("user_id", "t")
             .agg(F.min("value").alias("value")).withColumnRenamed("t", "rt"))
    return M.nearest(e.filter("event_type = 'click'"), right, ["user_id"], "t", "rt", ["value"],
                     day, tol, ["event_id"])


@query("nearest_within_tolerance", NEAR_SQL.format(cte=HITS_CTE, tol=36000))
def _(s, d):
    return _near(s, d, 36000)


@query("nearest_unbounded", NEAR_SQL.format(cte=HITS_CTE, tol=10**12))
def _(s, d):
    return _near(s, d, None)


@query("nearest_to_apex", f"""WITH {HITS_CTE},
p AS (SELECT user_id, arg_max(t, (value, -event_id)) AS apex_t FROM ev GROUP BY user_id)
SELECT p.user_id, p.apex_t, arg_min(e.t, (abs(e.t - apex_t), e.t)) AS near_t,
  arg_min(e.value, (abs(e.t - apex_t), e.t, e.event_id)) AS near_value FROM p JOIN ev e
  ON e.user_id = p.user_id AND e.event_type = 'view' GROUP BY p.user_id, p.apex_t""")
def _(s, d):
    e = ev(s, d)
    apex = e.groupBy("user_id").agg(F.max_by("t", F.struct("value", -F.col("event_id")))
                                    .alias("apex_t"))
    return M.nearest_per_key(apex, e.filter("event_type = 'view'"), ["user_id"], "apex_t", "t",
                             ["value"], ["event_id"])


@query("best_constant_offset", f"""WITH {HITS_CTE},
h AS (SELECT user_id, t // 3600 AS t FROM ev WHERE event_type = 'click'),
g AS (SELECT user_id, t // 3600 AS tt FROM ev WHERE event_type = 'purchase'),
k AS (SELECT h.user_id, o.range AS offset_h, t + o.range AS s FROM h, range(-15, 16) o),
n AS (SELECT user_id, offset_h, count(*) AS n_matched FROM k WHERE EXISTS (SELECT 1 FROM g
   WHERE g.user_id = k.user_id AND abs(k.s - g.tt) <= 3) GROUP BY user_id, offset_h)
SELECT user_id, CAST(arg_max(offset_h, (n_matched, -abs(offset_h), -offset_h)) AS INTEGER)
   AS "offset", max(n_matched) AS n_matched FROM n GROUP BY user_id""")
def _(s, d):
    e = ev(s, d).withColumn("t", F.floor(F.col("t") / 3600))
    return M.best_offset(e.filter("event_type = 'click'"),
                         e.filter("event_type = 'purchase'").withColumnRenamed("t", "tt"),
                         ["user_id"], "t", "tt", list(range(-15, 16)), 3)


@query("density_cluster", """WITH g AS (SELECT user_id, value AS v, count(*) AS c FROM events
  GROUP BY user_id, value),
w AS (SELECT user_id, v, sum(c) OVER q AS n, sum(v * c) OVER q / sum(c) OVER q AS m FROM g
  WINDOW q AS (PARTITION BY user_id ORDER BY v RANGE BETWEEN 1.25 PRECEDING AND 1.25 FOLLOWING))
SELECT user_id, arg_max(m, (n, -v)) AS cluster_mean, CAST(max(n) AS BIGINT) AS support,
  arg_max(v, (n, -v)) AS center FROM w GROUP BY user_id""", {6: "cluster_mean"})
def _(s, d):
    return M.densest(table(s, d, "events"), ["user_id"], "value", 1.25)


@query("close_tracks", f"""WITH {TRACKS_CTE},
pts AS (SELECT game_id, play_id, angle, frame_idx, ball_x + ball_w / 2 AS cx,
   ball_y + ball_h / 2 AS cy FROM tracks WHERE ball_x IS NOT NULL),
sp AS (SELECT {K3}, max(cy) - min(cy) AS span FROM pts GROUP BY {K3} HAVING count(*) >= 3),
mx AS (SELECT game_id, play_id, max(span) AS ms FROM sp GROUP BY game_id, play_id),
kept AS (SELECT sp.game_id, sp.play_id, sp.angle FROM sp JOIN mx ON sp.game_id = mx.game_id
   AND sp.play_id = mx.play_id WHERE span >= 0.9 * ms),
kp AS (SELECT p.* FROM pts p JOIN kept k ON p.game_id = k.game_id AND p.play_id = k.play_id
   AND p.angle = k.angle),
o AS (SELECT DISTINCT p.game_id, p.play_id, p.angle FROM pts p JOIN kp k ON p.game_id = k.game_id
   AND p.play_id = k.play_id AND p.angle <> k.angle AND abs(p.frame_idx - k.frame_idx) <= 5
   AND (p.cx-k.cx)*(p.cx-k.cx) + (p.cy-k.cy)*(p.cy-k.cy) < 900.0)
SELECT {K3} FROM kept UNION SELECT {K3} FROM o""")
def _(s, d):
    pts = tracks(s, d).filter("ball_x IS NOT NULL").select(
        *T.TRACK, "frame_idx", B.center_x("ball").alias("cx"), B.center_y("ball").alias("cy"))
    from orbweave.operators.selection import span_tracks
    kept = span_tracks(pts, T.SHOT, "angle", share=0.9)
    return M.join_close_tracks(pts, kept, T.SHOT, "angle", 5, 30.0)


@query("track_span_keep", f"""WITH {TRACKS_CTE},
pts AS (SELECT {K3}, ball_y + ball_h / 2 AS cy FROM tracks WHERE ball_x IS NOT NULL),
sp AS (SELECT {K3}, max(cy) - min(cy) AS span, count(*) AS n FROM pts GROUP BY {K3}),
mx AS (SELECT game_id, play_id, max(CASE WHEN n >= 3 THEN span END) AS ms FROM sp
   GROUP BY game_id, play_id)
SELECT sp.game_id, sp.play_id, sp.angle FROM sp JOIN mx ON sp.game_id = mx.game_id
 AND sp.play_id = mx.play_id WHERE ms IS NOT NULL AND (ms < 50 OR (n >= 3 AND span >= 0.6 * ms))""")
def _(s, d):
    from orbweave.operators.selection import span_tracks
    pts = tracks(s, d).filter("ball_x IS NOT NULL").select(
        *T.TRACK, "frame_idx", B.center_y("ball").alias("cy"))
    return span_tracks(pts, T.SHOT, "angle")


@query("next_gap", """WITH o AS (SELECT o_custkey, o_orderkey,
  epoch_us(o_orderdate) // 1000000 AS s FROM orders)
SELECT o_custkey, o_orderkey, s, lead(s) OVER (PARTITION BY o_custkey ORDER BY s, o_orderkey)
  - (s + 3600) AS gap_to_next FROM o""")
def _(s, d):
    o = _orders(s, d)
    return M.gap_to_next(o.withColumn("e", F.col("s") + 3600), ["o_custkey"], ["s", "o_orderkey"],
                         "s", "e", ordered.value_bucket("s", 30 * DAY)).drop("e")


def _orders(s, d):
    return table(s, d, "orders").select("o_custkey", "o_orderkey", F.floor(
        ordered.micros("o_orderdate") / 1_000_000).alias("s"))


@query("idle_gaps", f"""WITH o AS (SELECT o_custkey, o_orderkey,
  epoch_us(o_orderdate) // 1000000 // 86400 AS s FROM orders),
n AS (SELECT *, lead(s) OVER (PARTITION BY o_custkey ORDER BY s, o_orderkey) AS nx FROM o)
SELECT o_custkey, s + 1 + 3 AS idle_start, nx - 3 AS idle_end FROM n WHERE nx - (s + 1) > 8""")
def _(s, d):
    o = _orders(s, d).withColumn("s", F.floor(F.col("s") / DAY)).withColumn("e", F.col("s") + 1)
    return M.idle_gaps(o, ["o_custkey"], ["s", "o_orderkey"], "s", "e",
                       ordered.value_bucket("s", 30), 8, 3)


# ---- ordered rows ------------------------------------------------------------
@query("median_of_three", f"""WITH {TRACKS_CTE},
v AS (SELECT {K3}, frame_idx, ball_y, lag(ball_y) OVER w AS p, lead(ball_y) OVER w AS n FROM tracks
  WHERE ball_y IS NOT NULL WINDOW w AS (PARTITION BY {K3} ORDER BY frame_idx))
SELECT {K3}, frame_idx, ball_y, CASE WHEN p IS NULL OR n IS NULL THEN ball_y
  ELSE list_sort([p, ball_y, n])[2] END AS med3 FROM v""")
def _(s, d):
    r = tracks(s, d).filter("ball_y IS NOT NULL").select(*T.TRACK, "frame_idx", "ball_y")
    return S.median3(r, "ball_y")


@query("median_smooth", f"""WITH {TRACKS_CTE}
SELECT {K3}, frame_idx, median(coalesce(rim_x, 0)) OVER (PARTITION BY {K3} ORDER BY frame_idx
  ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS x_smooth FROM tracks""")
def _(s, d):
    r = tracks(s, d).select(*T.TRACK, "frame_idx", F.coalesce("rim_x", F.lit(0.0)).alias("x"))
    return S.median_smooth(r, ["x"], 9).drop("x")


@query("moving_average", f"""WITH {TRACKS_CTE},
v AS (SELECT {K3}, frame_idx, coalesce(ball_y, 0) AS y FROM tracks)
SELECT {K3}, frame_idx, CASE WHEN lag(y) OVER w IS NULL THEN avg(y) OVER f
   WHEN lead(y) OVER w IS NULL THEN avg(y) OVER b ELSE avg(y) OVER m END AS avg3 FROM v
WINDOW w AS (PARTITION BY {K3} ORDER BY frame_idx),
 f AS (PARTITION BY {K3} ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING),
 b AS (PARTITION BY {K3} ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
 m AS (PARTITION BY {K3} ORDER BY frame_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""",
       {6: "avg3"})
def _(s, d):
    r = tracks(s, d).select(*T.TRACK, "frame_idx", F.coalesce("ball_y", F.lit(0.0)).alias("y"))
    return S.moving_average3(r, "y", T.TRACK, "frame_idx").drop("y")


def _interp_sql(col):
    return f"""CASE WHEN {col} IS NOT NULL THEN {col} WHEN {col}_l IS NULL THEN {col}_r.v
  WHEN {col}_r IS NULL THEN {col}_l.v ELSE {col}_l.v + CAST(frame_idx - {col}_l.p AS DOUBLE)
  / ({col}_r.p - {col}_l.p) * ({col}_r.v - {col}_l.v) END"""


def _fill_sql(col):
    s = f"CASE WHEN {col} IS NOT NULL THEN {{'p': frame_idx, 'v': {col}}} END"
    return (f"last_value({s} IGNORE NULLS) OVER (PARTITION BY {K3} ORDER BY frame_idx "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {col}_l, "
            f"first_value({s} IGNORE NULLS) OVER (PARTITION BY {K3} ORDER BY frame_idx "
            f"ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS {col}_r")


@query("gap_interpolate", f"""WITH {TRACKS_CTE},
f AS (SELECT {K3}, frame_idx, ball_x, {_fill_sql('ball_x')} FROM tracks)
SELECT {K3}, frame_idx, ball_x, {_interp_sql('ball_x')} AS ball_x_filled FROM f""",
       {6: "ball_x_filled"})
def _(s, d):
    r = tracks(s, d).select(*T.TRACK, "frame_idx", "ball_x")
    return S.interpolate_hold(r, ["ball_x"])


@query("stable_boxes", f"""WITH {TRACKS_CTE},
f AS (SELECT {K3}, frame_idx, rim_x, rim_y, rim_w, rim_h, {_fill_sql('rim_x')},
  {_fill_sql('rim_y')}, {_fill_sql('rim_w')}, {_fill_sql('rim_h')} FROM tracks),
g AS (SELECT {K3}, frame_idx, rim_x IS NOT NULL AND rim_w IS NOT NULL AS rim_ok,
  {_interp_sql('rim_x')} AS x, {_interp_sql('rim_y')} AS y, {_interp_sql('rim_w')} AS w,
  {_interp_sql('rim_h')} AS h FROM f),
m AS (SELECT {K3}, frame_idx, rim_ok, median(x) OVER q AS x, median(y) OVER q AS y,
  median(w) OVER q AS w, median(h) OVER q AS h FROM g WINDOW q AS (PARTITION BY {K3}
  ORDER BY frame_idx ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING))
SELECT {K3}, frame_idx, rim_ok, CASE WHEN w > 0 AND h > 0 THEN x END AS stable_rim_x,
 CASE WHEN w > 0 AND h > 0 THEN y END AS stable_rim_y,
 CASE WHEN w > 0 AND h > 0 THEN w END AS stable_rim_w,
 CASE WHEN w > 0 AND h > 0 THEN h END AS stable_rim_h FROM m""",
       {6: "stable_rim_x stable_rim_y stable_rim_w stable_rim_h"})
def _(s, d):
    r = tracks(s, d).select(*T.TRACK, "frame_idx", "rim_x", "rim_y", "rim_w", "rim_h")
    return S.stable_boxes(r).drop("rim_x", "rim_y", "rim_w", "rim_h")


SPIKE_CTE = TRACKS_CTE + f""",
rul AS (SELECT {K3}, median(rim_w) AS ruler FROM tracks WHERE rim_w > 1 GROUP BY {K3}),
dd AS (SELECT {K3}, frame_idx, ball_x + ball_w / 2 AS cx, ball_y + ball_h / 2 AS cy FROM tracks
  WHERE ball_x IS NOT NULL),
nn AS (SELECT *, lag(cx) OVER w AS px, lag(cy) OVER w AS py, lead(cx) OVER w AS nx,
  lead(cy) OVER w AS ny, count(*) OVER (PARTITION BY {K3}) AS nd FROM dd
  WINDOW w AS (PARTITION BY {K3} ORDER BY frame_idx)),
st AS (SELECT nn.*, ruler, sqrt((cx-px)*(cx-px)+(cy-py)*(cy-py)) AS dp,
  sqrt((cx-nx)*(cx-nx)+(cy-ny)*(cy-ny)) AS dn, sqrt((nx-px)*(nx-px)+(ny-py)*(ny-py)) AS pn
  FROM nn JOIN rul ON nn.game_id = rul.game_id AND nn.play_id = rul.play_id AND nn.angle = rul.angle),
rej AS (SELECT *, nd >= 3 AND CASE WHEN dp IS NOT NULL AND dn IS NOT NULL
    THEN dp > 2.5*ruler AND dn > 2.5*ruler AND pn < 0.5*(dp+dn)
  WHEN dp IS NOT NULL THEN dp > 2.5*ruler WHEN dn IS NOT NULL THEN dn > 2.5*ruler
  ELSE false END AS r FROM st),
marked AS (SELECT t.*, coalesce(r, false) AS rejected FROM tracks t LEFT JOIN rej
  ON t.game_id = rej.game_id AND t.play_id = rej.play_id AND t.angle = rej.angle
  AND t.frame_idx = rej.frame_idx)
"""
GAP_CTE = SPIKE_CTE + f""",
kp AS (SELECT *, ball_x IS NOT NULL AND NOT rejected AS kept FROM marked),
ed AS (SELECT *, last_value(CASE WHEN kept THEN {{'p': frame_idx, 'c': ball_conf}} END IGNORE NULLS)
   OVER (PARTITION BY {K3} ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l,
  first_value(CASE WHEN kept THEN {{'p': frame_idx, 'c': ball_conf}} END IGNORE NULLS)
   OVER (PARTITION BY {K3} ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r
  FROM kp),
gap AS (SELECT *, coalesce(NOT kept AND r.p - l.p - 1 <= 12 AND l.c >= 0.3 AND r.c >= 0.3, false)
  AS trusted FROM ed)
"""


@query("spike_reject", f"WITH {SPIKE_CTE} SELECT {K3}, frame_idx, rejected FROM marked")
def _(s, d):
    return S.reject_spikes(tracks(s, d)).select(*T.TRACK, "frame_idx", "rejected")


def _gaps(s, d):
    r = S.reject_spikes(tracks(s, d))
    return S.trusted_gaps(r, F.col("ball_x").isNotNull() & ~F.col("rejected"))


@query("bounded_gaps", f"WITH {GAP_CTE} SELECT {K3}, frame_idx, trusted FROM gap")
def _(s, d):
    return _gaps(s, d).select(*T.TRACK, "frame_idx", "trusted")


@query("track_quality", f"""WITH {GAP_CTE},
q AS (SELECT {K3}, avg(CASE WHEN kept THEN 1.0 ELSE 0.0 END) AS cov,
  avg(CASE WHEN trusted THEN 1.0 ELSE 0.0 END) AS imp,
  coalesce(avg(CASE WHEN kept THEN ball_conf END), 0) AS mc, max(CASE WHEN rim_w > 1 THEN 1 ELSE 0 END)
  AS rul, sum(CASE WHEN kept THEN 1 ELSE 0 END) AS k FROM gap GROUP BY {K3})
SELECT {K3}, CASE WHEN rul = 1 AND k > 0 THEN least(1, greatest(0, (0.6*cov + 0.4*mc)*(1 - 0.5*imp)))
  ELSE 0 END AS track_quality FROM q""", {8: "track_quality"})
def _(s, d):
    return S.track_quality(_gaps(s, d))


@query("low_band_islands", """WITH v AS (SELECT user_id, event_id, ts, value, value < 60 AS low,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
i AS (SELECT *, rn - row_number() OVER (PARTITION BY user_id, low ORDER BY rn) AS grp FROM v),
z AS (SELECT *, count(*) OVER (PARTITION BY user_id, low, grp) AS m FROM i)
SELECT user_id, event_id, low AND m >= 3 AS in_band, low AND m < 3 AS low_alone FROM z""")
def _(s, d):
    e = table(s, d, "events").select("user_id", "event_id", "ts", "value")
    return S.low_bands(e, "value", ["user_id"], ["ts", "event_id"],
                       ordered.time_bucket("ts", DAY), 60.0, 3).drop("ts", "value")


@query("running_reference", f"""WITH {TRACKS_CTE},
v AS (SELECT {K3}, frame_idx, sqrt(coalesce(ball_x, 7.0)) AS x FROM tracks)
SELECT {K3}, frame_idx, sum(CASE WHEN frame_idx = 1 THEN x ELSE (1 - 0.95) * x END
  * pow(0.95, -frame_idx)) OVER (PARTITION BY {K3} ORDER BY frame_idx) * pow(0.95, frame_idx) AS ema
FROM v""", {6: "ema"})
def _(s, d):
    r = tracks(s, d).select(*T.TRACK, "frame_idx", F.sqrt(F.coalesce("ball_x", F.lit(7.0))).alias("x"))
    return S.running_reference(r, "x", T.TRACK, "frame_idx").drop("x")


CENTER_CTE = TRACKS_CTE + f""",
dd AS (SELECT {K3}, frame_idx, sqrt(pow(ball_x+ball_w/2-rim_x-rim_w/2, 2)
   + pow(ball_y+ball_h/2-rim_y-rim_h/2, 2)) AS dist FROM tracks),
cen AS (SELECT {K3}, count(*) AS n, coalesce(arg_min(frame_idx, (dist, frame_idx))
   FILTER (WHERE dist IS NOT NULL) - 1, count(*) // 2) AS center,
   count(dist) > 0 AS detected FROM dd GROUP BY {K3})"""


@query("closest_index", f"WITH {CENTER_CTE} SELECT * FROM cen")
def _(s, d):
    return S.closest_index(tracks(s, d))


@query("window_positions", f"""WITH {CENTER_CTE},
st AS (SELECT *, CASE WHEN greatest(center - 8, 0) + 16 > n THEN greatest(0, n - 16)
  ELSE greatest(center - 8, 0) END AS st FROM cen)
SELECT {K3}, n, center, detected, CAST(k.range AS INTEGER) AS slot, least(st + k.range, n - 1)
  AS position FROM st, range(16) k""")
def _(s, d):
    return S.window_positions(S.closest_index(tracks(s, d)))


@query("even_positions", f"""WITH {TRACKS_CTE},
c AS (SELECT {K3}, count(*) AS n FROM tracks GROUP BY {K3})
SELECT {K3}, n, CAST(k.range AS INTEGER) AS slot, CASE WHEN n <= 16 THEN least(k.range, n - 1)
  ELSE CAST(round_even(k.range * (n - 1) / 15.0, 0) AS BIGINT) END AS position
FROM c, range(16) k""")
def _(s, d):
    n = tracks(s, d).groupBy(*T.TRACK).agg(F.count(F.lit(1)).alias("n"))
    return S.even_positions(n)


@query("stratified_pick", """WITH o AS (SELECT o_orderpriority AS g, o_orderstatus AS st,
  o_custkey % 3 AS fam, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus,
  o_custkey % 3 ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority,
  o_orderstatus, o_custkey % 3) AS m, min(o_orderkey) OVER (PARTITION BY o_orderpriority,
  o_orderstatus, o_custkey % 3) AS f FROM orders),
r AS (SELECT *, dense_rank() OVER (PARTITION BY g ORDER BY m DESC, f) AS rk, CASE
  WHEN i = m // 2 THEN 0 WHEN (m % 2 = 1) = (i > m // 2) THEN 2 * abs(i - m // 2) - 1
  ELSE 2 * abs(i - m // 2) END AS rnd FROM o),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY rnd, rk) AS pick FROM r)
SELECT g, st, fam, o_orderkey, CAST(pick AS INTEGER) AS pick FROM p WHERE pick <= 25""")
def _(s, d):
    o = table(s, d, "orders").select(
        F.col("o_orderpriority").alias("g"), F.col("o_orderstatus").alias("st"),
        (F.col("o_custkey") % 3).alias("fam"), "o_orderkey")
    return S.stratified_pick(o, ["g"], ["st", "fam"], ["o_orderkey"],
                             ordered.value_bucket("o_orderkey", 100_000))


SWEEP_SQL = HITS_CTE + """,
b AS (SELECT user_id, event_id, t, value / 40 AS need, value AS dist, (event_id * 31) % 101 AS y FROM ev
  WHERE event_type <> 'purchase'),
h0 AS (SELECT user_id, CAST(stride AS INTEGER) AS stride, zone, t, dist, y FROM b,
  (SELECT unnest([1,2,3]) AS stride) s, (SELECT unnest([1.2,1.8,2.5]::DOUBLE[]) AS zone) z
  WHERE event_id % stride = 0 AND need <= zone QUALIFY row_number() OVER (PARTITION BY user_id, stride,
  zone, t ORDER BY dist, y) = 1),
o AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR t - lag(t) OVER w > 7200 THEN 1 ELSE 0 END AS nw FROM h0
  WINDOW w AS (PARTITION BY user_id, stride, zone ORDER BY t)),
c AS (SELECT *, sum(nw) OVER (PARTITION BY user_id, stride, zone ORDER BY t) AS cid FROM o),
e0 AS (SELECT user_id, stride, zone, count(*) AS n, min(t) AS tf, arg_min(t,(dist,t)) AS event_t,
  min(dist) AS md, arg_min(y,t) AS ys, arg_min(y,(dist,t)) AS ye FROM c GROUP BY user_id, stride, zone, cid),
ops AS (SELECT CAST(min_hits AS INTEGER) AS min_hits, reach, downward FROM (SELECT unnest([1,2]) AS min_hits) a,
  (SELECT unnest([-1,0.6,0.8]::DOUBLE[]) AS reach) r, (SELECT unnest([false,true]) AS downward) d),
e1 AS (SELECT e0.*, min_hits, reach, downward FROM e0, ops WHERE n >= min_hits AND (reach < 0 OR
  md <= reach * 40) AND (NOT downward OR event_t = tf OR ye >= ys)),
wx AS (SELECT w.user_id, win_id, lo, hi, CAST(stride AS INTEGER) AS stride, zone, ops.* FROM wins w,
  (SELECT unnest([1,2,3]) AS stride) s, (SELECT unnest([1.2,1.8,2.5]::DOUBLE[]) AS zone) z, ops),
wh AS (SELECT wx.user_id, wx.stride, wx.zone, wx.min_hits, wx.reach, wx.downward, count(*) AS n_gt,
  sum(CASE WHEN x.win_id IS NOT NULL THEN 1 ELSE 0 END) AS hit FROM wx LEFT JOIN (SELECT DISTINCT w.win_id,
   w.stride, w.zone, w.min_hits, w.reach, w.downward FROM wx w JOIN e1 ON w.user_id=e1.user_id AND
   w.stride=e1.stride AND w.zone=e1.zone AND w.min_hits=e1.min_hits AND w.reach=e1.reach AND
   w.downward=e1.downward AND event_t BETWEEN lo AND hi) x ON wx.win_id=x.win_id AND wx.stride=x.stride AND
  wx.zone=x.zone AND wx.min_hits=x.min_hits AND wx.reach=x.reach AND wx.downward=x.downward GROUP BY ALL),
eh AS (SELECT e1.user_id, e1.stride, e1.zone, e1.min_hits, e1.reach, e1.downward, count(*) AS n_ev,
  sum(CASE WHEN EXISTS (SELECT 1 FROM wins w WHERE w.user_id=e1.user_id AND e1.event_t BETWEEN w.lo AND w.hi)
  THEN 1 ELSE 0 END) AS ok FROM e1 GROUP BY ALL)
"""


RATE_SQL = """SELECT stride, zone, min_hits, reach, downward, avg(CAST(hit AS DOUBLE)/n_gt) AS recall,
 avg(CASE WHEN n_gt > 0 THEN CASE WHEN n_ev > 0 THEN CAST(ok AS DOUBLE)/n_ev ELSE 0 END END) AS precision,{more}
 CAST(sum(coalesce(n_ev-ok,0)) AS BIGINT) AS n_false, CAST(sum(coalesce(n_ev,0)) AS BIGINT) AS n_ev
FROM wh FULL JOIN eh USING (user_id, stride, zone, min_hits, reach, downward)"""
FALSE_PM_SQL = f"""WITH {SWEEP_SQL}, span AS (SELECT user_id, greatest(CAST(max(t) - min(t) AS DOUBLE) / 60, 1) AS minutes FROM ev GROUP BY 1),
sw AS ({RATE_SQL.format(more=" avg(CASE WHEN n_gt > 0 THEN coalesce(n_ev-ok,0)/minutes END) AS false_pm,")}
 JOIN span USING (user_id) GROUP BY ALL) SELECT * FROM sw"""
CONFIG_ORDER = "stride, zone, min_hits, reach, downward LIMIT 12"


def swept(s, d, rate=False):
    """Scores of all spotter configurations over the event table; with ``rate`` also false events per minute."""
    from orbweave.operators.spotting import SWEEP, config_sweep
    e = ev(s, d).filter("event_type <> 'purchase'")
    balls = e.select("user_id", F.col("event_id").alias("step"), "t", (F.col("value") / 40).alias("need"),
                     F.col("value").alias("dist"), ((F.col("event_id") * 31) % 101).alias("y"))
    spans = ev(s, d).groupBy("user_id").agg(((F.max("t") - F.min("t")) / 60).alias("minutes")) if rate else None
    return config_sweep(balls, wins(s, d), ["user_id"], day, 40.0, {**SWEEP, "gap": (7200,)}, spans)


@query("spotter_sweep", f"WITH {SWEEP_SQL} {RATE_SQL.format(more='')} GROUP BY ALL", {6: "recall precision"})
def _(s, d):
    return swept(s, d)


@query("spotter_false_rate", FALSE_PM_SQL, {6: "recall precision false_pm"})
def _(s, d):
    """All spotter configurations with their false events per minute."""
    return swept(s, d, rate=True)


@query("spotter_rate_top", f"""SELECT * FROM ({FALSE_PM_SQL})
ORDER BY round(recall, 9) DESC, round(precision, 9) DESC, round(false_pm, 9), {CONFIG_ORDER}""", {6: "recall precision false_pm"})
def _(s, d):
    """The twelve best spotter configurations, ranked down to their false events per minute."""
    from orbweave.operators.spotting import rank_configs
    return rank_configs(swept(s, d, rate=True))


@query("spotter_sweep_top", f"""SELECT * FROM (WITH {SWEEP_SQL} {RATE_SQL.format(more='')} GROUP BY ALL)
ORDER BY round(recall, 9) DESC, round(precision, 9) DESC, n_false, {CONFIG_ORDER}""", {6: "recall precision"})
def _(s, d):
    """The twelve best spotter configurations."""
    from orbweave.operators.spotting import rank_configs
    return rank_configs(swept(s, d))
