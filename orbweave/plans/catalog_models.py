"""Registered queries: signal arrays, model validation and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbweave.functions import ordered
from orbweave.functions import fixed as K
from orbweave.operators import boost, evaluate as E, learn as Y, shotmodel, signal as G, spotting as P, stack, trajectory as H
from orbweave.operators.tables import balance, feature_buckets, numeric_features
from orbweave.plans.catalog_decide import predicted, split_by_game
from orbweave.plans.inputs import SAMPLES_CTE, SCORED_CTE, samples, scored
from orbweave.plans.registry import query, table
from orbweave.streaming import spotter as W

FR_CTE = """fr AS (SELECT vec_id // 50 AS clip, vec_id % 50 AS pos, embedding FROM embeddings),
en AS (SELECT clip, pos, CASE WHEN lag(pos) OVER w = pos - 1 THEN list_avg(list_transform(
  list_zip(embedding, lag(embedding) OVER w), lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))))
  ELSE 0 END AS energy FROM fr WINDOW w AS (PARTITION BY clip ORDER BY pos))
"""


def frames(s, d):
    """All vectors as frames of 50-frame clips."""
    v = F.col("vec_id")
    return table(s, d, "embeddings").select(
        F.floor(v / 50).alias("clip"), (v % 50).alias("pos"), "embedding")


@query("frame_energy", f"WITH {FR_CTE} SELECT * FROM en", {6: "energy"})
def _(s, d):
    return G.frame_energy(frames(s, d), ["clip"], "pos", "embedding")


@query("region_variance", f"""WITH {FR_CTE},
m AS (SELECT clip, list_avg(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS m FROM fr)
SELECT clip, var_pop(m) AS roi_var FROM m GROUP BY clip""", {8: "roi_var"})
def _(s, d):
    return G.region_variance(frames(s, d), ["clip"], "embedding")


@query("motion_anchor", f"""WITH {FR_CTE},
a AS (SELECT clip, arg_max(pos, (energy, -pos)) AS anchor, max(energy) AS peak_energy, max(pos) + 1 AS n
  FROM en GROUP BY clip)
SELECT clip, anchor, peak_energy, greatest(anchor - 20, 0) AS lo, least(anchor + 41, n) AS hi FROM a""",
       {6: "peak_energy"})
def _(s, d):
    return G.motion_anchor(G.frame_energy(frames(s, d), ["clip"], "pos", "embedding"), ["clip"], "pos")


WAVE_CTE = """wv AS (SELECT vec_id, embedding, CASE WHEN vec_id % 7 = 0 THEN NULL
  ELSE CAST(vec_id % 10 AS DOUBLE) / 10 END AS ev FROM embeddings)"""


def waves(s, d):
    v = F.col("vec_id")
    return table(s, d, "embeddings").select(
        "vec_id", "embedding", F.when(v % 7 != 0, (v % 10).cast("double") / 10).alias("ev"))


@query("anchored_slice", f"""WITH {WAVE_CTE},
c AS (SELECT *, CAST(trunc((ev - 0.25) * 64) AS BIGINT) AS lo, CAST(trunc((ev + 0.25) * 64) AS BIGINT) AS hi FROM wv),
r AS (SELECT *, CASE WHEN ev IS NULL THEN 'no_rim_event' WHEN lo < 0 OR hi >= 64 THEN 'out_of_range'
  ELSE 'ok' END AS why FROM c)
SELECT vec_id, why, CASE WHEN why = 'ok' THEN hi - lo END AS n, CASE WHEN why = 'ok' THEN
 list_avg(list_transform(embedding[lo+1:hi], lambda x: CAST(x AS DOUBLE))) END AS mean FROM r""", {6: "mean"})
def _(s, d):
    r = G.anchored_slice(waves(s, d), "embedding", "ev", 64, 0.25, 0.25)
    total = F.aggregate("window", F.lit(0.0), lambda a, x: a + x.cast("double"))
    ok = F.col("why") == "ok"
    return r.select("vec_id", "why", F.when(ok, F.size("window").cast("long")).alias("n"),
                    F.when(ok, total / F.size("window")).alias("mean"))


@query("signal_features")
def _(s, d):
    """Loudness, band shares, centroid and onset of every vector read as a short waveform."""
    r = waves(s, d).withColumn("f", G.audio_features(64)("embedding"))
    return r.select("vec_id", "f.*")


def clip_sounds(s, d):
    """Two cameras' waveforms per clip of eight vectors: the far one is the sound, the near one hears it later, weaker
    and over noise of its own; the delay of 1, 3, 5, 7 or 9 samples is the game's."""
    v = F.col("vec_id")
    e = table(s, d, "embeddings").select(F.floor(v / 8).alias("clip"), v.alias("at"), F.transform(
        "embedding", lambda x: x.cast("double")).alias("e"))
    c = e.groupBy("clip").agg(F.sort_array(F.collect_list(F.struct("at", "e"))).alias("p")).filter("size(p) = 8").select(
        (F.col("clip") % 5).alias("game"), "clip", F.flatten(F.transform("p", lambda x: x["e"])).alias("w"))
    far = F.slice("w", 33, 448)
    near = F.zip_with(F.slice("w", F.lit(32) - F.col("game").cast("int") * 2, 448), F.reverse(far), lambda x, y: x * 0.8 + y * 0.3)
    return c.select("game", "clip", F.explode(F.create_map(F.lit("FR"), far, F.lit("NR"), near)).alias("angle", "wave"))


@query("signal_offset", """WITH c AS (SELECT vec_id // 8 AS clip, (vec_id // 8) % 5 AS game FROM embeddings GROUP BY ALL HAVING count(*) = 8)
SELECT game, CAST(2 * game + 1 AS DOUBLE) AS residual, count(*) AS support, CAST(2 * game + 2 AS DOUBLE) AS true_offset
FROM c GROUP BY game""", {6: "residual true_offset"})
def _(s, d):
    """Camera offset of every game from its clips' two waveforms; the twin states the delay that was put in."""
    pairs = G.camera_pairs(clip_sounds(s, d), ["game", "clip"], "angle", "wave", "FR", "NR")
    return G.true_offset(pairs, ["game"], "a", "b", 64, 1.0, fps=64.0)


# ---- validation ---------------------------------------------------------------------
FEATS = ["prob", "prob2", "n_chars"]


def model_rows(s, d):
    return split_by_game(Y.as_numbers(scored(s, d), FEATS))


@query("logistic_select_test")
def _(s, d):
    """Model and threshold chosen on val, refit, one test evaluation."""
    return Y.select_refit_test(model_rows(s, d), {
        "logistic": Y.logistic(FEATS), "boosted": Y.boosted(FEATS, 3, 0.08, 300)})


@query("group_cv")
def _(s, d):
    """Group k-fold by game: mean and std of accuracy, F1 and AUC."""
    return Y.cv_summary(Y.group_cv(model_rows(s, d), Y.logistic(FEATS), 4))


@query("gbt_logo")
def _(s, d):
    """Leave-one-game-out boosted trees with an inner validation game."""
    return boost.leave_one_game_out(model_rows(s, d), FEATS, depth=4, rate=0.08, rounds=500, leaf=40)


# every throw with texts and camera evidence derived from its samples
CAMERA_SQL = """{c}d AS (SELECT *, nr_x - {shift} BETWEEN 714 AND 1138 AND nr_y BETWEEN 953 AND 1110 AS deep FROM samples),
{c}0 AS (SELECT game_id, shot, min(t) FILTER (WHERE deep) AS t0 FROM {c}d GROUP BY game_id, shot),
{c}m AS (SELECT game_id, shot, max(nr_y) FILTER (WHERE deep AND t-t0<=1) AS my, arg_max(t,(nr_y,-t))
 FILTER (WHERE deep AND t-t0<=1) AS mt, count(*) FILTER (WHERE deep AND t-t0<=1) AS n_deep
 FROM {c}d JOIN {c}0 USING (game_id, shot) GROUP BY game_id, shot),
{c}b AS (SELECT game_id, shot, max(my) AS my, max(n_deep) AS n_deep, min(nr_y) FILTER (WHERE t>mt AND t-mt<=0.4
 AND nr_x - {shift} BETWEEN 514 AND 1338 AND nr_y>=776) AS b FROM {c}d JOIN {c}m USING (game_id, shot) GROUP BY game_id, shot),
{c}l AS (SELECT *, my - least(my, coalesce(b, my)) AS dl FROM {c}b),
{c}v AS (SELECT game_id, shot, CASE WHEN n_deep=0 THEN 'UND' WHEN dl>=150 THEN 'MISS' WHEN n_deep>=5 AND dl<40 THEN 'MAKE'
 WHEN dl>=60 THEN 'MISS-weak' ELSE 'MAKE-weak' END AS {c}, my AS {c}_cy, dl AS {c}_px, n_deep AS {c}_deep FROM {c}l)"""
SHOT_COLUMNS_SQL = f"""WITH {SAMPLES_CTE}, {CAMERA_SQL.format(c='fr', shift=150)}, {CAMERA_SQL.format(c='nr', shift=0)},
tx AS (SELECT DISTINCT game_id, shot, CASE WHEN shot % 2 = 0 THEN 'FG_MAKE' ELSE 'FG_MISS' END AS gt,
 CASE shot % 4 WHEN 0 THEN 'MAKE (passed through rim plane at r=' || shot % 37 || 'cm)'
  WHEN 1 THEN 'MISS RIM-OUT bounce=' || shot % 23 || 'cm' WHEN 2 THEN 'UNDECIDED no clear make signal'
  ELSE 'MISS (crossed r=' || shot % 90 || 'cm, gap-stop)' END AS verdict FROM samples),
ap AS (SELECT game_id, shot, count(*) AS n, arg_max({{'f': frame, 'x': x, 'y': y, 'z': z}}, (z, -frame)) AS a
 FROM samples GROUP BY game_id, shot),
lo AS (SELECT game_id, shot, min(z) AS z_min FROM samples JOIN ap USING (game_id, shot) WHERE frame >= a.f GROUP BY game_id, shot),
nu AS (SELECT *, coalesce(nullif(TRY_CAST(regexp_extract(verdict, 'r=([0-9]+)cm', 1) AS DOUBLE), 0), -1.0) AS cr,
 coalesce(nullif(TRY_CAST(regexp_extract(verdict, 'bounce=([0-9]+)cm', 1) AS DOUBLE), 0), 0.0) AS bo FROM tx)
SELECT game_id, shot, gt, CAST(gt = 'FG_MAKE' AS INTEGER) AS label, n AS n_samples,
 CASE WHEN n<3 THEN -1.0 ELSE sqrt(pow(a.x - 2008.7, 2) + pow(a.y - 713.2, 2)) END AS apex_r,
 CASE WHEN n<3 THEN -1.0 ELSE a.z END AS apex_z, CASE WHEN n<3 THEN -1.0 ELSE cr END AS cross_r,
 CASE WHEN n<3 THEN -1.0 ELSE z_min END AS z_min, CASE WHEN n<3 THEN -1.0 ELSE bo END AS bounce_cm,
 CAST(starts_with(verdict, 'MAKE') AS INTEGER) AS tri_make, CAST(starts_with(verdict, 'MISS') AS INTEGER) AS tri_miss,
 CAST(starts_with(verdict, 'UNDECIDED') AS INTEGER) AS tri_und, CAST(contains(verdict, 'RIM-OUT') AS INTEGER) AS tri_has_rim_out,
 0 AS tri_has_rim_bounce, CAST(contains(verdict, 'gap-stop') AS INTEGER) AS tri_has_gap_stop, 0 AS tri_has_smooth_descent,
 CAST(contains(verdict, 'passed through') AS INTEGER) AS tri_has_pass_through, 0 AS tri_has_clean_clean,
 CAST(contains(verdict, 'no clear make signal') AS INTEGER) AS tri_has_no_clear,
 {{cams}} FROM nu JOIN ap USING (game_id, shot) JOIN lo USING (game_id, shot) JOIN frv USING (game_id, shot) JOIN nrv USING (game_id, shot)"""
CAMERA_COLUMNS_SQL = ", ".join(f"""CASE WHEN {c}='UND' THEN 0 WHEN {c} LIKE '%-weak' THEN 1 ELSE 2 END AS {c}_strength,
 CAST(starts_with({c}, 'MAKE') AS INTEGER) AS {c}_is_make, CAST(starts_with({c}, 'MISS') AS INTEGER) AS {c}_is_miss,
 CAST({c}_deep AS DOUBLE) AS {c}_n_deep, coalesce({c}_px, 0.0) AS {c}_rebound_px, coalesce(nullif({c}_cy, 0), -1.0) AS {c}_max_cy"""
                               for c in ("fr", "nr"))


def shot_rows(s, d):
    x = samples(s, d)
    out = x.select("game_id", "shot").distinct()
    n = F.col("shot")
    text = (F.when(n % 4 == 0, F.concat(F.lit("MAKE (passed through rim plane at r="), (n % 37).cast("string"), F.lit("cm)")))
            .when(n % 4 == 1, F.concat(F.lit("MISS RIM-OUT bounce="), (n % 23).cast("string"), F.lit("cm")))
            .when(n % 4 == 2, "UNDECIDED no clear make signal")
            .otherwise(F.concat(F.lit("MISS (crossed r="), (n % 90).cast("string"), F.lit("cm, gap-stop)"))))
    out = out.withColumn("gt", F.when(n % 2 == 0, "FG_MAKE").otherwise("FG_MISS")).withColumn("verdict", text).withColumn("tri", text)
    for c, shift in (("fr", 150), ("nr", 0)):
        v = H.single_camera(x.withColumn("px", F.col("nr_x") - shift).withColumnRenamed("nr_y", "py"), H.SHOT, K.NEAR_HOOP_BOX)
        out = out.join(v.withColumnsRenamed({"camera_verdict": c, "max_cy": f"{c}_max_cy", "rebound_px": f"{c}_rebound_px",
                                             "n_deep": f"{c}_n_deep"}), list(H.SHOT))
    return shotmodel.shot_columns(out, x)


@query("shot_classifier_columns", SHOT_COLUMNS_SQL.replace("{cams}", CAMERA_COLUMNS_SQL),
       {6: "apex_r apex_z z_min fr_rebound_px fr_max_cy nr_rebound_px nr_max_cy"})
def _(s, d):
    return shot_rows(s, d)


@query("shot_classifier")
def _(s, d):
    """The 28-column classifier, every game held out once: metrics per game."""
    return shotmodel.held_out_games(shot_rows(s, d))


@query("balance_counts", f"""WITH {SCORED_CTE}
SELECT CASE WHEN grouping(game_id) = 1 THEN 'ALL' ELSE game_id END AS game, count(*) AS n, count(*) FILTER (WHERE n_chars >= 200) AS usable,
 count(*) FILTER (WHERE coalesce(n_chars < 200, true)) AS unusable, count(*) FILTER (WHERE n_chars >= 200 AND label = 1) AS makes,
 count(*) FILTER (WHERE n_chars >= 200 AND label = 0) AS misses, count(DISTINCT game_id) FILTER (WHERE n_chars >= 200) AS n_games
FROM scored GROUP BY ROLLUP (game_id)""")
def _(s, d):
    """Usable and unusable records per game; records of 200 characters and more are usable."""
    return balance(scored(s, d).withColumn("usable", F.col("n_chars") >= 200))


@query("best_single_auc", f"""WITH {SCORED_CTE},
u AS (SELECT label, unnest(['scores','scores','size','size']) AS family, unnest(['prob','prob2','n_chars','half']) AS feature,
 unnest([0, 1, 0, 1]) AS pos, unnest([CASE WHEN doc_id % 7 = 0 THEN NULL ELSE prob END, prob2, CAST(n_chars AS DOUBLE), 0.5]) AS v FROM scored),
m AS (SELECT feature, median(v) AS mid FROM u GROUP BY feature HAVING min(v) < max(v)),
f AS (SELECT family, feature, pos, label, coalesce(v, mid) AS v FROM u JOIN m USING (feature)),
k AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0::DOUBLE AS rk FROM f),
a AS (SELECT family, feature, pos, (sum(rk) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0::DOUBLE)
 / (count(*) FILTER (WHERE label = 1) * CAST(count(*) FILTER (WHERE label = 0) AS DOUBLE)) AS auc FROM k GROUP BY ALL)
SELECT family, feature, greatest(auc, 1 - auc) AS auc FROM a
QUALIFY row_number() OVER (PARTITION BY family ORDER BY greatest(auc, 1 - auc) DESC, pos) = 1""", {6: "auc"})
def _(s, d):
    """Which score and which size separates the labels best alone; a score is missing now and then."""
    r = scored(s, d).withColumn("prob", F.when(F.col("doc_id") % 7 != 0, F.col("prob"))).withColumn("half", F.lit(0.5))
    return E.best_single_auc(r, {"scores": ["prob", "prob2"], "size": ["n_chars", "half"]})


@query("logo_summary")
def _(s, d):
    """Weighted leave-one-game-out means and games meeting all targets."""
    return Y.logo_summary(Y.leave_one_game_out(model_rows(s, d), Y.logistic(FEATS)))


@query("out_of_fold")
def _(s, d):
    """Out-of-fold probability of every row."""
    return Y.out_of_fold(model_rows(s, d), Y.logistic(FEATS)).select("doc_id", "label", "p")


@query("ablation")
def _(s, d):
    """Test metrics with each feature bucket left out; buckets are found by the columns' names."""
    r = model_rows(s, d)
    buckets = feature_buckets(numeric_features(r, ["doc_id", "label", "toxic"]), {"scores": ["prob"], "size": ["n_"]})
    return Y.ablation(r, {b: cols for b, cols in buckets.items() if cols})


@query("permutation_importance")
def _(s, d):
    """F1 lost per permuted column."""
    r = model_rows(s, d)
    return Y.permutation_importance(Y.fit(Y.logistic(FEATS), r), r, FEATS, repeats=10)


@query("stack_logo", f"""WITH {SCORED_CTE},
r AS (SELECT doc_id, game_id, label, ln(p/(1-p)) AS a, ln(q/(1-q)) AS b FROM (SELECT *,
  greatest(1e-4, least(0.9999, prob)) AS p, greatest(1e-4, least(0.9999, prob2)) AS q FROM scored)),
g AS (SELECT DISTINCT game_id FROM r WHERE game_id IS NOT NULL),
c AS (SELECT g.game_id, regr_sxx(r.a, r.a) AS aa, regr_sxx(r.b, r.b) AS bb, covar_pop(r.a, r.b)*count(*) AS ab,
  covar_pop(r.a, r.label)*count(*) AS ay, covar_pop(r.b, r.label)*count(*) AS b_y, avg(r.a) AS ma, avg(r.b) AS mb,
  avg(r.label) AS my FROM g JOIN r ON r.game_id IS DISTINCT FROM g.game_id GROUP BY g.game_id),
w AS (SELECT *, (ay*bb - b_y*ab)/(aa*bb - ab*ab) AS wa, (b_y*aa - ay*ab)/(aa*bb - ab*ab) AS wb FROM c)
SELECT doc_id, label, my + wa*(a - ma) + wb*(b - mb) AS stacked FROM r LEFT JOIN w USING (game_id)""", {6: "stacked"})
def _(s, d):
    """Stacked score of two probabilities, leave one game out."""
    return stack.stack_scores(scored(s, d)).select("doc_id", "label", "stacked")


@query("stack_logistic")
def _(s, d):
    """Two-score logistic stack; no SQL twin, its steps are compared with plain gradient descent in the tests."""
    r = scored(s, d)
    return stack.stack_logistic(r, r).select("doc_id", "label", F.round("stacked", 6).alias("stacked"))


@query("model_weights")
def _(s, d):
    """Largest standardised coefficients."""
    return Y.coefficients(Y.fit(Y.logistic(FEATS), model_rows(s, d)), FEATS, s)


@query("head_to_head", f"""WITH {SCORED_CTE},
v AS (SELECT label, CASE WHEN prob>=0.5 THEN 1 ELSE 0 END AS a, CASE WHEN prob2>=0.5 THEN 1 ELSE 0 END AS b
 FROM scored)
SELECT count(*) AS a_n, avg(CASE WHEN a=label THEN 1.0 ELSE 0.0 END) AS a_accuracy,
 sum(a*label)*1.0/sum(a) AS a_precision, sum(a*label)*1.0/sum(label) AS a_recall,
 2.0*sum(a*label)/(sum(a)+sum(label)) AS a_f1, count(*) AS b_n,
 avg(CASE WHEN b=label THEN 1.0 ELSE 0.0 END) AS b_accuracy, sum(b*label)*1.0/sum(b) AS b_precision,
 sum(b*label)*1.0/sum(label) AS b_recall, 2.0*sum(b*label)/(sum(b)+sum(label)) AS b_f1 FROM v""",
       {6: "a_accuracy a_precision a_recall a_f1 b_accuracy b_precision b_recall b_f1"})
def _(s, d):
    r = predicted(s, d)
    return Y.head_to_head(r, r.withColumn("pred", (F.col("prob2") >= 0.5).cast("int")))


# ---- streams --------------------------------------------------------------------------
@query("spotter_stream", """WITH h AS (SELECT user_id, ts, value FROM events WHERE value <= 60
  AND event_type <> 'purchase'),
o AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 2 HOUR THEN 1 ELSE 0
  END AS nw FROM h WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
c AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts) AS cid FROM o)
SELECT user_id, count(*) AS n_hits, min(value) AS min_dist FROM c GROUP BY user_id, cid
HAVING count(*) >= 2 AND max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) FROM h)""")
def _(s, d):
    ev = W.stream_table(s, d, "events").filter("value <= 60 AND event_type <> 'purchase'")
    h = ev.select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("dist"))
    out = W.run_available(W.hit_sessions(h, ["user_id"], "ts", "2 hours"))
    return out.select("user_id", "n_hits", "min_dist")


REFERENCE_SQL = """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS key, ts, event_id AS frame, event_type <> 'view' AS hoop,
  [300 + sqrt(value), 200, 520 + sqrt(value), 330 + sqrt(value) / 2] AS h, event_id % 3 <> 0 AS ball,
  310.0 + event_id % 300 AS bx, 110.0 + event_id * 7 % 200 AS byy FROM events),
n AS (SELECT *, count(*) FILTER (WHERE hoop) OVER w AS i FROM e WINDOW w AS (PARTITION BY key ORDER BY ts, frame)),
r AS (SELECT *, {boxes} FROM n WINDOW w AS (PARTITION BY key ORDER BY ts, frame)),
d AS (SELECT *, sqrt(pow(bx - (b1 + b3) / 2, 2) + pow(byy - (b2 + b4) / 2, 2)) AS dist FROM r
  WHERE i > 0 AND ball AND ts <= (SELECT date_trunc('milliseconds', max(ts)) FROM events)
  AND bx BETWEEN b1 - 0.2 * (b3 - b1) AND b3 + 0.2 * (b3 - b1) AND byy BETWEEN b2 - 1.2 * (b4 - b2) AND b4),
o AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 2 HOUR THEN 1 ELSE 0 END AS nw
  FROM d WINDOW w AS (PARTITION BY key ORDER BY ts, frame)),
c AS (SELECT *, sum(nw) OVER (PARTITION BY key ORDER BY ts, frame) AS k FROM o)
SELECT key, arg_min(ts, (dist, ts, frame)) AS event_t, min(ts) AS t_first, max(ts) AS t_last, count(*) AS n_hits, min(dist) AS min_dist,
  {last} FROM c GROUP BY key, k HAVING count(*) >= 2 AND max(ts) + INTERVAL 2 HOUR < (SELECT date_trunc('milliseconds', max(ts)) FROM events)
""".format(boxes=", ".join(f"sum(CASE WHEN hoop THEN (CASE WHEN i = 1 THEN 1 ELSE 0.05 END) * h[{q}] * pow(0.95, -i) END) OVER w"
                           f" * pow(0.95, i) AS b{q}" for q in (1, 2, 3, 4)),
           last=", ".join(f"arg_max(b{q}, (ts, frame)) AS {c}" for q, c in ((1, "x1"), (2, "y1"), (3, "x2"), (4, "y2"))))


@query("reference_stream", REFERENCE_SQL, {6: "min_dist x1 y1 x2 y2"})
def _(s, d):
    """Running hoop box and events in its zone from a stream, folded by event time."""
    ev = W.stream_table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    value, hoop, ball = F.sqrt("value"), F.col("event_type") != "view", F.col("event_id") % 3 != 0
    bx, by = F.col("event_id") % 300 + 310.0, F.col("event_id") * 7 % 200 + 110.0
    boxes = dict(zip(W.HOOP, [F.when(hoop, v) for v in (value + 300, F.lit(200.0), value + 520, value / 2 + 330)]))
    boxes |= dict(zip(W.BALL, [F.when(ball, v) for v in (bx - 10, by - 10, bx + 10, by + 10)]))
    rows = ev.select("user_id", "ts", F.col("event_id").alias("frame"), *[v.alias(n) for n, v in boxes.items()])
    return W.run_available(W.reference_events(rows, "user_id", 7200.0))


@query("match_stream", """SELECT c.user_id, c.event_id AS ev_id, w.event_id AS win_id FROM events c
 JOIN events w ON c.user_id = w.user_id AND c.event_type = 'click' AND w.event_type = 'purchase'
 AND c.ts >= w.ts - INTERVAL 2 HOUR AND c.ts <= w.ts + INTERVAL 150 MINUTE""")
def _(s, d):
    def src():
        return W.stream_table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e = src().filter("event_type = 'click'").select("user_id", F.col("ts").alias("event_t"),
                                                    F.col("event_id").alias("ev_id"))
    w = src().filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("win_id"),
                                                       F.col("ts").alias("start"), F.col("ts").alias("end"))
    return W.run_available(W.match_stream(e, w, "user_id", "2 hours", "150 minutes", "30 days",
                                          cols=["ev_id"])).select("user_id", "ev_id", "win_id")
