"""Registered queries: projections, filters, joins and set operations on tables and boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbweave.functions import boxes as B, labels as L, ordered
from orbweave.operators import boxmatch as X, selection as Z, tables as A, tracks as T
from orbweave.plans.inputs import SCORED_CTE, TRACKS_CTE, scored, tracks
from orbweave.plans.registry import query, table

K3 = "game_id, play_id, angle"


@query("label_and_scope", """WITH o AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT'
 THEN '4PT_MAKE' WHEN '2-HIGH' THEN 'FG_MAKE' WHEN '3-MEDIUM' THEN 'FREE_THROW_MISS' WHEN '5-LOW'
 THEN 'TURNOVER' ELSE '3PT_MISS' END AS classification FROM orders)
SELECT o_orderkey, classification, CASE WHEN classification LIKE '%MAKE' THEN 1 ELSE 0 END AS label,
 classification <> '4PT_MAKE' AS v1_in_scope, regexp_extract(classification, '^(.*)_[^_]*$', 1)
 AS family, classification LIKE '%MAKE' AS is_make FROM o WHERE classification <> 'TURNOVER'""")
def _(s, d):
    p = F.col("o_orderpriority")
    cls = (F.when(p == "1-URGENT", "4PT_MAKE").when(p == "2-HIGH", "FG_MAKE")
           .when(p == "3-MEDIUM", "FREE_THROW_MISS").when(p == "5-LOW", "TURNOVER").otherwise("3PT_MISS"))
    o = table(s, d, "orders").select("o_orderkey", cls.alias("classification"))
    return o.withColumn("label", L.label_of()).filter(F.col("label").isNotNull()).select(
        "*", L.in_scope().alias("v1_in_scope"), L.family_of().alias("family"), L.is_make().alias("is_make"))


@query("truth_windows", """WITH o AS (SELECT o_orderkey, o_orderstatus AS cls, o_custkey,
 CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 500 AS DOUBLE) END AS st,
 CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey % 500 + 4 AS DOUBLE) END AS et FROM orders)
SELECT o_orderkey, cls, st, et, greatest(0, st - 2) AS win_start, et + 2 AS win_end FROM o
WHERE cls IN ('F', 'O') AND st IS NOT NULL AND et IS NOT NULL""")
def _(s, d):
    k = F.col("o_orderkey")
    o = table(s, d, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("cls"),
        F.when(k % 7 != 0, (k % 500).cast("double")).alias("st"),
        F.when(k % 11 != 0, (k % 500 + 4).cast("double")).alias("et"))
    from orbweave.sources.readers import shot_windows
    return shot_windows(o, ("F", "O"), "cls", "st", "et").select(
        "*", *B.buffered_window("st", "et"))


@query("box_offsets", f"""WITH {TRACKS_CTE}
SELECT {K3}, frame_idx, ball_x+ball_w/2 AS cx, (ball_x+ball_w/2-rim_x-rim_w/2)/rim_w AS dx_rw,
 (ball_y+ball_h/2-rim_y-rim_h/2)/rim_h AS dy_rh,
 sqrt(pow(ball_x+ball_w/2-rim_x-rim_w/2,2)+pow(ball_y+ball_h/2-rim_y-rim_h/2,2))/rim_w AS dist_rw,
 ball_x+ball_w/2 BETWEEN rim_x AND rim_x+rim_w AND ball_y+ball_h/2 BETWEEN rim_y AND rim_y+rim_h AS inside,
 abs(ball_x+ball_w/2-rim_x-rim_w/2) < 1.5*rim_w AND abs(ball_y+ball_h/2-rim_y-rim_h/2) < 2.0*rim_h AS near,
 abs(ball_x+ball_w/2-rim_x-rim_w/2) < 0.6*rim_w AND abs(ball_y+ball_h/2-rim_y-rim_h/2) < 0.6*rim_h AS cross,
 ball_x+ball_w/2 BETWEEN rim_x-0.2*rim_w AND rim_x+rim_w+0.2*rim_w AND ball_y+ball_h/2
  BETWEEN rim_y-1.2*rim_h AND rim_y+rim_h AS in_zone FROM tracks
WHERE ball_x IS NOT NULL AND rim_x IS NOT NULL""", {6: "dx_rw dy_rh dist_rw"})
def _(s, d):
    t = tracks(s, d).filter(B.present("ball") & B.present("rim"))
    cx, cy = B.center_x("ball"), B.center_y("ball")
    return t.select(*T.TRACK, "frame_idx", cx.alias("cx"), B.offset_rw().alias("dx_rw"),
                    B.offset_rh().alias("dy_rh"), B.distance_rw().alias("dist_rw"),
                    B.ball_in_rim().alias("inside"), B.near_rim().alias("near"),
                    B.at_crossing().alias("cross"),
                    B.in_zone(cx, cy, "rim_x", "rim_y", "rim_w", "rim_h").alias("in_zone"))


def _reg_sql(x0, x1, y0, y1):
    return (f"greatest(0, CAST(floor({x0}) AS INTEGER)) AS ax, greatest(0, CAST(floor({y0}) AS INTEGER)) AS ay, "
            f"least(1920, CAST(ceil({x1}) AS INTEGER)) AS bx, least(1080, CAST(ceil({y1}) AS INTEGER)) AS by_")


def _region_query(name, sql, fn):
    @query(name, f"""WITH {TRACKS_CTE},
r AS (SELECT {K3}, frame_idx, {sql} FROM tracks WHERE rim_x IS NOT NULL)
SELECT {K3}, frame_idx, CASE WHEN bx-ax>=2 AND by_-ay>=2 THEN ax END AS x,
 CASE WHEN bx-ax>=2 AND by_-ay>=2 THEN ay END AS y, CASE WHEN bx-ax>=2 AND by_-ay>=2 THEN bx-ax END AS w,
 CASE WHEN bx-ax>=2 AND by_-ay>=2 THEN by_-ay END AS h FROM r""")
    def _(s, d):
        t = tracks(s, d).filter(B.present("rim"))
        return t.select(*T.TRACK, "frame_idx", fn().alias("r")).select(
            *T.TRACK, "frame_idx", *[F.col(f"r.{c}").alias(c) for c in "xywh"])


_region_query("net_region", _reg_sql("rim_x+rim_w/2-0.6*rim_w", "rim_x+rim_w/2+0.6*rim_w",
                                     "rim_y+rim_h", "rim_y+rim_h+1.5*rim_h"), B.net_region)
_region_query("crop_region", _reg_sql("rim_x+rim_w/2-1.5*rim_w", "rim_x+rim_w/2+1.5*rim_w",
                                      "rim_y-1.5*rim_h", "rim_y+rim_h+2.5*rim_h"), B.crop_region)


@query("square_crop", f"""WITH {TRACKS_CTE},
r AS (SELECT {K3}, frame_idx, rim_x+rim_w/2 AS cx, rim_y+rim_h/2 AS cy, CAST(trunc(1.6*rim_w) AS INTEGER)
  AS sd FROM tracks WHERE rim_x IS NOT NULL),
q AS (SELECT *, CAST(trunc(least(greatest(cx-sd/2.0, 0), 1920-sd)) AS INTEGER) AS x,
 CAST(trunc(least(greatest(cy-sd*0.55::DOUBLE, 0), greatest(0, 1080-sd))) AS INTEGER) AS y FROM r)
SELECT {K3}, frame_idx, x, y, least(sd, 1920-x, 1080-y) AS side FROM q""")
def _(s, d):
    t = tracks(s, d).filter(B.present("rim"))
    return t.select(*T.TRACK, "frame_idx", B.square_crop(
        B.center_x("rim"), B.center_y("rim"), F.col("rim_w")).alias("r")).select(
        *T.TRACK, "frame_idx", "r.x", "r.y", "r.side")


@query("camera_of_side", """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'FR' ELSE 'FL' END
 AS far_cam, CASE WHEN c_mktsegment = 'BUILDING' THEN 'NR' ELSE 'NL' END AS near_cam FROM customer""")
def _(s, d):
    side = F.when(F.col("c_mktsegment") == "BUILDING", "RIGHT")
    return table(s, d, "customer").select("c_custkey", L.far_camera(side).alias("far_cam"),
                                          L.near_camera(side).alias("near_cam"))


# ---- joins --------------------------------------------------------------------
@query("attach_dimension", """SELECT s_suppkey, n_name, coalesce(r_name, 'NONE') AS r_name FROM supplier
 LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
 AND r_regionkey < 3""")
def _(s, d):
    nat = table(s, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name",
                                       F.col("n_regionkey").alias("r_regionkey"))
    reg = table(s, d, "region").filter("r_regionkey < 3")
    j = A.attach_dimension(table(s, d, "supplier").select("s_suppkey", "s_nationkey"), nat,
                           ["s_nationkey"])
    return A.attach_dimension(j, reg, ["r_regionkey"], {"r_name": "NONE"}).select(
        "s_suppkey", "n_name", "r_name")


@query("assemble_families", """SELECT c_custkey, n_orders, coalesce(spend, 0) AS spend FROM customer
 LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey) a
  ON c_custkey = a.o_custkey LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS spend FROM orders
  WHERE o_orderstatus = 'F' GROUP BY o_custkey) b ON c_custkey = b.o_custkey""", {2: "spend"})
def _(s, d):
    o = table(s, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    n = o.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    sp = o.filter("o_orderstatus = 'F'").groupBy("c_custkey").agg(F.sum("o_totalprice").alias("spend"))
    base = A.assemble(table(s, d, "customer").select("c_custkey"), [n], ["c_custkey"])
    return A.attach_optional(base, sp, ["c_custkey"])


@query("short_id_join", """WITH a AS (SELECT substr(c_name, 1, 17) AS pid8, min(c_custkey) AS c_custkey
 FROM customer GROUP BY 1), b AS (SELECT substr('Customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0'),
 1, 17) AS pid8, s_suppkey FROM supplier)
SELECT a.pid8, c_custkey, min(s_suppkey) AS s_suppkey FROM a JOIN b ON a.pid8 = b.pid8 GROUP BY 1, 2""")
def _(s, d):
    a = Z.first_per_key(table(s, d, "customer").select(
        F.substring("c_name", 1, 17).alias("pid8"), "c_custkey"), ["pid8"], [F.col("c_custkey")])
    b = Z.first_per_key(table(s, d, "supplier").select(F.substring(F.concat(
        F.lit("Customer#"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")), 1, 17).alias("pid8"),
        "s_suppkey"), ["pid8"], [F.col("s_suppkey")])
    return a.join(b, "pid8")


@query("full_outer_families", """SELECT coalesce(a.k, b.k) AS k, na, nb FROM
 (SELECT o_custkey AS k, count(*) AS na FROM orders WHERE o_orderstatus='F' GROUP BY 1) a FULL JOIN
 (SELECT o_custkey AS k, count(*) AS nb FROM orders WHERE o_orderpriority='1-URGENT' GROUP BY 1) b
 ON a.k = b.k""")
def _(s, d):
    o = table(s, d, "orders").withColumnRenamed("o_custkey", "k")
    a = o.filter("o_orderstatus = 'F'").groupBy("k").agg(F.count(F.lit(1)).alias("na"))
    b = o.filter("o_orderpriority = '1-URGENT'").groupBy("k").agg(F.count(F.lit(1)).alias("nb"))
    return a.join(b, "k", "full")


@query("semi_and_anti", """SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer
 WHERE c_acctbal > 0) AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment='MACHINERY')""")
def _(s, d):
    c = table(s, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    o = table(s, d, "orders").select("o_orderkey", "o_custkey")
    return (o.join(c.filter("c_acctbal > 0"), "o_custkey", "left_semi")
            .join(c.filter("c_mktsegment = 'MACHINERY'"), "o_custkey", "left_anti").select("o_orderkey"))


@query("system_overlap", f"""WITH {SCORED_CTE},
t AS (SELECT user_id, count(*) AS n_samples, max(value) AS apex FROM events GROUP BY user_id)
SELECT doc_id, label, prob, n_samples, apex FROM scored JOIN t ON doc_id = user_id""")
def _(s, d):
    t = table(s, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_samples"),
                                                     F.max("value").alias("apex"))
    return scored(s, d).join(t, F.col("doc_id") == F.col("user_id")).select(
        "doc_id", "label", "prob", "n_samples", "apex")


@query("key_set_difference", """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders),
b AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 1000)
SELECT k, 'left' AS only_in FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL
SELECT k, 'right' FROM b WHERE k NOT IN (SELECT k FROM a)""")
def _(s, d):
    return A.same_keys(table(s, d, "orders").select(F.col("o_custkey").alias("k")),
                       table(s, d, "customer").filter("c_acctbal > 1000")
                       .select(F.col("c_custkey").alias("k")), ["k"])


@query("complete_games", f"""WITH {TRACKS_CTE}
SELECT game_id, count(DISTINCT play_id) AS shots, count(DISTINCT angle) AS n_cameras FROM tracks
GROUP BY game_id HAVING count(DISTINCT play_id) >= 21 AND count(DISTINCT angle) >= 4""")
def _(s, d):
    t = tracks(s, d)
    return A.complete_games(t.select("game_id", "play_id").distinct(), t, "game_id", "angle", 21)


@query("table_compare", """WITH a AS (SELECT o_custkey AS k, sum(o_totalprice) AS v, count(*) AS n FROM orders
 GROUP BY 1), b AS (SELECT o_custkey AS k, sum(o_totalprice) AS v, count(*) AS n FROM orders
 WHERE o_orderstatus <> 'P' GROUP BY 1),
j AS (SELECT a.k AS ka, b.k AS kb, a.v AS av, b.v AS bv, a.n AS an, b.n AS bn FROM a FULL JOIN b ON a.k=b.k)
SELECT 'n' AS "column", count(*) FILTER (WHERE ka IS NULL OR kb IS NULL) AS unmatched,
 count(*) FILTER (WHERE an <> bn) AS n_diff, CAST(max(abs(an-bn)) AS DOUBLE) AS max_abs_diff FROM j UNION ALL
SELECT 'v', count(*) FILTER (WHERE ka IS NULL OR kb IS NULL), count(*) FILTER (WHERE an <> bn),
 max(abs(av-bv)) FROM j""", {2: "max_abs_diff"})
def _(s, d):
    o = table(s, d, "orders").withColumn("c", F.round(F.col("o_totalprice") * 100).cast("long"))

    def agg(df):
        return df.groupBy(F.col("o_custkey").alias("k")).agg(
            (F.sum("c") / 100).alias("v"), F.count(F.lit(1)).alias("n"))
    return A.compare_tables(agg(o), agg(o.filter("o_orderstatus <> 'P'")), ["k"], ["n", "v"])


@query("table_fingerprint_equal", """SELECT name, n_rows, true AS same FROM (
 SELECT 'orders' AS name, count(*) AS n_rows FROM orders UNION ALL
 SELECT 'part', count(*) FROM part) t""")
def _(s, d):
    out = None
    for name in ("orders", "part"):
        t = table(s, d, name)
        a = A.fingerprint(t)
        b = A.fingerprint(t.repartition(4)).withColumnsRenamed({"n_rows": "m", "digest": "e"})
        j = a.join(b, F.col("n_rows") == F.col("m")).select(
            F.lit(name).alias("name"), "n_rows", (F.col("digest") == F.col("e")).alias("same"))
        out = j if out is None else out.unionByName(j)
    return out


# ---- set operations, sorting ------------------------------------------------------
@query("concat_families", """SELECT c_custkey AS k, c_acctbal AS bal, NULL AS nat FROM customer UNION ALL
 SELECT s_suppkey, s_acctbal, s_nationkey FROM supplier""")
def _(s, d):
    a = table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"))
    b = table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"),
                                       F.col("s_nationkey").alias("nat"))
    return a.unionByName(b, allowMissingColumns=True)


@query("frame_intersection", f"""WITH {TRACKS_CTE}
SELECT game_id, play_id, frame_idx FROM tracks WHERE angle='FL' AND ball_x IS NOT NULL INTERSECT
SELECT game_id, play_id, frame_idx FROM tracks WHERE angle='NL' AND ball_x IS NOT NULL""")
def _(s, d):
    t = tracks(s, d).filter("ball_x IS NOT NULL")
    cols = ["game_id", "play_id", "frame_idx"]
    return t.filter("angle = 'FL'").select(*cols).intersect(t.filter("angle = 'NL'").select(*cols))


@query("drop_duplicates", """SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey""")
def _(s, d):
    return Z.first_per_key(table(s, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"],
                           [F.col("o_orderkey")])


@query("train_val_union", f"""WITH {SCORED_CTE} SELECT doc_id, game_id FROM scored
 WHERE game_id IN ('en', 'fr')""")
def _(s, d):
    return scored(s, d).filter(F.col("game_id").isin("en", "fr")).select("doc_id", "game_id")


# boxes: every event is a detection in the image of its user and day
BOX_CTE = """
bx AS (SELECT user_id AS img, CASE WHEN event_type IN ('click','view','error') THEN 'target'
  ELSE 'reference' END AS cls, event_id AS box_id, value AS x1, value * 0.7 AS y1,
  value + 40 + event_id % 30 AS x2, value * 0.7 + 30 + event_id % 20 AS y2,
  CAST((event_id * 37) % 100 AS DOUBLE) / 100 AS conf FROM events)
"""


def det_boxes(s, d):
    v, e = F.col("value"), F.col("event_id")
    return table(s, d, "events").select(
        F.col("user_id").alias("img"),
        F.when(F.col("event_type").isin("click", "view", "error"), "target").otherwise("reference")
        .alias("cls"), e.alias("box_id"), v.alias("x1"), (v * 0.7).alias("y1"),
        (v + 40 + e % 30).alias("x2"), (v * 0.7 + 30 + e % 20).alias("y2"),
        (((e * 37) % 100).cast("double") / 100).alias("conf"))


@query("best_box", f"""WITH {BOX_CTE}
SELECT img, cls, box_id, conf FROM bx QUALIFY row_number() OVER (PARTITION BY img, cls
 ORDER BY conf DESC, box_id) = 1""")
def _(s, d):
    return Z.best_by_confidence(det_boxes(s, d).select("img", "cls", "box_id", "conf"), ["img", "cls"],
                                "conf", ["box_id"])


@query("target_near_reference", f"""WITH {BOX_CTE},
r AS (SELECT img, box_id AS reference_id, (x1+x2)/2 AS rcx, (y1+y2)/2 AS rcy FROM bx WHERE cls='reference'
 QUALIFY row_number() OVER (PARTITION BY img ORDER BY (x2-x1)*(y2-y1) DESC, box_id) = 1),
t AS (SELECT b.img, box_id AS target_id, conf AS target_conf FROM bx b LEFT JOIN r ON b.img = r.img
 WHERE cls='target' QUALIFY row_number() OVER (PARTITION BY b.img ORDER BY CASE WHEN rcx IS NOT NULL THEN
  ((x1+x2)/2-rcx)*((x1+x2)/2-rcx)+((y1+y2)/2-rcy)*((y1+y2)/2-rcy) ELSE -conf END, box_id) = 1)
SELECT coalesce(r.img, t.img) AS img, reference_id, target_id, target_conf FROM r FULL JOIN t
 ON r.img = t.img""")
def _(s, d):
    return Z.target_near_reference(det_boxes(s, d), ["img"])


@query("box_overlap_pairs", f"""WITH {BOX_CTE},
p AS (SELECT a.img, a.box_id AS truth_id, b.box_id AS pred_id,
 greatest(0, least(a.x2,b.x2)-greatest(a.x1,b.x1))*greatest(0, least(a.y2,b.y2)-greatest(a.y1,b.y1)) AS i,
 (a.x2-a.x1)*(a.y2-a.y1)+(b.x2-b.x1)*(b.y2-b.y1) AS u FROM bx a JOIN bx b ON a.img = b.img
 AND a.cls='target' AND b.cls='reference')
SELECT img, truth_id, pred_id, i/(u-i) AS iou FROM p WHERE i/(u-i) >= 0.3""", {6: "iou"})
def _(s, d):
    b = det_boxes(s, d)
    return X.overlaps(b.filter("cls = 'target'"), b.filter("cls = 'reference'"), ["img"])


MATCH_CTE = f"""RECURSIVE {BOX_CTE.strip()},
kx AS (SELECT *, CASE WHEN box_id % 2 = 0 THEN 'ball' ELSE 'hoop' END AS kind FROM bx),
ov AS (SELECT a.img, a.kind, a.box_id AS truth_id, b.box_id AS pred_id,
 greatest(0, least(a.x2,b.x2)-greatest(a.x1,b.x1))*greatest(0, least(a.y2,b.y2)-greatest(a.y1,b.y1)) AS i,
 (a.x2-a.x1)*(a.y2-a.y1)+(b.x2-b.x1)*(b.y2-b.y1) AS u FROM kx a JOIN kx b ON a.img = b.img AND a.kind = b.kind
 AND a.cls='target' AND b.cls='reference'),
op AS MATERIALIZED (SELECT img, kind, truth_id, pred_id, i/(u-i) AS iou, row_number() OVER (PARTITION BY img, kind
 ORDER BY truth_id, pred_id) AS k FROM ov WHERE i/(u-i) >= 0.3),
fold AS (SELECT img, kind, truth_id, pred_id, iou, k, true AS taken, truth_id AS last, [pred_id] AS used FROM op WHERE k = 1
 UNION ALL SELECT op.img, op.kind, op.truth_id, op.pred_id, op.iou, op.k, op.truth_id <> last AND NOT list_contains(used, op.pred_id),
  CASE WHEN op.truth_id <> last AND NOT list_contains(used, op.pred_id) THEN op.truth_id ELSE last END,
  CASE WHEN op.truth_id <> last AND NOT list_contains(used, op.pred_id) THEN list_append(used, op.pred_id) ELSE used END
 FROM fold JOIN op ON op.img = fold.img AND op.kind = fold.kind AND op.k = fold.k + 1),
mt AS (SELECT img, kind, truth_id, pred_id, iou FROM fold WHERE taken)"""


def kind_boxes(s, d):
    """True and predicted boxes of two classes, and their one-to-one matches."""
    b = det_boxes(s, d).withColumn("kind", F.when(F.col("box_id") % 2 == 0, "ball").otherwise("hoop"))
    t, p = b.filter("cls = 'target'"), b.filter("cls = 'reference'")
    return t, p, X.match_boxes(X.overlaps(t, p, ["img", "kind"]), ["img", "kind"])


@query("box_matches", f"WITH {MATCH_CTE} SELECT * FROM mt", {6: "iou"})
def _(s, d):
    return kind_boxes(s, d)[2]


@query("detector_scores", f"""WITH {MATCH_CTE},
n AS (SELECT kind, count(*) FILTER (WHERE cls='target') AS n_truth, count(*) FILTER (WHERE cls='reference') AS n_pred FROM kx GROUP BY kind),
m AS (SELECT kind, count(*) AS tp FROM mt GROUP BY kind)
SELECT kind, n_truth, n_pred, coalesce(tp, 0) AS tp, CASE WHEN n_truth > 0 THEN CAST(coalesce(tp, 0) AS DOUBLE)/n_truth ELSE 0 END AS recall,
 CASE WHEN n_pred > 0 THEN CAST(coalesce(tp, 0) AS DOUBLE)/n_pred ELSE 0 END AS precision FROM n LEFT JOIN m USING (kind)""",
       {6: "recall precision"})
def _(s, d):
    """Greedy one-to-one box matching, then recall and precision per class."""
    return X.detector_scores(*kind_boxes(s, d), "kind")


@query("detector_moment_recall", f"""WITH {MATCH_CTE},
g AS (SELECT DISTINCT img, kind FROM kx WHERE cls='target' AND img % 3 = 0),
h AS (SELECT DISTINCT img, kind, 1 AS hit FROM mt)
SELECT kind, count(*) AS n_images, count(hit) AS n_found, CAST(count(hit) AS DOUBLE)/count(*) AS recall
FROM g LEFT JOIN h USING (img, kind) GROUP BY kind""", {6: "recall"})
def _(s, d):
    """Share of the images taken at a rim moment (every third one) in which a box of the class is found."""
    t, _, m = kind_boxes(s, d)
    return X.moment_recall(t.withColumn("moment", F.col("img") % 3 == 0), m, ["img"], "moment", "kind")
