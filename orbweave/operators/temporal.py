"""Joins in time: frame offsets, nearest rows, interval matches, clusters, density, gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from orbweave.functions import ordered
from orbweave.functions.skew import attach

WIDE_FRAMES, WIDE = 8, 4    # width of a cell in reaches, along time and in the picture


def offset_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str], frame: str = "frame_idx",
                 offset: int | Column = 0) -> DataFrame:
    """Pair row f of ``a`` with row f+offset of ``b``; the frame is part of the equi-join key."""
    off = offset if isinstance(offset, Column) else F.lit(offset)
    right = b.select(*keys, F.col(frame).alias("_f"),
                     *[F.col(c).alias(f"b_{c}") for c in b.columns if c not in keys])
    left = a.withColumn("_f", F.col(frame) + off)
    return left.join(right, [*keys, "_f"]).drop("_f")


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], left_t: str, right_t: str,
            cols: Sequence[str], bucket, tolerance: float | None = None,
            left_cols: Sequence[str] = ()) -> DataFrame:
    """Nearest row of ``right`` in time for every left row; the earlier one on equal distance.

    Both sides are merged into one ordered stream and the last right row before and the first
    after are carried along, so no pairs are built.  ``bucket(col)`` gives the order bucket.
    """
    payload = F.struct(F.col(right_t).alias("t"), *cols)
    lefts = left.select(*keys, F.col(left_t).alias("_t"), F.lit(1).alias("_side"),
                        F.struct(*left_cols, left_t).alias("_row"))
    rights = right.select(*keys, F.col(right_t).alias("_t"), F.lit(0).alias("_side"),
                          payload.alias("_hit"))
    both = lefts.unionByName(rights, allowMissingColumns=True)
    f = ordered.fill_known(both, keys, ["_t", "_side"], F.col("_hit"), bucket("_t"), "_bef", "_aft")
    f = f.filter(F.col("_side") == 1)
    d0, d1 = F.col("_t") - F.col("_bef.t"), F.col("_aft.t") - F.col("_t")
    pick = F.when(F.col("_bef").isNull(), F.col("_aft")).when(F.col("_aft").isNull(), F.col("_bef")) \
        .when(d0 <= d1, F.col("_bef")).otherwise(F.col("_aft"))
    f = f.withColumn("_pick", pick)
    gap = F.abs(F.col("_pick.t") - F.col("_t"))
    if tolerance is not None:
        f = f.withColumn("_pick", F.when(gap <= tolerance, F.col("_pick")))
    return f.select(*keys, "_row.*", F.col("_pick.t").alias("match_t"),
                    *[F.col(f"_pick.{c}").alias(f"match_{c}") for c in cols])


def nearest_per_key(points: DataFrame, rows: DataFrame, keys: Sequence[str], point_t: str,
                    row_t: str, cols: Sequence[str], spread: Sequence[str]) -> DataFrame:
    """Row nearest to the key's single point in time (first on ties): one aggregation."""
    r = attach(rows, points.select(*keys, F.col(point_t).alias("_pt")), keys, spread, "inner")
    best = F.min_by(F.struct(row_t, *cols), F.struct(F.abs(F.col(row_t) - F.col("_pt")), row_t))
    return r.groupBy(*keys).agg(F.max("_pt").alias(point_t), best.alias("_b")) \
        .select(*keys, point_t, F.col(f"_b.{row_t}").alias("near_t"),
                *[F.col(f"_b.{c}").alias(f"near_{c}") for c in cols])


def match_windows(events: DataFrame, windows: DataFrame, keys: Sequence[str], t: str,
                  lo: str, hi: str, order: Sequence[str], event_id: Sequence[str],
                  cols: Sequence[str], width: float) -> DataFrame:
    """First window (by ``order``) whose [lo, hi] holds the event; unmatched events keep nulls.

    Windows are repeated over the time buckets they touch, so the join is an equi-join on
    (key, bucket) and only overlapping rows of one bucket meet.
    """
    b0, b1 = ordered.value_bucket(lo, width), ordered.value_bucket(hi, width)
    w = windows.select(*keys, F.col(lo).alias("_lo"), F.col(hi).alias("_hi"),
                       F.struct(*order).alias("_ord"), F.struct(*cols).alias("_win"),
                       F.explode(F.sequence(b0, b1)).alias("_b"))
    e = events.withColumn("_b", ordered.value_bucket(t, width))
    inside = (F.col(t) >= F.col("_lo")) & (F.col(t) <= F.col("_hi"))
    j = e.join(w, [*keys, "_b"], "inner").filter(inside)
    # partial aggregation keeps one window per event and map task
    first = j.groupBy(*keys, *event_id).agg(F.min_by("_win", "_ord").alias("_w"))
    out = events.join(first, [*keys, *event_id], "left")
    return out.select(*events.columns, *[F.col(f"_w.{c}").alias(f"win_{c}") for c in cols])


def windows_hit(events: DataFrame, windows: DataFrame, keys: Sequence[str], t: str, lo: str,
                hi: str, bucket) -> tuple[DataFrame, DataFrame]:
    """(windows + ``hit``, events + ``matched``): any-overlap tests without building pairs.

    A window is hit when the first event at or after its start is not past its end.  An event
    is matched when the furthest end among windows started by then reaches it.
    """
    w = windows.select(*keys, F.col(lo).alias("_t"), F.lit(0).alias("_side"),
                       F.col(hi).alias("_hi"), F.struct(*windows.columns).alias("_win"))
    e = events.select(*keys, F.col(t).alias("_t"), F.lit(1).alias("_side"),
                      F.struct(*events.columns).alias("_ev"))
    both = w.unionByName(e, allowMissingColumns=True)
    order = ["_t", "_side"]
    f = ordered.fill_known(both, keys, order, F.when(F.col("_side") == 1, F.col("_t")),
                           bucket("_t"), "_eb", "_next_event")
    hit = f.filter("_side = 0").select("_win.*", F.coalesce(
        F.col("_next_event") <= F.col("_hi"), F.lit(False)).alias("hit"))
    r = ordered.running_max(both, keys, order, F.col("_hi"), bucket("_t"), "_reach")
    matched = r.filter("_side = 1").select("_ev.*", F.coalesce(
        F.col("_reach") >= F.col("_t"), F.lit(False)).alias("matched"))
    return hit, matched


def one_per_window(matched: DataFrame, window: Sequence[str], t: str, target: str,
                   cols: Sequence[str]) -> DataFrame:
    """The matched event closest to the window's target time (earliest on ties)."""
    best = F.min_by(F.struct(t, *cols), F.struct(F.abs(F.col(t) - F.col(target)), t))
    return (matched.dropna(subset=list(window)).groupBy(*window)
            .agg(best.alias("_e"), F.count(F.lit(1)).alias("n_events"))
            .select(*window, "n_events", F.col(f"_e.{t}").alias(t),
                    *[F.col(f"_e.{c}").alias(c) for c in cols]))


def best_offset(events: DataFrame, truths: DataFrame, keys: Sequence[str], t: str, truth_t: str,
                offsets: Sequence[int], tolerance: float) -> DataFrame:
    """Constant offset per key that lets most events find a truth within ``tolerance``.

    Truths become disjoint bucket marks, events are tried at each offset with a semi join
    (no pairs).  Ties take the offset nearest 0, then the smaller one.
    """
    width = float(tolerance)
    b = ordered.value_bucket
    marks = truths.select(*keys, F.col(truth_t).alias("_tt"), F.explode(F.sequence(
        b(truth_t, width) - 1, b(truth_t, width) + 1)).alias("_b"))
    tried = events.withColumn("offset", F.explode(F.array(*[F.lit(o) for o in offsets])))
    tried = tried.withColumn("_s", F.col(t) + F.col("offset")).withColumn("_b", b("_s", width))
    cond = [F.col(f"e.{k}") == F.col(f"m.{k}") for k in keys]
    cond += [F.col("e._b") == F.col("m._b"), F.abs(F.col("e._s") - F.col("m._tt")) <= tolerance]
    hits = tried.alias("e").join(marks.alias("m"), cond, "left_semi")
    n = hits.groupBy(*keys, "offset").agg(F.count(F.lit(1)).alias("n_matched"))
    best = F.max_by(F.struct("offset", "n_matched"),
                    F.struct("n_matched", -F.abs("offset"), -F.col("offset")))
    return n.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.offset", "b.n_matched")


def near_cells(points: DataFrame, wide: dict[str, tuple[str, float, float]]) -> DataFrame:
    """Each point once per cell it may reach into; ``wide`` names a cell's column, reach and width."""
    for n, (c, reach, width) in wide.items():
        points = points.withColumn(n, F.explode(F.sequence(F.floor((F.col(c) - reach) / width), F.floor((F.col(c) + reach) / width))))
    return points


def join_close_tracks(points: DataFrame, kept: DataFrame, keys: Sequence[str], track: str,
                      frames: int = 5, radius: float = 150.0) -> DataFrame:
    """Track ids that come within ``frames`` and ``radius`` of a point of a kept track.

    Points meet in cells several times as wide as the reach, so only those near a border are copied (2.8 copies on
    average), where cells as wide as the reach ask for 27.
    """
    wide = {"_cf": ("frame_idx", frames, WIDE_FRAMES * frames), "_cx": ("cx", radius, WIDE * radius), "_cy": ("cy", radius, WIDE * radius)}
    marked = points.select(*keys, track, "frame_idx", "cx", "cy").join(
        kept.select(*keys, track, F.lit(True).alias("_kept")), [*keys, track], "left")
    kp = marked.filter("_kept").select(
        *keys, F.col("frame_idx").alias("kf"), F.col("cx").alias("kx"), F.col("cy").alias("ky"),
        *[F.floor(F.col(c) / width).alias(n) for n, (c, _, width) in wide.items()])
    other = near_cells(marked.filter("_kept IS NULL").drop("_kept"), wide)
    cond = [F.col(f"o.{k}") == F.col(f"k.{k}") for k in [*keys, *wide]]
    dx, dy = F.col("o.cx") - F.col("k.kx"), F.col("o.cy") - F.col("k.ky")
    cond += [F.abs(F.col("o.frame_idx") - F.col("k.kf")) <= frames,
             dx * dx + dy * dy < radius * radius]
    hit = other.alias("o").join(kp.alias("k"), cond, "left_semi")
    return hit.select(*keys, track).distinct().unionByName(kept.select(*keys, track))


def densest(values: DataFrame, keys: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """Mean and size of the densest neighbourhood |v - c| <= tolerance; smallest centre on ties.

    Equal values are counted first; neighbourhoods are range frames inside value buckets of the
    tolerance's width, with the adjacent buckets copied in.
    """
    grain = values.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    home = ordered.value_bucket("_v", tolerance)
    d = (grain.withColumn("_home", home)
         .withColumn("_b", F.explode(F.array(F.col("_home") - 1, F.col("_home"),
                                             F.col("_home") + 1))))
    frame = (f"(PARTITION BY {', '.join([*keys, '_b'])} ORDER BY _v RANGE BETWEEN "
             f"{float(tolerance)}D PRECEDING AND {float(tolerance)}D FOLLOWING)")
    d = d.select(*keys, "_v", "_b", "_home", F.expr(f"sum(_c) OVER {frame}").alias("_n"),
                 F.expr(f"sum(_v * _c) OVER {frame}").alias("_s")) \
        .withColumn("_m", F.col("_s") / F.col("_n"))
    best = F.max_by(F.struct("_m", "_n", "_v"), F.struct("_n", -F.col("_v")))
    return (d.filter(F.col("_b") == F.col("_home")).groupBy(*keys).agg(best.alias("_x"))
            .select(*keys, F.col("_x._m").alias("cluster_mean"), F.col("_x._n").alias("support"),
                    F.col("_x._v").alias("center")))


def events_from_hits(hits: DataFrame, keys: Sequence[str], t: str, gap: float, bucket: Column,
                     dist: str = "dist", y: str | None = None, min_hits: int = 2) -> DataFrame:
    """Cluster hits separated by more than ``gap``; event time is the hit closest to the target.

    The cluster id is the time of its first hit, so clusters are aggregated with map-side
    combine and a hot key never sits in one task.  Of hits at one time the smallest ``y`` counts.
    """
    c = ordered.cluster_rows(hits, keys, t, gap, bucket)
    aggs = [F.count(F.lit(1)).alias("n_hits"), F.max(t).alias("t_last"),
            F.min_by(t, F.struct(dist, t)).alias("event_t"), F.min(dist).alias("min_dist")]
    if y:
        aggs += [F.min_by(y, F.struct(t, y)).alias("y_start"), F.min_by(y, F.struct(dist, t, y)).alias("y_event"),
                 F.min_by(t, F.struct(dist, t)).alias("_tc")]
    e = c.groupBy(*keys, F.col("cluster_start").alias("t_first")).agg(*aggs)
    if y:
        e = e.withColumn("descends", (F.col("_tc") == F.col("t_first"))
                         | (F.col("y_event") >= F.col("y_start"))).drop("_tc")
    return e.filter(F.col("n_hits") >= min_hits)


def gap_to_next(rows: DataFrame, keys: Sequence[str], order: Sequence[str], start: str, end: str,
                bucket: Column, name: str = "gap_to_next") -> DataFrame:
    """Time from the row's end to the next row's start in its key."""
    n = ordered.neighbours(rows, keys, order, [start], bucket, None, "_n")
    return n.withColumn(name, F.col(f"_n.{start}") - F.col(end)).drop("_n")


def idle_gaps(rows: DataFrame, keys: Sequence[str], order: Sequence[str], start: str, end: str,
              bucket: Column, longer_than: float = 8.0, trim: float = 3.0) -> DataFrame:
    """Stretches between consecutive rows longer than a limit, trimmed on both sides."""
    n = ordered.neighbours(rows, keys, order, [start], bucket, None, "_n")
    return (n.filter(F.col(f"_n.{start}") - F.col(end) > longer_than)
            .select(*keys, (F.col(end) + trim).alias("idle_start"),
                    (F.col(f"_n.{start}") - trim).alias("idle_end")))
