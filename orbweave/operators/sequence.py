"""Ordered-row operators: smoothing, gap filling, spike and band detection, sampling."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from orbweave.functions import boxes as B, fixed as K, ordered
from orbweave.functions.skew import attach
from orbweave.operators.tracks import TRACK, flag, width_ruler

PART = 4096   # rows of one key per part; a part plus its halo is what one task window sees


def _median_of(arr: Column) -> Column:
    """Median of a short array column."""
    s = F.array_sort(arr)
    n = F.size(s)
    hi = F.element_at(s, (F.floor(n / 2) + 1).cast("int"))
    lo = F.element_at(s, F.greatest(F.floor((n + 1) / 2), F.lit(1)).cast("int"))
    return F.when(n > 0, F.when(n % 2 == 1, lo).otherwise(F.lit(0.5) * (lo + hi)))


def median3(rows: DataFrame, value: str, keys: Sequence[str] = TRACK, order: str = "frame_idx",
            name: str = "med3") -> DataFrame:
    """3-point median over consecutive rows; the first and last row keep their value."""
    n = ordered.neighbours(rows, keys, [order], [value], ordered.frame_bucket(order), "_p", "_n")
    mid = F.array_sort(F.array(f"_p.{value}", value, f"_n.{value}"))[1]
    return n.withColumn(name, F.when(F.col("_p").isNull() | F.col("_n").isNull(), F.col(value))
                        .otherwise(mid)).drop("_p", "_n")


def _framed(rows, keys, pos, halo):
    h = ordered.with_halo(rows, pos, PART, halo)
    return h, Window.partitionBy(*keys, "_part").orderBy(pos)


def median_smooth(rows: DataFrame, values: Sequence[str], window: int,
                  keys: Sequence[str] = TRACK, pos: str = "frame_idx") -> DataFrame:
    """Centred odd-window median, shrinking at the ends; ``pos`` must be dense per key."""
    half = window // 2
    h, w = _framed(rows, keys, pos, half)
    w = w.rowsBetween(-half, half)
    h = h.select("*", *[_median_of(F.collect_list(v).over(w)).alias(f"{v}_smooth")
                        for v in values])
    return h.filter("_own").drop("_own", "_part")


def moving_average3(rows: DataFrame, value: str, keys: Sequence[str], pos: str,
                    name: str = "avg3") -> DataFrame:
    """3-point mean; the first and last row take the mean of the first / last three rows."""
    h, w = _framed(rows, keys, pos, 2)
    first, last = F.lag(value).over(w).isNull(), F.lead(value).over(w).isNull()

    def mean(lo, hi):
        return F.avg(value).over(w.rowsBetween(lo, hi))
    h = h.withColumn(name, F.when(first, mean(0, 2)).when(last, mean(-2, 0)).otherwise(mean(-1, 1)))
    return h.filter("_own").drop("_own", "_part")


def interpolate_hold(rows: DataFrame, values: Sequence[str], keys: Sequence[str] = TRACK,
                     pos: str = "frame_idx") -> DataFrame:
    """Linear interpolation of interior gaps, nearest known value held at both ends.

    ``pos`` is the dense row position; adds ``<value>_filled``.
    """
    vals = {(f"_b_{v}", f"_a_{v}"): F.when(F.col(v).isNotNull(), F.struct(
        F.col(pos).alias("p"), F.col(v).cast("double").alias("v"))) for v in values}
    r = ordered.fill_known_many(rows, keys, [pos], vals, ordered.frame_bucket(pos))
    for v in values:
        lo, hi = F.col(f"_b_{v}"), F.col(f"_a_{v}")
        frac = (F.col(pos) - lo["p"]).cast("double") / (hi["p"] - lo["p"])
        r = r.withColumn(f"{v}_filled", F.when(F.col(v).isNotNull(), F.col(v).cast("double"))
                         .when(lo.isNull(), hi["v"]).when(hi.isNull(), lo["v"])
                         .otherwise(lo["v"] + frac * (hi["v"] - lo["v"])))
    return r.drop(*[c for pair in vals for c in pair])


def stable_boxes(tracks: DataFrame, keys: Sequence[str] = TRACK, window: int = 9) -> DataFrame:
    """Rim box per frame: gaps interpolated, median-smoothed, plus the observed flag."""
    cols = ["rim_x", "rim_y", "rim_w", "rim_h"]
    r = interpolate_hold(tracks, cols, keys)
    r = r.withColumn("rim_ok", F.col("rim_x").isNotNull() & F.col("rim_w").isNotNull())
    r = r.select(*tracks.columns, "rim_ok", *[F.col(f"{c}_filled").alias(f"_{c}") for c in cols])
    r = median_smooth(r, [f"_{c}" for c in cols], window, keys)
    good = (F.col("_rim_w_smooth") > 0) & (F.col("_rim_h_smooth") > 0)
    return r.select(*tracks.columns, "rim_ok", *[
        F.when(good, F.col(f"_{c}_smooth")).alias(f"stable_{c}") for c in cols])


def reject_spikes(tracks: DataFrame, keys: Sequence[str] = TRACK) -> DataFrame:
    """Mark isolated teleports among detected rows (``rejected``); other rows are kept.

    Inner rows: both steps above 2.5 rim widths and the neighbours close to each other.
    End rows: the single step above the limit.  Needs a ruler and three detections.
    """
    keys = list(keys)
    det = tracks.filter(F.col("ball_x").isNotNull()).select(
        *keys, "frame_idx", B.center_x("ball").alias("cx"), B.center_y("ball").alias("cy"))
    n = ordered.neighbours(det, keys, ["frame_idx"], ["cx", "cy"], ordered.frame_bucket())
    counts = det.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nd"))
    per = width_ruler(tracks, keys).join(counts, keys)
    n = attach(n, per, keys, ["frame_idx"], "left")

    def step(a, b):
        return B.distance(F.col(f"{a}cx") - F.col(f"{b}cx"), F.col(f"{a}cy") - F.col(f"{b}cy"))
    thr = F.lit(K.SPIKE_RULERS) * F.col("ruler")
    before, after, across = step("", "prev."), step("", "next."), step("next.", "prev.")
    inner = ((before > thr) & (after > thr)
             & (across < F.lit(K.SPIKE_RETURN) * (before + after)))
    bad = (F.when(F.col("prev").isNotNull() & F.col("next").isNotNull(), inner)
           .when(F.col("prev").isNotNull(), before > thr)
           .when(F.col("next").isNotNull(), after > thr))
    marks = n.select(*keys, "frame_idx", F.coalesce(
        bad & (F.col("_nd") >= 3) & F.col("ruler").isNotNull(), F.lit(False)).alias("rejected"))
    return (tracks.join(marks, [*keys, "frame_idx"], "left")
            .withColumn("rejected", F.coalesce("rejected", F.lit(False))))


def trusted_gaps(rows: DataFrame, kept: Column, keys: Sequence[str] = TRACK,
                 pos: str = "frame_idx", conf: str = "ball_conf") -> DataFrame:
    """Mark missing rows inside gaps of at most 12 rows whose two edges are confident."""
    edge = F.when(kept, F.struct(F.col(pos).alias("p"), F.col(conf).alias("c")))
    r = ordered.fill_known(rows, keys, [pos], edge, ordered.frame_bucket(pos), "_l", "_r")
    ok = ((F.col("_r.p") - F.col("_l.p") - 1 <= K.MAX_GAP_FRAMES)
          & (F.col("_l.c") >= K.GAP_EDGE_CONF) & (F.col("_r.c") >= K.GAP_EDGE_CONF))
    return r.withColumn("trusted", F.coalesce(~kept & ok, F.lit(False))).drop("_l", "_r")


def track_quality(rows: DataFrame, keys: Sequence[str] = TRACK) -> DataFrame:
    """Reliability from coverage, confidence and bridged share; needs kept/trusted marks.

    ``rows`` carries ``rejected`` and ``trusted``; tracks without a ruler score 0.
    """
    kept = F.col("ball_x").isNotNull() & ~F.col("rejected")
    g = rows.groupBy(*keys).agg(
        F.avg(flag(kept)).alias("cov"), F.avg(flag(F.col("trusted"))).alias("imp"),
        F.avg(F.when(kept, F.col("ball_conf"))).alias("mc"), F.sum(flag(kept)).alias("k"),
        F.max(flag(F.col("rim_w") > 1.0)).alias("ruler"))
    mc = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("mc", F.lit(0.0))))
    q = (F.lit(0.6) * F.col("cov") + F.lit(0.4) * mc) * (F.lit(1.0) - F.lit(0.5) * F.col("imp"))
    return g.select(*keys, F.when((F.col("ruler") > 0) & (F.col("k") > 0), F.least(
        F.lit(1.0), F.greatest(F.lit(0.0), q))).otherwise(0.0).alias("track_quality"))


def low_bands(rows: DataFrame, value: str, keys: Sequence[str], order: Sequence[str],
              bucket: Column, low: float = 3.0, min_run: int = 3) -> DataFrame:
    """Flag runs of at least ``min_run`` consecutive low values (``in_band``) and lone lows."""
    r = rows.withColumn("_low", F.coalesce(F.col(value) < low, F.lit(False)))
    n = ordered.neighbours(r, keys, order, ["_low"], bucket, "_p", None)
    opens = F.col("_low") & ~F.coalesce(F.col("_p._low"), F.lit(False))
    n = n.withColumn("_start", F.when(opens, F.struct(*order))).drop("_p")
    f = ordered.fill_known(n, keys, order, F.col("_start"), bucket, "_run", "_after") \
        .drop("_start", "_after")
    f = f.withColumn("_run", F.when(F.col("_low"), F.col("_run")))
    sizes = (f.filter("_low").groupBy(*keys, "_run").agg(F.count(F.lit(1)).alias("_size"))
             .withColumnRenamed("_run", "_r"))
    on = [F.col(f"f.{k}") == F.col(f"s.{k}") for k in keys] + [F.col("f._run") == F.col("s._r")]
    out = f.alias("f").join(sizes.alias("s"), on, "left")
    band = F.coalesce(F.col("s._size") >= min_run, F.lit(False))
    return out.select(*[F.col(f"f.{c}") for c in rows.columns], band.alias("in_band"),
                      (F.col("f._low") & ~band).alias("low_alone"))


def running_reference(rows: DataFrame, value: str, keys: Sequence[str], pos: str,
                      keep: float = 0.95, name: str = "ema") -> DataFrame:
    """Exponential moving average after each row: first value, then keep*old + (1-keep)*new.

    ``keep`` lies above 0 and below 1.  A part's halo reaches back to weights of 1e-22, so parts give the full
    result; parts are short enough for ``keep ** -row`` to stay a finite number.
    """
    if not 0.0 < keep < 1.0:
        raise ValueError("keep must lie between 0 and 1")
    fade = -math.log(keep)
    halo = math.ceil(22 * math.log(10) / fade)
    part = max(halo, 1, min(PART, int(600 / fade) - 2 * halo))
    h = ordered.with_halo(rows, pos, part, halo)
    w = Window.partitionBy(*keys, "_part").orderBy(pos)
    rel = (F.col(pos) - F.col("_part") * part).cast("double")
    weight = F.when(F.col("_first") == F.col(pos), 1.0).otherwise(1.0 - keep)
    firsts = rows.groupBy(*keys).agg(F.min(pos).alias("_first"))
    h = attach(h, firsts, keys, [pos], "inner").withColumn("_rel", rel)
    term = weight * F.col(value) * F.pow(F.lit(keep), -F.col("_rel"))
    run = F.sum(term).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (h.withColumn(name, run * F.pow(F.lit(keep), F.col("_rel")))
            .filter("_own").drop("_own", "_part", "_rel", "_first"))


def closest_index(rows: DataFrame, keys: Sequence[str] = TRACK, pos: str = "frame_idx") -> DataFrame:
    """0-based position of the row where the ball is closest to the rim centre.

    Falls back to the middle row, with ``detected`` false, when no row has both boxes.
    """
    both = B.present("ball") & B.present("rim")
    d = B.distance(B.center_x("ball") - B.center_x("rim"), B.center_y("ball") - B.center_y("rim"))
    g = rows.groupBy(*keys).agg(
        F.min_by(F.col(pos), F.when(both, F.struct(d.alias("d"), F.col(pos).alias("p")))).alias("at"),
        F.min(pos).alias("p0"), F.count(F.lit(1)).alias("n"))
    return g.select(*keys, "n", F.coalesce(F.col("at") - F.col("p0"), F.floor(F.col("n") / 2))
                    .cast("long").alias("center"), F.col("at").isNotNull().alias("detected"))


def window_positions(per_key: DataFrame, length: int = 16, center: str = "center",
                     n: str = "n") -> DataFrame:
    """Positions of a fixed-length window around ``center``, shifted into [0, n), clamped."""
    c, size = F.col(center), F.col(n)
    start = F.greatest(c - length // 2, F.lit(0))
    start = F.when(start + length > size, F.greatest(F.lit(0), size - length)).otherwise(start)
    ks = F.array(*[F.lit(i) for i in range(length)])
    return (per_key.withColumn("_start", start).select("*", F.posexplode(ks).alias("slot", "_k"))
            .withColumn("position", F.least(F.col("_start") + F.col("_k"), size - 1))
            .drop("_start", "_k"))


def even_positions(per_key: DataFrame, k: int = 16, n: str = "n") -> DataFrame:
    """``k`` evenly spaced positions of n rows, half-even rounding; short keys repeat the last."""
    size = F.col(n)
    ks = F.array(*[F.lit(i) for i in range(k)])
    even = F.bround(F.col("slot") * (size - 1) / F.lit(float(k - 1)), 0).cast("long")
    return (per_key.select("*", F.posexplode(ks).alias("slot", "_k")).drop("_k")
            .withColumn("position", F.when(size <= k, F.least(F.col("slot"), size - 1))
                        .otherwise(even)))


def stratified_pick(rows: DataFrame, group: Sequence[str], strata: Sequence[str],
                    order: Sequence[str], bucket: Column, limit: int = 25) -> DataFrame:
    """At most ``limit`` rows per group, round-robin over strata (largest first).

    Each stratum gives its middle row first and then moves outwards.  Pick order is
    (round, stratum rank); strata of equal size rank by their first row.
    """
    sk = [*group, *strata]
    r = ordered.row_number(rows, sk, order, bucket, "_rn")
    sizes = rows.groupBy(*sk).agg(F.count(F.lit(1)).alias("_m"), F.min(F.struct(*order)).alias("_f"))
    rank = Window.partitionBy(*group).orderBy(F.col("_m").desc(), "_f")   # a few strata per group
    sizes = sizes.withColumn("_rank", F.row_number().over(rank)).drop("_f")
    r = attach(r, sizes, sk, order, "inner")
    i, mid = F.col("_rn") - 1, F.floor(F.col("_m") / 2)
    right_first = F.col("_m") % 2 == 1
    away = F.abs(i - mid)
    rnd = F.when(away == 0, 0).otherwise(
        2 * away - F.when((i > mid) == right_first, 1).otherwise(0))
    r = r.withColumn("_round", rnd).filter(F.col("_round") < limit)   # limit rows per stratum
    top = Window.partitionBy(*group).orderBy("_round", "_rank")
    return (r.withColumn("pick", F.row_number().over(top)).filter(F.col("pick") <= limit)
            .drop("_rn", "_m", "_rank", "_round"))
