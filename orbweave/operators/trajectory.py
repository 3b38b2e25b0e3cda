"""3-D trajectory operators: fits, arc windows, crossings, descent verdicts, triangulation."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from orbweave.functions import boxes as B, fixed as K, ordered
from orbweave.functions.lineage import cut
from orbweave.functions.skew import attach, grouped
from orbweave.operators import sequence as S
from orbweave.operators.evaluate import count_if
from orbweave.operators.tracks import flag

SHOT = ("game_id", "shot")


def radius(x="x", y="y") -> Column:
    return B.distance(F.col(x) - F.lit(K.RIM_X), F.col(y) - F.lit(K.RIM_Y))


def in_court(df: DataFrame, bounds=K.COURT_BOUNDS) -> DataFrame:
    return df.filter(B.in_bounds(bounds=bounds))


# ---- fits -------------------------------------------------------------------------
def parabola(samples: DataFrame, keys: Sequence[str] = SHOT) -> DataFrame:
    """Gravity-constrained least squares: x, y linear in t, z + g t^2/2 linear in t; RMS residual."""
    zc = F.col("z") + F.lit(0.5 * K.GRAVITY_CM) * F.col("t") * F.col("t")
    s = samples.withColumn("zc", zc)

    def line(c, p):
        return [F.regr_slope(c, "t").alias(f"v{p}"), F.regr_intercept(c, "t").alias(f"{p}0"),
                (F.regr_syy(c, "t") - F.coalesce(F.regr_sxy(c, "t") * F.regr_slope(c, "t"), F.lit(0.0)))
                .alias(f"_e{p}")]
    g = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *line("x", "x"), *line("y", "y"),
                             *line("zc", "z"))
    sse = F.greatest(F.col("_ex") + F.col("_ey") + F.col("_ez"), F.lit(0.0))
    return g.filter(F.col("vx").isNotNull()).select(
        *keys, "n", "x0", "y0", "z0", "vx", "vy", "vz", F.sqrt(sse / F.col("n")).alias("rms_cm"))


def arc_window(samples: DataFrame, keys: Sequence[str] = SHOT, before: float = 0.8,
               after: float = 0.15, min_apex: float = 240.0) -> DataFrame:
    """Rows of the throw around its apex; all rows when no apex is high enough.

    The apex is the highest row in front of the rim (1500..2200 cm), else the highest row.
    """
    front = (F.col("z") >= min_apex) & F.col("x").between(1500.0, 2200.0)
    top = F.struct("z", -F.col("frame"))
    g = samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.max_by("t", F.when(front, top)).alias("_ft"),
        F.max_by(F.struct("t", "z"), top).alias("_g"))
    t_apex = F.coalesce("_ft", F.when(F.col("_g.z") >= min_apex, F.col("_g.t")))
    g = g.select(*keys, F.when(F.col("_n") >= 6, t_apex).alias("t_apex"))
    r = attach(samples, g, keys, ["frame"], "inner")
    ok = F.col("t_apex").isNull() | F.col("t").between(F.col("t_apex") - before, F.col("t_apex") + after)
    return r.filter(ok)


def rim_crossings(fits: DataFrame, spans: DataFrame, keys: Sequence[str] = SHOT) -> DataFrame:
    """Times, places and radii where a fitted parabola meets the rim plane, up to 1 s past the data."""
    j = fits.join(spans, list(keys))
    a, b, c0 = F.lit(-0.5 * K.GRAVITY_CM), F.col("vz"), F.col("z0") - F.lit(K.RIM_Z)
    disc = b * b - F.lit(4.0) * a * c0
    roots = F.array(*[(-b + F.lit(s) * F.sqrt(disc)) / (F.lit(2.0) * a) for s in (1.0, -1.0)])
    x = j.filter(disc > 0).withColumn("t_cross", F.explode(roots)).filter(
        F.col("t_cross").between(F.col("t_min"), F.col("t_max") + 1.0))
    x = x.withColumn("x_cross", F.col("x0") + F.col("vx") * F.col("t_cross")) \
        .withColumn("y_cross", F.col("y0") + F.col("vy") * F.col("t_cross")) \
        .withColumn("r_cross", radius("x_cross", "y_cross"))
    return x.select(*keys, "t_cross", "x_cross", "y_cross", "r_cross",
                    (F.col("r_cross") <= K.RIM_RADIUS + K.BALL_RADIUS).alias("inside_rim"))


def _line_fits(t: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope and start of each coordinate over t for stacks of point sets (..., m) and (..., m, 3)."""
    tm, pm = t.mean(-1, keepdims=True), p.mean(-2, keepdims=True)
    dt = (t - tm)[..., None]
    with np.errstate(invalid="ignore"):   # a single point has no slope
        slope = (dt * (p - pm)).sum(-2) / (dt * dt).sum(-2)
    return slope, pm[..., 0, :] - slope * tm


def _ransac_fit(n_iter, inlier_cm, seed):
    """The robust fit of one arc as a function of its times and points."""
    drop = np.array([0.0, 0.0, 0.5 * K.GRAVITY_CM])
    drawn: dict[int, np.ndarray] = {}     # the seeded subsets depend on the arc length only

    def subsets(n):
        if n not in drawn:
            rng = np.random.default_rng(seed)
            drawn[n] = np.stack([rng.choice(n, size=4, replace=False) for _ in range(n_iter)])
        return drawn[n]

    def errors(slope, start, t, lifted):
        x, y, z = (start[..., i, None] + slope[..., i, None] * t - lifted[:, i] for i in range(3))
        return np.sqrt(x * x + y * y + z * z)

    def fit(t, p):
        """Number of rows and of inliers, slope and start of the refit, its rms."""
        n, lifted = len(t), p + drop * (t * t)[:, None]
        keep = use = np.arange(n)
        if n >= 4:
            picks = subsets(n)
            near = errors(*_line_fits(t[picks], lifted[picks]), t, lifted) <= inlier_cm
            best = int(np.argmax(near.sum(1)))
            keep = np.flatnonzero(near[best])
            use = keep if len(keep) >= 4 else picks[best]
        slope, start = _line_fits(t[use], lifted[use])
        return n, len(keep), *slope.tolist(), *start.tolist(), float(np.sqrt((errors(slope, start, t[use], lifted[use]) ** 2).mean()))

    return fit


def _ransac_group(keys, n_iter, inlier_cm, seed, within=()):
    fit = _ransac_fit(n_iter, inlier_cm, seed)

    def run(tab: pa.Table) -> pa.Table:
        tab = tab.sort_by([*((c, "ascending") for c in within), ("frame", "ascending")])
        t, p = tab["t"].to_numpy(), np.column_stack([tab[c].to_numpy() for c in "xyz"])
        cut_at = np.zeros(len(t), bool)
        cut_at[0] = True
        for c in within:
            v = tab[c].to_numpy()
            cut_at[1:] |= v[1:] != v[:-1]
        at = np.flatnonzero(cut_at)
        fits = [fit(t[i:j], p[i:j]) for i, j in zip(at, np.append(at[1:], len(t)))]
        out = {c: tab[c].take(pa.array(at)).combine_chunks() for c in (*keys, *within)}
        return pa.table({**out, **{c: pa.array(v) for c, v in zip(FIT, zip(*fits))}})
    return run


FIT = ("n", "n_inliers", "vx", "vy", "vz", "x0", "y0", "z0", "rms_cm")


def ransac_parabola(arcs: DataFrame, keys: Sequence[str] = SHOT, n_iter: int = 300,
                    inlier_cm: float = 70.0, seed: int = 42, within: Sequence[str] = ()) -> DataFrame:
    """Robust parabola per arc: seeded 4-point hypotheses, most inliers (first wins), refit.

    Arcs span under a second of frames, so a group is a few dozen rows.  ``within``: numbers that tell the few arcs of a
    key apart, which one call fits.
    """
    kt = ", ".join(f"{k} {dict(arcs.dtypes)[k]}" for k in (*keys, *within))
    schema = kt + ", n long, n_inliers long, vx double, vy double, vz double, x0 double, y0 double, " \
        "z0 double, rms_cm double"
    cols = arcs.select(*keys, *within, "frame", "t", "x", "y", "z")   # one-row arcs have no slope
    return grouped(cols, [*keys]).applyInArrow(_ransac_group(list(keys), n_iter, inlier_cm, seed, tuple(within)), schema)


# ---- ordered evidence ---------------------------------------------------------------
def first_plane_crossing(samples: DataFrame, keys: Sequence[str] = SHOT) -> DataFrame:
    """First step from at/above the rim plane to below it, with the interpolated place."""
    n = ordered.neighbours(samples.select(*keys, "frame", "t", "x", "y", "z"), keys, ["frame"],
                           ["t", "x", "y", "z"], ordered.frame_bucket("frame"), None, "nx")
    f = (F.col("z") - F.lit(K.RIM_Z)) / F.greatest(F.col("z") - F.col("nx.z"), F.lit(1e-3))
    hit = n.filter((F.col("z") >= K.RIM_Z) & (F.col("nx.z") < K.RIM_Z))
    c = hit.select(*keys, "frame", (F.col("x") + f * (F.col("nx.x") - F.col("x"))).alias("cross_x"),
                   (F.col("y") + f * (F.col("nx.y") - F.col("y"))).alias("cross_y"),
                   (F.col("nx.t") - F.col("t")).alias("cross_dt"))
    g = c.groupBy(*keys).agg(F.min_by(F.struct("frame", "cross_x", "cross_y", "cross_dt"), "frame")
                             .alias("c"))
    return g.select(*keys, "c.*").withColumn("cross_r", radius("cross_x", "cross_y"))


def contact_bounce(samples: DataFrame, keys: Sequence[str] = SHOT, pos: str = "frame") -> DataFrame:
    """First row at rim height (290..360 cm) that rises at least 5 cm within the next five rows."""
    h = ordered.with_halo(samples, pos, 4096, 5)
    w = Window.partitionBy(*keys, "_part").orderBy(pos).rowsBetween(1, 5)
    h = h.withColumn("_rise", F.max("z").over(w) - F.col("z")).filter("_own")
    hit = h.filter(F.col("z").between(290.0, 360.0) & (F.col("_rise") >= 5.0))
    g = hit.groupBy(*keys).agg(F.min_by(F.struct(pos, "z", "_rise", "x", "y"), pos).alias("b"))
    return g.select(*keys, F.col(f"b.{pos}").alias("contact_frame"), F.col("b._rise").alias("bounce_cm"),
                    F.col("b.z").alias("z_at_contact"), F.col("b.x").alias("bx"), F.col("b.y").alias("by_")) \
        .withColumn("r_at_contact", radius("bx", "by_")).drop("bx", "by_")


def apex_candidates(samples: DataFrame, keys: Sequence[str] = SHOT, pos: str = "frame",
                    min_z: float = 300.0, rise: float = 50.0, fall: float = 50.0,
                    span: int = 25) -> DataFrame:
    """Local maxima of the smoothed height with enough rise before and fall after, near the rim."""
    sm = S.moving_average3(samples, "z", keys, pos, "zs")
    h = ordered.with_halo(sm, pos, 4096, span + 1)
    w = Window.partitionBy(*keys, "_part").orderBy(pos)
    lo = F.min("zs").over(w.rowsBetween(-span, -1))
    hi = F.min("zs").over(w.rowsBetween(1, span - 1))
    h = h.withColumn("_lag", F.lag("zs").over(w)).withColumn("_lead", F.lead("zs").over(w)) \
        .withColumn("_lo", lo).withColumn("_hi", hi).filter("_own")
    ok = ((F.col("zs") >= min_z) & F.col("x").between(1500.0, 2200.0)
          & (F.col("zs") >= F.col("_lag")) & (F.col("zs") >= F.col("_lead"))
          & (F.col("zs") - F.col("_lo") >= rise) & (F.col("zs") - F.col("_hi") >= fall))
    return h.filter(ok).select(*keys, pos, "t", "x", "y", "z", "zs")


def descent_stats(samples: DataFrame, keys: Sequence[str] = SHOT) -> DataFrame:
    """Apex of the in-court rows, rows within 1.2 s after it, largest time gap, crossing bracket."""
    court = in_court(samples)
    apex = court.groupBy(*keys).agg(F.max_by(F.struct("frame", "t", "x", "y", "z"),
                                             F.struct("z", -F.col("frame"))).alias("a"))
    n = ordered.neighbours(court.select(*keys, "frame", "t", "z"), keys, ["frame"], ["t", "z"],
                           ordered.frame_bucket("frame"), None, "nx")
    r = attach(n, apex, keys, ["frame"], "inner")
    inside = (F.col("t") >= F.col("a.t")) & (F.col("t") <= F.col("a.t") + 1.2)
    both = inside & (F.col("nx.t") <= F.col("a.t") + 1.2)
    cross = ((F.col("frame") >= F.col("a.frame")) & (F.col("z") >= K.RIM_Z) & (F.col("nx.z") < K.RIM_Z))
    dt = F.col("nx.t") - F.col("t")
    g = r.groupBy(*keys).agg(
        F.max("a.z").alias("apex_z"), F.max(radius("a.x", "a.y")).alias("apex_r"),
        count_if(inside).alias("desc_n"), F.coalesce(F.max(F.when(both, dt)), F.lit(-1.0))
        .alias("desc_max_gap"),
        F.coalesce(F.min_by(dt, F.when(cross, F.col("frame"))), F.lit(-1.0)).alias("cross_dt"))
    return g


def reappearance(samples: DataFrame, stops: DataFrame, keys: Sequence[str] = SHOT) -> DataFrame:
    """In-court rows soon after the walk stopped: at rim height off centre, above the plane, in the gap."""
    r = attach(in_court(samples), stops.select(*keys, "stop_t"), keys, ["frame"], "inner")
    after = F.col("t") - F.col("stop_t")
    soon = (after > 1e-9) & (after <= 1.2)
    return r.groupBy(*keys).agg(
        count_if(soon & (F.col("z") > 250) & (F.col("z") < 420) & (radius() > 60))
        .alias("reappear_rim_h"),
        count_if(soon & (F.col("z") > K.RIM_Z)).alias("reappear_any"),
        count_if((after > 0) & (after <= 0.30)).alias("gap_raw_n"))


def approach_extrapolation(rows: DataFrame, keys: Sequence[str] = SHOT, order: str = "frame", least: int = 5) -> DataFrame:
    """Where the fitted image parabola of a ball comes down to rim level: n, crossing, t_cross, lateral, depth.

    ``rows``: keys, order, t, ball centre (cx, cy) and width (bw), hoop centre, width and height (rim_cx, rim_cy, rim_w,
    rim_h; constant per key).  Only balls within two hoop widths of the column and not two heights below it count.  cy is
    fitted by a quadratic and cx by a line in the time since the first row; where the quadratic opens downwards in the image,
    its descending root at rim level is the crossing.  ``lateral`` is the offset there in half hoop widths, ``depth``
    the width of the ball nearest that time (the first of two) in hoop widths.  Fewer than ``least`` rows, a flat or
    upward fit and a curve that never reaches the rim give crossing 0 and nulls.  Sums only: no key's rows meet.
    """
    keys = list(keys)
    near = (F.abs(F.col("cx") - F.col("rim_cx")) <= 2 * F.col("rim_w")) & (F.col("cy") <= F.col("rim_cy") + 2 * F.col("rim_h"))
    seen = rows.filter(near)
    first = seen.groupBy(*keys).agg(F.min_by("t", order).alias("_t0"), F.max("rim_cx").alias("rim_cx"), F.max("rim_cy").alias("rim_cy"),
                                    F.max("rim_w").alias("rim_w"))
    u = attach(seen.drop("rim_cx", "rim_cy", "rim_w"), first, keys, [order], "inner").withColumn("u", F.col("t") - F.col("_t0"))
    x, y = F.col("u"), F.col("cy") - F.col("rim_cy")
    power = {f"s{i}": F.sum(F.pow(x, F.lit(float(i)))) for i in range(1, 5)}
    sums = u.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[v.alias(c) for c, v in power.items()], F.sum(y).alias("y0"), F.sum(x * y).alias("y1"),
        F.sum(x * x * y).alias("y2"), F.regr_slope("cx", "u").alias("_m"), F.regr_intercept("cx", "u").alias("_q"))
    n, s1, s2, s3, s4, y0, y1, y2 = (F.col(c) for c in ("n", "s1", "s2", "s3", "s4", "y0", "y1", "y2"))
    whole = n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
    c = (y0 * (s2 * s4 - s3 * s3) - s1 * (y1 * s4 - s3 * y2) + s2 * (y1 * s3 - s2 * y2)) / F.nullif(whole, F.lit(0.0))
    b = (n * (y1 * s4 - s3 * y2) - y0 * (s1 * s4 - s2 * s3) + s2 * (s1 * y2 - s2 * y1)) / F.nullif(whole, F.lit(0.0))
    a = (n * (s2 * y2 - s3 * y1) - s1 * (s1 * y2 - s2 * y1) + y0 * (s1 * s3 - s2 * s2)) / F.nullif(whole, F.lit(0.0))
    fit = sums.withColumns({"_a": a, "_b": b, "_c": c}).withColumn("_d", F.col("_b") * F.col("_b") - 4 * F.col("_a") * F.col("_c"))
    ok = (F.col("n") >= least) & (F.col("_a") > 0) & (F.col("_d") > 0)
    fit = fit.select(*keys, "n", F.when(ok, (F.sqrt("_d") - F.col("_b")) / (2 * F.col("_a"))).alias("t_cross"), "_m", "_q")
    ball = attach(u.select(*keys, order, "u", "bw"), fit.select(*keys, "t_cross"), keys, [order], "inner").groupBy(*keys).agg(
        F.min_by("bw", F.struct(F.abs(F.col("u") - F.col("t_cross")).alias("d"), F.col(order).alias("o"))).alias("_bw"))
    out = fit.join(first, keys).join(ball, keys)
    at = F.col("_q") + F.col("_m") * F.col("t_cross")
    crossed = F.col("t_cross").isNotNull()
    return out.select(*keys, "n", crossed.cast("int").alias("crossing"), "t_cross",
                      (F.abs(at - F.col("rim_cx")) / (F.col("rim_w") / 2 + 1e-6)).alias("lateral"),
                      F.when(crossed, F.col("_bw") / (F.col("rim_w") + 1e-6)).alias("depth"))


# ---- descent verdict -----------------------------------------------------------------
@dataclass(frozen=True)
class DescentRules:
    """Parameters of the descent verdict; defaults are the production set."""
    skip_noisy: bool = True
    max_skips: int = 8
    y_guard: bool = True
    make_r: float = 40.0
    max_rows: int = 30

    @property
    def reach(self) -> int:
        """Rows after the apex the walk can look at before it must have ended."""
        return self.max_rows * (self.max_skips + 1) + 1


def _hop(a, b) -> Column:
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))


def _off_centre(p) -> Column:
    return F.sqrt((p["x"] - K.RIM_X) * (p["x"] - K.RIM_X) + (p["y"] - K.RIM_Y) * (p["y"] - K.RIM_Y))


def _walk_state(rules: DescentRules):
    """Step of the walk as an expression: (state, row) -> state.

    The state holds the last accepted row, the radii of the last four, the noisy rows in a row, the accepted positions
    and why the walk ended (``end``: gap, noise or done; null while it goes on).
    """
    def step(s, row):
        wait = F.greatest(row["t"] - s["at"]["t"], F.lit(1.0 / K.FPS))
        moves = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.get(s["radii"], i) - F.get(s["radii"], i - 1))
        steady = (F.size(s["radii"]) < 4) | (F.get(F.array_sort(moves), F.lit(1)) <= 1.5)
        vanished = (wait > 0.15) & (s["at"]["z"] < 360) & (_off_centre(s["at"]) < 45) & steady
        jump = _hop(row, s["at"])
        noisy = (jump > 250) | (jump / wait > 2500.0)
        noise = s["noise"] + 1
        tired = F.lit(True) if not rules.skip_noisy else noise > rules.max_skips
        below = (row["z"] < K.RIM_Z - 20) & (_off_centre(row) < 60)
        full = F.size(s["kept"]) + 1 >= rules.max_rows

        def state(at, radii, count, kept, end):
            return F.struct(at.alias("at"), radii.alias("radii"), count.alias("noise"), kept.alias("kept"), end.alias("end"))
        taken = state(row, F.slice(F.concat(s["radii"], F.array(_off_centre(row))),
                                   F.greatest(F.size(s["radii"]) - 2, F.lit(1)), 4), F.lit(0), F.concat(s["kept"], F.array(row["k"])),
                      F.when(below | full, "done"))
        ended = state(s["at"], s["radii"], s["noise"], s["kept"], F.lit("gap"))
        passed_over = state(s["at"], s["radii"], noise, s["kept"], F.when(tired, "noise"))
        return F.when(s["end"].isNotNull(), s).when(vanished, ended).when(noisy, passed_over).otherwise(taken)
    return step


def descent_walk(after_apex: DataFrame, keys: Sequence[str], rules: DescentRules) -> DataFrame:
    """Accepted rows of the post-apex walk (1..30 per shot) with their sequence number.

    ``after_apex`` holds at most ``rules.reach`` rows per shot, counted from the apex, so a shot's rows are folded as
    one sorted array by a native expression.
    """
    row = F.struct(F.col("pos").alias("k"), "t", "x", "y", "z")
    shots = after_apex.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    first = F.get("rows", F.lit(0))
    start = F.struct(first.alias("at"), F.array(_off_centre(first)).alias("radii"), F.lit(0).alias("noise"),
                     F.array(first["k"]).alias("kept"), F.lit(None).cast("string").alias("end"))
    walked = shots.withColumn("w", F.aggregate(F.slice("rows", 2, rules.reach), start, _walk_state(rules)))
    accepted = F.filter("rows", lambda r: F.array_contains("w.kept", r["k"]))
    return walked.select(*keys, F.coalesce(F.col("w.end") == "gap", F.lit(False)).alias("gap_stop"), F.posexplode(accepted).alias("i", "r")).select(
        F.col("r.k").alias("pos"), "r.t", "r.x", "r.y", "r.z", (F.col("i") + 1).cast("long").alias("seq"), "gap_stop", *keys)


def walk_evidence(walk: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Evidence of the walk per shot; windows see at most 30 rows."""
    w = Window.partitionBy(*keys).orderBy("seq")
    whole = Window.partitionBy(*keys)
    z, nz = F.col("z"), F.col("nz")
    f = (z - F.lit(K.RIM_Z)) / F.greatest(z - nz, F.lit(1e-3))
    r = (walk.withColumn("r", radius()).withColumn("nz", F.lead("z").over(w))
         .withColumn("nxx", F.lead("x").over(w)).withColumn("nyy", F.lead("y").over(w))
         .withColumn("rise", F.max("z").over(w.rowsBetween(1, 5)) - F.col("z"))
         .withColumn("dr", F.col("r") - F.lag("r").over(w))
         .withColumn("n_post", F.count(F.lit(1)).over(whole)))
    r = r.withColumn("crosses", (z >= K.RIM_Z) & (nz < K.RIM_Z))
    r = r.withColumn("cseq", F.min(F.when(F.col("crosses"), F.col("seq"))).over(whole))
    tail = (F.col("seq") > F.col("cseq")) & (F.col("seq") <= F.col("cseq") + 8)
    contact = F.col("nz").isNotNull() & z.between(290.0, 360.0) & (F.col("rise") >= 5.0)
    last = F.col("seq") == F.col("n_post")
    cx = F.col("x") + f * (F.col("nxx") - F.col("x"))
    cy = F.col("y") + f * (F.col("nyy") - F.col("y"))
    low = F.min_by(F.struct("z", "r"), F.struct("z", "seq"))
    g = r.groupBy(*keys).agg(
        F.max("n_post").alias("n_post"), F.max(flag(F.col("gap_stop"))).alias("gap"),
        low.alias("low"), F.min_by(F.struct("rise", "z", "r"), F.when(contact, F.col("seq")))
        .alias("contact"),
        F.min_by(F.struct(cx.alias("x"), cy.alias("y")), F.when(F.col("crosses"), F.col("seq")))
        .alias("cross"),
        count_if(tail).alias("tail_n"), F.min(F.when(tail, z)).alias("tail_min"),
        F.max_by(z, F.when(tail, F.col("seq"))).alias("tail_end"),
        F.max(F.when(last, F.struct("t", "x", "y", "z", "r"))).alias("stop"),
        F.array_sort(F.collect_list(F.when(F.col("seq") > F.col("n_post") - 3, F.col("dr")))).alias("drs"))
    return g.select(
        *keys, "n_post", (F.col("gap") > 0).alias("gap_stop"), F.col("low.z").alias("z_min"),
        F.col("low.r").alias("r_at_zmin"), F.col("contact.rise").alias("bounce_cm"),
        F.col("contact.z").alias("z_at_contact"), F.col("contact.r").alias("r_at_contact"),
        radius("cross.x", "cross.y").alias("cross_r"),
        F.abs(F.col("cross.y") - F.lit(K.RIM_Y)).alias("cross_y"),
        ((F.col("tail_n") >= 3) & (F.col("tail_min") > K.RIM_Z - 30)
         & (F.col("tail_end") >= K.RIM_Z - 5)).alias("bounce_back"),
        F.col("stop.t").alias("stop_t"), F.col("stop.r").alias("stop_r"), F.col("stop.z").alias("stop_z"),
        F.abs(F.col("stop.y") - F.lit(K.RIM_Y)).alias("y_off_stop"),
        F.when(F.col("n_post") >= 4, F.get("drs", F.lit(1))).alias("med_dr"))


def descent_rule(rules: DescentRules) -> Column:
    """Name of the rule that decides, in rule order, over walk evidence and apex columns."""
    guard = F.lit(rules.y_guard)
    cross, contact = F.col("cross_r").isNotNull(), F.col("bounce_cm").isNotNull()
    narrow = cross & (F.col("cross_r") < rules.make_r)
    y_off, cy = F.col("y_off_stop"), F.col("cross_y")
    bb = F.coalesce("bounce_back", F.lit(False))
    smooth = ((F.col("z_min") >= K.RIM_Z) & (F.col("r_at_zmin") < 80) & (F.col("apex_r") < 600)
              & ((F.col("apex_r") <= 80) | (F.col("z_min") - K.RIM_Z <= 50)) & (F.col("med_dr") <= 1.5))
    return (F.when(F.col("n_samples") < 3, "undecided_no_samples")
            .when(F.col("apex_z") < 250, "undecided_low_apex").when(F.col("apex_r") > 1000, "clean_far")
            .when(F.col("n_after") < 3, "undecided_no_descent")
            .when(F.coalesce("n_post", F.lit(0)) < 4, "undecided_short_walk")
            .when(F.col("gap_stop") & ~(guard & (y_off > 22)), "gap_stop")
            .when(narrow & bb & guard & (F.col("cross_r") < 25) & (cy < 20), "bounceback_override")
            .when(narrow & bb, "bounce_back")
            .when(narrow & contact & guard & (cy >= 15) & (y_off >= 20), "y_reject_rattle")
            .when(narrow & contact, "rattle_make")
            .when(narrow & guard & (y_off > 40), "y_reject_cross").when(narrow, "cross_make")
            .when(contact & (F.col("r_at_contact") < 150), "rim_out")
            .when(cross & guard & (cy <= 25) & ~bb, "cross_y_override").when(cross, "cross_too_wide")
            .when(smooth & guard & (y_off > 20), "y_reject_smooth").when(smooth, "smooth_make")
            .otherwise("rule6_default"))


REBOUND_S = 1.5          # the deepest point within a second of the apex, and 0.4 s after it
MAKE_RULES = ("gap_stop", "bounceback_override", "rattle_make", "cross_make", "cross_y_override",
              "smooth_make")


def near_rebound(after: DataFrame, keys: Sequence[str], box=K.NEAR_HOOP_BOX) -> DataFrame:
    """Near-camera rebound after the deepest point in the hoop box, within a second of the apex.

    ``after``: rows from the apex on with t, z, nr_x, nr_y and ``apex_t``.
    """
    x1, y1, x2, y2 = box
    deep = ((F.col("t") - F.col("apex_t") <= 1.0) & F.col("nr_x").between(x1, x2)
            & F.col("nr_y").between((y1 + y2) / 2.0, y2 + 30))
    top = after.groupBy(*keys).agg(
        F.max_by(F.struct("pos", "t", "z", "nr_y"), F.when(deep, F.struct("nr_y", -F.col("pos"))))
        .alias("m"), F.min(F.when(F.col("k") < 30, F.col("z"))).alias("z_low"))
    r = attach(after, top, keys, ["pos"], "inner")
    back = ((F.col("pos") > F.col("m.pos")) & (F.col("t") - F.col("m.t") <= 0.4)
            & F.col("nr_x").between(x1 - 200, x2 + 200) & (F.col("nr_y") >= y1 - 50)
            & (F.col("nr_y") < F.col("m.nr_y")))
    g = r.groupBy(*keys).agg(
        F.first("m").alias("m"), F.max("z_low").alias("z_low"),
        F.min_by(F.struct("nr_y", "z", "t"), F.when(back, F.struct("nr_y", "pos"))).alias("b"))
    climb = F.col("m.nr_y") - F.coalesce(F.col("b.nr_y"), F.col("m.nr_y"))
    sinks = F.coalesce(F.col("b.z") < F.col("m.z") - 5.0, F.lit(False))
    return g.select(*keys, F.coalesce((climb >= 100.0) & ~sinks, F.lit(False)).alias("nr_rebound"),
                    climb.alias("rebound_px"), "z_low")


def _after_apex(samples: DataFrame, keys: Sequence[str], rules: DescentRules, bounds, order: str, apex_at: str | None):
    """Numbered rows from the apex on, and one row per shot about its apex."""
    court = in_court(samples, bounds) if bounds else samples
    b = ordered.frame_bucket(order)
    n = cut(ordered.row_number(court, keys, [order], b, "pos"))
    row = F.struct("pos", "t", "x", "y", "z")
    if apex_at is None:
        highest = F.max_by(row, F.struct("z", -F.col("pos")))
    else:
        highest = F.min_by(row, F.struct(F.abs(F.col("t") - F.col(apex_at)), F.col("pos")))
    apex = n.groupBy(*keys).agg(highest.alias("a"), F.count(F.lit(1)).alias("n_samples"))
    apex = apex.select(*keys, "n_samples", F.col("a.pos").alias("apex_pos"), F.col("a.t").alias("apex_t"),
                       F.col("a.z").alias("apex_z"), radius("a.x", "a.y").alias("apex_r"),
                       (F.col("n_samples") - F.col("a.pos")).alias("n_after"))
    after = attach(n, apex.select(*keys, "apex_pos", "apex_t"), keys, [order], "inner")
    # the walk looks at ``reach`` rows, the rebound at REBOUND_S seconds, whatever the frame rate
    after = cut(after.withColumn("k", F.col("pos") - F.col("apex_pos")).filter((F.col("k") >= 0) & (
        (F.col("k") <= rules.reach) | (F.col("t") - F.col("apex_t") <= REBOUND_S))))
    return after, apex


def rows_after_apex(samples: DataFrame, keys: Sequence[str] = SHOT, rules: DescentRules = DescentRules(),
                    bounds=K.COURT_BOUNDS, order: str = "frame", apex_at: str | None = None) -> DataFrame:
    """What :func:`descent_walk` looks at: at most ``rules.reach`` rows of each shot, from the apex on."""
    return _after_apex(samples, list(keys), rules, bounds, order, apex_at)[0].filter(F.col("k") <= rules.reach)


VERDICT = ("verdict_class", "rule", "n_samples", "n_post", "apex_z", "apex_r", "z_min", "r_at_zmin", "bounce_cm", "r_at_contact",
           "cross_r", "cross_y", "y_off_stop", "stop_t", "nr_rebound")


def rescore(samples: DataFrame, keys: Sequence[str] = SHOT, rules: DescentRules = DescentRules(),
            bounds=K.COURT_BOUNDS, order: str = "frame", apex_at: str | None = None,
            min_samples: int = 3) -> DataFrame:
    """Typed verdict per shot from cached samples: bounds, apex, walk, rules, rebound override.

    The apex is the highest row, or, where ``apex_at`` names a column with its time, the row nearest that time;
    the first row on ties.  Shots with fewer than ``min_samples`` rows stay undecided.
    """
    return rescore_all(samples, {"": rules}, keys, bounds, order, apex_at, min_samples).drop("params")


def rescore_all(samples: DataFrame, sets: Mapping[str, DescentRules], keys: Sequence[str] = SHOT, bounds=K.COURT_BOUNDS,
                order: str = "frame", apex_at: str | None = None, min_samples: int = 3) -> DataFrame:
    """:func:`rescore` by several parameter sets: its columns and ``params``, the name of the set.

    Rows are numbered and rebounds looked for once per reach of the walk, and each walk is taken once: sets that differ in
    their rules only judge the same evidence.
    """
    keys, out = list(keys), None
    walks: dict[int, dict[DescentRules, dict[str, DescentRules]]] = {}
    for name, r in sets.items():
        walk = replace(r, y_guard=True, make_r=0.0)                # what the walk does not look at
        walks.setdefault(r.reach, {}).setdefault(walk, {})[name] = r
    for reach, taken in walks.items():
        after, apex = _after_apex(samples, keys, next(iter(taken)), bounds, order, apex_at)
        shots = samples.select(*keys).distinct().join(apex, keys, "left").join(near_rebound(after, keys), keys, "left")
        if len(taken) > 1:
            shots = cut(shots)
        for walk, judged in taken.items():
            ev = walk_evidence(descent_walk(after.filter(F.col("k") <= reach), keys, walk), keys)
            j = shots.join(ev, keys, "left").withColumn("n_samples", F.coalesce("n_samples", F.lit(0)))
            j = j.withColumn("_j", F.explode(F.array(*[F.struct(
                F.lit(name).alias("params"), F.when(F.col("n_samples") < min_samples, "undecided_no_samples").otherwise(
                    descent_rule(r)).alias("rule")) for name, r in judged.items()])))
            j = j.select("*", "_j.params", F.col("_j.rule").alias("_rule"))
            flip = (F.col("_rule").isin(*MAKE_RULES) & F.coalesce("nr_rebound", F.lit(False))
                    & (F.col("z_low") > 150))
            j = j.withColumn("rule", F.when(flip, "nr_rebound").otherwise(F.col("_rule")))
            cls = (F.when(F.col("rule").startswith("undecided"), "UND").when(F.col("rule").isin(*MAKE_RULES), "MAKE")
                   .otherwise("MISS"))
            j = j.withColumn("verdict_class", cls).withColumn("nr_rebound", F.coalesce("nr_rebound", F.lit(False)))
            j = j.select(*keys, "params", *VERDICT)
            out = j if out is None else out.unionByName(j)
    return out


# ---- attempts ------------------------------------------------------------------------
def attempts(samples: DataFrame, keys: Sequence[str] = SHOT, min_sep: float = 1.0,
             min_dip: float = 50.0) -> DataFrame:
    """Separate attempts of a window: apex candidates, highest first, apart in time and by a dip.

    The lowest height between neighbouring candidates is one ordered pass; only candidates, not
    samples, reach the greedy choice, a native fold over a window's few candidates.
    """
    keys = list(keys)
    # windows with fewer than six rows have no attempts
    enough = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 6").select(*keys)
    cand = cut(apex_candidates(samples, keys).join(enough, keys, "left_semi"))
    sm = S.moving_average3(samples, "z", keys, "frame", "zs").select(*keys, "frame", "zs")
    marked = sm.join(cand.select(*keys, "frame", F.lit(1).alias("_c")), [*keys, "frame"], "left")
    f = ordered.fill_known(marked, keys, ["frame"], F.when(F.col("_c") == 1, F.col("frame")),
                           ordered.frame_bucket("frame"), "seg", "_after")
    segs = f.filter(F.col("seg").isNotNull()).groupBy(*keys, "seg").agg(F.min("zs").alias("m"))
    c = cut(cand.join(segs.withColumnRenamed("seg", "frame"), [*keys, "frame"]))
    rest = [n for n in c.columns if n not in (*keys, "frame")]
    w = c.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("zs")).alias("_o"), "frame", *rest))).alias("cs"))

    def low(a, b):
        lo, hi = F.least(a["frame"], b["frame"]), F.greatest(a["frame"], b["frame"])
        between = F.filter("cs", lambda s: (s["frame"] >= lo) & (s["frame"] < hi))
        return F.coalesce(F.array_min(F.transform(between, lambda s: s["m"])), F.lit(1e9))

    def grown(kept, x):
        apart = F.forall(kept, lambda k: (F.abs(x["t"] - k["t"]) >= min_sep) & (k["zs"] - low(x, k) >= min_dip))
        return F.when(apart, F.concat(kept, F.array(x))).otherwise(kept)
    kept = F.aggregate("cs", F.filter("cs", lambda x: F.lit(False)), grown)
    out = w.select(*keys, F.explode(kept).alias("_k")).select(*keys, "_k.*")
    return out.select(*[n for n in c.columns if n != "m"])


def attempt_verdicts(samples: DataFrame, keys: Sequence[str] = SHOT, before: float = 0.8,
                     after: float = 1.5) -> DataFrame:
    """Verdict of every attempt, each judged from its own apex on its own time slice of at least five rows."""
    keys = list(keys)
    a = attempts(samples, keys).select(*keys, F.col("frame").alias("attempt"), F.col("t").alias("_at"))
    # attempts are at least a second apart, so a row belongs to at most four slices
    sl = samples.join(a, keys).filter(
        (F.col("t") >= F.col("_at") - before) & (F.col("t") <= F.col("_at") + after))
    v = rescore(sl, [*keys, "attempt"], bounds=None, apex_at="_at", min_samples=5)
    return v.select(*keys, "attempt", "verdict_class", "rule", "n_samples")


def attempt_summary(verdicts: DataFrame, keys: Sequence[str] = SHOT) -> DataFrame:
    """Number of attempts and the first and last verdict."""
    return verdicts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_attempts"), F.min_by("verdict_class", "attempt").alias("first"),
        F.max_by("verdict_class", "attempt").alias("last"))


# ---- single camera --------------------------------------------------------------------
def single_camera(rows: DataFrame, keys: Sequence[str], box, rebound_px: float = 60.0,
                  min_deep: int = 5, strong_px: float = 150.0) -> DataFrame:
    """Make/miss leaning of one camera from the ball inside its hoop box.

    ``rows``: keys, t, px, py.  Deepest row within a second of the first deep row, then the highest
    row in the next 0.4 s near the hoop.
    """
    x1, y1, x2, y2 = box
    deep = F.col("px").between(x1, x2) & F.col("py").between((y1 + y2) / 2.0, y2 + 30)
    d = rows.withColumn("_deep", F.coalesce(deep, F.lit(False)))
    first = d.groupBy(*keys).agg(F.min(F.when(F.col("_deep"), F.col("t"))).alias("_t0"))
    d = attach(d, first, keys, ["t"], "inner")
    use = F.col("_deep") & (F.col("t") - F.col("_t0") <= 1.0)
    top = d.groupBy(*keys).agg(
        F.max_by(F.struct("t", "py"), F.when(use, F.struct("py", -F.col("t")))).alias("m"),
        count_if(use).alias("n_deep"))
    d = attach(d.drop("_t0", "_deep"), top, keys, ["t"], "inner")
    back = ((F.col("t") > F.col("m.t")) & (F.col("t") - F.col("m.t") <= 0.4)
            & F.col("px").between(x1 - 200, x2 + 200) & (F.col("py") >= y1 - 50))
    g = d.groupBy(*keys).agg(F.first("m").alias("m"), F.max("n_deep").alias("n_deep"),
                             F.min(F.when(back, F.col("py"))).alias("_b"))
    delta = F.col("m.py") - F.least(F.col("m.py"), F.coalesce("_b", F.col("m.py")))
    v = (F.when(F.col("n_deep") == 0, "UND").when(delta >= strong_px, "MISS")
         .when((F.col("n_deep") >= min_deep) & (delta < 40), "MAKE")
         .when(delta >= rebound_px, "MISS-weak").otherwise("MAKE-weak"))
    return g.select(*keys, v.alias("camera_verdict"), F.col("m.py").alias("max_cy"),
                    delta.alias("rebound_px"), "n_deep")


# ---- triangulation -----------------------------------------------------------------------
def _null_vectors(p1: np.ndarray, p2: np.ndarray, u1: np.ndarray, u2: np.ndarray) -> np.ndarray:
    """Homogeneous least-squares points for stacks of projection matrices (n,3,4) and pixels (n,2)."""
    rows = [u[:, i, None] * p[:, 2] - p[:, i] for p, u in ((p1, u1), (p2, u2)) for i in (0, 1)]
    v = np.linalg.svd(np.stack(rows, 1))[2][:, -1]
    return v[:, :3] / v[:, 3:]


POINT = T.StructType([T.StructField(c, T.DoubleType()) for c in "xyz"])


@F.pandas_udf(POINT)
def triangulate(it: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]
                ) -> Iterator[pd.DataFrame]:
    """Point from two pixels and two 12-entry projection matrices; one batched SVD per Arrow batch."""
    for pa, pb, ax, ay, bx, by in it:
        m1 = np.stack(pa.to_numpy()).astype(float).reshape(-1, 3, 4)
        m2 = np.stack(pb.to_numpy()).astype(float).reshape(-1, 3, 4)
        pts = _null_vectors(m1, m2, np.c_[ax, ay].astype(float), np.c_[bx, by].astype(float))
        yield pd.DataFrame(pts, columns=["x", "y", "z"])


def triangulate_pairs(pairs: DataFrame, ax="fr_x", ay="fr_y", bx="nr_x", by="nr_y", pa="P_fr",
                      pb="P_nr") -> DataFrame:
    """Paired detections (with their calibration columns) to world points."""
    return pairs.withColumn("X", triangulate(pa, pb, ax, ay, bx, by)) \
        .select(*[c for c in pairs.columns if c not in (pa, pb)], "X.x", "X.y", "X.z")


def calibration_check(landmarks: DataFrame, calibration: str = "calibration_id") -> DataFrame:
    """Mean and largest distance between triangulated and known landmarks per calibration."""
    p = triangulate_pairs(landmarks)
    e = B.distance(F.col("x") - F.col("wx"), F.sqrt(
        (F.col("y") - F.col("wy")) * (F.col("y") - F.col("wy"))
        + (F.col("z") - F.col("wz")) * (F.col("z") - F.col("wz"))))
    return p.withColumn("_e", e).groupBy(calibration).agg(
        F.avg("_e").alias("mean_error_cm"), F.max("_e").alias("max_error_cm"),
        F.count(F.lit(1)).alias("n"))


def _arc_rows(frame, t, x, z, before: float = 0.8, after: float = 0.15, min_apex: float = 240.0) -> np.ndarray:
    """:func:`arc_window` of one throw's rows in memory: which of them it keeps."""
    if len(t) < 6:
        return np.ones(len(t), bool)
    front = np.flatnonzero((z >= min_apex) & (x >= 1500.0) & (x <= 2200.0))
    some = front if len(front) else np.flatnonzero(z >= min_apex)
    if not len(some):
        return np.ones(len(t), bool)
    apex = t[some[np.lexsort((frame[some], -z[some]))[0]]]
    return (t >= apex - before) & (t <= apex + after)


def _offset_fits(a, b, cameras, offsets: np.ndarray, fit, most: int = 1 << 16):
    """Offset, inliers and rms of each offset whose pairs of two cameras' rows (frames, pixels) leave an arc of six rows."""
    (af, ap), (bf, bp) = ((f[o], p[o]) for f, p in (a, b) for o in [np.argsort(f, kind="stable")])
    for offset in offsets:
        lo, hi = np.searchsorted(bf, af + offset, "left"), np.searchsorted(bf, af + offset, "right")
        i = np.repeat(np.arange(len(af)), hi - lo)
        j = np.arange(len(i)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[i]
        if len(i) * len(cameras) < 6:
            continue
        pts = np.concatenate([_null_vectors(np.broadcast_to(p, (len(k), 3, 4)), np.broadcast_to(q, (len(k), 3, 4)), ap[k], bp[m])
                              for p, q in cameras for at in range(0, len(i), most) for k, m in [(i[at:at + most], j[at:at + most])]])
        frame = np.tile(af[i], len(cameras))
        own = np.flatnonzero(np.logical_and.reduce([(v > low) & (v < high) for v, (low, high) in zip(pts.T, K.LOOSE_BOUNDS)]))
        own = own[np.argsort(frame[own], kind="stable")]
        frame, pts = frame[own], pts[own]
        t = frame.astype("f8") / K.FPS
        arc = _arc_rows(frame, t, pts[:, 0], pts[:, 2])
        if arc.sum() >= 6:
            found = fit(t[arc], pts[arc])
            yield int(offset), found[1], found[-1]


def offset_sweep(a: DataFrame, b: DataFrame, calibration: DataFrame, keys: Sequence[str],
                 offsets: Sequence[int]) -> DataFrame:
    """Best frame offset per shot: re-pair, triangulate, fit robustly, score inliers - rms/2.

    The rows of a shot meet once, both cameras' side by side, and every offset is tried on them in memory: the shuffles hold each
    row once whatever the number of offsets, and one row per shot is kept.  ``calibration``: P_fr and P_nr per value of the
    first key; a shot's pairs are triangulated by each of several.  Of equal scores the smallest offset wins.
    """
    from orbweave.functions.skew import maybe_broadcast
    keys, game = list(keys), keys[0]
    tried = np.array(sorted(set(offsets)))

    def seen(rows, name):
        packed = F.collect_list(F.struct("frame", F.col("px").cast("double").alias("px"), F.col("py").cast("double").alias("py")))
        known = rows.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in (*keys, "frame")))
        return known.groupBy(*keys).agg(packed.alias(name))
    cameras = cut(calibration.filter(F.col(game).isNotNull()).groupBy(game).agg(F.collect_list(F.struct("P_fr", "P_nr")).alias("cameras")))
    shots = seen(a, "a").join(seen(b, "b").hint("merge"), keys).join(maybe_broadcast(cameras), game).select(*keys, "a", "b", "cameras")
    kinds = dict(shots.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", offset int, score double, n_inliers bigint, rms_cm double"

    def best(batches):
        fit = _ransac_fit(200, 70.0, 42)

        def side(column, row):
            rows = column[row].values
            return rows.field("frame").to_numpy(zero_copy_only=False), np.column_stack(
                [rows.field(c).to_numpy(zero_copy_only=False) for c in ("px", "py")])
        for batch in batches:
            found, at = [], []
            for i in range(batch.num_rows):
                matrices = [tuple(np.array(c[p], float).reshape(3, 4) for p in ("P_fr", "P_nr")) for c in batch["cameras"][i].as_py()]
                fits = [(o, n - 0.5 * rms, n, rms) for o, n, rms in _offset_fits(
                    side(batch["a"], i), side(batch["b"], i), matrices, tried, fit)]
                if fits:                       # as in Spark, a score that is not a number is the largest
                    found.append(max(fits, key=lambda f: (f[1] != f[1], f[1] if f[1] == f[1] else 0.0, -f[0])))
                    at.append(i)
            if at:
                own = batch.select(keys).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(v, kind) for v, kind in zip(
                    zip(*found), (pa.int32(), pa.float64(), pa.int64(), pa.float64())))], names=[
                        *keys, "offset", "score", "n_inliers", "rms_cm"])
    return cut(shots.mapInArrow(best, schema))
