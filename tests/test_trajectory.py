"""Trajectory rules on hand-built throws, cleaning on an occluded parabola, fits on exact data."""
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orbweave.functions import boxes as B, fixed as K
from orbweave.operators import clean as C, sequence as S, tracks as T, trajectory as H
from orbweave.plans.shots import arbiter, with_predictions

RX, RY, RZ = K.RIM_X, K.RIM_Y, K.RIM_Z


def throw(points, t=None):
    """Rise to an apex, then the given (dx, dy, z) points relative to the rim."""
    rise = [(-300 + 40 * i, 0.0, 260 + 40 * i) for i in range(4)]
    pts = rise + list(points)
    ts = list(np.arange(len(pts)) / K.FPS) if t is None else list(np.arange(4) / K.FPS) + list(t)
    return [(RX + x, RY + y, float(z), float(s)) for (x, y, z), s in zip(pts, ts)]


DOWN = [(-60, 0, 450), (-40, 0, 420), (-25, 0, 380), (-12, 0, 340), (-5, 0, 315)]
CASES = {
    "cross_make": throw(DOWN + [(0, 0, 290), (2, 0, 260)]),
    "cross_too_wide": throw([(-60, 60, 450), (-60, 60, 400), (-60, 60, 350), (-60, 60, 310), (-60, 60, 280),
                             (-60, 60, 250)]),
    "cross_y_override": throw([(-90, 5, 450), (-85, 5, 400), (-80, 5, 350), (-75, 5, 310), (-70, 5, 280),
                               (-70, 5, 250)]),
    "bounce_back": throw(DOWN[:-1] + [(-30, 25, 306), (-30, 25, 300), (-30, 26, 299), (-30, 26, 303),
                                      (-30, 26, 304)]),
    "bounceback_override": throw(DOWN + [(0, 0, 303), (0, 0, 302), (0, 0, 303), (0, 0, 304)]),
    "rattle_make": throw(DOWN[:-1] + [(-5, 0, 310), (-5, 0, 318), (-2, 0, 312), (0, 0, 290), (0, 0, 260)]),
    "rim_out": throw(DOWN[:-1] + [(-25, 0, 310), (-50, 0, 330), (-80, 0, 370), (-90, 0, 380)]),
    "smooth_make": throw([(-60, 0, 450), (-45, 0, 420), (-30, 0, 390), (-15, 0, 345)]),
    "y_reject_smooth": throw([(-60, 40, 450), (-45, 36, 420), (-30, 32, 390), (-15, 28, 345)]),
    "gap_stop": throw(DOWN[:4] + [(40, 0, 100)], [4 / 30, 5 / 30, 6 / 30, 7 / 30, 14 / 30]),
    "rule6_default": throw([(-200, 200, 450), (-200, 200, 440), (-200, 200, 430), (-200, 200, 420)]),
    "undecided_low_apex": [(RX, RY, 200.0 - i, i / K.FPS) for i in range(8)],
    "undecided_no_descent": throw([(-60, 0, 450), (-50, 0, 440)]),
    "undecided_no_samples": [(RX, RY, 300.0, 0.0)],
    "clean_far": [(RX - 1150, RY, z, i / K.FPS) for i, z in enumerate((400.0, 500.0, 480.0, 450.0, 400.0))],
}


def table(spark, cases, nr=None):
    rows = [(1, name, i, t, x, y, z, *(nr[name][i] if nr and name in nr else (0.0, 0.0)))
            for name, pts in cases.items() for i, (x, y, z, t) in enumerate(pts)]
    return spark.createDataFrame(rows, "game_id int, shot string, frame long, t double, x double, y double, "
                                       "z double, nr_x double, nr_y double")


def test_every_rule(spark):
    got = {r.shot: r.rule for r in H.rescore(table(spark, CASES)).collect()}
    assert got == {k: k for k in CASES}


def test_rebound_overrides_a_make(spark):
    ys = [0.0] * 10 + [1050.0, 1000.0, 930.0]
    hover = {"bounceback_override": [(900.0, y) for y in ys]}
    df = table(spark, {"bounceback_override": CASES["bounceback_override"]}, hover)
    assert H.rescore(df).first().rule == "nr_rebound"
    nr = {"cross_make": [(900.0, y) for y in [0.0] * 6 + [1000.0, 1050.0, 930.0, 930.0, 930.0]]}
    plain = H.rescore(table(spark, {"cross_make": CASES["cross_make"]}, nr)).first()
    assert plain.verdict_class == "MAKE"      # the ball keeps sinking, so the near view is ignored


def test_make_radius_is_monotone(spark):
    df = table(spark, CASES)
    makes = [H.rescore(df, rules=H.DescentRules(make_r=r)).filter("verdict_class = 'MAKE'").count()
             for r in (5.0, 40.0, 120.0)]
    assert makes == sorted(makes)


def occluded(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(60):
        x, y = 100 + 6.0 * i + rng.normal(0, 3), 400 - 18.0 * i + 0.3 * i * i + rng.normal(0, 3)
        if i == 10:
            x, y = x + 900, y + 900
        seen = not (20 <= i <= 25 or 35 <= i <= 54)
        rows.append((1, 1, "FL", i + 1, *((x - 10, y - 10, 20.0, 20.0, 0.9) if seen else (None,) * 5),
                     300.0, 200.0, 80.0, 40.0, 0.9))
    cols = "game_id int, play_id int, angle string, frame_idx long, " + ", ".join(
        f"{p}_{c} double" for p in ("ball", "rim") for c in ("x", "y", "w", "h", "conf"))
    return spark.createDataFrame(rows, cols)


def test_cleaning_keeps_short_gaps_and_drops_spikes(spark):
    out = {r.frame_idx: r for r in C.clean_tracks(occluded(spark)).collect()}
    assert [f for f, r in out.items() if r.rejected] == [11]
    assert sorted(f for f, r in out.items() if r.imputed) == [11] + list(range(21, 27))
    assert all(out[f].cx is None for f in range(36, 56))
    f = C.clean_features(occluded(spark)).first()
    assert f.jitter_clean < f.jitter_raw and f.n_rejected_outlier == 1


def test_smoothing_in_parts_equals_whole(spark, monkeypatch):
    rng = np.random.default_rng(1)
    gaps = [range(300, 500), range(900, 1400), range(2100, 3100), range(3900, 4100)]
    rows = []
    for play, n in ((1, 6000), (2, 40), (3, 700)):
        for i in range(n):
            x, y = float(100 + (3 * i) % 900 / 3 + rng.normal(0, 4)), float(300 + 50 * np.sin(i / 15))
            seen = (play == 1 and i >= 20 and not any(i in g for g in gaps)) or play == 2
            rows.append((1, play, "FL", i, *((x, y, 20.0, 20.0, 0.9) if seen else (None,) * 5), 300.0, 200.0, 80.0, 40.0, 0.9))
    cols = "game_id int, play_id int, angle string, frame_idx long, " + ", ".join(
        f"{p}_{c} double" for p in ("ball", "rim") for c in ("x", "y", "w", "h", "conf"))
    df = spark.createDataFrame(rows, cols)

    def cleaned(part, block):
        monkeypatch.setattr(C, "PART", part)
        monkeypatch.setattr(C, "BLOCK", block)
        return {(r.play_id, r.frame_idx): (r.cx, r.cy) for r in C.clean_tracks(df).collect()}
    whole = cleaned(10_000, 10)
    assert len(whole) == len(rows) and sum(v[0] is not None for v in whole.values()) > 3000
    for part, block in ((64, 5), (512, 2), (2048, 2048)):
        parts = cleaned(part, block)
        assert whole.keys() == parts.keys()
        assert all((a is None) == (b is None) for f in whole for a, b in zip(whole[f], parts[f]))
        assert max(abs(a - b) for f in whole for a, b in zip(whole[f], parts[f]) if a is not None) < 1e-9, part


@pytest.mark.parametrize("part", [1, 7, 64])
def test_elements_hold_gaps_and_late_starts(part):
    rng = np.random.default_rng(part)
    z = np.cumsum(rng.normal(0, 3, (160, 2)), axis=0) + 500
    z[:9] = z[30:70] = z[100:103] = z[150:] = np.nan
    state = C._start(z[9])
    want = C._smooth_axes(z, *state)
    runs = [z[i:i + part] for i in range(0, len(z), part)]
    elements = [C._element(r) for r in runs]
    laters = [(np.zeros((2, 3)), np.zeros((2, 3, 3)))]
    for e in reversed(elements[1:]):
        laters.insert(0, C._before(e, laters[0]))
    got = []
    for r, e, later in zip(runs, elements, laters):
        got.append(C._smooth_axes(r, *state, later))
        state = C._after(state, e)
    assert np.allclose(np.concatenate(got), want, atol=1e-6, rtol=0)
    pair = C._joined(C._joined(elements[0], elements[1]), elements[2])
    once = C._element(z[:3 * part])
    assert all(np.allclose(a, b, rtol=1e-6, atol=1e-6) for a, b in zip(pair, once))


def test_runs_smoothed_together_equal_runs_alone():
    rng = np.random.default_rng(5)
    lengths = np.array([3, 40, 1, 17, 40])
    starts = np.cumsum(lengths) - lengths
    z = np.cumsum(rng.normal(0, 3, (lengths.sum(), 2)), axis=0) + 500
    z[rng.random(len(z)) < 0.3] = np.nan
    states = [C._start(np.array([500.0 + i, 490.0])) for i in range(5)]
    got = C._smooth_runs(z, starts, lengths, *(np.stack(v) for v in zip(*states)))
    elements = C._elements(z, starts, lengths)
    for i, (a, n) in enumerate(zip(starts, lengths)):
        assert np.allclose(got[a:a + n], C._smooth_axes(z[a:a + n], *states[i]), atol=1e-9)
        assert all(np.allclose(v[i], w) for v, w in zip(elements, C._element(z[a:a + n])))


def test_velocity_smoother_takes_many_runs_at_a_time(monkeypatch):
    calls, whole = [], C._cv_runs
    t = np.arange(30) / 30.0
    rows = [(p, "a", int(i), float(x), float(100 + 60 * x) if i % 4 else None, 50.0 if i % 4 else None, True)
            for p in range(6) for i, x in enumerate(t[:10 + 3 * p])]
    tab = pa.table({n: pa.array(v) for n, v in zip(("play_id", "angle", "frame_idx", "t", "px", "py", "_own"), zip(*rows))})
    tab = tab.append_column("_part", pa.array([0] * len(rows)))
    monkeypatch.setattr(C, "ROWS", 20)
    of = ["play_id", "angle", "_part"]

    def counted(x, starts, lengths):
        calls.append(len(starts))
        return whole(x, starts, lengths)
    got = pa.Table.from_batches(C._by_runs(of, counted)(tab.to_batches(max_chunksize=7)))
    assert got.num_rows == len(rows) and sum(calls) == 6 and len(calls) > 1
    one = whole(tab, *C._runs(tab, of))
    assert got.select(["play_id", "frame_idx"]).equals(one.select(["play_id", "frame_idx"]))
    assert np.allclose(got["sx"].to_numpy(), one["sx"].to_numpy()) and np.allclose(one["sx"].to_numpy(), [100 + 60 * r[3] for r in rows], atol=2)


def test_exact_parabola_and_robust_fit(spark):
    rows = []
    for i in range(24):
        t = i / 30
        z = 200 + 700 * t - 0.5 * K.GRAVITY_CM * t * t
        bad = i in (5, 12)
        rows.append((1, "a", i, t, 1600 + 300 * t + (500 if bad else 0), 700 + 20 * t, z))
    df = spark.createDataFrame(rows, "game_id int, shot string, frame long, t double, x double, y double, z double")
    ok = H.parabola(df.filter("frame NOT IN (5, 12)")).first()
    assert abs(ok.vz - 700) < 1e-6 and ok.rms_cm < 1e-5
    r = H.ransac_parabola(df).first()
    assert r.n_inliers == 22 and abs(r.vx - 300) < 1e-6 and abs(r.z0 - 200) < 1e-6


def test_attempts_need_time_and_a_dip(spark):
    def hump(center, top):
        return [top - 4.0 * (i - center) ** 2 for i in range(center - 12, center + 13)]
    zs = hump(12, 500) + hump(12, 520)
    rows = [(1, "two", i, i / K.FPS, 1800.0, RY, z, 0.0, 0.0) for i, z in enumerate(zs + zs)]
    rows += [(1, "one", i, i / K.FPS, 1800.0, RY, z, 0.0, 0.0) for i, z in enumerate(hump(12, 500))]
    df = spark.createDataFrame(rows, "game_id int, shot string, frame long, t double, x double, y double, "
                                     "z double, nr_x double, nr_y double")
    got = {}
    for r in H.attempts(df).collect():
        got.setdefault(r.shot, []).append(r.t)
    assert len(got["one"]) == 1 and len(got["two"]) >= 2
    ts = sorted(got["two"])
    assert all(b - a >= 1.0 for a, b in zip(ts, ts[1:]))


SAMPLE = "game_id int, shot string, frame long, t double, x double, y double, z double, nr_x double, nr_y double"


@pytest.mark.parametrize("keep", [1e-6, 0.5, 0.87, 0.95, 0.999])
def test_running_reference_of_a_long_track(spark, keep):
    x = np.random.default_rng(3).normal(100, 10, 6000)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "k int, frame long, x double")
    got = [r.ema for r in S.running_reference(df, "x", ["k"], "frame", keep).orderBy("frame").collect()]
    want = [x[0]]
    for v in x[1:]:
        want.append(keep * want[-1] + (1 - keep) * v)
    assert np.allclose(got, want, rtol=1e-9)


def test_each_attempt_is_judged_from_its_own_apex(spark):
    """A low attempt that falls through the rim, and 1.2 s later a higher one that lands far behind it."""
    def fall(at, top, x_of):
        return {at + k: (x_of(k), top - 1.6 * k * k) for k in range(-17, 18)}
    low = fall(18, 480, lambda k: RX - 6.0 * max(0, 12 - k))
    high = fall(54, 620, lambda k: RX + 14.0 * k)
    at = {**high, **{i: v for i, v in low.items() if i <= 35}}
    rows = [(1, "both", i, i / K.FPS, x, RY, z, 0.0, 0.0) for i, (x, z) in sorted(at.items())]
    rows += [(1, "short", i, i / K.FPS, RX, RY, z, 0.0, 0.0) for i, z in enumerate([200.0, 400.0, 460.0, 390.0, 210.0])]
    df = spark.createDataFrame(rows, SAMPLE)
    got = {r.attempt: r for r in H.attempt_verdicts(df).collect()}
    assert sorted(got) == [18, 54]
    for apex in got:                                  # the same slice without the other attempt's rows
        own = low if apex == 18 else high
        alone = H.rescore(df.filter(F.col("frame").isin(list(own))), bounds=None).filter("shot = 'both'").first()
        assert (got[apex].verdict_class, got[apex].rule) == (alone.verdict_class, alone.rule)
    assert got[18].rule != got[54].rule


def test_arbiter_takes_cues_from_the_chosen_source(spark):
    """The second pass has four rows and no verdict: the first pass decides, and its rows give the cues."""
    first = [(1, "a", i, i / K.FPS, RX - 6.0 * max(0, 30 - i), RY, 620 - 1.6 * (i - 18) ** 2, 0.0, 0.0) for i in range(36)]
    hires = [(1, "a", i, i / K.FPS, RX, RY, 300.0 + 20 * i, 0.0, 0.0) for i in range(4)]
    hires += [(1, "b", i, i / K.FPS, RX, RY, 9000.0, 0.0, 0.0) for i in range(5)]      # all out of court
    hires += [(1, "c", 0, 0.0, RX, RY, 400.0, 0.0, 0.0)]
    first, hires = (spark.createDataFrame(x, SAMPLE) for x in (first, hires))
    got = {r.shot: r for r in arbiter(first, hires).collect()}
    a = got["a"]
    assert a.tri_verdict != "UND" and (a.n_l1, a.n_hr, a.n_used, a.hr_available) == (36, 4, 36, True)
    assert a.apex_z == 620 and a.desc_n == 18 and abs(a.desc_max_gap - 1 / K.FPS) < 1e-9
    assert (got["b"].n_hr, got["b"].n_used, got["b"].tri_verdict, got["b"].desc_n) == (5, 5, "UND", 0)
    assert (got["c"].n_hr, got["c"].n_used, got["c"].hr_available, got["c"].apex_z) == (1, 0, False, -1)
    preds = spark.createDataFrame([(1, "a", "FG_MAKE", 0, 0.25)], "game_id int, shot string, classification string, pred int, prob double")
    p = with_predictions(arbiter(first, hires), preds).collect()
    assert len(p) == 1 and (p[0].gt_make, p[0].fus_make, p[0].fus_prob, p[0].tri_und) == (True, False, 0.25, False)


@pytest.mark.parametrize("fn,want", [(B.net_region, (96, 70, 48, 30)), (B.crop_region, (60, 20, 120, 100))])
def test_regions_golden(spark, fn, want):
    df = spark.createDataFrame([(100.0, 50.0, 40.0, 20.0)], "rim_x double, rim_y double, rim_w double, rim_h double")
    r = df.select(fn().alias("r")).first().r
    assert (r.x, r.y, r.w, r.h) == want


def test_approach_extrapolation_equals_polyfit(spark):
    rng = np.random.default_rng(4)
    rows, expect = [], {}
    for shot, n in enumerate([12, 9, 4, 15]):
        t = np.arange(n) / 30 + shot
        cx = 950 + 40 * (t - t[0]) + rng.normal(0, 2, n)
        cy = 500 + (300 if shot < 3 else -300) * (t - t[0]) ** 2 * 4 + 200 * (t - t[0]) + rng.normal(0, 1, n)
        rows += [("G", shot, i, *map(float, v), 960.0, 640.0, 120.0, 90.0) for i, v in enumerate(zip(t, cx, cy, 30 + np.arange(n)))]
        if n >= 5 and shot < 3:
            u = t - t[0]
            a, b, c = np.polyfit(u, cy, 2)
            root = max(np.roots([a, b, c - 640.0]).real)
            at = np.polyval(np.polyfit(u, cx, 1), root)
            expect[shot] = (root, abs(at - 960) / (60 + 1e-6), (30 + np.abs(u - root).argmin()) / (120 + 1e-6))
    df = spark.createDataFrame(rows, "game_id string, shot int, frame int, t double, cx double, cy double, bw double, "
                                     "rim_cx double, rim_cy double, rim_w double, rim_h double")
    got = {r.shot: r for r in H.approach_extrapolation(df).collect()}
    assert [got[i].crossing for i in range(4)] == [1, 1, 0, 0] and got[2].lateral is None and got[3].depth is None
    for shot, values in expect.items():
        assert np.allclose((got[shot].t_cross, got[shot].lateral, got[shot].depth), values, rtol=1e-6)


def test_arcs_of_a_key_fitted_in_one_call(spark):
    import random
    from orbweave.operators.trajectory import ransac_parabola
    r = random.Random(3)
    rows = [(1, s, o, f, f / 30, r.gauss(0, 60), r.gauss(0, 60), r.gauss(0, 60)) for s in range(3) for o in range(4) for f in range(4 + 3 * o)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "game_id long, shot long, offset int, frame long, t double, x double, y double, z double")
    apart = ransac_parabola(df, ["game_id", "shot", "offset"], 50)
    together = ransac_parabola(df, ["game_id", "shot"], 50, within=["offset"])
    assert together.columns == apart.columns and sorted(map(tuple, together.collect())) == sorted(map(tuple, apart.collect()))


def sweep_step_by_step(a, b, calibration, keys, offsets):
    """Every pair of every offset as a row, by the operators one after the other."""
    from orbweave.operators.temporal import offset_pairs
    tried = a.withColumn("offset", F.explode(F.array(*[F.lit(o) for o in offsets])))
    pairs = offset_pairs(tried, b, keys, "frame", F.col("offset")).select(
        *keys, "offset", "frame", (F.col("frame") / F.lit(K.FPS)).alias("t"), F.col("px").alias("fr_x"), F.col("py").alias("fr_y"),
        F.col("b_px").alias("nr_x"), F.col("b_py").alias("nr_y"))
    arcs = H.arc_window(H.in_court(H.triangulate_pairs(pairs.join(calibration, keys[0])), K.LOOSE_BOUNDS), [*keys, "offset"])
    arcs = arcs.join(arcs.groupBy(*keys, "offset").count().filter("count >= 6").drop("count"), [*keys, "offset"], "left_semi")
    s = H.ransac_parabola(arcs, keys, 200, within=["offset"]).withColumn("score", F.col("n_inliers") - F.lit(0.5) * F.col("rms_cm"))
    best = F.max_by(F.struct("offset", "score", "n_inliers", "rms_cm"), F.struct("score", -F.col("offset")))
    return s.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def test_offset_sweep_keeps_a_row_per_shot(spark, monkeypatch):
    from orbweave.plans.catalog_trajectory import cameras, project
    rng = np.random.default_rng(5)
    rows = []
    for shot in range(12):
        n, top = int(rng.integers(4, 40)), float(rng.uniform(150, 700))
        for f in range(n):
            x, y, z = 1400.0 + 20 * f, 700.0 + shot, top - 1.5 * (f - n / 2) ** 2
            rows.append((shot % 3, shot, f, *(v + float(rng.normal(0, 4)) for v in (x, y, z))))
    lm = cameras(spark.createDataFrame(rows + [(None, 3, 1, 1500.0, 700.0, 300.0), (1, 30, None, 1500.0, 700.0, 300.0)],
                                       "game_id long, shot long, frame long, x double, y double, z double").repartition(3))
    (fx, fy), (nx, ny) = project("P_fr"), project("P_nr")
    a = lm.select("game_id", "shot", "frame", fx.alias("px"), fy.alias("py"))
    b = lm.select("game_id", "shot", (F.col("frame") + 2).alias("frame"), nx.alias("px"), ny.alias("py"))
    cal = cameras(spark.createDataFrame([(0,), (0,), (1,), (None,)], "game_id long"))      # game 0 has two, game 2 has none
    kept, cut = [], H.cut
    monkeypatch.setattr(H, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    got = H.offset_sweep(a, b, cal, ["game_id", "shot"], range(-3, 9))
    want = sweep_step_by_step(a, b, cal, ["game_id", "shot"], range(-3, 9))
    assert got.dtypes == want.dtypes
    got, want = (sorted(map(tuple, df.collect())) for df in (got, want))
    assert got == want and 4 < len(got) <= 8 and {r[2] for r in got} >= {2}
    assert max(df.count() for df in kept) <= 12              # not one for each pair of each offset


def test_arc_rows_equal_the_arc_window(spark):
    rng = np.random.default_rng(6)
    rows = []
    for shot in range(60):
        n = int(rng.integers(1, 45))
        for f in rng.choice(60, n, replace=False).tolist():
            z = float(rng.choice([200.0, 239.9, 240.0, 300.0, 301.0])) if shot % 4 else 100.0
            rows.append((1, shot, f, f / K.FPS, float(rng.choice([1400.0, 1500.0, 1900.0, 2200.0, 2300.0])), 0.0, z))
    df = spark.createDataFrame(rows, "game_id long, shot long, frame long, t double, x double, y double, z double")
    want = sorted((r.shot, r.frame) for r in H.arc_window(df).collect())
    got = []
    for shot in range(60):
        own = [r for r in rows if r[1] == shot]
        f, t, x, z = (np.array([r[i] for r in own]) for i in (2, 3, 4, 6))
        got += [(shot, int(v)) for v in f[H._arc_rows(f, t, x, z)]]
    assert sorted(got) == want


def test_continuity_chain_is_one_table_pass():
    from orbweave.operators.selection import _chain
    rows = [(1, 5, 0.0, 0.0, 0.9, False), (1, 2, 50.0, 0.0, 0.4, True), (2, 1, 500.0, 0.0, 1.0, True),
            (3, 2, 60.0, 0.0, 0.1, False), (3, 1, 40.0, 0.0, 0.1, False), (4, 1, 41.0, 0.0, None, False)]
    t = pa.table(dict(zip(("frame_idx", "box_id", "cx", "cy", "conf", "preferred"), map(pa.array, zip(*rows)))))
    got = _chain(300.0)(t)
    assert list(zip(got["frame_idx"].to_pylist(), got["box_id"].to_pylist())) == [(1, 2), (3, 1), (4, 1)]


def test_attempts_choose_without_python(spark):
    df = spark.createDataFrame([(1, "a", 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)], SAMPLE)
    assert "FlatMapGroups" not in H.attempts(df)._jdf.queryExecution().toString()
