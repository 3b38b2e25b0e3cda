"""Camera waveform pairs and one-to-one box matches against plain loops."""
import numpy as np
from pyspark.sql import functions as F

from orbweave.operators import boxmatch as X, signal as G

WAVES = "game int, clip int, angle string, wave array<double>"


def plain_lag(a, b, reach):
    a, b = ((d := np.diff(x)) / (d.std() or 1) for x in (np.asarray(a), np.asarray(b)))
    full = np.correlate(b, a, "full")
    lags = np.arange(-len(a) + 1, len(b))
    near = np.abs(lags) <= reach
    i = full[near].argmax()
    return lags[near][i], full[near][i] / (np.median(np.abs(full[near])) + 1e-9)


def test_lags_of_unequal_and_odd_pairs(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for clip, (n, m) in enumerate([(200, 200), (200, 180), (90, 200), (200, 200), (40, 40)]):
        a, b = rng.normal(size=n).tolist(), rng.normal(size=m).tolist()
        rows += [(clip % 2, clip, "FR", a), (clip % 2, clip, "NR", b)]
        want[clip] = plain_lag(a, b, 75)
    odd = [[], [1.0], None, [1.0, float("nan"), 2.0], [1.0, None, 2.0]]
    rows += [(9, 10 + i, side, w) for i, x in enumerate(odd) for side, w in (("FR", x), ("NR", [1.0, 2.0, 4.0]))]
    rows += [(9, 20, "FR", [3.0, 3.0, 3.0]), (9, 20, "NR", [1.0, 2.0, 4.0]), (9, 21, "FR", [1.0, 2.0]), (9, 22, "FL", [1.0, 2.0])]
    pairs = G.camera_pairs(spark.createDataFrame(rows, WAVES), ["game", "clip"], "angle", "wave", "FR", "NR")
    got = {r.clip: r.l for r in pairs.select("clip", G.lag_of(50)("a", "b").alias("l")).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 10, 11, 13, 14, 20]
    for clip, (lag, peak) in want.items():
        assert got[clip].lag_s == lag / 50 and np.isclose(got[clip].peak, peak)
    assert all(got[c].lag_s is None and got[c].peak is None for c in (10, 11, 13, 14))
    assert got[20].peak == 0


def test_offset_leaves_out_weak_peaks(spark):
    rng = np.random.default_rng(4)
    rows = []
    for clip in range(12):
        x = rng.normal(size=600)
        other = x[40 - 6:540 - 6] + rng.normal(size=500) * 0.3 if clip < 9 else rng.normal(size=500)
        rows += [(1, clip, "FR", x[40:540].tolist()), (1, clip, "NR", other.tolist())]
    pairs = G.camera_pairs(spark.createDataFrame(rows, WAVES), ["game", "clip"], "angle", "wave", "FR", "NR")
    r = G.true_offset(pairs, ["game"], "a", "b", 60, 4.0, fps=30.0).collect()
    assert [(x.game, x.residual, x.support, x.true_offset) for x in r] == [(1, 3.0, 9, 7.0)]
    assert G.true_offset(pairs.limit(0), ["game"], "a", "b", 60).count() == 0


def test_matches_equal_the_loop(spark):
    rng = np.random.default_rng(5)
    data = sorted({(int(rng.integers(30)), int(rng.integers(8)), int(rng.integers(8))) for _ in range(500)})
    want = []
    for img in range(30):
        used, done = set(), set()
        for _, t, p in (x for x in data if x[0] == img):
            if t not in done and p not in used:
                done.add(t), used.add(p), want.append((img, t, p))
    rows = [(i, t, p, (t * 8 + p) / 100) for i, t, p in data] * 2 + [(3, None, 1, 0.5), (3, 1, None, 0.5)]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "img int, truth_id long, pred_id long, iou double")
    got = X.match_boxes(df, ["img"])
    assert got.columns == df.columns and sorted((r.img, r.truth_id, r.pred_id) for r in got.collect()) == want
    assert X.match_boxes(df.limit(0), ["img"]).count() == 0
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_moment_recall(spark):
    truth = spark.createDataFrame([(1, "ball", True), (1, "ball", True), (2, "ball", True), (3, "ball", False), (4, "hoop", None)],
                                  "img int, cls string, rim boolean")
    found = spark.createDataFrame([(1, "ball"), (1, "ball"), (3, "ball"), (4, "hoop")], "img int, cls string")
    assert [tuple(r) for r in X.moment_recall(truth, found, ["img"], "rim", "cls").collect()] == [("ball", 2, 1, 0.5)]
    assert X.moment_recall(truth.filter(F.lit(False)), found, ["img"], "rim", "cls").count() == 0
