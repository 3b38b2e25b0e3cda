"""Skew-safe building blocks against plain windows and numpy, with buckets small enough to matter."""
import random

import numpy as np
from pyspark.sql import Window, functions as F

from orbweave.functions import ordered, quantiles, skew
from orbweave.operators import evaluate as E, sequence as S, temporal as M


def skewed(spark, n=600, seed=1):
    r = random.Random(seed)
    rows = [(0 if r.random() < 0.6 else r.randrange(1, 6), i, round(r.uniform(-5, 50), 2),
             None if r.random() < 0.3 else r.randrange(100)) for i in range(n)]
    return spark.createDataFrame(rows, "k int, i long, v double, m int")


def test_row_number_and_neighbours_match_plain_windows(spark):
    df = skewed(spark)
    w = Window.partitionBy("k").orderBy("i")
    b = ordered.value_bucket("i", 7)
    got = ordered.neighbours(ordered.row_number(df, ["k"], ["i"], b, "rn"), ["k"], ["i"], ["i", "v"], b)
    want = df.select("k", "i", F.row_number().over(w).cast("long").alias("rn"),
                     F.lag("i").over(w).alias("p"), F.lead("i").over(w).alias("n"))
    a = got.select("k", "i", "rn", F.col("prev.i").alias("p"), F.col("next.i").alias("n"))
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_fill_known_and_running_max(spark):
    df = skewed(spark)
    b = ordered.value_bucket("i", 5)
    w = Window.partitionBy("k").orderBy("i")
    got = ordered.fill_known(df, ["k"], ["i"], F.col("m"), b)
    got = ordered.running_max(got, ["k"], ["i"], F.col("v"), b)
    want = df.select("k", "i", F.last("m", True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
                     F.first("m", True).over(w.rowsBetween(0, Window.unboundedFollowing)),
                     F.max("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    a = got.select("k", "i", "known_before", "known_after", "running_max")
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_clusters_across_bucket_borders(spark):
    ts = [0, 2, 3, 9, 10, 11, 12, 13, 14, 30, 40, 41]
    df = spark.createDataFrame([(1, t) for t in ts], "k int, t long")
    got = {r.t: r.cluster_start for r in
           ordered.cluster_rows(df, ["k"], "t", 2, ordered.value_bucket("t", 3)).collect()}
    assert got == {0: 0, 2: 0, 3: 0, 9: 9, 10: 9, 11: 9, 12: 9, 13: 9, 14: 9, 30: 30, 40: 40, 41: 40}


def test_clusters_of_rows_of_one_time(spark):
    rows = [(k, t, n) for k in range(40) for t in (0, 1, 9, 10, 20) for n in range(3)]
    df = spark.createDataFrame(rows, "k int, t long, n int").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")     # many partitions, as with many rows
    try:
        got = ordered.cluster_rows(df, ["k"], "t", 2, ordered.value_bucket("t", 3)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r.k, r.t, r.n, r.cluster_start) for r in got) == [(k, t, n, {1: 0, 10: 9}.get(t, t)) for k, t, n in rows]


def test_percentiles_selection_equals_numpy(spark):
    df = skewed(spark, 900)
    probs = (0.1, 0.5, 0.9)
    native = {r.k: r for r in quantiles.percentiles(df, ["k"], ["v", "i"], probs).collect()}
    spread = {r.k: r for r in quantiles.percentiles(df, ["k"], ["v", "i"], probs, limit=100).collect()}
    pdf = df.toPandas()
    for k, g in pdf.groupby("k"):
        for c in ("v", "i"):
            for p in probs:
                want = np.percentile(g[c], p * 100)
                name = f"{c}_p{round(p * 100):02d}"
                assert abs(native[k][name] - want) < 1e-9 and abs(spread[k][name] - want) < 1e-9
    one = quantiles.percentiles(df, [], ["v"], (0.5,), limit=100).first()
    assert abs(one.v - np.median(pdf["v"])) < 1e-9


def test_attach_splits_hot_keys_without_changing_rows(spark):
    df = skewed(spark)
    per = df.groupBy("k").agg(F.max("v").alias("mx"))
    a = skew.attach(df, per, ["k"], ["i"]).select("k", "i", "mx")
    assert sorted(map(tuple, a.collect())) == sorted(
        map(tuple, df.join(per, "k").select("k", "i", "mx").collect()))


def test_auc_against_pairs(spark):
    r = random.Random(3)
    rows = [(r.randrange(3), round(r.random(), 1), r.randrange(2)) for _ in range(200)] + [(9, 0.4, 1)]
    df = spark.createDataFrame(rows, "g int, prob double, label int")
    got = {x.g: x.auc for x in E.auc(df, ["g"]).collect()}
    for g in {x[0] for x in rows}:
        pos = [p for k, p, y in rows if k == g and y == 1]
        neg = [p for k, p, y in rows if k == g and y == 0]
        want = 0.5 if not pos or not neg else sum(
            (a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
        assert abs(got[g] - want) < 1e-12
    gold = spark.createDataFrame([(.1, 0), (.2, 0), (.8, 1), (.9, 1)], "prob double, label int")
    assert E.auc(gold).first().auc == 1.0


def test_threshold_index_is_exact_at_the_thresholds(spark):
    grid = E.grid(0.30, 0.85, 0.01)
    assert np.array_equal(grid, np.arange(0.30, 0.85, 0.01))
    vals = [x for t in grid for x in (t, np.nextafter(t, 0), np.nextafter(t, 1))] + [0.0, 1.0]
    df = spark.createDataFrame([(float(v),) for v in vals], "p double")
    for r in df.select("p", E.passed(F.col("p"), grid).alias("k")).collect():
        assert r.k == sum(t <= r.p for t in grid)


def test_interpolation_golden_and_windows(spark):
    vals = [None, 10.0, 10.0, None, 20.0, None]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(vals)], "k int, frame_idx long, x double")
    out = S.interpolate_hold(df, ["x"], ["k"]).orderBy("frame_idx").collect()
    assert [r.x_filled for r in out] == [10, 10, 10, 15, 20, 20]
    per = spark.createDataFrame([(1, 20, 40), (2, 1, 40), (3, 39, 40)], "k int, center long, n long")
    got = {k: [r.position for r in g] for k, g in _group(S.window_positions(per).orderBy("k", "slot"))}
    assert got[1] == list(range(12, 28)) and got[1][8] == 20
    assert got[2] == list(range(16)) and got[3] == list(range(24, 40))


def _group(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.k, []).append(r)
    return out.items()


def test_densest_neighbourhood_brute_force(spark):
    r = random.Random(5)
    vals = [(r.randrange(2), float(r.randrange(200)) / 8) for _ in range(150)]
    df = spark.createDataFrame(vals, "k int, v double")
    got = {x.k: x for x in M.densest(df, ["k"], "v", 1.0).collect()}
    for k in (0, 1):
        vs = [v for g, v in vals if g == k]
        best = max(((sum(abs(v - c) <= 1.0 for v in vs), -c) for c in vs))
        assert (got[k].support, -got[k].center) == best


def test_frame_energy_breaks_at_missing_frames(spark):
    from orbweave.operators import signal as G
    rows = [(1, 0, [0.0, 0.0]), (1, 1, [1.0, 3.0]), (1, 3, [5.0, 5.0]), (1, 4, [5.0, 7.0])]
    df = spark.createDataFrame(rows, "k int, pos long, px array<double>")
    got = {r.pos: r.energy for r in G.frame_energy(df, ["k"], "pos", "px").collect()}
    assert got == {0: 0.0, 1: 2.0, 3: 0.0, 4: 1.0}


def test_audio_features_and_lag(spark):
    from orbweave.operators import signal as G
    rate = 4000
    t = np.arange(rate) / rate
    tone = (0.5 * np.sin(2 * np.pi * 1000 * t)).tolist()
    noise = np.random.default_rng(0).normal(size=rate)
    late = np.roll(noise, 120)
    df = spark.createDataFrame([(tone, noise.tolist(), late.tolist())],
                               "tone array<double>, a array<double>, b array<double>")
    r = df.select(G.audio_features(rate)("tone").alias("f"), G.lag_of(rate)("a", "b").alias("l")).first()
    assert abs(r.f.rms - 0.5 / np.sqrt(2)) < 1e-3 and r.f.e_500_2k > 0.99 and abs(r.f.centroid - 1000) < 5
    assert abs(r.l.lag_s - 120 / rate) < 1e-9 and r.l.peak > 8
