"""Boosted trees of all folds at once against trees grown by plain search."""
import numpy as np
import pytest

from orbweave.operators import boost


def plain_tree(x, g, h, depth, leaf):
    """(feature, border value, left, right) or the leaf value, by trying every border on the raw values."""
    best = None
    if depth:
        for j in range(x.shape[1]):
            for b in np.unique(x[:, j])[:-1]:
                m = x[:, j] <= b
                if min(m.sum(), (~m).sum()) < leaf or min(h[m].sum(), h[~m].sum()) < 1e-3:
                    continue
                gain = g[m].sum() ** 2 / h[m].sum() + g[~m].sum() ** 2 / h[~m].sum() - g.sum() ** 2 / h.sum()
                if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, j, b, m)
    if best is None:
        return -g.sum() / h.sum()
    _, j, b, m = best
    return j, b, plain_tree(x[m], g[m], h[m], depth - 1, leaf), plain_tree(x[~m], g[~m], h[~m], depth - 1, leaf)


def plain_value(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def plain_boost(x, y, rounds, rate, depth, leaf):
    base = np.log(y.mean() / (1 - y.mean()))
    trees, f = [], np.full(len(y), base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        trees.append(plain_tree(x, p - y, p * (1 - p), depth, leaf))
        f += rate * np.array([plain_value(trees[-1], r) for r in x])
    return lambda rows: 1 / (1 + np.exp(-(base + rate * np.array([[plain_value(t, r) for t in trees] for r in rows]).sum(1))))


def shots(n=240, seed=0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 40, n), rng.integers(0, 25, n), rng.integers(0, 3, n)]).astype(float)
    y = (x[:, 0] + 3 * x[:, 1] * (x[:, 2] > 0) + rng.normal(0, 12, n) > 45).astype(int)
    return x, y, np.array([f"G{i % 4}" for i in range(n)])


def frame(spark, x, y, game):
    return spark.createDataFrame([(int(i), g, int(t), *map(float, r)) for i, (r, t, g) in enumerate(zip(x, y, game))],
                                 "shot long, game_id string, label int, apex_r double, z_min double, n_deep double")


COLS = ["apex_r", "z_min", "n_deep"]


@pytest.mark.parametrize("part_rows", [250_000, 40])
def test_all_folds_equal_plain_trees(spark, monkeypatch, part_rows):
    monkeypatch.setattr(boost, "PART_ROWS", part_rows)
    monkeypatch.setattr(boost, "KEEP", 3)
    x, y, game = shots()
    got = boost.out_of_fold(frame(spark, x, y, game), COLS, depth=3, rate=0.3, rounds=7, leaf=8).orderBy("shot").collect()
    for g in "G0 G1 G2 G3".split():
        model = plain_boost(x[game != g], y[game != g], 7, 0.3, 3, 8)
        assert np.allclose([r.p for r in got if r.game_id == g], model(x[game == g]), atol=1e-9)


def test_missing_values_and_labels(spark):
    x, y, game = shots(120, 1)
    x[::7, 1] = np.nan
    df = frame(spark, x, y, game)
    whole = boost.out_of_fold(df, COLS, depth=2, rate=0.3, rounds=3, leaf=5).orderBy("shot").collect()
    for g in "G0 G1 G2 G3".split():
        train = game != g
        known = np.sort(x[train, 1][~np.isnan(x[train, 1])])
        filled = np.where(np.isnan(x), known[(len(known) - 1) // 2], x)
        model = plain_boost(filled[train], y[train], 3, 0.3, 2, 5)
        assert np.allclose([r.p for r in whole if r.game_id == g], model(filled[game == g]), atol=1e-9)
    more = df.unionByName(df.selectExpr("shot + 1000 AS shot", "game_id", "cast(null AS int) AS label", *COLS))
    again = boost.out_of_fold(more, COLS, depth=2, rate=0.3, rounds=3, leaf=5).where("shot < 1000").orderBy("shot").collect()
    assert [r.p for r in again] == [r.p for r in whole]


def test_folds_that_cannot_learn(spark):
    df = frame(spark, np.ones((6, 3)), np.array([0, 0, 0, 1, 1, 1]), np.array(["A"] * 3 + ["B"] * 3))
    got = {r.game_id: r.p for r in boost.out_of_fold(df, COLS, rounds=2, depth=2, leaf=1).collect()}
    assert got["A"] > 0.999 and got["B"] < 0.001                       # one class in the other game
    alone = boost.out_of_fold(df.where("game_id = 'A'"), COLS, rounds=2, depth=2, leaf=1)
    assert {r.p for r in alone.collect()} == {0.5}
    assert boost.leave_one_game_out(df.limit(0), COLS, rounds=2).collect() == []


def test_leave_one_game_out_thresholds(spark):
    x, y, game = shots(400, 2)
    table = boost.leave_one_game_out(frame(spark, x, y, game), COLS, depth=3, rate=0.1, rounds=20, leaf=10)
    rows = {r.game_id: r for r in table.collect()}
    assert sorted(rows) == ["G0", "G1", "G2", "G3"] and sum(r.n for r in rows.values()) == 400
    train = ~np.isin(game, ["G1", "G2"])                                # G1 is scored, G2 chooses its threshold
    model = plain_boost(x[train], y[train], 20, 0.1, 3, 10)
    pv, pt, yv, yt = model(x[game == "G2"]), model(x[game == "G1"]), y[game == "G2"], y[game == "G1"]

    def loss(t):
        tp, fp, fn = ((pv >= t) & (yv == 1)).sum(), ((pv >= t) & (yv == 0)).sum(), ((pv < t) & (yv == 1)).sum()
        return round(max(0, 0.9 - tp / (tp + fp)) + max(0, 0.9 - tp / (tp + fn)), 12) if tp + fp else 9
    best = min((loss(0.30 + i * (0.31 - 0.30)), i) for i in range(55))[1]
    assert abs(rows["G1"].threshold - (0.30 + best * 0.01)) < 1e-9
    assert rows["G1"].tp == ((pt >= rows["G1"].threshold) & (yt == 1)).sum()
    assert all(r.accuracy > 0.7 for r in rows.values())


@pytest.mark.parametrize("fold_rows", [2_000_000, 0])
def test_a_table_of_many_parts_takes_one_job_up_to_a_bound(spark, monkeypatch, fold_rows):
    monkeypatch.setattr(boost, "PART_ROWS", 40)
    monkeypatch.setattr(boost, "KEEP", 3)
    monkeypatch.setattr(boost, "FOLD_ROWS", fold_rows)
    x, y, game = shots()
    df = frame(spark, x, y, game)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"boost-{fold_rows}", "")
    forest = boost.fit_folds(df, COLS, [{g} for g in "G0 G1 G2 G3".split()], depth=3, rate=0.3, rounds=7, leaf=8)
    jobs = len(tracker.getJobIdsForGroup(f"boost-{fold_rows}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 21 if fold_rows else jobs >= 21                       # passes take a job per tree level
    got = boost.score_folds(df, forest, {"p": {f"G{i}": i for i in range(4)}}).orderBy("shot").collect()
    for g in "G0 G1 G2 G3".split():
        model = plain_boost(x[game != g], y[game != g], 7, 0.3, 3, 8)
        assert np.allclose([r.p for r in got if r.game_id == g], model(x[game == g]), atol=1e-9)
