"""Band and flip grids against row-by-row counting."""
import numpy as np

from orbweave.operators import decide

SCHEMA = "prob double, prob2 double, label int"
LOS, HIS = [0.2, 0.3, 0.4], [0.3, 0.5, 0.6]


def rows(n, seed):
    rng = np.random.default_rng(seed)
    edge = [0.1, 0.2, 0.3, 0.4, 0.45, 0.5, 0.6, 0.9, None]           # many values on the borders, some missing
    return [(edge[int(rng.integers(9))], edge[int(rng.integers(9))], int(rng.integers(2)) if rng.integers(9) else None) for _ in range(n)]


def right(score, t, label):
    return score is not None and label is not None and (score >= t) == (label == 1)


def test_band_grid_counts_every_row(spark):
    data = rows(400, 0)
    got = {(r.lo, r.hi): (r.n, r.accuracy) for r in decide.gate_search(spark.createDataFrame(data, SCHEMA), LOS, HIS, 0.5, 0.4).collect()}
    want = {(lo, hi): (400, sum(right(b, 0.4, y) if a is not None and lo <= a <= hi else right(a, 0.5, y) for a, b, y in data) / 400)
            for lo in LOS for hi in HIS}
    assert got == want
    empty = decide.gate_search(spark.createDataFrame([], SCHEMA), LOS, HIS, 0.5, 0.4).collect()
    assert len(empty) == 9 and all(r.n == 0 and r.accuracy is None for r in empty)


def test_flip_grid_counts_every_row(spark):
    data, cuts = [(None if a is None else int(a > 0.3), b, y) for a, b, y in rows(400, 1)], [0.2, 0.3, 0.4, 0.45]
    df = spark.createDataFrame(data, "pred int, ratio double, label int")
    got = {r.cut: r for r in decide.flip_search(df, "pred", "ratio", cuts).collect()}
    assert sorted(got) == cuts
    for cut in cuts:
        flips = [p == 1 and q is not None and q < cut for p, q, _ in data]
        ok = sum(p is not None and y is not None and (0 if f else p) == y for (p, _, y), f in zip(data, flips))
        assert got[cut].n == 400 and got[cut].accuracy == ok / 400
        assert [got[cut].flipped_good, got[cut].flipped_bad] == [sum(f and y == v for (_, _, y), f in zip(data, flips)) for v in (0, 1)]
    top = max(r.accuracy for r in got.values())
    assert [c for c in cuts if got[c].is_best] == [next(c for c in cuts if got[c].accuracy == top)]
    assert [(r.n, r.accuracy) for r in decide.flip_search(df.limit(0), "pred", "ratio", cuts).collect()] == [(0, None)] * 4
