"""Stacks of two scores against plain least squares and plain gradient descent."""
import math

import numpy as np
import pytest

from orbweave.operators import stack

SCHEMA = "i int, game_id string, prob double, prob2 double, label int, stacker string"


def shots(n, seed=0, games="ABCD"):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    p, q = (np.clip(0.5 + w * (y - 0.5) + rng.normal(0, 0.25, n), 0, 1) for w in (0.3, 0.5))
    return [(i, games[int(rng.integers(len(games)))], float(p[i]), float(q[i]), int(y[i]), "x") for i in range(n)]


def plain_logo(rows):
    def x(r):
        a, b = (min(max(v, 1e-4), 1 - 1e-4) for v in r[2:4])
        return [math.log(a / (1 - a)), math.log(b / (1 - b)), 1.0]
    out = {}
    for g in {r[1] for r in rows}:
        fit = [r for r in rows if r[1] != g]
        w = np.linalg.lstsq(np.array([x(r) for r in fit]), np.array([r[4] for r in fit], float), rcond=None)[0]
        out |= {r[0]: float(np.dot(x(r), w)) for r in rows if r[1] == g}
    return out


def test_logo_stack_equals_least_squares(spark):
    rows = shots(300)
    got = {r.i: r.stacked for r in stack.stack_scores(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = plain_logo(rows)
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-9


def test_hot_game_and_missing_values(spark):
    rows = shots(400, 1, "AAAAAAAB")
    holes = [(1000, "A", None, 0.5, 1, "x"), (1001, "A", 0.5, float("nan"), 1, "x"), (1002, "B", 0.5, 0.5, None, "x"), (1003, "C", None, None, None, "x")]
    got = {r.i: r.stacked for r in stack.stack_scores(spark.createDataFrame(rows + holes, SCHEMA)).collect()}
    want = plain_logo(rows)
    assert len(got) == 404 and max(abs(got[i] - want[i]) for i in want) < 1e-9
    assert got[1000] is None and got[1001] is None and got[1003] is None and got[1002] is not None
    lost = [(1, None, 0.2, 0.7, 1, "x"), (2, "A", 0.4, 0.6, 0, "x")]
    assert [r.stacked for r in stack.stack_scores(spark.createDataFrame(lost, SCHEMA)).collect()] == [None, None]
    line = [(i, "AB"[i % 2], 0.1 + i / 20, 0.1 + i / 20, i % 2, "x") for i in range(10)]
    assert all(r.stacked is None for r in stack.stack_scores(spark.createDataFrame(line, SCHEMA)).collect())
    assert stack.stack_scores(spark.createDataFrame([], SCHEMA)).collect() == []


def test_logistic_stack_equals_long_gradient_descent(spark):
    rows = shots(200, 2)
    x, y = np.array([r[2:4] for r in rows]), np.array([r[4] for r in rows], float)
    w, b = np.zeros(2), 0.0
    for _ in range(60000):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        w, b = w - 0.5 * (x.T @ (p - y) / len(y) + 1e-6 * w), b - 0.5 * float(np.mean(p - y))
    df = spark.createDataFrame(rows, SCHEMA)
    assert stack.fit_logistic(df) == pytest.approx((*w, b), abs=1e-3)
    got = {r.i: r.stacked for r in stack.stack_logistic(df, df).collect()}
    assert max(abs(got[r[0]] - 1 / (1 + math.exp(-(r[2] * w[0] + r[3] * w[1] + b)))) for r in rows) < 1e-3


def test_logistic_edges(spark):
    apart = [(i, "A", float(i > 4), 0.5, int(i > 4), "x") for i in range(10)]
    w = stack.fit_logistic(spark.createDataFrame(apart, SCHEMA))
    assert all(map(math.isfinite, w)) and w[0] > 5
    assert stack.fit_logistic(spark.createDataFrame([], SCHEMA)) == (0.0, 0.0, 0.0)
    assert all(map(math.isfinite, stack.fit_logistic(spark.createDataFrame(apart[5:], SCHEMA))))
