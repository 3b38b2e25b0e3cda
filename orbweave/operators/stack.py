"""Stacks of two scores from sufficient statistics: rows are read once per fit, whatever the number of games."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from orbweave.functions.skew import attach

FLOOR = 1e-4               # scores are kept this far from 0 and 1 before the log-odds
SINGULAR = 1e-12           # share below which a spread or determinant is rounding, so a fit has no single solution
SUMS = ("n", "a", "b", "y", "aa", "ab", "bb", "ay", "by")


def log_odds(c: str) -> Column:
    p = F.greatest(F.lit(FLOOR), F.least(F.lit(1 - FLOOR), F.col(c)))
    return F.when(F.col(c).isNotNull() & ~F.isnan(c), F.log(p / (1 - p)))


def moments(df: DataFrame, a: str, b: str, y: str, groups=()) -> DataFrame:
    """Sums of 1, a, b, y and their products per group, over rows that have all three."""
    whole = F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(y).isNotNull()
    one = {"a": F.col(a), "b": F.col(b), "y": F.col(y).cast("double")}
    return df.where(whole).groupBy(*groups).agg(F.count(F.lit(1)).cast("double").alias("n"), *[
        F.sum(one[s[0]] * one[s[1]] if len(s) == 2 else one[s]).alias(s) for s in SUMS[1:]])


def _plane(m: dict[str, Column]) -> tuple[Column, Column, Column]:
    """Weights of a, b and 1 of the least-squares plane, by centred sums; null where they are not determined."""
    def centred(s):
        return m[s] - m[s[0]] * m[s[1]] / m["n"]
    aa, ab, bb, ay, by = (centred(s) for s in ("aa", "ab", "bb", "ay", "by"))
    det = aa * bb - ab * ab
    ok = (m["n"] > 2) & (aa > SINGULAR * m["aa"]) & (bb > SINGULAR * m["bb"]) & (det > SINGULAR * aa * bb)
    wa, wb = (F.when(ok, x / det) for x in (ay * bb - by * ab, by * aa - ay * ab))
    return wa, wb, (m["y"] - wa * m["a"] - wb * m["b"]) / m["n"]


def stack_scores(df: DataFrame, a: str = "prob", b: str = "prob2", game: str = "game_id", label: str = "label") -> DataFrame:
    """Leave-one-game-out least squares of the label on the log-odds of two scores: all columns and ``stacked``.

    One aggregate gives each game's sums; the fit without a game takes that game's sums from the totals and solves the
    normal equations as column expressions, so there is no fit per game.  Rows that miss a score or the label are in
    no fit; without a score there is no stacked value.  Rows without a game are in every fit and get no value, as
    do games whose other games leave the plane open (fewer than three rows, or log-odds on a line).
    """
    rows = df.withColumns({"__a": log_odds(a), "__b": log_odds(b)})
    total = moments(rows, "__a", "__b", label).first().asDict()
    own = moments(rows, "__a", "__b", label, [game])
    games = df.select(game).where(F.col(game).isNotNull()).distinct().join(own, game, "left")
    rest = {s: F.lit(float(total[s] or 0)) - F.coalesce(F.col(s), F.lit(0.0)) for s in SUMS}
    fits = games.select(game, *[w.alias(n) for w, n in zip(_plane(rest), ("__wa", "__wb", "__w"))])
    out = attach(rows, fits, [game], ["__a", "__b", label])
    return out.select(*df.columns, (F.col("__wa") * F.col("__a") + F.col("__wb") * F.col("__b") + F.col("__w")).alias("stacked"))


def fit_logistic(df: DataFrame, a: str = "prob", b: str = "prob2", label: str = "label", ridge: float = 1e-6,
                 steps: int = 50, tol: float = 1e-10) -> tuple[float, float, float]:
    """Weights of two scores and the intercept of a logistic model, by Newton steps of one aggregate each.

    Minimises the mean log loss plus ``ridge``/2 of the squared weights, which keeps separable labels finite.  A step
    that would raise the loss is halved.  Rows that miss a score or the label are left out; no rows give zeros.
    """
    rows = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"), F.col(label).cast("double").alias("y"))
    rows = rows.where("a IS NOT NULL AND b IS NOT NULL AND y IS NOT NULL AND NOT isnan(a) AND NOT isnan(b)")

    def sums(w):
        z = F.lit(float(w[0])) * F.col("a") + F.lit(float(w[1])) * F.col("b") + F.lit(float(w[2]))
        p = 1 / (1 + F.exp(-z))
        x = (F.col("a"), F.col("b"), F.lit(1.0))
        loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - F.col("y") * z
        r = rows.agg(F.count(F.lit(1)), F.sum(loss), *[F.sum((p - F.col("y")) * v) for v in x],
                     *[F.sum(p * (1 - p) * x[i] * x[j]) for i in range(3) for j in range(3)]).first()
        if not r[0]:
            return None
        v = np.array(r[1:], float) / r[0]
        keep = ridge * np.array([1.0, 1.0, 0.0])
        return v[0] + (keep * w * w).sum() / 2, v[1:4] + keep * w, v[4:].reshape(3, 3) + np.diag(keep)
    w = np.zeros(3)
    now = sums(w)
    for _ in range(steps if now else 0):
        step = np.linalg.lstsq(now[2], now[1], rcond=None)[0]
        if np.abs(step).max() < tol:
            break
        after = sums(w - step)
        while after[0] > now[0] + 1e-15 and np.abs(step).max() >= tol:
            step = step / 2
            after = sums(w - step)
        w, now = w - step, after
    return tuple(w.tolist())


def stack_logistic(train: DataFrame, rows: DataFrame, a: str = "prob", b: str = "prob2", label: str = "label") -> DataFrame:
    """Probability of a two-score logistic model fitted on ``train``: all columns of ``rows`` and ``stacked``."""
    wa, wb, w = fit_logistic(train, a, b, label)
    return rows.withColumn("stacked", 1 / (1 + F.exp(-(F.lit(wa) * F.col(a) + F.lit(wb) * F.col(b) + F.lit(w)))))
