"""The small shot classifier: 28 columns from samples, verdict texts and per-camera evidence, boosted per held-out game."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from orbweave.functions import fixed as K, labels as L
from orbweave.operators import boost, evaluate as E
from orbweave.operators.trajectory import SHOT, radius

TRAJECTORY = ("n_samples", "apex_r", "apex_z", "cross_r", "z_min", "bounce_cm")
FLAGS = ("tri_make", "tri_miss", "tri_und", "tri_has_rim_out", "tri_has_rim_bounce", "tri_has_gap_stop",
         "tri_has_smooth_descent", "tri_has_pass_through", "tri_has_clean_clean", "tri_has_no_clear")
CAMERA = ("strength", "is_make", "is_miss", "n_deep", "rebound_px", "max_cy")
COLUMNS = (*TRAJECTORY, *FLAGS, *(f"{c}_{x}" for c in ("fr", "nr") for x in CAMERA))


def _or(value: Column, default: float) -> Column:
    """A missing or zero value counts as the default."""
    return F.when(value != 0, value.cast("double")).otherwise(F.lit(float(default)))


def trajectory_columns(samples: DataFrame, keys: Sequence[str] = SHOT, order: str = "frame") -> DataFrame:
    """Per shot: number of samples, radius and height of the highest one (the first of equals), lowest height from
    there on.  One aggregate per step; no shot's rows are brought together."""
    top = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_samples"), F.max_by(
        F.struct(order, "x", "y", "z"), F.struct("z", (-F.col(order)).alias("o"))).alias("a"))
    low = samples.join(top.select(*keys, F.col(f"a.{order}").alias("_from")), list(keys)).groupBy(*keys).agg(
        F.min(F.when(F.col(order) >= F.col("_from"), F.col("z"))).alias("z_min"))
    return top.join(low, list(keys)).select(*keys, "n_samples", radius("a.x", "a.y").alias("apex_r"),
                                            F.col("a.z").alias("apex_z"), "z_min")


def shot_columns(shots: DataFrame, samples: DataFrame, keys: Sequence[str] = SHOT, order: str = "frame") -> DataFrame:
    """The 28 columns of every shot, with its keys, ``gt`` and ``label`` (1 for a make class).

    ``shots``: keys, gt, ``verdict`` and ``tri`` (texts), ``fr`` and ``nr`` (camera verdict codes) and per camera
    n_deep, rebound_px, max_cy with that prefix.  Fewer than three samples give -1 for all trajectory columns
    but their number; numbers missing in the text are -1 (bounce: 0).
    """
    few = F.col("n_samples") < 3
    v = F.coalesce("verdict", F.lit(""))
    whole = {"apex_r": F.col("apex_r"), "apex_z": F.col("apex_z"), "z_min": F.col("z_min"),
             "cross_r": _or(L.number_in(v, r"r=(\d+)cm"), -1), "bounce_cm": _or(L.number_in(v, r"bounce=(\d+)cm"), 0)}
    t = F.coalesce("tri", F.lit(""))
    flags = dict(zip(("tri_make", "tri_miss", "tri_und", *FLAGS[3:]), L.verdict_flags(t)))
    cameras = {}
    for c in ("fr", "nr"):
        code = F.coalesce(c, F.lit("UND"))
        cameras |= {f"{c}_strength": L.strength_of(code), f"{c}_is_make": code.startswith("MAKE").cast("int"),
                    f"{c}_is_miss": code.startswith("MISS").cast("int"), f"{c}_n_deep": _or(F.col(f"{c}_n_deep"), 0),
                    f"{c}_rebound_px": _or(F.col(f"{c}_rebound_px"), 0), f"{c}_max_cy": _or(F.col(f"{c}_max_cy"), -1)}
    d = shots.join(trajectory_columns(samples, keys, order), list(keys), "left").withColumn(
        "n_samples", F.coalesce("n_samples", F.lit(0)))
    made = {n: F.when(few, -1.0).otherwise(e).alias(n) for n, e in whole.items()}
    made |= {n: e.alias(n) for n, e in (flags | cameras).items()}
    return d.select(*keys, "gt", F.col("gt").isin(*K.MAKE_CLASSES).cast("int").alias("label"),
                    *[made.get(c, F.col(c)) for c in COLUMNS])


def held_out_games(table: DataFrame, group: str = "game_id", rounds: int = 200, depth: int = 3, rate: float = 0.05,
                   leaf: int = 1) -> DataFrame:
    """Metrics per held-out game at a threshold of one half."""
    scored = boost.out_of_fold(table, COLUMNS, group, rounds=rounds, depth=depth, rate=rate, leaf=leaf)
    return E.binary_metrics(scored.withColumn("pred", (F.col("p") >= 0.5).cast("int")), [group])
