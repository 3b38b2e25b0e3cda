"""Detector scoring: one-to-one box matching by overlap and recall/precision per class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from orbweave.functions import boxes as B
from orbweave.operators.evaluate import count_if, ratio


def overlaps(truth: DataFrame, preds: DataFrame, keys: Sequence[str], floor: float = 0.3,
             cell: float = 256.0) -> DataFrame:
    """(truth_id, pred_id, iou) pairs of an image and class that overlap enough.

    Boxes meet only in grid cells they both touch; a pair is kept in its first shared cell.
    """
    def cells(df, p):
        xs = F.sequence(F.floor(F.col("x1") / cell), F.floor(F.col("x2") / cell))
        ys = F.sequence(F.floor(F.col("y1") / cell), F.floor(F.col("y2") / cell))
        d = df.select(*keys, F.col("box_id").alias(f"{p}_id"), *[
            F.col(c).alias(f"{p}{c}") for c in ("x1", "y1", "x2", "y2")],
            F.explode(xs).alias("_cx"), ys.alias("_ys"))
        return d.withColumn("_cy", F.explode("_ys")).drop("_ys")
    j = cells(truth, "truth").join(cells(preds, "pred"), [*keys, "_cx", "_cy"])
    first = ((F.col("_cx") == F.floor(F.greatest("truthx1", "predx1") / cell))
             & (F.col("_cy") == F.floor(F.greatest("truthy1", "predy1") / cell)))
    iou = B.iou([F.col(f"truth{c}") for c in ("x1", "y1", "x2", "y2")],
                [F.col(f"pred{c}") for c in ("x1", "y1", "x2", "y2")])
    return (j.filter(first).withColumn("iou", iou).filter(F.col("iou") >= floor)
            .select(*keys, "truth_id", "pred_id", "iou"))


def match_boxes(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One-to-one: truths in id order take the first free prediction that overlaps.

    A fold over the overlapping pairs of one image and class in (truth, prediction) order; a group is as large as what
    a detector reports for one image.  A repeated pair counts once.
    """
    row = F.struct("truth_id", "pred_id", "iou")
    truth, pred = pairs.schema["truth_id"].dataType, pairs.schema["pred_id"].dataType
    kept = F.array().cast(T.ArrayType(pairs.select(row.alias("r")).schema["r"].dataType))
    start = F.struct(F.lit(None).cast(truth).alias("last"), F.array().cast(T.ArrayType(pred)).alias("used"), kept.alias("kept"))

    def step(state, pair):
        free = ~state["last"].eqNullSafe(pair["truth_id"]) & ~F.array_contains(state["used"], pair["pred_id"])
        taken = F.struct(pair["truth_id"].alias("last"), F.array_append(state["used"], pair["pred_id"]).alias("used"),
                         F.array_append(state["kept"], pair).alias("kept"))
        return F.when(free, taken).otherwise(state)
    g = pairs.filter("truth_id IS NOT NULL AND pred_id IS NOT NULL").groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("p"))
    return g.select(*keys, F.inline(F.aggregate("p", start, step, lambda x: x["kept"])))


def moment_recall(truth: DataFrame, matched: DataFrame, image: Sequence[str], moment: str, cls: str) -> DataFrame:
    """Per class: images of the ``moment`` (a boolean column of ``truth``) with a true box, and the share with any found."""
    seen = truth.filter(F.col(moment)).select(*image, cls).distinct()
    hit = matched.select(*image, cls, F.lit(True).alias("_hit")).distinct()
    return seen.join(hit, [*image, cls], "left").groupBy(cls).agg(
        F.count(F.lit(1)).alias("n_images"), count_if(F.col("_hit")).alias("n_found")).select(
        cls, "n_images", "n_found", ratio(F.col("n_found"), F.col("n_images")).alias("recall"))


def detector_scores(truth: DataFrame, preds: DataFrame, matched: DataFrame, cls: str) -> DataFrame:
    """Recall and precision per class."""
    t = truth.groupBy(cls).agg(F.count(F.lit(1)).alias("n_truth"))
    p = preds.groupBy(cls).agg(F.count(F.lit(1)).alias("n_pred"))
    m = matched.groupBy(cls).agg(F.count(F.lit(1)).alias("tp"))
    j = t.join(p, cls, "full").join(m, cls, "left").fillna(0, ["n_truth", "n_pred", "tp"])
    return j.select(cls, "n_truth", "n_pred", "tp", ratio(F.col("tp"), F.col("n_truth")).alias("recall"),
                    ratio(F.col("tp"), F.col("n_pred")).alias("precision"))
