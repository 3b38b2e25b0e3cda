"""Choosing rows: best boxes per frame, track ids by span, deduplication, continuity picks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from orbweave.functions.skew import attach, grouped


def best_by_confidence(boxes: DataFrame, keys: Sequence[str], conf: str = "conf",
                       tie: Sequence[str] = ()) -> DataFrame:
    """Highest-confidence row per key (frame and class); first by ``tie`` on equal confidence."""
    return first_per_key(boxes, keys, [-F.col(conf), *[F.col(c) for c in tie]])


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first by an explicit order; aggregation with map-side combine."""
    rest = [c for c in rows.columns if c not in keys]
    pos = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    g = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), pos).alias("_r"))
    return g.select(*keys, "_r.*")


def target_near_reference(boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Largest reference box per frame, and the target nearest to it (else most confident).

    ``boxes``: keys, ``cls`` (target/reference), x1, y1, x2, y2, conf, box_id.
    """
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    cx, cy = (F.col("x1") + F.col("x2")) / 2.0, (F.col("y1") + F.col("y2")) / 2.0
    ref = boxes.filter(F.col("cls") == "reference").groupBy(*keys).agg(
        F.max_by(F.struct(F.col("box_id").alias("ref_id"), cx.alias("rcx"), cy.alias("rcy")),
                 F.struct(area, -F.col("box_id"))).alias("r"))
    tgt = attach(boxes.filter(F.col("cls") == "target").select(
        *keys, "box_id", "conf", cx.alias("cx"), cy.alias("cy")), ref, keys, ["box_id"], "left")
    d2 = ((F.col("cx") - F.col("r.rcx")) * (F.col("cx") - F.col("r.rcx"))
          + (F.col("cy") - F.col("r.rcy")) * (F.col("cy") - F.col("r.rcy")))
    rank = F.when(F.col("r").isNotNull(), d2).otherwise(-F.col("conf"))
    best = tgt.groupBy(*keys).agg(F.min_by(F.struct("box_id", "conf"), F.struct(
        rank, F.col("box_id"))).alias("t"))
    return ref.join(best, list(keys), "full").select(
        *keys, F.col("r.ref_id").alias("reference_id"), F.col("t.box_id").alias("target_id"),
        F.col("t.conf").alias("target_conf"))


def span_tracks(points: DataFrame, keys: Sequence[str], track: str, share: float = 0.6,
                min_points: int = 3, min_span: float = 50.0) -> DataFrame:
    """Tracks whose vertical span reaches ``share`` of the key's largest span.

    When the largest span is below ``min_span`` every track of the key is kept.
    """
    span = points.groupBy(*keys, track).agg(
        (F.max("cy") - F.min("cy")).alias("_span"), F.count(F.lit(1)).alias("_n"))
    long = F.when(F.col("_n") >= min_points, F.col("_span"))
    best = span.groupBy(*keys).agg(F.max(long).alias("_best"))
    j = attach(span, best, keys, [track], "inner")
    keep = (F.col("_best") < min_span) | (long >= F.lit(share) * F.col("_best"))
    return j.filter(F.col("_best").isNotNull() & keep).select(*keys, track)


def _chain(max_step):
    def run(t: pa.Table) -> pa.Table:
        t = t.filter(t["frame_idx"].is_valid()).sort_by([("frame_idx", "ascending"), ("box_id", "ascending")])
        frame, preferred = t["frame_idx"].to_numpy(), t["preferred"].fill_null(False).to_numpy()
        x, y, conf = (t[c].to_numpy().astype(float) for c in ("cx", "cy", "conf"))
        conf = np.where(np.isnan(conf), -np.inf, conf)
        starts = np.flatnonzero(np.append(True, frame[1:] != frame[:-1])) if len(frame) else np.zeros(0, int)
        picks, at = [], None
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(frame)]):
            if at is None:
                pool = a + np.flatnonzero(preferred[a:b]) if preferred[a:b].any() else np.arange(a, b)
                at = int(pool[conf[pool].argmax()])
            else:
                step = np.hypot(x[a:b] - x[at], y[a:b] - y[at])
                near = int(np.where(np.isnan(step), np.inf, step).argmin())
                if not step[near] <= max_step:
                    continue
                at = a + near
            picks.append(at)
        return t.take(pa.array(picks, pa.int64()))
    return run


def continuity_picks(boxes: DataFrame, keys: Sequence[str], max_step: float = 300.0) -> DataFrame:
    """One box per frame that continues the previous pick; none further than ``max_step``.

    The first pick is the most confident preferred box.  Each pick depends on the one before, so
    a key is one group; keys are single clip windows (camera and play) of a few hundred frames.
    ``boxes``: keys, frame_idx, box_id, cx, cy, conf, preferred.
    """
    src = boxes.select(*keys, "frame_idx", "box_id", "cx", "cy", "conf", "preferred")
    return grouped(src, [*keys]).applyInArrow(_chain(max_step), src.schema)
