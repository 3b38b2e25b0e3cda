"""Exact percentiles (linear interpolation) that survive hot groups.

Groups up to a checked size use Spark's exact ``percentile`` aggregate.  Larger groups - at most
rows/limit of them - are answered by a distributed selection: histogram, pick the bucket that
holds each wanted rank, rank only that bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from orbweave.functions.skew import GROUP_LIMIT, attach, hot_keys


def percentiles(df: DataFrame, keys: Sequence[str], cols: Sequence[str],
                probs: Sequence[float] = (0.5,), limit: int = GROUP_LIMIT) -> DataFrame:
    """One row per key; column ``c_pNN`` per column and probability (``c`` alone for one prob)."""
    hot = hot_keys(df, keys, limit) if keys else None
    if keys:
        any_hot = not hot.isEmpty()
    else:
        any_hot = df.count() > limit
    if not any_hot:
        return _native(df, keys, cols, probs)
    if not keys:
        tagged = df.withColumn("_all", F.lit(0))
        return _selected(tagged, ["_all"], cols, probs).drop("_all")
    hot = F.broadcast(hot)  # bounded: at most rows/limit keys
    cold_part = _native(df.join(hot, list(keys), "left_anti"), keys, cols, probs)
    hot_part = _selected(df.join(hot, list(keys), "left_semi"), keys, cols, probs)
    return cold_part.unionByName(hot_part)


def _name(col: str, prob: float, single: bool) -> str:
    return col if single else f"{col}_p{round(prob * 100):02d}"


def _native(df, keys, cols, probs):
    single = len(probs) == 1
    aggs = [F.percentile(F.col(c).cast("double"), F.lit(float(p))).alias(_name(c, p, single))
            for c in cols for p in probs]
    return df.groupBy(*keys).agg(*aggs)


def _selected(df: DataFrame, keys: Sequence[str], cols: Sequence[str], probs: Sequence[float],
              buckets: int = 4096) -> DataFrame:
    """Distributed exact selection; no task sees more than one histogram bucket of a key."""
    keys = list(keys)
    gk = [*keys, "_name"]
    longed = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("_name"), F.col(c).cast("double").alias("_v")) for c in cols
    ])).alias("_s")).select(*keys, "_s._name", "_s._v").filter(F.col("_v").isNotNull())
    grain = longed.groupBy(*gk, "_v").agg(F.count(F.lit(1)).alias("_c"))

    stats = grain.groupBy(*gk).agg(F.sum("_c").alias("_n"), F.min("_v").alias("_lo"),
                                   F.max("_v").alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    idx = F.when(span > 0, F.least(F.lit(buckets - 1), F.floor(
        (F.col("_v") - F.col("_lo")) / span * F.lit(buckets))).cast("int")).otherwise(F.lit(0))
    placed = attach(grain, stats, gk, ["_v"], "inner").withColumn("_k", idx)

    hist = placed.groupBy(*gk, "_k").agg(F.sum("_c").alias("_bc"), F.max("_n").alias("_n"))
    cum = Window.partitionBy(*gk).orderBy("_k")   # at most `buckets` rows per key
    hist = hist.withColumn("_upto", F.sum("_bc").over(cum))
    wanted = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.lit(e).alias("end"))
                       for p in probs for e in ("lo", "hi")])
    at = F.col("_w.p") * (F.col("_n") - 1)
    rank = F.when(F.col("_w.end") == "lo", F.floor(at)).otherwise(F.ceil(at)).cast("long")
    targets = (hist.withColumn("_w", F.explode(wanted)).withColumn("_rank", rank)
               .filter((F.col("_rank") < F.col("_upto"))
                       & (F.col("_rank") >= F.col("_upto") - F.col("_bc")))
               .select(*gk, "_k", F.col("_w.p").alias("_p"), F.col("_w.end").alias("_end"),
                       F.col("_rank"), (F.col("_upto") - F.col("_bc")).alias("_before"),
                       (at - F.floor(at)).alias("_frac")))
    # only rows of a wanted bucket survive the join; rank them inside that bucket
    need = targets.groupBy(*gk, "_k").agg(F.min("_before").alias("_before"))
    inside = Window.partitionBy(*gk, "_k").orderBy("_v")
    ranked = (placed.select(*gk, "_k", "_v", "_c").join(need, [*gk, "_k"])
              .withColumn("_end_rank", F.col("_before") + F.sum("_c").over(inside)))
    hit = (ranked.withColumnRenamed("_before", "_b0").join(targets, [*gk, "_k"])
           .filter((F.col("_rank") < F.col("_end_rank"))
                   & (F.col("_rank") >= F.col("_end_rank") - F.col("_c"))))
    pair = hit.groupBy(*gk, "_p").agg(
        F.max(F.when(F.col("_end") == "lo", F.col("_v"))).alias("_a"),
        F.max(F.when(F.col("_end") == "hi", F.col("_v"))).alias("_z"),
        F.max("_frac").alias("_frac"))
    val = F.when(F.col("_a") == F.col("_z"), F.col("_a")).otherwise(
        (1 - F.col("_frac")) * F.col("_a") + F.col("_frac") * F.col("_z"))
    single = len(probs) == 1
    out = pair.withColumn("_q", val).groupBy(*keys).agg(*[
        F.max(F.when((F.col("_name") == c) & (F.col("_p") == float(p)), F.col("_q")))
        .alias(_name(c, p, single)) for c in cols for p in probs])
    # a key whose columns are all null keeps its row, as in the native way
    same = [F.col(f"_own_{i}").eqNullSafe(F.col(k)) for i, k in enumerate(keys)]
    own = df.select(*[F.col(k).alias(f"_own_{i}") for i, k in enumerate(keys)]).distinct()
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return own.join(out, cond, "left").select(
        *[F.col(f"_own_{i}").alias(k) for i, k in enumerate(keys)],
        *[_name(c, p, single) for c in cols for p in probs])


def medians(df: DataFrame, keys: Sequence[str], cols: Sequence[str],
            limit: int = GROUP_LIMIT) -> DataFrame:
    return percentiles(df, keys, cols, (0.5,), limit)
