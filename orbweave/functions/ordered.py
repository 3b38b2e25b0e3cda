"""Ordered per-key operators that never place a whole key in one task.

Every function takes a ``bucket``: an integer column that does not decrease along the order
(frame // n, day of a timestamp, ...).  Work happens inside (key, bucket); only the first and
last row of each bucket, or one summary row per bucket, meet in a per-key window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

FRAME_BUCKET = 4096


def frame_bucket(col: str = "frame_idx", width: int = FRAME_BUCKET) -> Column:
    return F.floor(F.col(col) / F.lit(width)).cast("long")


def micros(col: str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, independent of the session time zone."""
    c = F.col(col)
    whole = (F.unix_date(F.to_date(c)).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60)
    part = (F.extract(F.lit("SECOND"), c) * F.lit(1_000_000)).cast("long")
    return whole * F.lit(1_000_000) + part


def time_bucket(col: str, seconds: float) -> Column:
    """Bucket of a timestamp column; ``seconds`` wide."""
    return F.floor(micros(col) / F.lit(int(seconds * 1_000_000))).cast("long")


def value_bucket(col: str, width: float) -> Column:
    return F.floor(F.col(col) / F.lit(float(width))).cast("long")


def row_number(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
               name: str = "rn") -> DataFrame:
    """Exact row number per key: rank inside the bucket plus the rows of earlier buckets."""
    b = df.withColumn("__b", bucket)
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (b.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__c"))
               .withColumn("__off", F.coalesce(F.sum("__c").over(before), F.lit(0)))
               .drop("__c"))
    inside = Window.partitionBy(*keys, "__b").orderBy(*order)
    return (b.withColumn("__rn", F.row_number().over(inside))
            .join(offsets, [*keys, "__b"])
            .withColumn(name, (F.col("__rn") + F.col("__off")).cast("long"))
            .drop("__rn", "__off", "__b"))


def neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str],
               bucket: Column, prev: str | None = "prev", nxt: str | None = "next") -> DataFrame:
    """Add the previous and next row of the key as structs of ``cols`` (null at the ends)."""
    payload = F.struct(*cols)
    b = df.withColumn("__b", bucket)
    w1 = Window.partitionBy(*keys, "__b").orderBy(*order)
    b = b.withColumn("__p", F.lag(payload).over(w1)).withColumn("__n", F.lead(payload).over(w1))
    # rows at a bucket edge travel to the per-key window, the others stay in their bucket
    edge = F.col("__p").isNull() | F.col("__n").isNull()
    b = b.withColumn("__g", F.when(~edge, F.col("__b")))
    w2 = Window.partitionBy(*keys, "__g").orderBy(*order)
    out = b
    if prev:
        out = out.withColumn(prev, F.coalesce("__p", F.lag(payload).over(w2)))
    if nxt:
        out = out.withColumn(nxt, F.coalesce("__n", F.lead(payload).over(w2)))
    return out.drop("__b", "__p", "__n", "__g")


def fill_known(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column,
               bucket: Column, before: str = "known_before", after: str = "known_after",
               ) -> DataFrame:
    """Latest non-null ``value`` at or before the row and earliest at or after it."""
    return fill_known_many(df, keys, order, {(before, after): value}, bucket)


def fill_known_many(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                    values: dict[tuple[str, str], Column], bucket: Column) -> DataFrame:
    """``fill_known`` for several values in one pass; names map (before, after) to a value."""
    b = df.withColumn("_b", bucket)
    for i, v in enumerate(values.values()):
        b = b.withColumn(f"_v{i}", v)
    ids = range(len(values))
    pos = F.struct(*[F.col(c) for c in order])

    def seen(i):
        return F.when(F.col(f"_v{i}").isNotNull(), pos)
    sums = b.groupBy(*keys, "_b").agg(*[e for i in ids for e in (
        F.max_by(F.col(f"_v{i}"), seen(i)).alias(f"_l{i}"),
        F.min_by(F.col(f"_v{i}"), seen(i)).alias(f"_f{i}"))])
    wb = Window.partitionBy(*keys).orderBy("_b")
    carry = sums.select(*keys, "_b", *[e for i in ids for e in (
        F.last(f"_l{i}", ignorenulls=True)
        .over(wb.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_cb{i}"),
        F.first(f"_f{i}", ignorenulls=True)
        .over(wb.rowsBetween(1, Window.unboundedFollowing)).alias(f"_ca{i}"))])
    w = Window.partitionBy(*keys, "_b").orderBy(*order)
    out = b.select("*", *[e for i in ids for e in (
        F.last(f"_v{i}", ignorenulls=True)
        .over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(f"_ib{i}"),
        F.first(f"_v{i}", ignorenulls=True)
        .over(w.rowsBetween(0, Window.unboundedFollowing)).alias(f"_ia{i}"))])
    out = out.join(carry, [*keys, "_b"])
    return out.select(*df.columns, *[e for i, (nb, na) in enumerate(values) for e in (
        F.coalesce(f"_ib{i}", f"_cb{i}").alias(nb), F.coalesce(f"_ia{i}", f"_ca{i}").alias(na))])


def running_max(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column,
                bucket: Column, name: str = "running_max") -> DataFrame:
    """Largest value at or before the row: inside the bucket, then over earlier buckets."""
    b = df.withColumn("_b", bucket).withColumn("_v", value)
    wb = (Window.partitionBy(*keys).orderBy("_b")
          .rowsBetween(Window.unboundedPreceding, -1))
    carry = (b.groupBy(*keys, "_b").agg(F.max("_v").alias("_m"))
             .select(*keys, "_b", F.max("_m").over(wb).alias("_c")))
    w = (Window.partitionBy(*keys, "_b").orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, 0))
    return (b.withColumn("_i", F.max("_v").over(w)).join(carry, [*keys, "_b"])
            .withColumn(name, F.greatest("_i", "_c")).drop("_b", "_v", "_i", "_c"))


def with_halo(df: DataFrame, position: str, width: int, halo: int, part: str = "_part",
              own: str = "_own") -> DataFrame:
    """Copy rows within ``halo`` positions of a part border into the neighbouring part.

    ``position`` is a dense integer per key, so a frame of up to ``halo`` rows on either side is
    complete for every row marked ``own``.  Rows are copied at most once while halo < width.
    """
    home = F.floor(F.col(position) / F.lit(width)).cast("long")
    lo = F.floor((F.col(position) - F.lit(halo)) / F.lit(width)).cast("long")
    hi = F.floor((F.col(position) + F.lit(halo)) / F.lit(width)).cast("long")
    return (df.withColumn("_home", home)
            .withColumn(part, F.explode(F.sequence(lo, hi)))
            .withColumn(own, F.col(part) == F.col("_home"))
            .drop("_home"))


def cluster_rows(df: DataFrame, keys: Sequence[str], t: str, gap: float, bucket: Column) -> DataFrame:
    """Mark gap-separated clusters: adds ``cluster_start`` (the ``t`` of the cluster's first row).

    A row further than ``gap`` from the previous row of its key opens a new cluster.  Rows of one time are in one
    cluster, so their order decides nothing: starts are the largest opening time so far, peers included.
    """
    b = df.withColumn("_b", bucket)
    w = Window.partitionBy(*keys, "_b").orderBy(t)
    b = b.withColumn("_prev", F.lag(t).over(w))
    b = b.withColumn("_open", F.when(F.col(t) - F.col("_prev") > F.lit(gap), F.col(t)))
    sums = b.groupBy(*keys, "_b").agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"), F.max("_open").alias("_last"))
    wb = Window.partitionBy(*keys).orderBy("_b")
    before = F.lag("_hi").over(wb)
    sums = sums.withColumn("_edge", F.when(before.isNull() | (F.col("_lo") - before > F.lit(gap)), F.col("_lo")))
    carry = sums.select(*keys, "_b", F.coalesce("_edge", F.max(F.coalesce("_last", "_edge")).over(
        wb.rowsBetween(Window.unboundedPreceding, -1))).alias("_carry"))
    peers = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return (b.withColumn("_inside", F.max("_open").over(peers)).join(carry, [*keys, "_b"])
            .withColumn("cluster_start", F.coalesce("_inside", "_carry"))
            .drop("_b", "_prev", "_open", "_inside", "_carry"))
