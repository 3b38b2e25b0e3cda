"""Joins and checks that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

SALTS = 8
#: A group up to this many rows may be handled by one task (about 100 MB of doubles).
GROUP_LIMIT = 1_000_000
#: Tables proven smaller than this many rows may be broadcast.
BROADCAST_ROWS = 200_000


def attach(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], spread: Sequence[str],
           how: str = "left", salts: int = SALTS, shuffled: bool = False) -> DataFrame:
    """Join one-row-per-key values onto many rows without sending a hot key to one task.

    The row side is split over ``salts`` parts of each key by a hash of ``spread``
    (columns that differ between rows of a key); the per-key side is repeated once per part.
    ``shuffled``: never broadcast.  Spark sizes a compressed file by its bytes and does not see that the
    rows are repeated, so where there are about as many keys as rows it may broadcast a large table.
    """
    part = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    left = rows.withColumn("__part", part)
    right = per_key.withColumn("__part", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.join(right.hint("merge") if shuffled else right, [*keys, "__part"], how).drop("__part")


def hot_keys(df: DataFrame, keys: Sequence[str], limit: int = GROUP_LIMIT) -> DataFrame:
    """Keys with more than ``limit`` rows; there are at most rows/limit of them."""
    return df.groupBy(*keys).count().filter(F.col("count") > limit).select(*keys)


def bounded_rows(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """True when the table is proven to have at most ``limit`` rows (reads at most limit+1)."""
    return df.limit(limit + 1).count() <= limit


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only after the size check; otherwise leave the join to shuffle."""
    return F.broadcast(df) if bounded_rows(df, limit) else df


def or_default(col: Column | str, default) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c, F.lit(default))


def grouped(df: DataFrame, keys: Sequence[str]):
    """Grouping for a Python group function, spread over the session's shuffle partitions.

    Python time per row is far above its bytes, so partitions must not be merged by size; an
    explicit partition count is left alone by adaptive coalescing and serves the grouping as is.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).groupBy(*keys)
