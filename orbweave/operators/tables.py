"""Table-level operators: validated assembly, optional families, deduplication, comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from orbweave.functions.skew import maybe_broadcast


def attach_dimension(facts: DataFrame, dim: DataFrame, keys: Sequence[str],
                     defaults: dict | None = None) -> DataFrame:
    """Left join of a dimension; broadcast only when its size is checked to be small."""
    j = facts.join(maybe_broadcast(dim), list(keys), "left")
    for col, value in (defaults or {}).items():
        j = j.withColumn(col, F.coalesce(F.col(col), F.lit(value)))
    return j


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def assemble(base: DataFrame, families: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """1:1 left join of feature families; raises when a family repeats a key.

    A left join on a unique key cannot change the row count, so the key check is the whole check.
    """
    out = base
    for fam in families:
        if not repeated_keys(fam, keys).isEmpty():
            raise ValueError(f"family with columns {fam.columns} repeats a key")
        out = out.join(fam, list(keys), "left")
    return out


def attach_optional(base: DataFrame, family: DataFrame, keys: Sequence[str],
                    fill: float = 0.0) -> DataFrame:
    """Left join of an optional family whose absent values count as ``fill``."""
    cols = [c for c in family.columns if c not in keys]
    return base.join(family, list(keys), "left").fillna(fill, cols)


def same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys present on one side only, labelled; empty when both sides cover the same keys."""
    m = a.select(*keys, F.lit(1).alias("_s")).unionByName(b.select(*keys, F.lit(2).alias("_s")))
    g = m.groupBy(*keys).agg(F.sum(F.when(F.col("_s") == 1, 1).otherwise(0)).alias("na"),
                             F.sum(F.when(F.col("_s") == 2, 1).otherwise(0)).alias("nb"))
    return g.filter((F.col("na") == 0) | (F.col("nb") == 0)).select(
        *keys, F.when(F.col("na") > 0, "left").otherwise("right").alias("only_in"))


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free content digest: row count and the sum of row hashes."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(h).cast("string").alias("digest"))


def verify_fingerprint(df: DataFrame, n_rows: int, digest: str) -> DataFrame:
    """Return the table only when its digest equals the pinned one."""
    got = fingerprint(df).first()
    if (got.n_rows, got.digest) != (n_rows, digest):
        raise ValueError(f"frozen input changed: {got.n_rows} rows, digest {got.digest}")
    return df


def compare_tables(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Per column: rows on one side only, rows that differ, largest absolute difference."""
    j = a.select(*keys, F.lit(True).alias("_a"), *[F.col(c).alias(f"a_{c}") for c in cols]).join(
        b.select(*keys, F.lit(True).alias("_b"), *[F.col(c).alias(f"b_{c}") for c in cols]),
        list(keys), "full")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()

    def stats(c) -> Column:
        x, y = F.col(f"a_{c}").cast("double"), F.col(f"b_{c}").cast("double")
        return F.struct(
            F.lit(c).alias("column"), F.sum((~both).cast("long")).alias("unmatched"),
            F.sum((both & ~x.eqNullSafe(y)).cast("long")).alias("n_diff"),
            F.coalesce(F.max(F.abs(x - y)), F.lit(0.0)).alias("max_abs_diff"))
    return j.agg(F.array(*[stats(c) for c in cols]).alias("s")).select(F.explode("s").alias("r")) \
        .select("r.*")


def balance(records: DataFrame, game: str = "game_id", label: str = "label", usable: str = "usable") -> DataFrame:
    """Class and game balance: records, usable and unusable ones, usable makes and misses per game and in all.

    A null ``usable`` is not usable.  ``n_games`` counts the games with a usable record, the folds of a
    leave-one-game-out run; it is 0 or 1 for a game.
    """
    ok = F.coalesce(F.col(usable), F.lit(False))

    def n(cond):
        return F.count(F.when(cond, 1))
    g = records.withColumn("_g", F.col(game)).rollup("_g").agg(
        F.count(F.lit(1)).alias("n"), n(ok).alias("usable"), n(~ok).alias("unusable"),
        n(ok & (F.col(label) == 1)).alias("makes"), n(ok & (F.col(label) == 0)).alias("misses"),
        F.count_distinct(F.when(ok, F.col(game))).alias("n_games"), F.grouping("_g").alias("_all"))
    return g.select(F.when(F.col("_all") == 1, "ALL").otherwise(F.col("_g").cast("string")).alias("game"),
                    "n", "usable", "unusable", "makes", "misses", "n_games")


def complete_games(plays: DataFrame, cameras: DataFrame, game: str, angle: str,
                   min_shots: int = 60, need: int = 4) -> DataFrame:
    """Games with enough labelled shots that also have all cameras."""
    p = plays.groupBy(game).agg(F.count(F.lit(1)).alias("shots")).filter(F.col("shots") >= min_shots)
    c = (cameras.groupBy(game).agg(F.count_distinct(angle).alias("n_cameras"))
         .filter(F.col("n_cameras") >= need))
    return p.join(c, game)


def numeric_features(df: DataFrame, drop: Sequence[str] = ()) -> list[str]:
    """Numeric columns minus metadata."""
    ok = ("int", "bigint", "double", "float", "smallint", "tinyint")
    return [c for c, t in df.dtypes if t in ok and c not in drop]


def feature_buckets(cols: Sequence[str], prefixes: dict[str, Sequence[str]]) -> dict[str, list[str]]:
    """Columns grouped by the first bucket whose prefix matches; the rest under 'other'."""
    out: dict[str, list[str]] = {b: [] for b in (*prefixes, "other")}
    for c in cols:
        home = next((b for b, ps in prefixes.items() if c.startswith(tuple(ps))), "other")
        out[home].append(c)
    return out
