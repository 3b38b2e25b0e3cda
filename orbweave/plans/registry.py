"""Registry of named queries with their SQL twins on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, dp: dict[str, str] | None = None):
    """Register a query.

    ``dp`` maps a number of decimals to the columns compared at that precision, on both sides.
    Float sums depend on summation order, so results are compared after rounding.
    """
    digits = {col: int(n) for n, cols in (dp or {}).items() for col in cols.split()}

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.select(*[
                (F.round(F.col(f"`{c}`"), digits[c]) + F.lit(0.0)).alias(c) if c in digits
                else F.col(f"`{c}`") for c in df.columns])
        run.__name__ = name
        run.__doc__ = fn.__doc__
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            if digits:
                rep = ", ".join(f'round(CAST("{c}" AS DOUBLE), {n}) + CAST(0 AS DOUBLE) AS "{c}"' for c, n in digits.items())
                ORACLES[name] = f"SELECT * REPLACE ({rep}) FROM (\n{sql.strip()}\n) AS q"
            else:
                ORACLES[name] = sql.strip()
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
