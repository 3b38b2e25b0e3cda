"""Writers: predictions, reports and idempotent per-game output."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from orbweave.functions.skew import maybe_broadcast

PREDICTION_COLUMNS = ("game_id", "play_id", "classification", "label", "prob", "pred", "correct")


def prediction_rows(df: DataFrame) -> DataFrame:
    """Fixed prediction columns, probability rounded half-even to six digits, sorted by shot."""
    return df.select("game_id", "play_id", "classification", "label",
                     F.bround("prob", 6).alias("prob"), "pred",
                     (F.col("label") == F.col("pred")).alias("correct")).orderBy("game_id", "play_id")


def write_predictions(df: DataFrame, path: str) -> None:
    prediction_rows(df).write.mode("overwrite").parquet(path)


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """CSV with header, or JSON lines."""
    w = df.write.mode("overwrite")
    w.csv(path, header=True) if fmt == "csv" else w.json(path)


def write_new_games(df: DataFrame, path: str, key: str = "game_id", force: bool = False) -> DataFrame:
    """Append only games whose partition is absent; ``force`` replaces the given games' partitions.

    Returns the rows that were written.  Rerunning after a failure writes what is missing.
    """
    spark = df.sparkSession
    if force:
        (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(key).parquet(path))
        return df
    try:
        done = spark.read.parquet(path).select(F.col(key).cast(df.schema[key].dataType).alias(key)) \
            .distinct()
        todo = df.join(maybe_broadcast(done), key, "left_anti")
    except Exception as ex:
        if "PATH_NOT_FOUND" not in str(ex) and "UNABLE_TO_INFER_SCHEMA" not in str(ex):
            raise
        todo = df
    todo.write.mode("append").partitionBy(key).parquet(path)
    return todo
