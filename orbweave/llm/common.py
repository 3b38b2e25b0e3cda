"""Helpers the operators of this subpackage share: learning folds, written intermediates, Arrow access."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from orbweave.functions.lineage import checkpoint_dir

ROWS_PER_BATCH = 2000


def fold(key: Column, folds: int = 5) -> Column:
    """crc32 of the key's text modulo ``folds``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(folds)


def written(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write an intermediate as Parquet into the shared folder and read it back.

    Cuts the lineage like a checkpoint, in columnar form: a lost executor costs a re-read.
    """
    spark = df.sparkSession
    folder = checkpoint_dir(spark)
    if not folder:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete intermediates of :func:`written` that nothing reads any more, and let Spark delete its shuffle files.

    It does so once the driver has collected the frames that the files belong to.
    """
    for df in frames:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    if frames:
        jvm.System.gc()


def texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each value of a string column, without building Python strings; null is empty."""
    for value in column:
        yield value.as_buffer().to_pybytes() if value.is_valid else b""


def utf8(data: bytes) -> bytes:
    """The bytes, with U+FFFD for what is not UTF-8."""
    try:
        data.decode()
        return data
    except UnicodeDecodeError:
        return data.decode("utf-8", "replace").encode()


def slices(batches, rows: int = 256):
    """Arrow batches cut into short ones, so that a task holds few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def arrow_rows(columns: dict[str, list | pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=schema.field(n).type)
         for n, c in columns.items()], schema=schema)


def join_back(rows: DataFrame, per_group: DataFrame, on: str, size: str, total: int, share: int = 1000) -> DataFrame:
    """Inner join of rows to one row per group, safe where a group holds a large part of all rows.

    Groups with more than 1/``share`` of the ``total`` rows are at most ``share`` by counting, so they go to every
    task; the others are joined by a shuffle, none of whose keys is hot.
    """
    limit = max(1, total // share)
    hot = F.broadcast(per_group.where(F.col(size) > limit))
    rest = per_group.where(F.col(size) <= limit)
    return rows.join(hot, on).unionByName(rows.join(hot.select(on), on, "left_anti").join(rest, on))
