"""Cut the lineage of an intermediate that several later steps read."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpoint_dir(spark) -> str:
    """The shared folder the session names; one of this machine's only in local mode, where it is shared."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        named = tempfile.mkdtemp(prefix="checkpoint-")
    if not named:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint an intermediate that several steps read, so it is computed once.

    The files live in the shared folder, so a lost executor costs a re-read and nothing else.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
