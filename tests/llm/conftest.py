import pytest
from pyspark.sql import types as T

VERDICTS = T.StructType([
    T.StructField("name", T.LongType()), T.StructField("verdict", T.StringType()), T.StructField("key", T.StringType()),
    T.StructField("digest", T.StringType()), T.StructField("gt", T.StringType())])


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    """The folder the operators write intermediates to, as a cluster would name one."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def verdicts(spark):
    """Make a verdict table of (name, verdict), with columns whose names clash with the operators' own."""
    def make(rows, parts=3):
        return spark.createDataFrame([(k, t, "x", "y", "MAKE") for k, t in rows], VERDICTS).repartition(parts)
    return make


ODD = [
    (1, "MAKE (cross r=12cm, z_min=-3cm)"), (2, None), (3, ""), (4, "make (CROSS r=12cm, z_min=-3cm)"),
    (5, "  \n\t "), (6, "MISS été – ñandú 🎯 нет"), (7, "MAKE (cross r=12cm, z_min=-3cm)"), (7, "MAKE (cross r=12cm, z_min=-3cm)"),
    (None, "UNDECIDED no apex"), (None, None), (8, "x" * 300), (9, "rim " * 30_000), (10, "é" * 5_000), (11, "1"), (12, "a\nb\na"),
]


@pytest.fixture(scope="session")
def odd_rows():
    return ODD
