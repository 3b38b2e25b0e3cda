"""Readers for manifests, label windows, tracks, samples, caches, predictions and label text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from orbweave.functions import fixed as K

MANIFEST = T.StructType([T.StructField("games", T.ArrayType(T.StructType([
    T.StructField("game_id", T.StringType()), T.StructField("s3_prefix", T.StringType()),
    T.StructField("date", T.StringType()), T.StructField("shots", T.LongType()),
    T.StructField("makes", T.LongType()), T.StructField("misses", T.LongType()),
    T.StructField("split", T.StringType())])))])

WINDOWS = T.StructType([T.StructField("games", T.MapType(T.StringType(), T.ArrayType(T.StructType([
    T.StructField("play_id", T.StringType()), T.StructField("id", T.StringType()),
    T.StructField("classification", T.StringType()), T.StructField("start_timestamp", T.DoubleType()),
    T.StructField("end_timestamp", T.DoubleType()), T.StructField("angle", T.StringType())]))))])

_NUM = [T.StructField(f"{p}_{c}", T.DoubleType()) for p in ("ball", "rim")
        for c in ("x", "y", "w", "h", "conf")]
TRACKS = T.StructType([
    T.StructField("game_id", T.StringType()), T.StructField("play_id", T.StringType()),
    T.StructField("classification", T.StringType()), T.StructField("angle", T.StringType()),
    T.StructField("detector", T.StringType()), T.StructField("frame_idx", T.LongType()),
    T.StructField("timestamp", T.DoubleType()), *_NUM])

NETMOTION = T.StructType([
    *[T.StructField(c, T.StringType()) for c in ("play_id", "classification", "angle")],
    T.StructField("frame_idx", T.LongType()), T.StructField("timestamp", T.DoubleType()),
    *[T.StructField(f"roi_{c}", T.IntegerType()) for c in "xywh"],
    *[T.StructField(c, T.DoubleType()) for c in ("framediff_energy", "flow_mag", "roi_var")],
    T.StructField("rim_ok", T.BooleanType())])

SHOT_RESULT = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("gt", T.StringType()),
    T.StructField("verdict", T.StringType()),
    T.StructField("samples", T.ArrayType(T.StructType([
        T.StructField("frame", T.LongType()), T.StructField("t", T.DoubleType()),
        T.StructField("fr_px", T.ArrayType(T.DoubleType())), T.StructField("fr_conf", T.DoubleType()),
        T.StructField("nr_px", T.ArrayType(T.DoubleType())), T.StructField("nr_conf", T.DoubleType()),
        T.StructField("X_cm", T.ArrayType(T.DoubleType()))])))])

CACHE = T.StructType([
    T.StructField("fps", T.DoubleType()), T.StructField("t0", T.DoubleType()),
    T.StructField("t1", T.DoubleType()), T.StructField("stride", T.IntegerType()),
    T.StructField("rim", T.ArrayType(T.DoubleType())),
    T.StructField("frames", T.ArrayType(T.StructType([
        T.StructField("f", T.LongType()),
        T.StructField("balls", T.ArrayType(T.ArrayType(T.DoubleType())))])))])

PREDICTIONS = T.StructType([
    *[T.StructField(c, T.StringType()) for c in ("game_id", "play_id", "classification")],
    T.StructField("label", T.IntegerType()), T.StructField("prob", T.DoubleType()),
    T.StructField("pred", T.IntegerType())])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Game rows of a nested manifest; shots default 0, split default train."""
    raw = spark.read.schema(MANIFEST).json(path, multiLine=True)
    g = raw.select(F.explode("games").alias("g")).select("g.*")
    return (g.withColumn("shots", F.coalesce("shots", F.lit(0)))
            .withColumn("split", F.coalesce("split", F.lit("train"))))


def games_for_split(manifest: DataFrame, split: str) -> DataFrame:
    if split == "all":
        return manifest
    if split not in ("train", "val", "test"):
        raise ValueError(f"unknown split {split!r}")
    return manifest.filter(F.col("split") == split)


def read_windows(spark: SparkSession, path: str, game: str | None = None) -> DataFrame:
    """Labelled windows from a map of arrays; a requested game that is absent is an error."""
    raw = spark.read.schema(WINDOWS).json(path, multiLine=True)
    rows = raw.select(F.explode("games").alias("game_id", "w"))
    if game is not None:
        rows = rows.filter(F.col("game_id") == game)
        if rows.isEmpty():
            raise ValueError(f"no labelled windows for game {game!r}")
    r = rows.select("game_id", F.explode("w").alias("w")).select("game_id", "w.*")
    return r.withColumn("play_id", F.coalesce("play_id", "id")).drop("id")


def shot_windows(rows: DataFrame, classes: Sequence[str] | None = None, cls: str = "classification",
                 start: str = "start_timestamp", end: str = "end_timestamp") -> DataFrame:
    """Rows of shot classes with both timestamps, in the order of their start."""
    classes = classes or (*K.MAKE_CLASSES, *K.MISS_CLASSES)
    return rows.filter(F.col(cls).isin(*classes) & F.col(start).isNotNull() & F.col(end).isNotNull()).orderBy(start)


def clean_nan(df: DataFrame) -> DataFrame:
    """Turn NaN into null once, so Spark never sorts or aggregates it as a value."""
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c)
                       for c, t in df.dtypes])


def read_tracks(spark: SparkSession, path: str, games: Sequence[str] | None = None) -> DataFrame:
    """Track files partitioned by game_id, pruned to the wanted games; absent games raise."""
    df = clean_nan(spark.read.schema(TRACKS).parquet(path))
    return only_games(df, games)


def only_games(df: DataFrame, games: Sequence[str] | None, key: str = "game_id") -> DataFrame:
    if games is None:
        return df
    have = {r[0] for r in df.filter(F.col(key).isin(*games)).select(key).distinct().collect()}
    missing = sorted(set(games) - have)     # at most len(games) keys reach the driver
    if missing:
        raise ValueError(f"missing tracks for {missing}")
    return df.filter(F.col(key).isin(*games))


def read_parquet_or_json(spark: SparkSession, base: str, schema: T.StructType) -> DataFrame:
    """Parquet when it can be read, else JSON lines, with one explicit schema."""
    try:
        return clean_nan(spark.read.schema(schema).parquet(f"{base}.parquet"))
    except Exception as ex:
        if "PATH_NOT_FOUND" not in str(ex):
            raise
    return clean_nan(spark.read.schema(schema).json(f"{base}.jsonl"))


def read_netmotion(spark: SparkSession, pattern: str) -> DataFrame:
    """Motion files, one per game, with the game id taken from the directory name."""
    df = clean_nan(spark.read.schema(NETMOTION).parquet(pattern))
    return df.withColumn("game_id", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))


def read_samples(spark: SparkSession, pattern: str) -> DataFrame:
    """Per-shot result documents, one row per triangulated sample."""
    raw = spark.read.schema(SHOT_RESULT).json(pattern, multiLine=True)
    x = raw.select("name", "gt", "verdict", F.posexplode("samples").alias("pos", "s"))
    return x.select("name", "gt", "verdict", "pos", "s.frame", "s.t", "s.fr_px", "s.fr_conf", "s.nr_px",
                    "s.nr_conf", F.col("s.X_cm")[0].alias("x"), F.col("s.X_cm")[1].alias("y"),
                    F.col("s.X_cm")[2].alias("z"))


def read_detection_cache(spark: SparkSession, pattern: str) -> DataFrame:
    """Sparse detection caches: one row per ball; frames without balls keep a null box."""
    raw = spark.read.schema(CACHE).json(pattern, multiLine=True)
    f = raw.select(F.input_file_name().alias("source"), "fps", "t0", "t1", "stride", "rim",
                   F.explode("frames").alias("fr"))
    b = f.select("source", "fps", "t0", "t1", "stride", "rim", F.col("fr.f").alias("f"),
                 F.explode_outer("fr.balls").alias("b"))
    return b.select(*[c for c in b.columns if c != "b"],
                    *[F.col("b")[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


def read_predictions(spark: SparkSession, path: str, schema: T.StructType = PREDICTIONS) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def parse_label_lines(lines: DataFrame, text: str = "value", width: float = 1920.0,
                      height: float = 1080.0) -> DataFrame:
    """``class cx cy w h`` lines (normalised) to absolute corner boxes; blank lines drop out."""
    p = F.split(F.trim(F.col(text)), r"\s+")
    r = lines.withColumn("_p", p).filter(F.size("_p") >= 5)

    def num(i):
        return F.col("_p")[i].cast("double")
    w, h = F.lit(width), F.lit(height)
    return r.select(*[c for c in lines.columns if c != text], F.col("_p")[0].cast("int").alias("cls"),
                    ((num(1) - num(3) / 2) * w).alias("x1"), ((num(2) - num(4) / 2) * h).alias("y1"),
                    ((num(1) + num(3) / 2) * w).alias("x2"), ((num(2) + num(4) / 2) * h).alias("y2"))


def read_label_text(spark: SparkSession, pattern: str) -> DataFrame:
    return parse_label_lines(spark.read.text(pattern).withColumn("source", F.input_file_name()))
