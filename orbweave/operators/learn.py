"""Model fitting and validation on Spark ML, grouped by game.

Loops run over a handful of games, column sets or parameter sets; every fit and every scoring is
a Spark job over the whole table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from orbweave.functions.lineage import cut
from orbweave.operators import evaluate as E

PART_ROWS = 50_000         # fewer rows of a part cost less than its task
MOST_ROWS = 1_000_000


def logistic(cols: Sequence[str], reg: float = 0.01) -> Pipeline:
    """Median impute, standardise, class-weighted L2 logistic regression (weights in ``_w``)."""
    imp = [f"_i_{c}" for c in cols]
    return Pipeline(stages=[
        Imputer(strategy="median", relativeError=0.0, inputCols=list(cols), outputCols=imp),
        VectorAssembler(inputCols=imp, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_x", withMean=True),
        LogisticRegression(featuresCol="_x", labelCol="label", weightCol="_w", regParam=reg,
                           maxIter=50)])


def boosted(cols: Sequence[str], depth: int = 4, rate: float = 0.08, rounds: int = 20,
            leaf: int = 20) -> Pipeline:
    """Median impute and gradient-boosted trees."""
    imp = [f"_i_{c}" for c in cols]
    return Pipeline(stages=[
        Imputer(strategy="median", relativeError=0.0, inputCols=list(cols), outputCols=imp),
        VectorAssembler(inputCols=imp, outputCol="_x"),
        GBTClassifier(featuresCol="_x", labelCol="label", maxDepth=depth, stepSize=rate,
                      maxIter=rounds, minInstancesPerNode=leaf, seed=42)])


def balanced(df: DataFrame) -> DataFrame:
    """Add class weights n / (2 n_class)."""
    n = df.agg(F.count(F.lit(1)).alias("n"), E.count_if(F.col("label") == 1).alias("p")).first()
    pos, neg = max(n.p, 1), max(n.n - n.p, 1)
    return df.withColumn("_w", F.when(F.col("label") == 1, n.n / (2.0 * pos)).otherwise(n.n / (2.0 * neg)))


def as_numbers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in cols}) \
        .withColumn("label", F.col("label").cast("int"))


def spread(df: DataFrame) -> DataFrame:
    """The rows computed once and dealt evenly, so that each of a fit's many passes uses all cores.

    A part holds at least ``PART_ROWS`` rows as far as there are cores for more, and at most ``MOST_ROWS``.
    """
    rows = cut(df)
    n, cores = rows.count(), df.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(-(-n // PART_ROWS), max(cores, -(-n // MOST_ROWS))))
    return rows if parts == rows.rdd.getNumPartitions() else cut(rows.repartition(parts))


def fit(pipe: Pipeline, train: DataFrame):
    return pipe.fit(balanced(train))


def score(model, df: DataFrame, name: str = "p") -> DataFrame:
    """Original columns plus the probability of class 1."""
    s = model.transform(df.withColumn("_w", F.lit(1.0)))
    return s.select(*df.columns, vector_to_array("probability")[1].alias(name))


def folds_by_game(df: DataFrame, k: int = 5, game: str = "game_id") -> DataFrame:
    """Whole games dealt to folds, largest first in serpentine order so fold sizes stay even."""
    sizes = df.groupBy(game).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy(F.col("_n").desc(), game)      # one row per game
    i = F.row_number().over(w) - 1
    lap, seat = F.floor(i / k), i % k
    return sizes.select(game, F.when(lap % 2 == 0, seat).otherwise(k - 1 - seat).cast("int").alias("fold"))


def group_cv(df: DataFrame, pipe: Pipeline, k: int = 5, game: str = "game_id") -> DataFrame:
    """Accuracy, F1 and AUC per fold of whole games, as one scored table aggregated per fold."""
    f = df.join(F.broadcast(folds_by_game(df, k, game)), game)   # one row per game
    out = None
    for i in range(k):
        test = f.filter(F.col("fold") == i)
        if test.isEmpty():
            continue
        s = score(fit(pipe, f.filter(F.col("fold") != i)), test)
        out = s if out is None else out.unionByName(s)
    out = out.withColumn("pred", (F.col("p") >= 0.5).cast("int"))
    m = E.binary_metrics(out, ["fold"]).select("fold", "n", "accuracy", "f1")
    return m.join(E.auc(out, ["fold"], "p").select("fold", "auc"), "fold")


def cv_summary(folds: DataFrame) -> DataFrame:
    """Mean and population std over folds."""
    return folds.agg(F.count(F.lit(1)).alias("folds"), *[
        e for c in ("accuracy", "f1", "auc") for e in (
            F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))])


def games_of(df: DataFrame, game: str = "game_id") -> list:
    """Distinct games in order; a manifest-sized list."""
    return [r[0] for r in df.select(game).distinct().orderBy(game).collect()]


def out_of_fold(df: DataFrame, pipe: Pipeline, game: str = "game_id") -> DataFrame:
    """Leave-one-game-out probability of every row."""
    out = None
    for g in games_of(df, game):
        s = score(fit(pipe, df.filter(F.col(game) != g)), df.filter(F.col(game) == g))
        out = s if out is None else out.unionByName(s)
    return out


def leave_one_game_out(df: DataFrame, pipe: Pipeline, game: str = "game_id",
                       grid: Sequence[float] = tuple(E.grid(0.30, 0.85, 0.01))) -> DataFrame:
    """Per held-out game: threshold from an inner validation game, then its metrics.

    The inner game is the next one in order, cyclically.
    """
    games, out = games_of(df, game), None
    for i, g in enumerate(games):
        inner = games[(i + 1) % len(games)]
        model = fit(pipe, df.filter(~F.col(game).isin(g, inner)))
        val = score(model, df.filter(F.col(game) == inner))
        thr = E.threshold_by_shortfall(E.sweep(val, grid, score="p")).first().threshold
        test = score(model, df.filter(F.col(game) == g)) \
            .withColumn("pred", (F.col("p") >= F.lit(thr)).cast("int"))
        m = E.binary_metrics(test, [game]).withColumn("threshold", F.lit(thr))
        out = m if out is None else out.unionByName(m)
    return out


def logo_summary(table: DataFrame) -> DataFrame:
    """Row-weighted means and the number of games that meet all targets."""
    def wavg(c):
        return (F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c)
    hits = (F.col("accuracy") >= 0.92) & (F.col("precision") >= 0.90) & (F.col("recall") >= 0.90)
    return table.agg(F.count(F.lit(1)).alias("games"), wavg("accuracy"), wavg("precision"),
                     wavg("recall"), E.count_if(hits).alias("n_meeting_targets"))


def select_refit_test(df: DataFrame, candidates: dict[str, Pipeline], split: str = "split") -> DataFrame:
    """Choose model and threshold on val, refit on train and val, score test once."""
    df = spread(df)
    train, val = (df.filter(F.col(split) == x) for x in ("train", "val"))
    best = None
    for name, pipe in candidates.items():
        sw = E.sweep(score(fit(pipe, train), val), [0.05 + k * 0.01 for k in range(91)], score="p")
        pick = E.threshold_by_floor(sw).first()
        if best is None or pick.score > best[2]:
            best = (name, pick.threshold, pick.score)
    name, thr, val_score = best
    model = fit(candidates[name], df.filter(F.col(split).isin("train", "val")))
    s = score(model, df.filter(F.col(split) == "test"))
    m = E.binary_metrics(s.withColumn("pred", (F.col("p") >= F.lit(thr)).cast("int")))
    return m.withColumn("model", F.lit(name)).withColumn("threshold", F.lit(thr)) \
        .withColumn("val_score", F.lit(val_score))


def ablation(df: DataFrame, buckets: dict[str, Sequence[str]], make=logistic) -> DataFrame:
    """Test metrics with all features and with each bucket left out."""
    full = [c for cols in buckets.values() for c in cols]
    sets = {"all": full, **{f"without_{b}": [c for c in full if c not in cols]
                            for b, cols in buckets.items()}}
    out = None
    for name, cols in sets.items():
        if cols:
            m = select_refit_test(df, {name: make(cols)})
            out = m if out is None else out.unionByName(m)
    return out


def grid_search(df: DataFrame, cols: Sequence[str], depths=(3, 4, 5), leaves=(10, 20, 40),
                rates=(0.03, 0.05, 0.08), rounds=(300, 500), split: str = "split") -> DataFrame:
    """Validation score of every boosted-tree setting, best first."""
    train, val = (df.filter(F.col(split) == x) for x in ("train", "val"))
    spark, rows = df.sparkSession, []
    for d in depths:
        for leaf in leaves:
            for r in rates:
                for n in rounds:
                    s = score(fit(boosted(cols, d, r, n, leaf), train), val)
                    p = E.threshold_f1_or_precision(E.sweep(s, E.grid(0.30, 0.85, 0.01), score="p")).first()
                    rows.append((d, leaf, r, n, float(p.score), float(p.threshold)))
    return spark.createDataFrame(rows, "depth int, leaf int, rate double, rounds int, score double, "
                                       "threshold double").orderBy(F.col("score").desc())


def permutation_importance(model, df: DataFrame, cols: Sequence[str], repeats: int = 10,
                           threshold: float = 0.5) -> DataFrame:
    """F1 lost when one column is permuted.

    A column is permuted by a join of the rows in key order with the rows in hashed order, both
    numbered by a distributed sort.
    """
    base = df.withColumn("_row", F.monotonically_increasing_id())
    base = cut(base)

    def f1(d):
        s = score(model, d).withColumn("pred", (F.col("p") >= threshold).cast("int"))
        return E.binary_metrics(s).first().f1
    start, rows = f1(base.drop("_row")), []
    from orbweave.functions import ordered
    one = base.withColumn("_k", F.lit(0))
    here = ordered.row_number(one, ["_k"], ["_row"], F.shiftright("_row", 33), "_n")
    for c in cols:
        lost = []
        for rep in range(repeats):
            h = F.xxhash64(F.lit(rep), "_row")
            there = ordered.row_number(one.select("_k", "_row", c).withColumn("_h", h), ["_k"], ["_h", "_row"],
                                       F.shiftright("_h", 52), "_n")
            d = here.drop(c).join(there.select("_n", c), "_n")
            lost.append(start - f1(d.select(*df.columns)))
        rows.append((c, float(sum(lost) / len(lost))))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double") \
        .orderBy(F.col("importance").desc())


def head_to_head(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Metrics of two variants side by side (label, pred on each side)."""
    u = a.select("label", "pred").withColumn("variant", F.lit(names[0])).unionByName(
        b.select("label", "pred").withColumn("variant", F.lit(names[1])))
    m = E.binary_metrics(u, ["variant"])
    cols = ("n", "accuracy", "precision", "recall", "f1")
    return m.agg(*[F.max(F.when(F.col("variant") == v, F.col(c))).alias(f"{v}_{c}")
                   for v in names for c in cols])


def coefficients(model, cols: Sequence[str], spark, top: int = 20) -> DataFrame:
    """Largest standardised coefficients or tree importances."""
    m = model.stages[-1]
    w = m.coefficients if hasattr(m, "coefficients") else m.featureImportances
    rows = [(c, float(v)) for c, v in zip(cols, w.toArray())]
    return spark.createDataFrame(rows, "feature string, weight double") \
        .orderBy(F.abs("weight").desc(), "feature").limit(top)
