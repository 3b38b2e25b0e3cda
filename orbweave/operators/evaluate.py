"""Scoring of decisions: outcome tallies, binary metrics, AUC, sweeps, thresholds, audits."""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from orbweave.functions import labels as L
from orbweave.functions.quantiles import medians, percentiles


def count_if(cond: Column) -> Column:
    return F.sum(F.coalesce(cond, F.lit(False)).cast("long"))


def ratio(num: Column, den: Column, empty: float = 0.0) -> Column:
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(empty))


def confusion(label="label", pred="pred", prefix: str = "") -> list[Column]:
    y, p = F.col(label), F.col(pred)
    return [F.count(F.lit(1)).alias(f"{prefix}n"),
            count_if((y == 1) & (p == 1)).alias(f"{prefix}tp"),
            count_if((y == 0) & (p == 0)).alias(f"{prefix}tn"),
            count_if((y == 0) & (p == 1)).alias(f"{prefix}fp"),
            count_if((y == 1) & (p == 0)).alias(f"{prefix}fn")]


def rates(df: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 from n/tp/tn/fp/fn; 0 where undefined."""
    tp, tn, fp, fn, n = (F.col(c) for c in ("tp", "tn", "fp", "fn", "n"))
    return df.select("*", ratio(tp + tn, n).alias("accuracy"),
                     ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
                     ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def binary_metrics(df: DataFrame, groups: Sequence[str] = (), label="label",
                   pred="pred") -> DataFrame:
    return rates(df.groupBy(*groups).agg(*confusion(label, pred)))


def metrics_by_group(df: DataFrame, group: str = "game_id", label="label", pred="pred",
                     name: str = "game") -> DataFrame:
    """One row per group plus an ALL row, from a single rollup."""
    g = df.rollup(group).agg(*confusion(label, pred),
                             F.grouping(group).alias("_all"))
    return rates(g.withColumn(name, F.when(F.col("_all") == 1, "ALL")
                              .otherwise(F.col(group).cast("string"))).drop("_all", group))


def tally(df: DataFrame, cls: str = "gt", verdict: str = "verdict") -> DataFrame:
    """Outcome counts per class and in total, with decided and overall accuracy in percent."""
    cat = df.withColumn("_cat", L.outcome(cls, verdict))
    g = cat.rollup(cls).agg(
        *[count_if(F.col("_cat") == c).alias(c.lower()) for c in ("TP", "TN", "FP", "FN", "UND")],
        F.grouping(cls).alias("_all"))
    dec = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    right = 100.0 * (F.col("tp") + F.col("tn"))
    return (g.withColumn("cls", F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col(cls)))
            .select("cls", "tp", "tn", "fp", "fn", "und", (dec + F.col("und")).alias("n"),
                    ratio(right, dec).alias("decided_acc"),
                    ratio(right, dec + F.col("und")).alias("overall_acc")))


def auc(df: DataFrame, groups: Sequence[str] = (), score="prob", label="label") -> DataFrame:
    """ROC-AUC with average ranks on ties, 0.5 when a class is absent.

    Rows are first reduced to counts per distinct score.  The running negative count over the
    scores is taken in two levels (score buckets, then scores inside a bucket), so no task holds
    all scores of one group.
    """
    g = list(groups)
    per = (df.filter(F.col(score).isNotNull())
           .groupBy(*g, F.col(score).cast("double").alias("_s"))
           .agg(count_if(F.col(label) == 1).alias("_p"), count_if(F.col(label) == 0).alias("_q")))
    lows = per.groupBy(*g).agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi"),
                               F.sum("_p").alias("n_pos"), F.sum("_q").alias("n_neg"))
    from orbweave.functions.skew import attach
    keyed = per.withColumn("_one", F.lit(1))
    lows = lows.withColumn("_one", F.lit(1))
    gk = [*g, "_one"]
    span = F.col("_hi") - F.col("_lo")
    placed = attach(keyed, lows, gk, ["_s"], "inner").withColumn("_k", F.when(
        span > 0, F.floor((F.col("_s") - F.col("_lo")) / span * 4096)).otherwise(0).cast("int"))
    hist = placed.groupBy(*gk, "_k").agg(F.sum("_q").alias("_qb"))
    before = Window.partitionBy(*gk).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.select(*gk, "_k", F.coalesce(F.sum("_qb").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*gk, "_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("_q").over(inside), F.lit(0)) + F.col("_off")
    won = placed.join(hist, [*gk, "_k"]).withColumn(
        "_won", F.col("_p") * (below + F.col("_q") * F.lit(0.5)))
    out = won.groupBy(*g).agg(F.sum("_won").alias("_w"), F.sum("_p").alias("n_pos"),
                              F.sum("_q").alias("n_neg"))
    return out.select(*g, "n_pos", "n_neg", F.when(
        (F.col("n_pos") == 0) | (F.col("n_neg") == 0), F.lit(0.5)).otherwise(
        F.col("_w") / (F.col("n_pos").cast("double") * F.col("n_neg"))).alias("auc"))


# ---- threshold sweeps ------------------------------------------------------------
def grid(start: float, stop: float, step: float) -> list[float]:
    """start + i*step below stop, computed the way numpy's arange does."""
    delta = (start + step) - start
    n = math.ceil((stop - start) / step)
    return [start + i * delta for i in range(n)]


def passed(score: Column, thresholds: Sequence[float]) -> Column:
    """How many of the ascending thresholds are <= score; null for a null score, which passes none."""
    ts = F.array(*[F.lit(float(t)) for t in thresholds])
    return F.when(score.isNotNull(), F.size(F.filter(ts, lambda t: t <= score)))


def sweep(df: DataFrame, thresholds: Sequence[float], groups: Sequence[str] = (), score="prob",
          label="label") -> DataFrame:
    """Confusion and rates per group and threshold (score >= threshold predicts 1).

    Rows are reduced to counts per (group, number of thresholds passed) - at most T+1 per group -
    and the thresholds are applied to those counts.
    """
    g = list(groups)
    h = df.groupBy(*g, passed(F.col(score), thresholds).alias("k")).agg(
        count_if(F.col(label) == 1).alias("p"), count_if(F.col(label) == 0).alias("q"))
    h = h.groupBy(*g).agg(F.collect_list(F.struct("k", "p", "q")).alias("h"),
                          F.sum("p").alias("_p"), F.sum("q").alias("_q"))
    ts = F.array(*[F.lit(float(t)) for t in thresholds])
    x = h.select("*", F.posexplode(ts).alias("i", "threshold"))

    def above(field):
        return F.aggregate(F.filter("h", lambda s: F.coalesce(s["k"] > F.col("i"), F.lit(False))), F.lit(0).cast("long"),
                           lambda acc, s: acc + s[field])
    x = x.select(*g, "i", "threshold", above("p").alias("tp"), above("q").alias("fp"), "_p", "_q")
    return rates(x.select(*g, "i", "threshold", (F.col("_p") + F.col("_q")).alias("n"), "tp",
                          (F.col("_q") - F.col("fp")).alias("tn"), "fp",
                          (F.col("_p") - F.col("tp")).alias("fn")))


def _pick(s: DataFrame, groups, value: Column, ok: Column) -> DataFrame:
    order = F.when(ok, F.struct(value.alias("v"), (-F.col("i")).alias("i")))
    return s.groupBy(*groups).agg(F.max_by(F.struct("threshold", value.alias("score")), order)
                                  .alias("b"))


def threshold_by_floor(s: DataFrame, groups: Sequence[str] = (), floor: float = 0.85,
                       min_recall: float = 0.5, beta: float = 0.5) -> DataFrame:
    """Best F1 among thresholds above a precision floor, else best F-beta; lowest on ties."""
    b2 = beta * beta
    p, r = F.col("precision"), F.col("recall")
    fb = ratio((1 + b2) * p * r, b2 * p + r)
    order = F.struct(F.col("f1").alias("v"), (-F.col("i")).alias("i"))
    clears = (p >= floor) & (r >= min_recall)
    g = s.withColumn("_fb", fb).groupBy(*groups).agg(
        F.max_by(F.struct("threshold", F.col("f1").alias("score")), F.when(clears, order)).alias("a"),
        F.max_by(F.struct("threshold", F.col("_fb").alias("score")),
                 F.struct("_fb", -F.col("i"))).alias("b"))
    best = F.coalesce(F.col("a"), F.col("b"))
    return g.select(*groups, best["threshold"].alias("threshold"), best["score"].alias("score"))


def threshold_f1_or_precision(s: DataFrame, groups: Sequence[str] = (),
                              floor: float = 0.85) -> DataFrame:
    """F1 above a precision floor, precision itself below it; thresholds predicting none skipped."""
    val = F.when(F.col("precision") < floor, F.col("precision")).otherwise(F.col("f1"))
    g = _pick(s, groups, val, F.col("tp") + F.col("fp") > 0)
    return g.select(*groups, F.coalesce("b.threshold", F.lit(0.5)).alias("threshold"),
                    F.coalesce("b.score", F.lit(-1.0)).alias("score"))


def threshold_by_shortfall(s: DataFrame, groups: Sequence[str] = (), target: float = 0.90) -> DataFrame:
    """Smallest summed shortfall of precision and recall below the target."""
    loss = (F.greatest(F.lit(target) - F.col("precision"), F.lit(0.0))
            + F.greatest(F.lit(target) - F.col("recall"), F.lit(0.0)))
    g = _pick(s, groups, -F.round(loss, 12), F.col("tp") + F.col("fp") > 0)
    return g.select(*groups, F.coalesce("b.threshold", F.lit(0.5)).alias("threshold"),
                    (-F.col("b.score")).alias("loss"))


def threshold_by_accuracy(s: DataFrame, groups: Sequence[str] = (),
                          toward_half: bool = False) -> DataFrame:
    """Highest accuracy; lowest threshold on ties, or the one nearest 0.5 on 4-digit accuracy."""
    acc = F.round("accuracy", 4) if toward_half else F.col("accuracy")
    near = -F.abs(F.col("threshold") - 0.5) if toward_half else F.lit(0.0)
    order = F.struct(acc.alias("v"), near.alias("n"), (-F.col("i")).alias("i"))
    g = s.groupBy(*groups).agg(F.max_by(F.struct("threshold", acc.alias("accuracy")), order).alias("b"))
    return g.select(*groups, "b.threshold", "b.accuracy")


def radius_sweep(df: DataFrame, thresholds: Sequence[float], cls: str = "gt", radius: str = "r_cm",
                 base: str = "base", groups: Sequence[str] = ()) -> DataFrame:
    """Outcome tally per make-radius threshold: a crossing inside the radius is a make.

    Rows without a crossing radius keep their base verdict class.  Aggregates rows to a few
    counts per class before the thresholds are applied.
    """
    g = list(groups)
    k = F.when(F.col(radius).isNotNull(), passed(F.col(radius), thresholds))
    small = df.groupBy(*g, cls, base, k.alias("k")).agg(F.count(F.lit(1)).alias("c"))
    x = small.select("*", F.posexplode(F.array(*[F.lit(float(t)) for t in thresholds]))
                     .alias("i", "threshold"))
    says = F.when(F.col("k").isNull(), F.col(base)).when(F.col("k") <= F.col("i"), "MAKE") \
        .otherwise("MISS")
    text = F.when(says == "UND", "UNDECIDED").otherwise(says)
    x = x.withColumn("_cat", L.outcome(F.col(cls), text))
    t = x.groupBy(*g, "threshold").agg(*[
        F.sum(F.when(F.col("_cat") == c, F.col("c")).otherwise(0)).alias(c.lower())
        for c in ("TP", "TN", "FP", "FN", "UND")])
    dec = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    right = 100.0 * (F.col("tp") + F.col("tn"))
    return t.select("*", ratio(right, dec).alias("decided_acc"),
                    ratio(right, dec + F.col("und")).alias("overall_acc"))


def best_radius(s: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Threshold with the best decided and the best overall accuracy, first on ties."""
    def top(c):
        return F.max_by("threshold", F.struct(c, -F.col("threshold")))
    return s.groupBy(*groups).agg(top("decided_acc").alias("best_decided"),
                                  F.max("decided_acc").alias("decided_acc"),
                                  top("overall_acc").alias("best_overall"),
                                  F.max("overall_acc").alias("overall_acc"))


# ---- comparisons and audits ---------------------------------------------------------
GOOD, BAD = ("TP", "TN"), ("FP", "FN")


def flips(df: DataFrame, old: str, new: str) -> DataFrame:
    """Outcome changes between two variants: improved, regressed or neutral, counted."""
    n = df.groupBy(F.col(old).alias("old_cat"), F.col(new).alias("new_cat")).agg(
        F.count(F.lit(1)).alias("n")).filter(F.col("old_cat") != F.col("new_cat"))
    kind = (F.when(F.col("old_cat").isin("FP", "FN", "UND") & F.col("new_cat").isin(*GOOD), "improved")
            .when(F.col("old_cat").isin(*GOOD) & F.col("new_cat").isin(*BAD), "regressed")
            .otherwise("neutral"))
    return n.select("old_cat", "new_cat", kind.alias("kind"), "n")


def verdict_types(df: DataFrame, verdict: str = "verdict", cat: str = "cat", of: str = "FN") -> DataFrame:
    """How often each kind of verdict occurs among the rows of one outcome.

    The kind is what follows the first bracket, up to a colon; a text without a bracket is a kind of its own.
    """
    v = F.col(verdict)
    head = F.split_part(v, F.lit(":"), F.lit(1))
    kind = F.when(head.contains("("), F.split_part(head, F.lit("("), F.lit(2))).when(v.contains("("), head).otherwise(v)
    return df.filter(F.col(cat) == of).groupBy(F.trim(kind).alias("verdict_type")).agg(F.count(F.lit(1)).alias("n"))


def best_single_auc(df: DataFrame, families: dict[str, Sequence[str]], label: str = "label") -> DataFrame:
    """Per family of columns the one that separates the label best alone: family, feature, auc.

    An AUC below one half counts from the other side; missing values take the column's median; constant and empty
    columns are left out, ties go to the first column, and a family without a useful column has no feature and 0.5.
    All columns of all families are ranked together, as one table of (feature, value).
    """
    cols = list(dict.fromkeys(c for f in families.values() for c in f))
    long = df.select(label, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot([label], cols, "feature", "value")
    varied = long.groupBy("feature").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi")).filter("_lo < _hi")
    usual = medians(long, ["feature"], ["value"]).withColumnRenamed("value", "_mid")
    fill = F.broadcast(varied.join(usual, "feature").select("feature", "_mid"))          # one row per column
    r = long.join(fill, "feature").withColumn("value", F.coalesce("value", "_mid"))
    found = auc(r, ["feature"], "value", label).withColumn("auc", F.greatest(F.col("auc"), 1 - F.col("auc")))
    spark = df.sparkSession
    order = spark.createDataFrame([(f, c, i) for f, cs in families.items() for i, c in enumerate(cs)] or [],
                                  "family string, feature string, _at int")
    names = spark.createDataFrame([(f,) for f in families], "family string")
    best = order.join(found.filter("auc > 0.5"), "feature").groupBy("family").agg(
        F.min_by(F.struct("feature", "auc"), F.struct(-F.col("auc"), "_at")).alias("b"))
    return names.join(best, "family", "left").select("family", F.col("b.feature").alias("feature"),
                                                     F.coalesce("b.auc", F.lit(0.5)).alias("auc"))


def quantile_compare(df: DataFrame, groups: Sequence[str], cols: Sequence[str],
                     probs: Sequence[float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """p10/p50/p90 and share above zero per population; negative means missing."""
    v = df.select(*groups, *[F.when(F.col(c) >= 0, F.col(c)).alias(c) for c in cols])
    q = percentiles(v, groups, cols, probs)
    n = v.groupBy(*groups).agg(*[e for c in cols for e in (
        F.count(c).alias(f"{c}_n"), F.avg((F.col(c) > 0).cast("double")).alias(f"{c}_frac_pos"))])
    return q.join(n, list(groups))


def feature_separation(df: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """Class means and folded AUC (max of auc and 1-auc) of each single feature."""
    long = df.select(label, F.explode(F.array(*[F.struct(
        F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]))
        .alias("s")).select(label, "s.feature", "s.value").filter(F.col("value").isNotNull())
    m = long.groupBy("feature").agg(F.avg(F.when(F.col(label) == 1, F.col("value"))).alias("make_mean"),
                                    F.avg(F.when(F.col(label) == 0, F.col("value"))).alias("miss_mean"))
    a = auc(long, ["feature"], "value", label)
    return m.join(a, "feature").select("feature", "make_mean", "miss_mean",
                                       F.greatest(F.col("auc"), 1 - F.col("auc")).alias("auc"))


def quantile_veto(df: DataFrame, value: str, label="label", pred="pred",
                  probs: Sequence[float] = (0.1, 0.2, 0.3)) -> DataFrame:
    """How many false and true positives a cut below each low percentile would flip.

    The few percentile values are fitted first and enter the count as constants.
    """
    cuts = percentiles(df, [], [value], probs).first()
    fp, tp = F.col(label) == 0, F.col(label) == 1

    def counts(p, cut):
        below = F.col(value) < F.lit(cut)
        return F.struct(F.lit(float(p)).alias("p"), F.lit(cut).alias("cut"),
                        count_if(below & fp).alias("fp_flipped"), count_if(fp).alias("n_fp"),
                        count_if(below & tp).alias("tp_lost"), count_if(tp).alias("n_tp"))
    one = df.filter(F.col(pred) == 1).agg(F.array(*[
        counts(p, cuts[f"{value}_p{round(p * 100):02d}"]) for p in probs]).alias("a"))
    return one.select(F.explode("a").alias("c")).select("c.*")


def winsor_bounds(train: DataFrame, cols: Sequence[str], p: float = 0.01) -> DataFrame:
    """[p, 1-p] percentile band of each column, one row."""
    return percentiles(train, [], cols, (p, 1 - p))


def winsorise(df: DataFrame, bounds: DataFrame, cols: Sequence[str], p: float = 0.01) -> DataFrame:
    """Clip columns to a fitted one-row band, whose values become constants of the plan."""
    b = bounds.first()
    lo, hi = f"p{round(p * 100):02d}", f"p{round((1 - p) * 100):02d}"
    return df.withColumns({c: F.least(F.greatest(F.col(c).cast("double"), F.lit(b[f"{c}_{lo}"])),
                                      F.lit(b[f"{c}_{hi}"])) for c in cols})


def residual_strata(errors: DataFrame, min_dist: Column, conf: Column, quality: Column) -> DataFrame:
    """Evidence class of each error and whether it is out of reach of the model."""
    stratum = (F.when((min_dist > 1.5) | (conf < 0.30), "occlusion_fundamental")
               .when(quality < 0.45, "weak_evidence").otherwise("ball_clearly_at_rim"))
    return errors.groupBy(stratum.alias("stratum")).agg(
        F.count(F.lit(1)).alias("n"), count_if((quality < 0.20) & (conf < 0.25)).alias("n_unfixable"),
        count_if(F.col("pred") == 1).alias("n_fp"), count_if(F.col("pred") == 0).alias("n_fn"))


def error_class(label="label", pred="pred") -> Column:
    """Named class of a wrong decision; null when the decision is right."""
    fp, fn = (F.col(label) == 0) & (F.col(pred) == 1), (F.col(label) == 1) & (F.col(pred) == 0)
    return (F.when(fp & (F.col("g_far_dmin") > 2.0) & (F.col("g_far_bdet") > 0.6)
                   & (F.col("g_near_inside") > 0.05), "depth_illusion_fp")
            .when(fp & (F.col("prob") >= 0.90), "high_confidence_fp")
            .when(fp, "rim_grazer_fp")
            .when(fn & (F.col("frac_inside_rim_max") < 0.15)
                  & (F.col("through_hoop_conf_max") > 0.5), "swish_fn")
            .when(fn, "weak_signal_fn"))


def uncertain(df: DataFrame, lo: float = 0.40, hi: float = 0.70, score="prob") -> DataFrame:
    return df.filter(F.col(score).between(lo, hi))


def game_summary(df: DataFrame, group: str = "game_id") -> DataFrame:
    """Per game: shots, accuracy, error counts and how many scores sit in the uncertain band."""
    c = df.groupBy(group).agg(*confusion(), count_if(F.col("prob").between(0.40, 0.70))
                              .alias("n_uncertain"))
    return c.select(group, F.col("n").alias("n_shots"), ratio(F.col("tp") + F.col("tn"), F.col("n"))
                    .alias("accuracy"), F.col("fp").alias("n_fp"), F.col("fn").alias("n_fn"),
                    "n_uncertain")


def abstain(df: DataFrame, margin: float, groups: Sequence[str] = ()) -> DataFrame:
    """Share of scores within ``margin`` of 0.5 and accuracy on the rest."""
    sure = F.abs(F.col("prob") - 0.5) >= margin
    right = (F.col("prob") >= 0.5).cast("int") == F.col("label")
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.avg((~sure).cast("double")).alias("abstain_rate"),
        ratio(count_if(sure & right), count_if(sure)).alias("decided_acc"))


def label_suspects(df: DataFrame, confident: float = 0.95) -> DataFrame:
    """Decisions that are both confident and wrong."""
    sure_make = (F.col("prob") >= confident) & (F.col("label") == 0)
    sure_miss = (F.col("prob") <= float(1 - Decimal(str(confident)))) & (F.col("label") == 1)   # 1 - 0.9 is below 0.1 in binary
    return df.filter(sure_make | sure_miss).withColumn(
        "confidence", F.greatest(F.col("prob"), 1 - F.col("prob")))


def agreement_zones(df: DataFrame, model: str, other: str, label: str = "label") -> DataFrame:
    """Share of real makes in each model-by-trajectory cell."""
    return df.groupBy(model, other).agg(F.count(F.lit(1)).alias("n"),
                                        F.sum(F.col(label).cast("long")).alias("makes"),
                                        F.avg(F.col(label).cast("double")).alias("make_rate"))


def oracle_bound(df: DataFrame, preds: Sequence[str], label: str = "label") -> DataFrame:
    """Accuracy if the right one of several systems were always chosen."""
    hit = F.greatest(*[(F.col(p) == F.col(label)).cast("int") for p in preds])
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(hit.cast("double")).alias("oracle_acc"),
                  *[F.avg((F.col(p) == F.col(label)).cast("double")).alias(f"{p}_acc") for p in preds])


def policy_safety(df: DataFrame, base: str, policy: str, group: str = "game_id") -> DataFrame:
    """Accuracy change of a policy per group and whether any group got worse."""
    def acc(c):
        return F.avg((F.col(c) == F.col("label")).cast("double"))
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), acc(base).alias("base_acc"),
                              acc(policy).alias("policy_acc"))
    return g.withColumn("delta", F.col("policy_acc") - F.col("base_acc")) \
        .withColumn("safe", F.col("delta") >= 0)


def ship_rule(iterations: DataFrame, it: str = "iteration") -> DataFrame:
    """Ship, plateau and overfit flags over an iteration table (one row per iteration).

    Ship: precision and recall both at the previous best row's level or above.  Plateau: three
    consecutive gains under half a point on both.  Overfit: val-test gap above 8 points twice.
    """
    w = Window.orderBy(it)   # one row per iteration: a handful of rows

    def gain(c):
        return F.col(c) - F.lag(c).over(w)
    d = iterations.select("*", gain("precision").alias("dp"), gain("recall").alias("dr"))
    flat = ((F.col("dp") < 0.005) & (F.col("dr") < 0.005)).cast("int")
    over = (F.col("val_acc") - F.col("test_acc") > 0.08).cast("int")
    d = d.withColumn("_flat", flat).withColumn("_over", over)
    return d.select(*iterations.columns,
                    F.coalesce((F.col("dp") >= 0) & (F.col("dr") >= 0), F.lit(True)).alias("ship"),
                    F.coalesce(F.sum("_flat").over(w.rowsBetween(-2, 0)) == 3, F.lit(False))
                    .alias("plateau"),
                    F.coalesce(F.sum("_over").over(w.rowsBetween(-1, 0)) == 2, F.lit(False))
                    .alias("overfit"))


def data_health(quality: DataFrame, game: str = "game_id", angle: str = "angle",
                drop: float = 0.8) -> DataFrame:
    """Mean quality per game and camera against the corpus; flags values below a share of it."""
    g = quality.groupBy(game, angle).agg(F.avg("track_quality").alias("mean_quality"),
                                         F.avg((F.col("track_quality") > 0).cast("double"))
                                         .alias("usable_share"), F.count(F.lit(1)).alias("n"))
    total = quality.groupBy(angle).agg(F.avg("track_quality").alias("corpus_quality"))
    total = F.broadcast(total)   # one row per camera
    return g.join(total, angle).withColumn(
        "degraded", F.col("mean_quality") < F.lit(drop) * F.col("corpus_quality"))


def accuracy_by_class(df: DataFrame, cls: str = "classification") -> DataFrame:
    return df.groupBy(cls).agg(F.count(F.lit(1)).alias("n"), F.avg(
        (F.col("pred") == F.col("label")).cast("double")).alias("accuracy"))


def coverage_summary(shots: DataFrame, flag_col: str) -> DataFrame:
    """Counts by label and split and the make rate with and without a flag, one row."""
    return shots.agg(
        F.count(F.lit(1)).alias("n_shots"), count_if(F.col("label") == 1).alias("n_makes"),
        count_if(F.col("label") == 0).alias("n_misses"),
        *[count_if(F.col("split") == x).alias(f"n_{x}") for x in ("train", "val", "test")],
        F.avg((F.col(flag_col) == 1).cast("double")).alias("flag_share"),
        F.avg(F.when(F.col(flag_col) == 1, F.col("label"))).alias("flag_make_rate"),
        F.avg(F.when(F.col(flag_col) != 1, F.col("label"))).alias("noflag_make_rate"))
