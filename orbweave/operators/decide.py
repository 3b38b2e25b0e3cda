"""Merging decisions of several systems and applying policies, as column expressions and joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from orbweave.functions import fixed as K, labels as L
from orbweave.functions.skew import maybe_broadcast


def c(name) -> Column:
    return F.col(name) if isinstance(name, str) else name


def decided(v) -> Column:
    return c(v).isNotNull() & (c(v) != "") & ~c(v).startswith("UNDECIDED")


def hires_first(hires, first) -> list[Column]:
    """Second-pass verdict if decided, else first pass if decided, else undecided; with layer."""
    h, l1 = c(hires), c(first)
    rest = F.coalesce(F.nullif(h, F.lit("")), F.nullif(l1, F.lit("")), F.lit("UNDECIDED"))
    return [F.when(decided(h), h).when(decided(l1), l1).otherwise(rest).alias("verdict"),
            F.when(decided(h), "hires").when(decided(l1), "L1").otherwise("und").alias("layer")]


def ensemble_pair(a, b, a_name: str = "a", b_name: str = "b") -> list[Column]:
    """Two variants: shared verdict, the other one when one is undecided, undecided on conflict."""
    ka, kb = L.verdict_class(a), L.verdict_class(b)
    both = (ka == "UND") & (kb == "UND")
    v = (F.when(both, F.coalesce(F.nullif(c(a), F.lit("")), c(b))).when(ka == "UND", c(b))
         .when(kb == "UND", c(a)).when(ka == kb, c(a)).otherwise(f"UNDECIDED ({a_name}-{b_name} disagree)"))
    s = (F.when(both, "both-und").when(ka == "UND", f"filled-by-{b_name}")
         .when(kb == "UND", f"filled-by-{a_name}").when(ka == kb, "agree").otherwise("disagree"))
    return [v.alias("verdict"), s.alias("source")]


def _strong_fill(fr: Column, nr: Column) -> Column:
    """Verdict of a strong camera that the other camera does not strongly contradict."""
    return (F.when((fr == "MAKE") & (nr != "MISS"), "MAKE")
            .when((nr == "MAKE") & (fr != "MISS"), "MAKE")
            .when((fr == "MISS") & (nr != "MAKE"), "MISS")
            .when((nr == "MISS") & (fr != "MAKE"), "MISS"))


def three_way_vote(tri, far, near) -> list[Column]:
    """Trajectory verdict adjusted by two single cameras.

    Undecided takes a strong fill; decided flips only on two strong contradictions; a weak miss
    yields to a strong far-camera make.
    """
    t, f, n = c(tri), c(far), c(near)
    und, make, miss = (t.startswith(p) for p in ("UNDECIDED", "MAKE", "MISS"))
    weak = miss & (t.contains("no clear make signal") | t.contains("(CLEAN: "))
    fill = _strong_fill(f, n)
    v = (F.when(und, F.coalesce(fill, F.lit("UNDECIDED")))
         .when(make & (f == "MISS") & (n == "MISS"), "MISS")
         .when(miss & (f == "MAKE") & (n == "MAKE"), "MAKE")
         .when(weak & (f == "MAKE"), "MAKE").otherwise(t))
    r = (F.when(und & fill.isNotNull(), "fill").when(und, "und-kept")
         .when(make & (f == "MISS") & (n == "MISS"), "flip")
         .when(miss & (f == "MAKE") & (n == "MAKE"), "flip")
         .when(weak & (f == "MAKE"), "weak-miss").otherwise("kept"))
    return [v.alias("final"), r.alias("reason")]


def revote_changes(rows: DataFrame, keep: Sequence[str], cls: str, before: str, tri: str, far: str, near: str) -> DataFrame:
    """Rows whose outcome a new three-way vote on the cached signals changes.

    ``before`` holds the outcome (TP, TN, FP, FN or UND) of the last run; returns ``keep``, old_cat, new_cat, the new
    verdict and its reason.
    """
    # a generated row is computed once, however often the outcome and the filter name its columns
    voted = rows.select("*", F.inline(F.array(F.struct(*three_way_vote(tri, far, near)))))
    return voted.select(*keep, F.col(before).alias("old_cat"), L.outcome(cls, "final").alias("new_cat"), "final", "reason") \
        .filter(~F.col("old_cat").eqNullSafe(F.col("new_cat")))


def tiered_merge(first: DataFrame, key: str, rerun: DataFrame, cameras: DataFrame,
                 hires: DataFrame, attempts: DataFrame) -> DataFrame:
    """Layered merge with a label of the layer that decided.

    L1 first pass; L2 confident rerun of undecided rows; L3 strong camera fill of still undecided
    rows; L4 replacement verdicts from an input list; L5 first of several attempts.
    Inputs: rerun(key, rerun), cameras(key, fr, nr), hires(key, hires),
    attempts(key, n_attempts, first_attempt).
    """
    j = first
    for side in (rerun, cameras, hires, attempts):
        j = j.join(side, key, "left")
    return layers(j, [x for x in first.columns if x != "verdict"])


def layers(j: DataFrame, keep: Sequence[str]) -> DataFrame:
    """:func:`tiered_merge` of rows that hold all systems' columns: verdict, rerun, fr, nr, hires, n_attempts and
    first_attempt, null where a system has none.  Returns ``keep``, the verdict and its layer; no row meets another."""
    # every test is on input columns, so the expression stays small; a confident rerun is decided
    und = F.col("verdict").startswith("UNDECIDED")
    fill = _strong_fill(F.col("fr"), F.col("nr"))
    j = j.withColumn("_l2", und & F.coalesce(L.rerun_is_confident("rerun"), F.lit(False)))
    j = j.withColumn("_l3", und & ~F.col("_l2") & fill.isNotNull())
    x3 = (F.when(F.col("_l2"), F.col("rerun"))
          .when(F.col("_l3"), F.concat(fill, F.lit(" (ENSEMBLE)"))).otherwise(F.col("verdict")))
    l4 = F.coalesce(F.col("hires") != x3, F.lit(False))
    x4 = F.when(l4, F.col("hires")).otherwise(x3)
    l5 = F.coalesce((F.col("n_attempts") >= 2) & decided("first_attempt")
                    & (F.col("first_attempt") != x4), F.lit(False))
    v = F.when(l5, F.concat(F.col("first_attempt"), F.lit("  [MULTI-SHOT: 1st attempt]"))) \
        .otherwise(x4)
    layer = (F.when(l5, "L5-multishot").when(l4, "L4-hires").when(F.col("_l3"), "L3-ensemble")
             .when(F.col("_l2"), "L2-und-rerun").otherwise("tri"))
    return j.select(*keep, v.alias("verdict"), layer.alias("layer"))


def promote_only(first: DataFrame, key: str, rerun: DataFrame, cameras: DataFrame) -> DataFrame:
    """Layers 1-3 only: undecided rows may be promoted, decided rows never change."""
    none = first.select(key).limit(0)
    return tiered_merge(first, key, rerun, cameras,
                        none.withColumn("hires", F.lit(None).cast("string")),
                        none.withColumn("n_attempts", F.lit(None).cast("int"))
                        .withColumn("first_attempt", F.lit(None).cast("string")))


def first_decided(candidates: DataFrame, keys: Sequence[str], priority: str = "priority",
                  verdict: str = "verdict") -> DataFrame:
    """Verdict of the highest-priority source that decided; undecided when none did."""
    g = candidates.groupBy(*keys).agg(
        F.min_by(F.struct(verdict, priority), F.when(decided(verdict), F.col(priority))).alias("b"))
    return g.select(*keys, F.coalesce(F.col(f"b.{verdict}"), F.lit("UNDECIDED")).alias(verdict),
                    F.col(f"b.{priority}").alias("source"))


def first_decided_of(candidates: Sequence[tuple[int, Column]], verdict: str = "verdict") -> list[Column]:
    """:func:`first_decided` of candidates (priority, verdict) that stand in one row, as columns."""
    picks = [F.when(decided(v), F.struct(v.alias("v"), F.lit(p).alias("p"))) for p, v in sorted(candidates, key=lambda x: x[0])]
    best = F.coalesce(*picks)
    return [F.coalesce(best["v"], F.lit("UNDECIDED")).alias(verdict), best["p"].alias("source")]


def veto(make, prob, verdict, gate: float = 0.99) -> Column:
    """Frozen policy: misses stay, near-certain makes stay, confident trajectory misses veto."""
    confident = F.lit(False)
    for p in K.CONFIDENT_MISS_PREFIXES:
        confident = confident | c(verdict).startswith(p)
    return (F.when(~c(make), F.lit(False)).when(c(prob) >= gate, F.lit(True))
            .when(F.coalesce(confident, F.lit(False)), F.lit(False)).otherwise(F.lit(True)))


def blends(a="prob", b="prob2", weight: float = 0.6) -> list[Column]:
    """Mean, more-confident, gate-when-unsure, geometric mean and weighted blends of two scores."""
    x, y = c(a), c(b)

    def floor(e):
        return F.greatest(F.lit(1e-4), F.least(F.lit(1.0), e))
    half = F.lit(0.5)
    return [((x + y) / 2.0).alias("mean_blend"),
            F.when(F.abs(x - half) >= F.abs(y - half), x).otherwise(y).alias("max_confidence"),
            F.when(F.abs(x - half) < 0.2, y).otherwise(x).alias("gate_unsure"),
            F.sqrt(floor(x) * floor(y)).alias("geometric"),
            (F.lit(weight) * x + F.lit(1.0 - weight) * y).alias("weighted")]


def band_gate(lo: float, hi: float, t_main: float, t_other: float, a="prob", b="prob2") -> Column:
    """Inside [lo, hi] of the main score the other score decides."""
    return F.when((c(a) >= lo) & (c(a) <= hi), (c(b) >= t_other).cast("int")) \
        .otherwise((c(a) >= t_main).cast("int"))


def ratio_flip(pred, ratio, cut: float) -> Column:
    """Make becomes miss when the size ratio at the crossing is below ``cut``."""
    return F.when((c(pred) == 1) & F.coalesce(c(ratio) < cut, F.lit(False)), 0).otherwise(c(pred))


def apply_corrections(rows: DataFrame, corrections: DataFrame, key: str, label: str) -> DataFrame:
    """Replace labels by an override table where it has the key."""
    fix = corrections.select(key, F.col("corrected").alias("_fix"))
    j = rows.join(maybe_broadcast(fix), key, "left")
    return j.select(*[F.coalesce(F.col("_fix"), F.col(label)).alias(label) if x == label else F.col(x)
                      for x in rows.columns], F.col("_fix").isNotNull().alias("was_corrected"))


def gate_search(df: DataFrame, los: Sequence[float], his: Sequence[float], t_main: float,
                t_other: float, label: str = "label", a: str = "prob", b: str = "prob2") -> DataFrame:
    """Accuracy of the band gate for every (lo, hi) pair.

    Rows are counted once by how many borders they have passed, which leaves at most one row per step of the main score;
    each pair then takes the counts inside its band.  A missing score is never right, and never inside a band.
    """
    def right(score, t):
        return F.coalesce(F.sum(((c(score) >= t).cast("int") == c(label)).cast("long")), F.lit(0))

    def passed(op, borders):
        return F.coalesce(sum((op(c(a), F.lit(v)).cast("int") for v in borders), F.lit(0)), F.lit(0))
    steps = df.groupBy(passed(lambda x, v: x >= v, los).alias("i"), passed(lambda x, v: x > v, his).alias("j")).agg(
        F.count(F.lit(1)).alias("n"), right(a, t_main).alias("main"), right(b, t_other).alias("other"))
    one = steps.agg(F.sum("n").alias("n"), F.sum("main").alias("main"), F.collect_list(
        F.struct("i", "j", (F.col("other") - F.col("main")).alias("gain"))).alias("steps"))
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(m).alias("m"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
                                for k, lo in enumerate(sorted(los)) for m, hi in enumerate(sorted(his))]))
    gain = F.expr("aggregate(filter(steps, s -> s.i > p.k AND s.j <= p.m), 0L, (x, s) -> x + s.gain)")
    return one.select("n", "main", "steps", pairs.alias("p")).select(
        "p.lo", "p.hi", F.coalesce("n", F.lit(0)).alias("n"), ((F.col("main") + gain) / F.col("n")).alias("accuracy"))


def flip_search(df: DataFrame, pred: str, ratio: str, cuts: Sequence[float], label: str = "label") -> DataFrame:
    """Accuracy, good and bad flips of the ratio flip for every cut, and which cut is best (the first of equal ones).

    Makes are counted once by how many cuts their ratio has passed; a cut flips those that have not passed it.  A missing
    ratio never flips, a missing prediction or label is never right.
    """
    order = sorted(cuts)
    level = F.when(c(pred) == 1, sum((c(ratio) >= F.lit(v)).cast("int") for v in order))
    levels = df.groupBy(level.alias("level")).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((c(pred) == c(label)).cast("long")), F.lit(0)).alias("right"),
        *[F.coalesce(F.sum((c(label) == v).cast("long")), F.lit(0)).alias(f"l{v}") for v in (0, 1)])
    one = levels.agg(F.sum("n").alias("n"), F.sum("right").alias("right"), F.collect_list(F.struct("level", "l0", "l1")).alias("levels"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("cut")) for k, v in enumerate(order)]))

    def flipped(side):
        return F.expr(f"aggregate(filter(levels, s -> s.level <= p.k), 0L, (x, s) -> x + s.l{side})")
    out = one.select("n", "right", "levels", each.alias("p")).select(
        "p.cut", "n", "right", flipped(0).alias("flipped_good"), flipped(1).alias("flipped_bad"))
    out = out.withColumn("accuracy", (F.col("right") + F.col("flipped_good") - F.col("flipped_bad")) / F.col("n"))
    best = out.agg(F.max_by("cut", F.struct("accuracy", -F.col("cut"))).alias("best"))
    return out.join(F.broadcast(best), out.cut == best.best, "left").select(
        "cut", F.coalesce("n", F.lit(0)).alias("n"), "accuracy", "flipped_good", "flipped_bad", F.col("best").isNotNull().alias("is_best"))


def gate_effect(df: DataFrame, pred: str, ratio: str, cut: float, label: str = "label") -> DataFrame:
    """Accuracy before and after the ratio flip, with good and bad flips."""
    g = df.withColumn("_g", ratio_flip(pred, ratio, cut))
    flipped = F.col("_g") != F.col(pred)
    return g.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col(pred) == F.col(label)).cast("double")).alias("base_acc"),
        F.avg((F.col("_g") == F.col(label)).cast("double")).alias("gated_acc"),
        F.sum((flipped & (F.col(label) == 0)).cast("long")).alias("flipped_good"),
        F.sum((flipped & (F.col(label) == 1)).cast("long")).alias("flipped_bad"))
