"""Labels, class families, camera sides and verdict-text parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from orbweave.functions import fixed as K


def c(name) -> Column:
    return F.col(name) if isinstance(name, str) else name


def label_of(cls="classification") -> Column:
    """1 for make classes, 0 for miss classes, null for anything else."""
    return (F.when(c(cls).isin(*K.MAKE_CLASSES), F.lit(1))
            .when(c(cls).isin(*K.MISS_CLASSES), F.lit(0)))


def in_scope(cls="classification") -> Column:
    return c(cls).isin(*K.SCOPE_CLASSES)


def family_of(cls="classification") -> Column:
    return F.regexp_extract(c(cls), r"^(.*)_[^_]*$", 1)


def is_make(cls="classification") -> Column:
    return c(cls).endswith("MAKE")


def side_of(angle="side") -> Column:
    return F.coalesce(c(angle), F.lit("LEFT"))


def far_camera(side) -> Column:
    return F.when(side_of(side) == "LEFT", "FL").otherwise("FR")


def near_camera(side) -> Column:
    return F.when(side_of(side) == "LEFT", "NL").otherwise("NR")


def verdict_class(v="verdict") -> Column:
    return (F.when(c(v).startswith("MAKE"), "MAKE").when(c(v).startswith("MISS"), "MISS")
            .otherwise("UND"))


def verdict_rule(v="verdict") -> Column:
    """Rule name of the first phrase found in the text; the phrase order decides."""
    return F.coalesce(*[F.when(c(v).contains(p), F.lit(r)) for p, r in K.RULE_PHRASES],
                      F.lit("other"))


def number_in(v, pattern: str) -> Column:
    """First capture of ``pattern`` as a double; null when the text has no match."""
    # an array without a match gives null at once; casting its empty text would throw and catch an error per row
    return F.try_element_at(F.regexp_extract_all(c(v), F.lit(pattern), F.lit(1)), F.lit(1)).try_cast("double")


def rerun_is_confident(v="verdict") -> Column:
    """High-confidence test of a rerun verdict before it may replace an undecided one."""
    r = number_in(v, r"passed through rim plane at r=(\d+)cm, z_min=-?\d+cm")
    z = number_in(v, r"passed through rim plane at r=\d+cm, z_min=(-?\d+)cm")
    wide = number_in(v, r"crossed rim plane at r=(\d+)cm")
    apex = number_in(v, r"apex r=(\d+)cm")
    make = c(v).startswith("MAKE") & F.coalesce((r <= 25) & (z <= 320), F.lit(False))
    miss = c(v).startswith("MISS") & (
        (c(v).contains("RIM-OUT") & c(v).contains("bounce="))
        | F.coalesce(wide >= 80, F.lit(False)) | F.coalesce(apex >= 300, F.lit(False)))
    return make | miss


def strength_of(v) -> Column:
    return F.when(c(v) == "UND", 0).when(c(v).endswith("-weak"), 1).otherwise(2)


def verdict_flags(v="verdict") -> list[Column]:
    """One-hot flags of the verdict text."""
    def has(*phrases):
        e = c(v).contains(phrases[0])
        for p in phrases[1:]:
            e = e | c(v).contains(p)
        return e.cast("int")
    return [
        c(v).startswith("MAKE").cast("int").alias("tri_make"),
        c(v).startswith("MISS").cast("int").alias("tri_miss"),
        c(v).startswith("UNDECIDED").cast("int").alias("tri_und"),
        has("RIM-OUT").alias("tri_has_rim_out"),
        has("rim-bounce").alias("tri_has_rim_bounce"),
        has("gap-stop").alias("tri_has_gap_stop"),
        has("smooth descent").alias("tri_has_smooth_descent"),
        has("passed through", "rattled in").alias("tri_has_pass_through"),
        has("CLEAN: ").alias("tri_has_clean"),
        has("no clear make signal").alias("tri_has_no_clear"),
    ]


def outcome(gt="gt", v="verdict") -> Column:
    """TP/TN/FP/FN, UND for an undecided verdict, ? for an unknown class or text."""
    make, miss = c(gt).isin(*K.MAKE_CLASSES), c(gt).isin(*K.MISS_CLASSES)
    says_make, says_miss = c(v).startswith("MAKE"), c(v).startswith("MISS")
    return (F.when(c(v).startswith("UNDECIDED"), "UND")
            .when(make & says_make, "TP").when(miss & says_miss, "TN")
            .when(miss & says_make, "FP").when(make & says_miss, "FN").otherwise("?"))
