"""Box and point geometry as column expressions; boxes are top-left + size unless named xyxy."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from orbweave.functions.fixed import COURT_BOUNDS


def c(name) -> Column:
    return F.col(name) if isinstance(name, str) else name


def center_x(p: str) -> Column:
    return c(f"{p}_x") + c(f"{p}_w") / F.lit(2.0)


def center_y(p: str) -> Column:
    return c(f"{p}_y") + c(f"{p}_h") / F.lit(2.0)


def present(p: str) -> Column:
    return (c(f"{p}_x").isNotNull() & c(f"{p}_y").isNotNull()
            & c(f"{p}_w").isNotNull() & c(f"{p}_h").isNotNull())


def xyxy_to_xywh(x1, y1, x2, y2) -> list[Column]:
    return [c(x1).alias("x"), c(y1).alias("y"),
            (c(x2) - c(x1)).alias("w"), (c(y2) - c(y1)).alias("h")]


def xywh_to_xyxy(x, y, w, h) -> list[Column]:
    return [c(x).alias("x1"), c(y).alias("y1"),
            (c(x) + c(w)).alias("x2"), (c(y) + c(h)).alias("y2")]


def offset_rw() -> Column:
    """Sideways ball offset in rim widths, from the boxes of the same row."""
    return (center_x("ball") - center_x("rim")) / c("rim_w")


def offset_rh() -> Column:
    return (center_y("ball") - center_y("rim")) / c("rim_h")


def distance(dx: Column, dy: Column) -> Column:
    """Euclidean length; sqrt of squares so every engine rounds alike."""
    return F.sqrt(dx * dx + dy * dy)


def distance_rw() -> Column:
    return distance(center_x("ball") - center_x("rim"),
                    center_y("ball") - center_y("rim")) / c("rim_w")


def in_box(x, y, x1, y1, x2, y2) -> Column:
    return (c(x) >= c(x1)) & (c(x) <= c(x2)) & (c(y) >= c(y1)) & (c(y) <= c(y2))


def ball_in_rim() -> Column:
    return in_box(center_x("ball"), center_y("ball"), "rim_x", "rim_y",
                  c("rim_x") + c("rim_w"), c("rim_y") + c("rim_h"))


def near_rim(kx: float = 1.5, ky: float = 2.0) -> Column:
    return ((F.abs(center_x("ball") - center_x("rim")) < F.lit(kx) * c("rim_w"))
            & (F.abs(center_y("ball") - center_y("rim")) < F.lit(ky) * c("rim_h")))


def over_rim(k: float = 0.6) -> Column:
    return F.abs(center_x("ball") - center_x("rim")) < F.lit(k) * c("rim_w")


def at_crossing(k: float = 0.6) -> Column:
    return over_rim(k) & (F.abs(center_y("ball") - center_y("rim")) < F.lit(k) * c("rim_h"))


def in_zone(bx: Column, by: Column, x: str, y: str, w: str, h: str,
            above: float | Column = 1.2, side: float = 0.2) -> Column:
    """Arrival zone over a reference box: a little wider, ``above`` heights up, down to its floor."""
    up = F.lit(above) if not isinstance(above, Column) else above
    return ((bx >= c(x) - F.lit(side) * c(w)) & (bx <= c(x) + c(w) + F.lit(side) * c(w))
            & (by >= c(y) - up * c(h)) & (by <= c(y) + c(h)))


def in_bounds(x="x", y="y", z="z", bounds=COURT_BOUNDS) -> Column:
    (x0, x1), (y0, y1), (z0, z1) = bounds
    return ((c(x) > x0) & (c(x) < x1) & (c(y) > y0) & (c(y) < y1) & (c(z) > z0) & (c(z) < z1))


def _region(x0: Column, x1: Column, y0: Column, y1: Column, fw: int, fh: int) -> Column:
    ix0 = F.greatest(F.lit(0), F.floor(x0).cast("int"))
    iy0 = F.greatest(F.lit(0), F.floor(y0).cast("int"))
    ix1 = F.least(F.lit(fw), F.ceil(x1).cast("int"))
    iy1 = F.least(F.lit(fh), F.ceil(y1).cast("int"))
    ok = (ix1 - ix0 >= 2) & (iy1 - iy0 >= 2)
    return F.when(ok, F.struct(ix0.alias("x"), iy0.alias("y"), (ix1 - ix0).alias("w"),
                               (iy1 - iy0).alias("h")))


def net_region(p: str = "rim", frame_w: int = 1920, frame_h: int = 1080) -> Column:
    """Region hanging below the rim: 0.6 widths each side, 1.5 heights down, clipped."""
    bottom = c(f"{p}_y") + c(f"{p}_h")
    half = F.lit(0.6) * c(f"{p}_w")
    return _region(center_x(p) - half, center_x(p) + half, bottom,
                   bottom + F.lit(1.5) * c(f"{p}_h"), frame_w, frame_h)


def crop_region(p: str = "rim", frame_w: int = 1920, frame_h: int = 1080) -> Column:
    """Region around the rim: 1.5 widths each side, 1.5 heights above, 2.5 below, clipped."""
    half = F.lit(1.5) * c(f"{p}_w")
    return _region(center_x(p) - half, center_x(p) + half,
                   c(f"{p}_y") - F.lit(1.5) * c(f"{p}_h"),
                   c(f"{p}_y") + c(f"{p}_h") + F.lit(2.5) * c(f"{p}_h"), frame_w, frame_h)


def square_crop(cx: Column, cy: Column, w: Column, frame_w: int = 1920, frame_h: int = 1080,
                scale: float = 1.6) -> Column:
    """Square of side scale*w, biased upwards, pushed inside the frame."""
    side = (F.lit(scale) * w).cast("int")
    x1 = F.least(F.greatest(cx - side / F.lit(2.0), F.lit(0.0)),
                 (F.lit(frame_w) - side).cast("double")).cast("int")
    y1 = F.least(F.greatest(cy - side * F.lit(0.55), F.lit(0.0)),
                 F.greatest(F.lit(0.0), (F.lit(frame_h) - side).cast("double"))).cast("int")
    return F.struct(x1.alias("x"), y1.alias("y"),
                    F.least(side, F.lit(frame_w) - x1, F.lit(frame_h) - y1).alias("side"))


def buffered_window(start="start_timestamp", end="end_timestamp", buffer: float = 2.0):
    return [F.greatest(F.lit(0.0), c(start) - F.lit(buffer)).alias("win_start"),
            (c(end) + F.lit(buffer)).alias("win_end")]


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two xyxy boxes given as lists of four columns."""
    iw = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    ih = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    inter = iw * ih
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))
