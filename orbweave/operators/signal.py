"""Operators over signal arrays: frame energy, anchors, audio windows, cross-correlation lags."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from orbweave.functions import fixed as K, ordered
from orbweave.operators.temporal import densest


def mean_abs_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two equally long arrays."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))),
                        F.lit(0.0), lambda acc, v: acc + v)
    return total / F.size(a)


def frame_energy(frames: DataFrame, keys: Sequence[str], pos: str, pixels: str) -> DataFrame:
    """Energy against the previous frame; 0 for the first frame and after a missing one."""
    n = ordered.neighbours(frames, keys, [pos], [pos, pixels], ordered.frame_bucket(pos), "_p", None)
    follows = F.col(f"_p.{pos}") == F.col(pos) - 1
    e = F.when(follows, mean_abs_difference(F.col(pixels), F.col(f"_p.{pixels}"))).otherwise(0.0)
    return n.select(*keys, pos, e.alias("energy"))


def region_variance(frames: DataFrame, keys: Sequence[str], pixels: str) -> DataFrame:
    """Population variance of the per-frame means."""
    mean = F.aggregate(pixels, F.lit(0.0), lambda acc, v: acc + v.cast("double")) / F.size(pixels)
    return frames.select(*keys, mean.alias("m")).groupBy(*keys).agg(F.var_pop("m").alias("roi_var"))


def motion_anchor(energy: DataFrame, keys: Sequence[str], pos: str, fps: float = K.FPS,
                  before: float = 0.7, after: float = 1.4) -> DataFrame:
    """Frame of peak energy and the frame range kept around it (end exclusive)."""
    g = energy.groupBy(*keys).agg(
        F.max_by(F.struct(pos, "energy"), F.struct("energy", -F.col(pos))).alias("a"),
        (F.max(pos) + 1).alias("n"))
    lo, hi = int(before * fps), int(after * fps)
    return g.select(*keys, F.col(f"a.{pos}").alias("anchor"), F.col("a.energy").alias("peak_energy"),
                    F.greatest(F.col(f"a.{pos}") - lo, F.lit(0)).alias("lo"),
                    F.least(F.col(f"a.{pos}") + hi, F.col("n")).alias("hi"))


def anchored_slice(rows: DataFrame, wave: str, event_t: str, rate: int, before: float = 0.5,
                   after: float = 1.5) -> DataFrame:
    """Window of the waveform around an event, with a reason when there is none."""
    lo = ((F.col(event_t) - before) * rate).cast("long")
    hi = ((F.col(event_t) + after) * rate).cast("long")
    why = (F.when(F.col(event_t).isNull(), "no_rim_event")
           .when((lo < 0) | (hi >= F.size(wave)), "out_of_range").otherwise("ok"))
    r = rows.withColumn("why", why)
    cut = F.slice(wave, (lo + 1).cast("int"), (hi - lo).cast("int"))
    return r.withColumn("window", F.when(F.col("why") == "ok", cut))


AUDIO = T.StructType([T.StructField(c, T.DoubleType()) for c in (
    "rms", "peak", "e_50_500", "e_500_2k", "e_2k_5k", "e_5k_8k", "centroid", "onset_peak",
    "peak_time_norm")])
# --- fixed values: audio bands in Hz ---
BANDS = ((50, 500), (500, 2000), (2000, 5000), (5000, 8000))


def audio_features(rate: int):
    """Arrow UDF: loudness, peak, four band shares, centroid, loudest hop and where it is."""
    def one(x) -> list[float]:
        if x is None or len(x) < rate // 10:
            return [float("nan")] * len(AUDIO)
        x = np.asarray(x, dtype=float)
        power = np.abs(np.fft.rfft(x * np.hanning(len(x)))) ** 2
        hz = np.fft.rfftfreq(len(x), 1.0 / rate)
        bands = [power[(hz >= lo) & (hz < hi)].sum() for lo, hi in BANDS]
        total = sum(bands) + 1e-12
        hop = rate // 50
        starts = np.arange(0, len(x) - hop, hop)
        loud = np.sqrt((x[starts[:, None] + np.arange(hop)] ** 2).mean(1))
        return [float(np.sqrt((x ** 2).mean())), float(np.abs(x).max()), *[b / total for b in bands],
                float((hz * power).sum() / (power.sum() + 1e-12)), float(loud.max()),
                float(loud.argmax() / max(1, len(loud)))]

    @F.pandas_udf(AUDIO)
    def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in it:
            yield pd.DataFrame([one(x) for x in s], columns=AUDIO.names)
    return run


# samples of one transform, so that a batch of long waveforms stays small in memory
BLOCK = 1 << 21


def _lags(a: np.ndarray, b: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Lag in samples and prominence of the correlation peak for each row of two matrices."""
    def whiten(x):
        d = np.diff(x, axis=1)
        s = d.std(axis=1, keepdims=True)
        return np.divide(d, s, out=d, where=s > 0)

    a, b = whiten(a), whiten(b)
    size = 1 << (a.shape[1] + b.shape[1] - 1).bit_length()
    lags = np.arange(-min(reach, a.shape[1] - 1), min(reach, b.shape[1] - 1) + 1)
    c = np.fft.irfft(np.fft.rfft(b, size) * np.conj(np.fft.rfft(a, size)), size)[:, lags]    # negative lags wrap
    at = c.argmax(axis=1)
    return lags[at], c[np.arange(len(c)), at] / (np.median(np.abs(c), axis=1) + 1e-9)


def lag_of(rate: int, max_lag_s: float = 1.5):
    """Arrow UDF: lag in seconds of the cross-correlation peak of two signals, and its prominence.

    Signals are differenced and scaled to unit deviation; a positive lag says that the second one hears it later.
    Pairs of equal lengths are transformed together.  A pair with a null signal, a null or non-finite sample or
    fewer than two samples has nulls.
    """
    out = T.StructType([T.StructField("lag_s", T.DoubleType()), T.StructField("peak", T.DoubleType())])

    def usable(x):
        return x is not None and len(x) > 1 and np.isfinite(np.asarray(x, dtype=float)).all()

    @F.pandas_udf(out)
    def run(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in it:
            found = np.full((len(a), 2), np.nan)
            alike: dict[tuple[int, int], list[int]] = {}
            for i, (x, y) in enumerate(zip(a, b)):
                if usable(x) and usable(y):
                    alike.setdefault((len(x), len(y)), []).append(i)
            for (n, m), rows in alike.items():
                step = max(1, BLOCK // (n + m))
                for k in range(0, len(rows), step):
                    at = rows[k:k + step]
                    lag, peak = _lags(np.stack([a.iloc[i] for i in at]).astype(float),
                                      np.stack([b.iloc[i] for i in at]).astype(float), int(max_lag_s * rate))
                    found[at, 0], found[at, 1] = lag / rate, peak
            yield pd.DataFrame(found, columns=["lag_s", "peak"]).astype(object).where(np.isfinite(found), None) \
                .astype({"lag_s": "Float64", "peak": "Float64"})
    return run


def camera_pairs(waves: DataFrame, clip: Sequence[str], angle: str, wave: str, first: str, second: str) -> DataFrame:
    """Waveforms of two cameras side by side, for the clips that both have heard: clip, a, b.

    One aggregate by clip; a clip's waveform is the longest of several of one camera.
    """
    def of(side):
        return F.max_by(F.when(F.col(angle) == side, F.col(wave)), F.when(F.col(angle) == side, F.size(wave)))
    g = waves.filter(F.col(angle).isin(first, second)).groupBy(*clip).agg(of(first).alias("a"), of(second).alias("b"))
    return g.filter("a IS NOT NULL AND b IS NOT NULL")


def true_offset(pairs: DataFrame, keys: Sequence[str], a: str, b: str, rate: int, baked: float = 0.0,
                min_peak: float = 8.0, tolerance: float = 1.0, fps: float = K.FPS) -> DataFrame:
    """Camera offset in frames per key: densest cluster of prominent lags, plus the baked offset."""
    lag = pairs.withColumn("l", lag_of(rate)(a, b)).select(
        *keys, (F.col("l.lag_s") * fps).alias("residual"), F.col("l.peak").alias("peak"))
    usable = lag.filter(F.col("peak") >= min_peak)
    d = densest(usable, keys, "residual", tolerance)
    return d.select(*keys, F.col("cluster_mean").alias("residual"), "support",
                    (F.col("cluster_mean") + baked).alias("true_offset"))
