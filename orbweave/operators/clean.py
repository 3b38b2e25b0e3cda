"""Track cleaning: spikes out, smoother over the rest, short trusted gaps filled, features again."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orbweave.functions import boxes as B, ordered
from orbweave.functions.lineage import cut
from orbweave.functions.skew import attach
from orbweave.operators import sequence as S, tracks as T
from orbweave.operators.evaluate import best_single_auc, count_if

PART, BLOCK = 2048, 2048   # frames per part, parts per block
ROWS = 100_000             # rows of whole parts that a task smooths together
HALO = 256                 # frames of overlap of the gated smoother, whose gates depend on the state

# --- fixed values: smoother noise (pixels, pixels per frame squared) ---------------
MEASURE_SD, ACCEL_SD, START_VAR = 6.0, (1.5, 4.0), 1e3


STEP = np.array([[1.0, 1.0, 0.5], [0.0, 1.0, 1.0], [0.0, 0.0, 1.0]])
NOISE = np.array([sd ** 2 for sd in ACCEL_SD])[:, None, None] * np.outer([0.5, 1.0, 1.0], [0.5, 1.0, 1.0])


def _start(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State before a track's first frame: at its first detection, at rest."""
    mean = np.zeros((2, 3))
    mean[:, 0] = first
    return mean, np.repeat((np.eye(3) * START_VAR)[None], 2, 0)


def _informed(mean, cov, eta, info):
    """The state after adding what later detections say about it."""
    solve = np.linalg.inv(np.eye(3) + cov @ info)
    return np.einsum("...ij,...j->...i", solve, mean + np.einsum("...ij,...j->...i", cov, eta)), solve @ cov


def _steps(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs from the longest to the shortest, and for every step how many of them have a row there."""
    order = np.argsort(-lengths, kind="stable")
    steps = np.arange(lengths.max() if len(lengths) else 0)
    return order, len(lengths) - np.searchsorted(lengths[order][::-1], steps, side="right")


def _smooth_runs(z: np.ndarray, starts: np.ndarray, lengths: np.ndarray, mean: np.ndarray, cov: np.ndarray,
                 later=None) -> np.ndarray:
    """Constant-acceleration forward filter and backward smoother of many runs of rows; z is (n, 2) with NaN gaps.

    All runs take a step together, both axes as one batch of 3-state systems, from the states before their first rows
    (run, axis, ...); ``later`` is what detections behind the last rows say about the last states.
    """
    order, active = _steps(lengths)
    starts, lengths, mean, cov = starts[order], lengths[order], mean[order], cov[order]
    held, out = [], np.empty(z.shape)
    for k, n in enumerate(active):
        mean, cov = mean[:n] @ STEP.T, STEP @ cov[:n] @ STEP.T + NOISE
        pred = mean, cov
        row = z[starts[:n] + k]
        seen = ~np.isnan(row[:, 0])
        w = np.where(seen[:, None, None], cov[:, :, :, 0] / (cov[:, :, 0, 0] + MEASURE_SD ** 2)[:, :, None], 0.0)
        mean = mean + w * np.where(seen[:, None], row - mean[:, :, 0], 0.0)[:, :, None]
        cov = cov - w[:, :, :, None] * cov[:, :, None, 0, :]
        held.append((*pred, mean, cov))
    smooth = np.empty((0, 2, 3))
    for k in range(len(active) - 1, -1, -1):
        n, m = active[k], len(smooth)                      # runs m to n end here
        _, _, mean, cov = held[k]
        ends = mean[m:n]
        if later is not None:
            ends = _informed(ends, cov[m:n], later[0][order[m:n]], later[1][order[m:n]])[0]
        if m:
            pred_m, pred_c = held.pop()[:2]
            back = cov[:m] @ STEP.T @ np.linalg.inv(pred_c)
            ends = np.concatenate([mean[:m] + np.einsum("raij,raj->rai", back, smooth - pred_m), ends])
        smooth = ends
        out[starts[:n] + k] = smooth[:, :, 0]
    return out


def _smooth_axes(z: np.ndarray, mean: np.ndarray, cov: np.ndarray, later=None) -> np.ndarray:
    """One run of rows from one state."""
    return _smooth_runs(z, np.array([0]), np.array([len(z)]), mean[None], cov[None],
                        None if later is None else [v[None] for v in later])


# A run of frames as one affine-Gaussian element: the last state is turn @ (state before) + shift, with covariance
# spread; the run's detections say eta, info about the state before.  Elements of neighbouring runs are joined.

def _elements(z: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """Elements of many runs of rows, (run, axis, ...); all runs take a step together."""
    order, active = _steps(lengths)
    runs = len(lengths)
    turn, shift, spread = np.tile(np.eye(3), (runs, 2, 1, 1)), np.zeros((runs, 2, 3)), np.zeros((runs, 2, 3, 3))
    eta, info = np.zeros((runs, 2, 3)), np.zeros((runs, 2, 3, 3))
    for k, n in enumerate(active):
        at = order[:n]
        a, b, c = STEP @ turn[at], shift[at] @ STEP.T, STEP @ spread[at] @ STEP.T + NOISE
        row = z[starts[at] + k]
        seen = ~np.isnan(row[:, 0])[:, None, None]
        var, see = c[:, :, 0, 0] + MEASURE_SD ** 2, np.where(seen, a[:, :, 0, :], 0.0)
        miss = np.where(seen[:, 0], row - b[:, :, 0], 0.0)
        w = np.where(seen, c[:, :, :, 0] / var[:, :, None], 0.0)
        eta[at] += see * (miss / var)[:, :, None]
        info[at] += see[:, :, :, None] * see[:, :, None, :] / var[:, :, None, None]
        turn[at], shift[at] = a - w[:, :, :, None] * see[:, :, None, :], b + w * miss[:, :, None]
        spread[at] = c - w[:, :, :, None] * c[:, :, None, 0, :]
    return turn, shift, spread, eta, info


def _element(z: np.ndarray) -> tuple[np.ndarray, ...]:
    return tuple(v[0] for v in _elements(z, np.array([0]), np.array([len(z)])))


def _after(state, e):
    """Mean and covariance behind a run, from those before it."""
    mean, cov = _informed(*state, e[3], e[4])
    return np.einsum("aij,aj->ai", e[0], mean) + e[1], e[0] @ cov @ e[0].swapaxes(1, 2) + e[2]


def _before(e, later):
    """What a run and all behind it say about the state before the run."""
    eta, info = later
    back = e[0].swapaxes(1, 2) @ np.linalg.inv(np.eye(3) + info @ e[2])
    return (np.einsum("aij,aj->ai", back, eta - np.einsum("aij,aj->ai", info, e[1])) + e[3], back @ info @ e[0] + e[4])


def _joined(a, b):
    """The element of two neighbouring runs."""
    solve = b[0] @ np.linalg.inv(np.eye(3) + a[2] @ b[4])
    return (solve @ a[0], np.einsum("aij,aj->ai", solve, a[1] + np.einsum("aij,aj->ai", a[2], b[3])) + b[1],
            solve @ a[2] @ b[0].swapaxes(1, 2) + b[2], *_before(a, (b[3], b[4])))


def _packed(parts) -> list[float]:
    return np.concatenate([np.ravel(p) for p in parts]).tolist()


def _unpacked(values, shapes) -> list[np.ndarray]:
    x, out = np.asarray(values, dtype=float), []
    for shape in shapes:
        n = int(np.prod(shape))
        out.append(x[:n].reshape(shape))
        x = x[n:]
    return out


_V, _M = (2, 3), (2, 3, 3)
ELEMENT, ENTRY = (_M, _V, _M, _V, _M), (_V, _M, _V, _M)


def _rows_of(t: pa.Table, keys: Sequence[str], **cols) -> pa.Table:
    """Key columns of the table's first rows, as many as there are values, with typed columns."""
    n = len(next(iter(cols.values())))
    kinds = {"first": pa.list_(pa.float64()), "element": pa.list_(pa.float64()), "entry": pa.list_(pa.float64())}
    return pa.table({**{k: t[k][:n] for k in keys}, **{c: pa.array(v, kinds.get(c)) for c, v in cols.items()}})


def _runs(t: pa.Table, of: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """First rows and lengths of the runs of equal ``of``; nulls are equal."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for c in of:
        code = t[c].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        new[1:] |= code[1:] != code[:-1]
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, t.num_rows))


def _by_runs(of: Sequence[str], make):
    """For mapInArrow on rows sorted by ``of``: ``make(table, starts, lengths)`` on about ``ROWS`` rows of whole runs at a time."""
    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= ROWS:
                t = pa.Table.from_batches(held)
                last = int(_runs(t, of)[0][-1])
                if last:
                    whole = t.slice(0, last)
                    yield from make(whole, *_runs(whole, of)).to_batches()
                held, n = t.slice(last).combine_chunks().to_batches(), t.num_rows - last
        if n:
            t = pa.Table.from_batches(held)
            yield from make(t, *_runs(t, of)).to_batches()
    return run


def _in_runs(df: DataFrame, of: Sequence[str], then: Sequence[str], make, schema: str) -> DataFrame:
    """Runs of equal ``of``, ordered by ``then``, many at a time; no task holds more than ``ROWS`` rows and a run."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))   # not merged by size, see skew.grouped
    return df.repartition(n, *of).sortWithinPartitions(*of, *then).mapInArrow(_by_runs(of, make), schema)


def _first_seen(z: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Row of each run's first detection, -1 without one."""
    seen = np.append(np.flatnonzero(~np.isnan(z[:, 0])), len(z))
    first = seen[np.searchsorted(seen, starts)]
    return np.where(first < starts + lengths, first, -1)


def _element_rows(keys):
    def make(t: pa.Table, starts, lengths) -> pa.Table:
        z = _positions(t)
        parts, first = _elements(z, starts, lengths), _first_seen(z, starts, lengths)
        flat = np.concatenate([p.reshape(len(starts), -1) for p in parts], 1)
        kind = pa.list_(pa.float64())
        return pa.table({**{k: t[k].take(pa.array(starts)) for k in [*keys, "_part"]},
                         "first": pa.array([z[i].tolist() if i >= 0 else None for i in first], kind),
                         "element": pa.array(flat.tolist(), kind)})
    return make


def _joined_rows(keys):
    """One element for all parts of a block."""
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("_part")
        total = None
        for v in t["element"].to_pylist():
            e = _unpacked(v, ELEMENT)
            total = e if total is None else _joined(total, e)
        first = next((v for v in t["first"].to_pylist() if v is not None), None)
        return _rows_of(t, [*keys, "_block"], first=[first], element=[_packed(total)])
    return run


def _entry_rows(keys, at):
    """For every run the state before it and what all behind it say; ``entry`` of the whole stretch, if it has one."""
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by(at)
        elements = [_unpacked(v, ELEMENT) for v in t["element"].to_pylist()]
        whole = t["entry"][0].as_py() if "entry" in t.column_names else None
        if "entry" in t.column_names:
            if whole is None:
                return _rows_of(t, [*keys, at], entry=[None] * len(elements))
            *state, eta, info = _unpacked(whole, ENTRY)
        else:
            first = next((v for v in t["first"].to_pylist() if v is not None), None)
            if first is None:
                return _rows_of(t, [*keys, at], entry=[None] * len(elements))
            state, eta, info = _start(np.array(first)), np.zeros(_V), np.zeros(_M)
        states, laters = [], [(eta, info)]
        for e in elements:
            states.append(state)
            state = _after(state, e)
        for e in reversed(elements[1:]):
            laters.append(_before(e, laters[-1]))
        return _rows_of(t, [*keys, at], entry=[_packed((*s, *x)) for s, x in zip(states, reversed(laters))])
    return run


def _part_entries(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Entry of every part of the tracks that have more than one: keys, _part, entry.

    Parts are summarised in parallel; their elements are joined per block of 2,048 parts, blocks are scanned per track
    (one row per four million frames) and parts inside their block.
    """
    def like(df, *more):
        return ", ".join([*(f"`{n}` {t}" for n, t in df.select(*keys).dtypes), *more])
    other = rows.filter(F.col("_part") > 0).select(*[F.col(k).alias(f"_o{i}") for i, k in enumerate(keys)]).distinct()
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_o{i}"))
    long = rows.join(other, same, "left_semi").select(*keys, "_part", "frame_idx", "zx", "zy")
    typed = "first array<double>, element array<double>"
    parts = cut(_in_runs(long, [*keys, "_part"], ["frame_idx"], _element_rows(keys), like(rows, "_part bigint", typed))
                .withColumn("_block", F.floor(F.col("_part") / BLOCK).cast("long")))
    blocks = parts.groupBy(*keys, "_block").applyInArrow(_joined_rows(keys), like(rows, "_block bigint", typed))
    whole = blocks.groupBy(*keys).applyInArrow(_entry_rows(keys, "_block"), like(rows, "_block bigint", "entry array<double>"))
    w = whole.withColumnsRenamed({k: f"_o{i}" for i, k in enumerate(keys)} | {"_block": "_b"})
    inside = parts.join(w, same & (F.col("_block") == F.col("_b"))).select(*keys, "_block", "_part", "element", "entry")
    return inside.groupBy(*keys, "_block").applyInArrow(_entry_rows(keys, "_part"), like(rows, "_part bigint", "entry array<double>"))


def _positions(t: pa.Table) -> np.ndarray:
    return np.column_stack([t["zx"].to_numpy(), t["zy"].to_numpy()]).astype(float)


def _with_columns(t: pa.Table, **cols) -> pa.Table:
    """Append columns (NaN becomes null) and keep the rows the part owns."""
    for name, values in cols.items():
        t = t.append_column(name, pa.array(values, from_pandas=True))
    return t.filter(t["_own"])


def _smooth_parts(t: pa.Table, starts: np.ndarray, lengths: np.ndarray) -> pa.Table:
    """Parts from their exact entries, which come before their rows (``_row`` false); a track of a
    single part has no such row and starts at its first detection."""
    row = t["_row"].to_numpy()
    told = ~row[starts]
    z, runs = _positions(t), len(starts)
    first = _first_seen(z, starts + told, lengths - told)
    mean, cov = np.zeros((runs, 2, 3)), np.tile(np.eye(3) * START_VAR, (runs, 2, 1, 1))
    mean[:, :, 0] = np.where(first[:, None] >= 0, z[first], 0.0)
    eta, info = np.zeros((runs, 2, 3)), np.zeros((runs, 2, 3, 3))
    known = ~told & (first >= 0)
    for i in np.flatnonzero(told):
        entry = t["entry"][int(starts[i])].as_py()
        if entry is not None:
            known[i] = True
            mean[i], cov[i], eta[i], info[i] = _unpacked(entry, ENTRY)
    s = np.full(z.shape, np.nan)
    for later in (False, True):
        go = known & (told == later) & (lengths > told)
        at = np.repeat(go, lengths) & row
        n = (lengths - told)[go]
        s[at] = _smooth_runs(z[at], np.cumsum(n) - n, n, mean[go], cov[go], (eta[go], info[go]) if later else None)
    for name, values in (("sx", s[:, 0]), ("sy", s[:, 1])):
        t = t.append_column(name, pa.array(values, from_pandas=True))
    return t.filter(t["_row"]).drop_columns(["_row", "entry"])


def marked_tracks(tracks: DataFrame, keys: Sequence[str] = T.TRACK) -> DataFrame:
    """Rows with ``rejected`` (spikes) and ``trusted`` (short gaps between confident edges)."""
    kept = F.col("ball_x").isNotNull() & ~F.col("rejected")
    return S.trusted_gaps(S.reject_spikes(tracks, keys), kept, keys)


def clean_tracks(tracks: DataFrame, keys: Sequence[str] = T.TRACK) -> DataFrame:
    """Cleaned centre per frame with provenance: cx, cy, imputed, rejected, raw_cx, raw_cy.

    Tracks longer than 2,048 frames are smoothed in parts, each from its exact entry state and with what all later
    detections say about its last one, so the parts do not show; shorter ones - every shot window - are smoothed whole.
    """
    keys = list(keys)
    kept = F.col("ball_x").isNotNull() & ~F.col("rejected")
    r = marked_tracks(tracks, keys)
    r = r.select(*keys, "frame_idx", "rejected", "trusted", "ball_x", "ball_conf", "rim_w",
                 B.center_x("ball").alias("raw_cx"), B.center_y("ball").alias("raw_cy"))
    r = r.withColumn("zx", F.when(kept, F.col("raw_cx"))).withColumn("zy", F.when(kept, F.col("raw_cy")))
    h = cut(r.withColumn("_part", F.floor(F.col("frame_idx") / F.lit(PART)).cast("long")))
    typed = ", ".join(f"`{n}` {t}" for n, t in h.dtypes) + ", sx double, sy double"
    rows = h.withColumn("_row", F.lit(True)).unionByName(
        _part_entries(h, keys).withColumn("_row", F.lit(False)), allowMissingColumns=True)
    s = _in_runs(rows, [*keys, "_part"], ["_row", "frame_idx"], _smooth_parts, typed)
    show = kept | F.col("trusted")
    return s.select(*keys, "frame_idx", "rejected", "trusted", "ball_x", "ball_conf", "rim_w", "raw_cx",
                    "raw_cy", F.when(show, F.col("sx")).alias("cx"),
                    F.when(show, F.col("sy")).alias("cy"),
                    (F.col("trusted") & F.col("sx").isNotNull()).cast("int").alias("imputed"))


def clean_features(tracks: DataFrame, keys: Sequence[str] = T.TRACK) -> DataFrame:
    """Cleaned-track features per camera: trajectory levers again plus provenance and quality."""
    keys = list(keys)
    cl = cut(clean_tracks(tracks, keys))
    valid = F.col("cx").isNotNull()
    g = cl.groupBy(*keys).agg(
        count_if(F.col("rejected")).alias("n_rejected_outlier"), F.sum("imputed").alias("n_imputed"),
        count_if(valid).alias("n_cleaned_points"),
        F.avg(F.when(valid, F.col("imputed"))).alias("imp_frac"))
    out = g.join(S.track_quality(cl, keys), keys, "left") \
        .join(T.jitter(cl, "raw_cy", keys, "jitter_raw"), keys, "left") \
        .join(T.jitter(cl, "cy", keys, "jitter_clean"), keys, "left")
    ref = T.reference_box(tracks, keys)
    pts = cl.filter(valid).select(
        *keys, "frame_idx", F.col("cx").alias("ball_x"), F.col("cy").alias("ball_y"),
        F.lit(0.0).alias("ball_w"), F.lit(0.0).alias("ball_h"),
        F.when(F.col("imputed") == 1, 0.4).otherwise(0.9).alias("ball_conf"))
    enough = g.filter("n_cleaned_points >= 3").select(*keys, F.lit(1).alias("_enough"))
    pts = attach(pts, enough, keys, ["frame_idx"], "inner").drop("_enough")
    det = cut(T.numbered(T.detections(pts, ref, keys), keys))
    best = T.best_rows(det, keys)
    inside = det.groupBy(*keys).agg(F.avg(F.col("inside").cast("double")).alias("frac_inside_rim"))
    parts = [T.closest(det, keys).select(*keys, "min_dist_rw"), inside,
             T.plane_crossings(det, keys).select(*keys, "through_hoop"),
             T.bounce_out(det, best, keys), T.arc(det, best, keys)]
    for p in parts:
        out = out.join(p.withColumnsRenamed({c: f"cln_{c}" for c in p.columns if c not in keys}),
                       keys, "left")
    out = T.fill_sentinels(out, keys)
    return out.withColumn("jitter_reduction", F.col("jitter_raw") - F.col("jitter_clean"))


def cleaning_auc(features: DataFrame, label: str = "label") -> DataFrame:
    """The arc column that separates the label best alone, raw and cleaned, one row: raw_feature, raw_auc,
    cleaned_feature, cleaned_auc, improved."""
    arcs = [c for c in features.columns if c.startswith("arc_")]
    cleaned = [c for c in features.columns if c.startswith("cln_arc_")]
    best = best_single_auc(features, {"raw": arcs, "cleaned": cleaned}, label)
    return best.agg(*[F.max(F.when(F.col("family") == f, F.col(c))).alias(f"{f}_{c}")
                      for f in ("raw", "cleaned") for c in ("feature", "auc")]).withColumn(
        "improved", F.col("cleaned_auc") > F.col("raw_auc"))


def cleaning_summary(clean: DataFrame) -> DataFrame:
    """Mean jitter raw and cleaned and the relative reduction, one row."""
    g = clean.agg(F.avg("jitter_raw").alias("jitter_raw"), F.avg("jitter_clean").alias("jitter_clean"))
    return g.withColumn("reduction", 1 - F.col("jitter_clean") / F.col("jitter_raw"))


# ---- constant-velocity smoother over irregular times -------------------------------
# --- fixed values: gate in standard deviations, noise, longest bridged time ---------
GATE, MEASURE_PX, ACCEL_PX, BRIDGE_S = 4.0, 6.0, 1500.0, 0.25


def _nearest_seen(t: np.ndarray, has: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Time between each row and the nearest detection of its run; infinite without one."""
    order = np.lexsort((t, run))
    t, has, run, at = t[order], has[order], run[order], np.arange(len(t))
    before = np.maximum.accumulate(np.where(has, at, -1))
    after = np.minimum.accumulate(np.where(has, at, len(t))[::-1])[::-1]
    out = np.full(len(t), np.inf)
    for near, inside in ((before, before >= 0), (after, after < len(t))):
        near = np.where(inside, near, 0)
        out = np.minimum(out, np.where(inside & (run[near] == run), np.abs(t - t[near]), np.inf))
    back = np.empty(len(t))
    back[order] = out
    return back


def _cv_runs(tab: pa.Table, starts: np.ndarray, lengths: np.ndarray) -> pa.Table:
    """All parts take a step together; per axis state (position, velocity), both axes share the covariance."""
    t = tab["t"].to_numpy().astype(float)
    z = np.column_stack([tab["px"].to_numpy(), tab["py"].to_numpy()]).astype(float)
    has, first = ~np.isnan(z[:, 0]), _first_seen(z, starts, lengths)
    sx, sy, sigma, observed = np.full(len(t), np.nan), np.full(len(t), np.nan), np.full(len(t), np.inf), np.zeros(len(t), bool)
    go = first >= 0
    order, active = _steps(lengths[go])
    at, first = starts[go][order], first[go][order]
    m, last = np.stack([z[first], np.zeros((len(first), 2))], 1), t[first]       # (run, position and velocity, axis)
    cov = np.tile(np.diag([MEASURE_PX ** 2, 1e6]), (len(first), 1, 1))

    def moves(dt):
        move = np.tile(np.eye(2), (len(dt), 1, 1))
        move[:, 0, 1] = dt
        return move
    held = []
    for k, n in enumerate(active):
        row = at[:n] + k
        dt = np.maximum(t[row] - last[:n], 1e-3)
        move, push, last = moves(dt), np.stack([dt * dt / 2, dt], 1), t[row]
        m = move @ m[:n]
        cov = move @ cov[:n] @ move.swapaxes(1, 2) + ACCEL_PX ** 2 * (push[:, :, None] * push[:, None, :])
        pred = m, cov
        var, miss = cov[:, 0, 0] + MEASURE_PX ** 2, z[row] - m[:, 0]
        take = (miss * miss).sum(1) / var < GATE ** 2                           # false where nothing is detected
        observed[row] = take
        w = np.where(take[:, None], cov[:, :, 0] / var[:, None], 0.0)
        m = m + w[:, :, None] * np.where(take[:, None], miss, 0.0)[:, None, :]
        cov = cov - w[:, :, None] * cov[:, None, 0, :]
        held.append((*pred, m, cov, move))
    sm = np.empty((0, 2, 2))
    sc = np.empty((0, 2, 2))
    for k in range(len(active) - 1, -1, -1):
        n, ahead = active[k], len(sm)
        m, cov = held[k][2:4]
        if ahead:
            pm, pc, _, _, move = held.pop()
            g = cov[:ahead] @ move.swapaxes(1, 2) @ np.linalg.inv(pc)
            sm = np.concatenate([m[:ahead] + g @ (sm - pm), m[ahead:]])
            sc = np.concatenate([cov[:ahead] + g @ (sc - pc) @ g.swapaxes(1, 2), cov[ahead:]])
        else:
            sm, sc = m, cov
        row = at[:n] + k
        sx[row], sy[row], sigma[row] = sm[:, 0, 0], sm[:, 0, 1], np.sqrt(np.maximum(sc[:, 0, 0], 0.0))
    near = _nearest_seen(t, has, np.repeat(np.arange(len(starts)), lengths))
    sigma[(near > BRIDGE_S) & ~observed] = np.inf
    return _with_columns(tab, sx=sx, sy=sy, sigma=sigma, observed=observed)


def smooth_velocity(rows: DataFrame, keys: Sequence[str] = T.TRACK) -> DataFrame:
    """Gated constant-velocity smoother; sigma is infinite too far from any detection.

    ``rows``: keys, frame_idx (dense), t, px, py (null without detection).
    """
    h = ordered.with_halo(rows.select(*keys, "frame_idx", "t", "px", "py"), "frame_idx", PART, HALO)
    typed = ", ".join(f"{n} {t}" for n, t in h.dtypes) + ", sx double, sy double, sigma double, " \
        "observed boolean"
    s = _in_runs(h, [*keys, "_part"], ["frame_idx"], _cv_runs, typed)
    return s.drop("_part", "_own")
