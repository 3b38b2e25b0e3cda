"""Clip signals whitened on their leading principal components, found by Chebyshev-filtered subspace iteration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SCALE = 64             # a signal value c counts as the integer floor(SCALE * c)
LIMIT = float(1 << 52)    # integers beyond this saturate
GUARD = 16             # columns of the subspace besides the wanted ones
DEGREE = 8             # passes over the data per filter
ROUNDS = 60
NO_RANK = 1e-12        # eigenvalues up to this share of the largest one count as zero


# --- one task's rows -------------------------------------------------------------------------------------

def signal_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows of an array column are whole, their lengths, and their integers one after the other.

    Whole: not null, not empty, no null or non-finite entry.
    """
    n = len(column)
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype("i8")
    flat = column.flatten().cast(pa.float64())
    good = np.isfinite(flat.to_numpy(zero_copy_only=False)) & flat.is_valid().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(n), size)
    whole = (size > 0) & (np.bincount(row[~good], minlength=n) == 0)
    c = flat.to_numpy(zero_copy_only=False)[whole[row]]
    with np.errstate(over="ignore"):
        return whole, size[whole], np.clip(np.floor(SCALE * c), -LIMIT, LIMIT)


def matrix_of(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have ``d`` entries and are whole, and their integers as a float matrix (all below 2**53)."""
    whole, size, flat = signal_rows(column)
    at = np.cumsum(size) - size
    mine = size == d
    rows = np.flatnonzero(whole)[mine]
    return rows, flat[at[mine][:, None] + np.arange(d)] if len(rows) else np.zeros((0, d))


def deviations(y: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """Sum over the dimensions of (n*y - total)^2, exact; null where it needs more than 63 bits."""
    rough = n * n * np.square(y - np.array([t / n for t in total])).sum(1)
    out: list[int | None] = [None] * len(y)
    small = (rough < 2.0 ** 62) & (n * np.abs(y).max(1, initial=0) < 2.0 ** 62)
    if small.any() and max(map(abs, total)) < 1 << 62:
        z = n * y[small].astype("i8") - np.array(total, "i8")
        for i, v in zip(np.flatnonzero(small).tolist(), np.square(z).sum(1).tolist()):
            out[i] = v
    else:
        small[:] = False
    for i in np.flatnonzero(~small & (rough < 2.0 ** 64)).tolist():
        v = sum((n * int(a) - t) ** 2 for a, t in zip(y[i], total))
        out[i] = v if v < 1 << 63 else None
    return out


# --- passes over the table -------------------------------------------------------------------------------

def _sums(rows: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Per signal length: number of rows and exact sums of the integers, as two halves that cannot overflow."""
    def run(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            _, size, flat = signal_rows(b.column(0))
            at = np.cumsum(size) - size
            for d in np.unique(size).tolist():
                y = flat[at[size == d][:, None] + np.arange(d)].astype("i8")
                part = held.setdefault(d, np.zeros(2 * d + 1, "i8"))
                part[0] += len(y)
                part[1:d + 1] += (y >> 26).sum(0)
                part[d + 1:] += (y & ((1 << 26) - 1)).sum(0)
        for d, part in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(part), pa.int32()), pa.array(
                np.arange(len(part), dtype="i4")), pa.array(part)], names=["d", "cell", "v"])
    cells = rows.mapInArrow(run, "d int, cell int, v bigint").groupBy("d", "cell").agg(F.sum("v").alias("v"))
    out: dict[int, tuple[int, list[int]]] = {}
    found = cells.toArrow().to_pydict()
    by = {(d, c): v for d, c, v in zip(found["d"], found["cell"], found["v"])}
    for d in set(found["d"]):
        out[d] = by[d, 0], [(by[d, 1 + i] << 26) + by[d, 1 + d + i] for i in range(d)]
    return out


def _cells(rows: DataFrame, d: int, mean: np.ndarray, of, cells: int) -> np.ndarray:
    """Sum over all centred signals of ``of(matrix) -> cells`` numbers: one vector per task, added up by Spark."""
    def run(batches):
        total = np.zeros(cells)
        for b in batches:
            _, y = matrix_of(b.column(0), d)
            if len(y):
                total += of(y - mean)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells, dtype="i4")), pa.array(total)], names=["cell", "v"])
    found = rows.mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(cells)
    out[found["cell"].to_numpy()] = found["v"].to_numpy()
    return out


# --- the iteration ---------------------------------------------------------------------------------------

class Lanczos:
    """Single-vector recurrence that rides along with the block passes; bounds the spectrum from below."""

    def __init__(self, start: np.ndarray):
        self.basis, self.alpha, self.beta = [start / np.linalg.norm(start)], [], []

    @property
    def vector(self) -> np.ndarray:
        return self.basis[-1]

    def step(self, product: np.ndarray) -> None:
        v = self.basis[-1]
        self.alpha.append(float(v @ product))
        rest = product.copy()
        for _ in range(2):                                       # the basis is short: orthogonalise against all
            q = np.array(self.basis)
            rest -= q.T @ (q @ rest)
        size = float(np.linalg.norm(rest))
        self.beta.append(size)
        done = len(self.basis) >= len(v) or size <= 1e-12 * max(1e-300, abs(self.alpha[0]))
        if done:                                                 # the space is used up: nothing to add
            rest, size = np.zeros_like(v), 1.0
        self.basis.append(rest / size)

    def lowest(self) -> float:
        """Smallest Ritz value less its residual."""
        k = len(self.alpha)
        if k < 3:
            return 0.0
        t = np.diag(self.alpha) + np.diag(self.beta[:k - 1], 1) + np.diag(self.beta[:k - 1], -1)
        w, s = np.linalg.eigh(t)
        return max(0.0, float(w[0] - abs(self.beta[k - 1] * s[-1, 0])))


def leading(apply, d: int, k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues and unit eigenvectors (columns) of a d x d covariance known by ``apply`` alone.

    ``apply(Q)`` returns VQ.  A Chebyshev polynomial of V, by its three-term recurrence, maps the unwanted part of
    the spectrum into [-1, 1] and lets the wanted part grow; the block is orthonormalised (QR), projected
    (Rayleigh-Ritz) and filtered again until certified: each wanted pair's residual |Vq - eq| is at the rounding
    floor of double sums.  The filter's interval goes from the Lanczos bound to the block's smallest Ritz value,
    which never exceeds the eigenvalue of its rank.  Before the pairs are accepted the guard columns are drawn
    anew once, so that a direction the first draw missed would show.
    """
    m = min(d, k + GUARD)
    rng = np.random.default_rng(seed)
    low = Lanczos(rng.standard_normal(d))
    q = np.linalg.qr(rng.standard_normal((d, m)))[0]

    def product(block):
        z = apply(np.column_stack([block, low.vector]))
        low.step(z[:, -1])
        return z[:, :-1]
    before, redrawn = np.inf, m == d
    for _ in range(ROUNDS):
        z = product(q)
        values, turn = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, z = q @ turn, z @ turn
        top = max(float(values[0]), 0.0)
        wanted = int((values[:k] > NO_RANK * top).sum())
        residual = float(np.linalg.norm(z[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0).max(initial=0.0))
        floor = residual <= 4e-15 * d ** 0.5 * top or (residual <= 1e-11 * top and residual > before / 2)
        if floor and redrawn:
            return values[:wanted], q[:, :wanted]
        if floor:
            redrawn, before = True, np.inf
            q = np.linalg.qr(np.column_stack([q[:, :k], rng.standard_normal((d, m - k))]))[0]
            z = product(q)
        else:
            before = residual
        a = min(low.lowest(), float(values[-1]))
        b = max(float(values[-1]), 1e-3 * float(values[wanted - 1]) if wanted else 1.0)
        centre, half = (a + b) / 2, max((b - a) / 2, 1e-6 * b)
        scale = half / (top - centre) if top > centre else 1.0      # keeps the largest growth at one
        old, now, sigma = q, (z - centre * q) * (scale / half), scale
        for _ in range(DEGREE - 1):
            following = 1.0 / (2.0 / scale - sigma)
            old, now = now, 2 * following / half * (product(now) - centre * now) - sigma * following * old
            sigma = following
        q = np.linalg.qr(now)[0]
    raise ArithmeticError(f"the leading {k} components are not certified after {ROUNDS} filters")


def whiten(vectors: DataFrame, key: str = "clip", vector: str = "wave", components: int = 32) -> DataFrame:
    """Whitened leading components of clip signals.

    ``vectors``: one row per clip with an array of numbers.  Each entry c counts as y = floor(64 c); a constant
    added to all of them would change nothing below.  Returns per clip and component (from 1, by falling
    eigenvalue e of the covariance with divisor n): key, component, n, deviation (sum over the entries of
    (n y - sum y)^2, exact, null where it needs more than 63 bits), whitened ((y - mean) on the component over
    sqrt(e)), explained (e over the trace) and identity_error (largest entry of the whitened columns' covariance minus
    the identity, measured by a pass).

    Signals that are null, empty or hold a null or non-finite entry take no part; of several lengths only the one
    most rows have counts (ties: the longest).  Entries beyond 2**52 after scaling saturate.  Components without
    variance are left out, so one row, equal rows or an empty table give no rows.  Repeated rows count each, a
    null key is kept, other columns are not read.

    Each pass reads the signals once and adds one d x (components + 17) matrix per task; the driver holds matrices of
    that size only.  A lost executor costs its tasks of the current pass.
    """
    kind = vectors.schema[key].dataType.simpleString()
    schema = (f"key {kind}, component int, n bigint, deviation bigint, whitened double, explained double, "
              "identity_error double")
    rows = vectors.select(F.col(vector).alias("v"))
    names = {"key": key}
    sums = _sums(rows)
    d = max(sums, key=lambda size: (sums[size][0], size), default=0)
    n, total = sums.get(d, (0, []))
    mean = np.array([t / n for t in total])
    values = np.zeros(0)
    if d:
        spread = _cells(rows, d, mean, lambda y: np.array([np.square(y).sum()]), 1)[0] / n
        if spread > 0:
            values, basis = leading(
                lambda q: _cells(rows, d, mean, lambda y: (y.T @ (y @ q)).ravel(), q.size).reshape(q.shape) / n,
                d, components)
    k = len(values)
    if not k:
        return vectors.sparkSession.createDataFrame([], schema).withColumnsRenamed(names)
    axes = basis / np.sqrt(values)
    gram = _cells(rows, d, mean, lambda y: (lambda w: (w.T @ w).ravel())(y @ axes), k * k).reshape(k, k) / n
    error = float(np.abs(gram - np.eye(k)).max())
    explained = values / spread

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                b = batch.slice(at, 2000)
                mine, y = matrix_of(b.column(1), d)
                if len(mine):
                    each = np.repeat(np.arange(len(mine)), k)
                    yield pa.RecordBatch.from_arrays([
                        b.column(0).take(pa.array(mine[each])), pa.array(np.tile(np.arange(1, k + 1, dtype="i4"), len(mine))),
                        pa.array(np.full(len(each), n, "i8")),
                        pa.array(deviations(y, n, total), pa.int64()).take(pa.array(each)),
                        pa.array(((y - mean) @ axes).ravel()), pa.array(np.tile(explained, len(mine))),
                        pa.array(np.full(len(each), error))],
                        names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return vectors.select(F.col(key).alias("key"), F.col(vector).alias("v")).mapInArrow(run, schema).withColumnsRenamed(names)
