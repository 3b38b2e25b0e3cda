"""Histogram gradient boosting for many leave-out folds at once.

Columns are binned once.  Folds of a bounded number of rows grow in one job, each fold by a task of its own on its one-byte
bins.  Larger tables grow all folds in the same passes: one aggregate per tree level holds the gradient sums of every (fold,
node, column, bin), whatever the number of rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from orbweave.functions.lineage import checkpoint_dir, cut
from orbweave.operators import evaluate as E

BINS = 255                 # bins of a column; the byte 255 marks a missing value
MISSING = 255
PART_ROWS = 50_000         # binned rows per task of a pass
FOLD_ROWS = 2_000_000      # rows of a table whose folds are learned by a task each (about 100 bytes a row); larger ones take passes
KEEP = 10                  # rounds between two writes of the margins
LEAST_HESSIAN = 1e-3


@dataclass
class Forest:
    """Trees of all folds: arrays (round, fold, node) over heap-ordered nodes; a node without a split has feature -1."""
    columns: list[str]
    borders: list[np.ndarray]
    impute: np.ndarray                       # (fold, column): the bin of the training median
    base: np.ndarray                         # (fold,): log-odds of the training rows
    depth: int
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)


# --- one task's rows -------------------------------------------------------------------------------------

def bins_of(batch: pa.RecordBatch, columns: Sequence[str], borders: Sequence[np.ndarray]) -> np.ndarray:
    """Number of borders below each value, one byte per column; null and NaN are MISSING."""
    out = np.full((batch.num_rows, len(columns)), MISSING, "u1")
    for i, (c, b) in enumerate(zip(columns, borders)):
        x = batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)
        known = ~np.isnan(x)
        out[known, i] = np.searchsorted(b, x[known], side="left")
    return out


def nodes_of(x: np.ndarray, tree, depth: int) -> np.ndarray:
    """Node of every row and fold: ``x`` is (row, fold, column)."""
    feature, bar, _ = tree
    n, folds, _ = x.shape
    node, fold = np.zeros((n, folds), "i8"), np.arange(folds)
    rows = np.arange(n)[:, None]
    for _ in range(depth):
        f = feature[fold, node]
        right = x[rows, fold, np.maximum(f, 0)] > bar[fold, node]
        node = np.where(f >= 0, 2 * node + 1 + right, node)
    return node


def margins_of(x: np.ndarray, start: np.ndarray, trees, depth: int) -> np.ndarray:
    out = start.copy()
    for tree in trees:
        out += tree[2][np.arange(out.shape[1]), nodes_of(x, tree, depth)]
    return out


def _filled(bins: np.ndarray, impute: np.ndarray) -> np.ndarray:
    """(row, fold, column) bins with the fold's median where a value is missing."""
    return np.where(bins[:, None, :] == MISSING, impute[None], bins[:, None, :])


def best_splits(sums: np.ndarray, leaf: int) -> list[tuple]:
    """Best border of each node from its (node, bin, gradient/hessian/count) sums: (gain, bin, left G, left H, G, H, n)."""
    left = sums.cumsum(1)
    total = left[:, -1:, :]
    right = total - left
    ok = ((left[..., 2] >= leaf) & (right[..., 2] >= leaf)
          & (left[..., 1] >= LEAST_HESSIAN) & (right[..., 1] >= LEAST_HESSIAN))
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left[..., 0] ** 2 / left[..., 1] + right[..., 0] ** 2 / right[..., 1] - total[..., 0] ** 2 / total[..., 1])
    gain = np.where(ok, gain, -np.inf)
    best = gain.argmax(1)
    node = np.arange(len(best))
    return [(float(g), int(b), float(lg), float(lh), float(t[0]), float(t[1]), int(t[2])) for g, b, lg, lh, t in zip(
        gain[node, best], best, left[node, best, 0], left[node, best, 1], total[:, 0])]


def fold_trees(x: np.ndarray, y: np.ndarray, base: float, depth: int, rate: float, rounds: int, leaf: int) -> tuple[np.ndarray, ...]:
    """Feature, bar and value (round, node) of one fold's trees from its bins (column, row), which hold no MISSING."""
    c, n = x.shape
    flat, row, m = x.ravel(), np.arange(n), np.full(n, base)
    feature, bar = np.full((rounds, 2 ** (depth + 1) - 1), -1, "i4"), np.zeros((rounds, 2 ** (depth + 1) - 1), "i4")
    value = np.zeros(bar.shape)
    for at in range(rounds):
        p = 1 / (1 + np.exp(-m))
        grad, hess, node = p - y, p * (1 - p), np.zeros(n, "i8")
        for level in range(depth):
            width = 2 ** level
            on = node >= width - 1                             # rows in nodes of this level
            whole = bool(on.all())
            mine = slice(None) if whole else np.flatnonzero(on)
            cell, g, h = (node[mine] - (width - 1)) * 256, grad[mine], hess[mine]
            sums = np.empty((c, width * 256, 3))
            for j in range(c):
                place = cell + x[j][mine]
                sums[j, :, 0] = np.bincount(place, g, width * 256)
                sums[j, :, 1] = np.bincount(place, h, width * 256)
                # the least hessian asks for a row already
                sums[j, :, 2] = np.bincount(place, minlength=width * 256) if leaf > 1 else sums[j, :, 1] > 0
            found = best_splits(sums.reshape(c * width, 256, 3), leaf)
            if level == 0 and found[0][5] > 0:
                value[at, 0] = -rate * found[0][4] / found[0][5]
            for i in range(width):
                of = found[i::width]                           # one per column
                j = max(range(c), key=lambda q: of[q][0])      # the first of equals
                gain, b, lg, lh, tg, th, _ = of[j]
                if gain > 0:
                    here = width - 1 + i
                    feature[at, here], bar[at, here] = j, b
                    value[at, 2 * here + 1], value[at, 2 * here + 2] = -rate * lg / lh, -rate * (tg - lg) / (th - lh)
            if (feature[at, width - 1:2 * width - 1] < 0).all():
                break
            f = feature[at][node]
            right = flat[np.maximum(f, 0) * n + row] > bar[at][node]
            node = np.where(on & (f >= 0), 2 * node + 1 + right, node)
        m += value[at][node]
    return feature, bar, value


SPLIT = {"fold": pa.int32(), "col": pa.int32(), "node": pa.int32(), "gain": pa.float64(), "bin": pa.int32(), "lg": pa.float64(),
         "lh": pa.float64(), "g": pa.float64(), "h": pa.float64(), "n": pa.int64()}


# --- fitting ---------------------------------------------------------------------------------------------

def _written(df: DataFrame) -> DataFrame:
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/boost-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quantile_borders(df: DataFrame, columns: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Up to ``bins`` - 1 ascending borders per column, all columns in one aggregate."""
    shares = [i / bins for i in range(1, bins)]
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    row = df.agg(*[F.percentile_approx(number(c), shares, 20_000).alias(f"b{i}") for i, c in enumerate(columns)]).first()
    return [np.unique(np.array(row[f"b{i}"] or [], "f8")) for i in range(len(columns))]


def fit_folds(df: DataFrame, columns: Sequence[str], left_out: Sequence[Collection], group: str = "game_id",
              label: str = "label", depth: int = 4, rate: float = 0.08, rounds: int = 500, leaf: int = 40) -> Forest:
    """Boosted trees of every fold: fold k learns from all rows whose group is not in ``left_out[k]``.

    Logistic loss, trees of ``depth`` levels with at least ``leaf`` rows per leaf, Newton leaf values times ``rate``.  Missing
    values take the bin of the training median of the fold, found from the bin counts.  Rows without a label of 0
    or 1 are not learned from.  Equal gains take the first column, then the lowest border.  A fold without
    rows or with one class predicts its base rate.

    Up to ``FOLD_ROWS`` rows each fold is dealt to a task, which grows all its trees.  Beyond, every tree level is one pass over
    the binned rows, with the same result: the margins of all folds are written every ``KEEP`` rounds, passes
    between two writes add the trees since, and the driver sees one split per (fold, node, column).
    """
    columns, spark = list(columns), df.sparkSession
    k, c = len(left_out), len(columns)
    groups = [r[0] for r in df.select(group).distinct().collect()]        # a manifest-sized list
    number = {g: i for i, g in enumerate(groups)}
    use = np.array([[g not in out for out in left_out] for g in groups], bool).reshape(len(groups), k)
    borders = quantile_borders(df, columns)

    def binned(batches):
        for b in batches:
            bins = bins_of(b, columns, borders)
            yield pa.RecordBatch.from_arrays([
                pa.array([number[g] for g in b.column(group).to_pylist()], pa.int32()), b.column(label).cast(pa.int8()),
                pa.array([r.tobytes() for r in bins], pa.binary()), pa.array([None] * len(bins), pa.binary())],
                names=["g", "y", "bins", "margins"])
    rows = df.where(F.col(label).isin(0, 1)).select(group, F.col(label).cast("tinyint").alias(label), *[
        F.col(x).cast("double").alias(x) for x in columns if x not in (group, label)])
    n = rows.count()
    state = _written(rows.mapInArrow(binned, "g int, y tinyint, bins binary, margins binary").repartition(max(1, -(-n // PART_ROWS))))

    def arrays(b):
        x = np.frombuffer(b"".join(b.column("bins").to_pylist()), "u1").reshape(-1, c)
        return b.column("g").to_numpy(), b.column("y").to_numpy().astype("f8"), x

    def counts(batches):
        held = np.zeros((len(groups), 2 + c * 256), "i8")
        for b in batches:
            g, y, x = arrays(b)
            np.add.at(held, (g, y.astype("i8")), 1)
            for j in range(c):
                np.add.at(held, (g, 2 + 256 * j + x[:, j].astype("i8")), 1)
        at, cell = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype("i4")), pa.array(cell.astype("i4")), pa.array(held[at, cell])],
                                         names=["g", "cell", "n"])
    seen = np.zeros((len(groups), 2 + c * 256), "i8")
    for r in state.mapInArrow(counts, "g int, cell int, n bigint").groupBy("g", "cell").agg(F.sum("n").alias("n")).collect():
        seen[r.g, r.cell] = r.n
    fold = use.T.astype("i8") @ seen                                       # what each fold learns from
    known = fold[:, 2:].reshape(k, c, 256)[:, :, :MISSING].cumsum(2)
    impute = (known * 2 >= np.maximum(known[:, :, -1:], 1)).argmax(2).astype("u1")
    ones, zeros = fold[:, 1].astype("f8"), fold[:, 0].astype("f8")
    base = np.where((ones > 0) & (zeros > 0), np.log(np.maximum(ones, 1e-300) / np.maximum(zeros, 1e-300)),
                    np.where(ones > 0, 35.0, np.where(zeros > 0, -35.0, 0.0)))
    forest = Forest(columns, borders, impute, base, depth)
    n_nodes, recent = 2 ** (depth + 1) - 1, 0

    def margins(b, x, trees):
        kept = b.column("margins")
        start = np.tile(base, (len(x), 1)) if kept.null_count else np.frombuffer(
            b"".join(kept.to_pylist()), "f8").reshape(-1, k)
        return margins_of(x, start, trees, depth)

    def add_sums(held, level, tree, g, y, x, m):
        """Add the rows' gradients, hessians and counts by (fold, column, node and bin)."""
        width = 2 ** level
        p = 1 / (1 + np.exp(-m))
        node = nodes_of(x, tree, level) - (width - 1)
        for f in range(k):
            mine = np.flatnonzero(use[g, f] & (node[:, f] >= 0))
            cell = node[mine, f] * 256
            grad = p[mine, f] - y[mine]
            hess = p[mine, f] * (1 - p[mine, f])
            for j in range(c):
                place = cell + x[mine, f, j]
                held[f, j, :, 0] += np.bincount(place, grad, width * 256)
                held[f, j, :, 1] += np.bincount(place, hess, width * 256)
                held[f, j, :, 2] += np.bincount(place, minlength=width * 256)

    def splits(f, j, level, sums):
        width = 2 ** level
        return [(f, j, width - 1 + i, *s) for i, s in enumerate(best_splits(sums.reshape(width, 256, 3), leaf))]

    def grow(find):
        """One tree per fold; ``find(tree, level)`` gives the best split of each (fold, column, node)."""
        tree = (np.full((k, n_nodes), -1, "i4"), np.zeros((k, n_nodes), "i4"), np.zeros((k, n_nodes)))
        for level in range(depth):
            best: dict[tuple[int, int], tuple] = {}
            for f, col, node, gain, bar, lg, lh, g, h, _ in sorted(find(tree, level), key=lambda r: (r[0], r[2], r[1])):
                if level == 0 and h > 0:
                    tree[2][f, 0] = -rate * g / h
                if gain > 0 and gain > best.get((f, node), (0.0,))[0]:
                    best[f, node] = (gain, col, bar, lg, lh, g, h)
            for (f, node), (_, col, bar, lg, lh, g, h) in best.items():
                tree[0][f, node], tree[1][f, node] = col, bar
                tree[2][f, 2 * node + 1], tree[2][f, 2 * node + 2] = -rate * lg / lh, -rate * (g - lg) / (h - lh)
            if not best:
                break
        return tree

    def dealt(batches):
        """Every fold's copy of the rows it learns from."""
        for b in batches:
            g = b.column("g").to_numpy()
            for f in range(k):
                mine = pa.array(np.flatnonzero(use[g, f]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), f, "i4")), b.column("y").take(mine),
                                                  b.column("bins").take(mine)], names=["fold", "y", "bins"])

    def all_rounds(batches):
        """All trees of the folds dealt to this task."""
        held: dict[int, list] = {}
        for b in batches:
            of = b.column("fold").to_numpy()
            for f in np.unique(of):
                mine = b.filter(pa.array(of == f))
                held.setdefault(int(f), []).append((mine.column("y").to_numpy(), np.frombuffer(
                    b"".join(mine.column("bins").to_pylist()), "u1").reshape(-1, c)))
        for f in sorted(held):
            parts = held.pop(f)
            y, x = (np.concatenate([p[i] for p in parts]) for i in range(2))
            del parts
            x = np.ascontiguousarray(np.where(x == MISSING, impute[f], x).T)
            trees = fold_trees(x, y.astype("f8"), float(base[f]), depth, rate, rounds, leaf)
            yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), *[pa.array([t.tobytes()], pa.binary()) for t in trees]],
                                             names=["fold", "feature", "bar", "value"])

    def level_pass(trees, tree, level):
        def sums(batches):
            held = np.zeros((k, c, 2 ** level * 256, 3))
            for b in batches:
                step = max(4096, 8_000_000 // (k * c))
                for at in range(0, b.num_rows, step):
                    part = b.slice(at, step)
                    g, y, raw = arrays(part)
                    x = _filled(raw, impute)
                    add_sums(held, level, tree, g, y, x, margins(part, x, trees))
            for f in range(k):
                for j in range(c):
                    yield pa.RecordBatch.from_arrays([
                        pa.array([f], pa.int32()), pa.array([j], pa.int32()), pa.array([held[f, j].tobytes()], pa.binary())],
                        names=["fold", "col", "sums"])

        def added(t: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(v.as_buffer(), "f8") for v in t["sums"])
            found = splits(t["fold"][0].as_py(), t["col"][0].as_py(), level, total)
            return pa.table([pa.array(v, kind) for v, kind in zip(zip(*found), SPLIT.values())], names=list(SPLIT))
        schema = ", ".join(f"{n} {'int' if v == pa.int32() else 'bigint' if v == pa.int64() else 'double'}" for n, v in SPLIT.items())
        return [tuple(r) for r in state.mapInArrow(sums, "fold int, col int, sums binary").groupBy("fold", "col").applyInArrow(
            added, schema).collect()]

    if not n or not c:
        return forest
    if n <= FOLD_ROWS:
        folds = state.mapInArrow(dealt, "fold int, y tinyint, bins binary").repartitionById(max(1, k), "fold")
        grown = (np.full((rounds, k, n_nodes), -1, "i4"), np.zeros((rounds, k, n_nodes), "i4"), np.zeros((rounds, k, n_nodes)))
        for r in folds.mapInArrow(all_rounds, "fold int, feature binary, bar binary, value binary").collect():
            for to, v in zip(grown, r[1:]):
                to[:, r.fold] = np.frombuffer(v, to.dtype).reshape(rounds, n_nodes)
        forest.trees = list(zip(*grown))
        return forest
    for _ in range(rounds):
        trees = forest.trees[len(forest.trees) - recent:]
        forest.trees.append(grow(lambda tree, level: level_pass(trees, tree, level)))
        recent += 1
        if recent == KEEP:
            since = forest.trees[-recent:]

            def added_up(batches, since=since):
                for b in batches:
                    _, _, raw = arrays(b)
                    m = margins(b, _filled(raw, impute), since)
                    yield pa.RecordBatch.from_arrays([b.column("g"), b.column("y"), b.column("bins"), pa.array(
                        [r.tobytes() for r in m], pa.binary())], names=["g", "y", "bins", "margins"])
            state, recent = _written(state.mapInArrow(added_up, state.schema)), 0
    return forest


def score_folds(df: DataFrame, forest: Forest, scores: Mapping[str, Mapping], group: str = "game_id") -> DataFrame:
    """All columns plus one probability per name in ``scores``, which maps a row's group to the fold that scores it.

    Null where the group has no fold.
    """
    k, columns, names = len(forest.base), forest.columns, df.columns
    numbers = df.select(*df.columns, *[F.col(x).cast("double").alias(f"__x{i}") for i, x in enumerate(columns)])
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.DoubleType()) for n in scores]])
    inner = [f"__x{i}" for i in range(len(columns))]

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 65_536):
                b = whole.slice(at, 65_536)
                bins, games = bins_of(b, inner, forest.borders), b.column(group).to_pylist()
                out = [b.column(n) for n in names]
                for fold_of in scores.values():
                    fold, p = np.array([fold_of.get(g, k) for g in games], "i8"), np.zeros(len(bins))
                    for f in np.unique(fold[fold < k]):                    # each row by the trees of its own fold only
                        mine = np.flatnonzero(fold == f)
                        x = _filled(bins[mine], forest.impute[f:f + 1])
                        p[mine] = 1 / (1 + np.exp(-margins_of(x, np.full((len(mine), 1), forest.base[f]), [
                            tuple(t[f:f + 1] for t in tree) for tree in forest.trees], forest.depth)[:, 0]))
                    out.append(pa.array(p, mask=fold == k))
                yield pa.RecordBatch.from_arrays(out, names=[*names, *scores])
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))   # hundreds of trees a row: not merged by size
    return numbers.repartition(parts).mapInArrow(run, schema)


# --- validation over games -------------------------------------------------------------------------------

def out_of_fold(df: DataFrame, columns: Sequence[str], group: str = "game_id", **settings) -> DataFrame:
    """Probability ``p`` of every row by the trees of the other games."""
    df = cut(df)
    games = sorted(r[0] for r in df.select(group).distinct().collect())
    forest = fit_folds(df, columns, [{g} for g in games], group, **settings)
    return score_folds(df, forest, {"p": {g: i for i, g in enumerate(games)}}, group)


def leave_one_game_out(df: DataFrame, columns: Sequence[str], group: str = "game_id",
                       grid: Sequence[float] = tuple(E.grid(0.30, 0.85, 0.01)), **settings) -> DataFrame:
    """Per held-out game: threshold from an inner validation game (the next one in order), then its metrics.

    All games' trees grow in the same passes; the thresholds of all inner games come from one sweep.
    """
    df = cut(df)
    games = sorted(r[0] for r in df.select(group).distinct().collect())
    inner = {g: games[(i + 1) % len(games)] for i, g in enumerate(games)}
    forest = fit_folds(df, columns, [{g, inner[g]} for g in games], group, **settings)
    scored = score_folds(df, forest, {"p": {g: i for i, g in enumerate(games)},
                                      "p_val": {inner[g]: i for i, g in enumerate(games)}}, group)
    picked = E.threshold_by_shortfall(E.sweep(scored, grid, [group], score="p_val"), [group])
    names = df.sparkSession.createDataFrame([(g, v) for g, v in inner.items()], T.StructType([
        df.schema[group], T.StructField("_inner", df.schema[group].dataType)]))            # one row per game
    thresholds = F.broadcast(names.join(picked.select(F.col(group).alias("_inner"), "threshold"), "_inner").drop("_inner"))
    test = scored.join(thresholds, group).withColumn("pred", (F.col("p") >= F.col("threshold")).cast("int"))
    return E.binary_metrics(test, [group]).join(thresholds, group)
