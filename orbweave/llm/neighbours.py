"""Nearest clip signals by cosine: a block matrix product over int8 tiles with error bounds."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

TILE, PART = 4096, 512            # candidates and queries compared at once
TILES, TILE_BYTES = 64, 1 << 25   # parts of the candidates, unless a part has fewer than TILE rows or more bytes of doubles


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of unit rows, their scales, the norms of what the codes stand for and of what they miss."""
    scale = np.abs(x).max(axis=1) / 127.0
    codes = np.rint(x / np.where(scale > 0, scale, 1)[:, None]).astype("i1")
    stand = codes * scale[:, None]
    return codes, scale, np.linalg.norm(stand, axis=1), np.linalg.norm(x - stand, axis=1)


def tile_bounds(q, c) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of a tile and the most that each can be off.

    With x = x' + r (code and residue): |x.y - x'.y'| <= |r_x||y'| + |x||r_y|, and |x| = 1.  The int8 product
    is exact in 32-bit floats up to 1,040 components, which are therefore taken 1,024 at a time.
    """
    dot = np.zeros((len(q[0]), len(c[0])))
    for at in range(0, q[0].shape[1], 1024):
        dot += q[0][:, at:at + 1024].astype("f4") @ c[0][:, at:at + 1024].astype("f4").T
    return dot * q[1][:, None] * c[1][None, :], q[3][:, None] * c[2][None, :] + c[3][None, :] + 1e-9


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosine in double precision; sums run from the first component to the last."""
    total = lambda x: np.cumsum(x, axis=1)[:, -1]
    return total(a * b) / (np.sqrt(total(a * a)) * np.sqrt(total(b * b)))


def tile_best(ids, x, q_ids, qx, k: int):
    """The ``k`` best candidates of each query in one tile: query ids, ids and cosines, exact."""
    unit = lambda v: v / np.sqrt((v * v).sum(1))[:, None]
    codes, q_codes = quantise(unit(x)), quantise(unit(qx))
    found = []
    for c in (slice(i, i + TILE) for i in range(0, len(ids), TILE)):
        for q in (slice(i, i + PART) for i in range(0, len(q_ids), PART)):
            found += part_best(ids[c], x[c], [v[c] for v in codes], q_ids[q], qx[q], [v[q] for v in q_codes], k)
    q, c, score = map(np.concatenate, zip(*found)) if found else (q_ids[:0], ids[:0], np.zeros(0))
    order = np.lexsort((c, -score, q))
    q, c, score = q[order], c[order], score[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], c[keep], score[keep]


def part_best(ids, x, codes, q_ids, qx, q_codes, k: int):
    """The ``k`` best candidates of each query, or a few more, from rows and their int8 codes: (query ids, ids, cosines)."""
    estimate, off = tile_bounds(q_codes, codes)
    same = q_ids[:, None] == ids[None, :]
    low = np.where(same, -np.inf, estimate - off)
    kth = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(q_ids), -np.inf)
    rows, columns = np.nonzero((estimate + off >= kth[:, None]) & ~same)
    for at in range(0, len(rows), 200_000):       # a chunk may end inside a query: the merge allows for that
        r, c = rows[at:at + 200_000], columns[at:at + 200_000]
        score = cosines(qx[r], x[c])
        order = np.lexsort((ids[c], -score, r))
        r, c, score = r[order], c[order], score[order]
        first = np.searchsorted(r, r)
        keep = np.arange(len(r)) - first < k
        yield q_ids[r[keep]], ids[c[keep]], score[keep]


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows with a key and a vector of finite components that is not zero: key, vec (floats if they were, else doubles)."""
    single = isinstance(vectors.schema[vector].dataType.elementType, T.FloatType)
    v = F.col(vector) if single else F.transform(vector, lambda x: x.cast("double"))
    big = F.lit(float("inf"))
    return vectors.select(F.col(key).cast("long").alias("key"), v.alias("vec")).where(
        F.col("key").isNotNull() & F.col("vec").isNotNull()
        & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big))
        & F.exists("vec", lambda x: x != 0))


def nearest(vectors: DataFrame, queries, key: str = "clip", vector: str = "wave", k: int = 5, tile: int | None = None
            ) -> DataFrame:
    """The ``k`` nearest other clips of every query clip by cosine: query_id, rank, key, score.

    ``vectors``: one row per clip with an integer key and a signal array; ``queries``: a condition that marks the
    queries.  Exact: ties go to the smaller key, and a query with fewer candidates gets them all.  Vectors that
    are null, zero or hold a null or non-finite component take no part; vectors of different lengths are compared
    with those of their own length only.  Copies of a clip under other keys count; a query never finds its own key.

    Queries and candidates are dealt into tiles by a hash of the key, so every tile is one task's work of bounded size
    whatever the table's.  Rows are copied once per tile they are in and shuffled as rows, never packed or broadcast; a
    query is in as many tiles as the candidates have parts, a candidate in as many as the queries have.  The queries are one
    part up to TILE_BYTES; the candidates are TILES parts or, up to that size, fewer of TILE rows.  ``tile``: rows of a part of either.
    In a tile int8 products give all cosines with an error bound, some thousand rows at a time; only pairs whose upper
    bound reaches the k-th lower bound are computed again in double.  Each tile sends ``k`` rows per query to the
    merge, where a heap keeps the best.
    """
    base = usable(vectors, key, vector).withColumn("size", F.size("vec"))
    asked = usable(vectors.where(queries), key, vector).withColumn("size", F.size("vec"))
    rows, components = base.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    n_asked = asked.count()
    most = max(1, TILE_BYTES * rows // max(1, 8 * components))
    blocks = max(1, -(-rows // (tile or min(most, max(TILE, -(-rows // TILES))))))
    q_blocks = max(1, -(-n_asked // (tile or most)))

    def dealt(df, n, other, own_name, other_name):
        own = F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
        return df.withColumn(own_name, own).withColumn(other_name, each).groupBy("qb", "cb", "size")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        flat = lambda t: np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t["vec"].chunks]).astype("f8")
        found = (np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0))
        if left.num_rows and right.num_rows:
            found = tile_best(right["key"].to_numpy(), flat(right).reshape(right.num_rows, -1),
                              left["key"].to_numpy(), flat(left).reshape(left.num_rows, -1), k)
        return pa.table(dict(zip(("query_id", "key", "score"), found)))
    found = dealt(asked, q_blocks, blocks, "qb", "cb").cogroup(dealt(base, blocks, q_blocks, "cb", "qb")).applyInArrow(
        best, "query_id bigint, key bigint, score double")

    def merge(part: pa.Table) -> pa.Table:
        best: dict[int, list] = {}
        for q, c, s in zip(*(part[n].to_pylist() for n in ("query_id", "key", "score"))):
            heap = best.setdefault(q, [])
            item = (s, -c)
            if len(heap) < k:
                heapq.heappush(heap, item)
            elif item > heap[0]:
                heapq.heapreplace(heap, item)
        out = [(q, r + 1, -c, s) for q, heap in best.items() for r, (s, c) in enumerate(sorted(heap, reverse=True))]
        columns = list(zip(*out)) if out else [[], [], [], []]
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "rank": pa.array(columns[1], pa.int32()),
                         "key": pa.array(columns[2], pa.int64()), "score": pa.array(columns[3], pa.float64())})
    return found.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n_asked // 256)))).alias("part")).applyInArrow(
        merge, "query_id bigint, rank int, key bigint, score double").select(
            "query_id", "rank", F.col("key").alias(key), "score")
