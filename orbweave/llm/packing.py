"""Verdict texts packed into training sequences: length patterns fitted to the length histogram."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from orbweave.llm.common import slices, texts, written
from orbweave.llm.wordbpe import END_ID, word_ids

CAPACITY = 4096
GRAIN = 8            # lengths are rounded up to multiples of this when patterns are fitted


# --- the plan: patterns and their repeat counts, from the histogram alone ---------------------------------

def patterns_of(present: np.ndarray, units: int) -> list[tuple[int, ...]]:
    """Patterns of one to three lengths (largest first) from the lengths present: all that fill ``units`` exactly, and of
    every length with each other one the closest that leave space: no third length would fit in better."""
    have = np.zeros(units + 1, bool)
    have[present] = True
    fits = np.where(have, np.arange(units + 1), 0)
    fits = np.maximum.accumulate(fits)                          # the largest length present up to each size
    out = []
    for a in present[::-1].tolist():
        best = int(min(fits[units - a], a))
        if not best or a + best < units:
            out.append((a, best) if best else (a,))
        for b in range(best, 0, -1):
            if not have[b]:
                continue
            c = int(min(fits[units - a - b], b))
            if a + b + c == units or b == best:
                pattern = (a, b, c) if c else (a, b)
                if pattern != out[-1] if out else True:
                    out.append(pattern)
    return out


def non_negative_fit(columns: np.ndarray, histogram: np.ndarray, rounds: int = 400, at_once: int = 8,
                     slack: np.ndarray | None = None) -> np.ndarray:
    """Least-squares repeat counts x >= 0 of the patterns: ``sum of x * column`` close to the histogram.

    Active-set method: patterns whose gradient is largest join the passive set, the set is solved without bounds,
    and a step towards the solution stops where the first count reaches zero, which leaves the set.
    ``columns`` has each pattern's up to three lengths as indexes, -1 where it has fewer.  ``slack`` is the share of a
    sequence that each pattern leaves open; it counts as one more row of the fit, whose target is 0.
    """
    n = len(columns)
    x, passive = np.zeros(n), []
    used = columns >= 0
    safe = np.where(used, columns, 0)
    waste = np.zeros(n) if slack is None else slack

    def dense(members):
        a = np.zeros((len(histogram) + 1, len(members)))
        for j, m in enumerate(members):
            for c in columns[m][used[m]]:
                a[c, j] += 1
        a[-1] = waste[members]
        return a
    target = np.append(histogram, 0.0)
    for _ in range(rounds):
        covered = np.bincount(safe[used], np.broadcast_to(x[:, None], columns.shape)[used], minlength=len(histogram))
        gradient = np.where(used, (histogram - covered)[safe], 0.0).sum(1) - waste * (waste @ x)
        gradient[passive] = -np.inf
        best = np.argsort(-gradient, kind="stable")[:at_once]
        best = best[gradient[best] > 1e-6 * max(1.0, histogram.max())]
        if not len(best):
            break
        passive = passive + best.tolist()
        while passive:
            a = dense(passive)
            z = np.linalg.solve(a.T @ a + 1e-9 * np.eye(len(passive)), a.T @ target)
            if (z > 0).all():
                x[passive] = z
                break
            now = x[passive]
            low = z <= 0
            share = (now[low] / np.maximum(now[low] - z[low], 1e-300)).min()
            moved = now + share * (z - now)
            x[passive] = moved
            gone = low & (moved <= 1e-9)                         # members that block the step; new ones at 0 stay
            x[[m for m, g in zip(passive, gone) if g]] = 0
            passive = [m for m, g in zip(passive, gone) if not g]
    return x


def best_fit(counts: dict[int, int], open_packs: dict[int, list], units: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: equal lengths go together into equal packs.

    ``open_packs``: space left -> [(pattern, number of packs)].  Returns all packs as patterns with counts.
    """
    spaces = sorted(open_packs)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect_left(spaces, length)
            if i == len(spaces):
                space, pattern, n = units, (), left if length * 2 > units else -(-left // (units // length))
            else:
                space = spaces[i]
                pattern, n = open_packs[space].pop()
                if not open_packs[space]:
                    del open_packs[space], spaces[i]
            fill = max(1, min(space // length, -(-left // n)))       # as many as fit in each, while they last
            whole = min(n, left // fill)
            for packs, each in ((whole, fill), (1 if whole < n and left - whole * fill else 0, left - whole * fill)):
                if packs:
                    left -= packs * each
                    n -= packs
                    rest = space - each * length
                    if rest not in open_packs:
                        open_packs[rest] = []
                        insort(spaces, rest)
                    open_packs[rest].append((pattern + (length,) * each, packs))
            if n and pattern:
                if space not in open_packs:
                    open_packs[space] = []
                    insort(spaces, space)
                open_packs[space].append((pattern, n))
    return [p for packs in open_packs.values() for p in packs]


def _exact(pattern: tuple[int, ...], n: int, lengths: dict[int, list[list[int]]]):
    """``n`` repeats of a pattern of rounded lengths with exact ones for them, longest first: (exact pattern, repeats).

    ``lengths``: rounded length -> [exact length, pieces left], longest last; what is used is taken from it.  Each
    entry but the last uses up one exact length, so there are at most as many entries more as lengths.
    """
    while n:
        chosen, times = [], n
        for k in set(pattern):
            m = pattern.count(k)
            length, left = lengths[k][-1]
            if left >= m:
                times = min(times, left // m)
                chosen += [length] * m
            else:                                    # the last ones of a length share a pack with the next length
                times, need = 1, m
                for length, left in reversed(lengths[k]):
                    chosen += [length] * min(left, need)
                    need -= min(left, need)
                    if not need:
                        break
        for length in chosen:
            k = next(k for k in set(pattern) if any(x[0] == length for x in lengths[k]))
            entry = next(x for x in lengths[k] if x[0] == length)
            entry[1] -= times
            if not entry[1]:
                lengths[k].remove(entry)
        yield tuple(sorted(chosen, reverse=True)), times
        n -= times


def plan(histogram: dict[int, int], capacity: int, grain: int = 1) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with repeat counts that place every length of the histogram exactly once.

    Lengths are rounded up to ``grain`` only where patterns are enumerated and fitted; what a pattern's exact lengths
    leave open, and the rest, is filled by exact lengths.  While there are more sequences than the tokens need, the
    emptiest are taken apart and their pieces placed again, twice as many each time.
    """
    packs = _fitted(histogram, capacity, grain)
    rest = dict(histogram)
    for pattern, n in packs:
        for k in pattern:
            rest[k] -= n
    done = best_fit({k: n for k, n in rest.items() if n}, _by_space(packs, capacity), capacity)
    least = -(-sum(k * n for k, n in histogram.items()) // capacity)
    apart = max(1, sum(n for _, n in done) // 64)
    total = sum(n for _, n in done)
    while total > least:
        again, whole = _taken_apart(done, apart, capacity), apart >= total
        if sum(n for _, n in again) < total:
            done, total = again, sum(n for _, n in again)
        if whole:
            break
        apart *= 2
    return done


def _by_space(packs, capacity: int) -> dict[int, list]:
    out: dict[int, list] = {}
    for pattern, n in packs:
        out.setdefault(capacity - sum(pattern), []).append((pattern, n))
    return out


def _taken_apart(packs, count: int, capacity: int):
    """The packs after the pieces of the ``count`` emptiest went best-fit-decreasing into the others and new ones."""
    kept, pieces = [], {}
    for pattern, n in sorted(packs, key=lambda p: (sum(p[0]), p)):
        gone = min(n, count)
        count -= gone
        for k in pattern if gone else ():
            pieces[k] = pieces.get(k, 0) + gone
        if n > gone:
            kept.append((pattern, n - gone))
    return best_fit(pieces, _by_space(kept, capacity), capacity)


def _fitted(histogram: dict[int, int], capacity: int, grain: int) -> list[tuple[tuple[int, ...], int]]:
    """Packs of the fitted patterns, in exact lengths; their counts are rounded down."""
    exact: dict[int, list[list[int]]] = {}
    for length in sorted(histogram):
        if histogram[length]:
            exact.setdefault(-(-length // grain), []).append([length, int(histogram[length])])
    left = {k: sum(n for _, n in entries) for k, entries in exact.items()}
    units, out = capacity // grain, []
    if not left:
        return out
    present = np.array(sorted(left))
    found = patterns_of(present, units)
    columns = np.full((len(found), 3), -1)
    for i, p in enumerate(found):
        columns[i, :len(p)] = p
    target = np.zeros(units + 1)
    target[present] = [left[k] for k in present.tolist()]
    slack = 1 - np.array([sum(p) for p in found]) / units
    repeats = np.floor(non_negative_fit(columns, target, slack=slack) + 1e-6).astype(int)
    for i in np.lexsort((-repeats, slack)):
        pattern, need = found[i], {}
        for k in pattern:
            need[k] = need.get(k, 0) + 1
        n = min(int(repeats[i]), *(left.get(k, 0) // m for k, m in need.items()))
        if n > 0:
            for k, m in need.items():
                left[k] -= n * m
            out += _exact(pattern, n, exact)
    return out


def slots(patterns: list[tuple[tuple[int, ...], int]]):
    """Per length: first rank, first sequence and place of each run of equal slots; ranks run from 0."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for pattern, n in patterns:
        for place, k in enumerate(pattern):
            runs.setdefault(k, []).append((used.get(k, 0), sequence, place))
            used[k] = used.get(k, 0) + n
        sequence += n
    return {k: np.array(v, "i8") for k, v in runs.items()}


# --- on Spark --------------------------------------------------------------------------------------------

def pieces_of(rows: DataFrame, tokenizer: str, key: str = "name", text: str = "verdict",
              capacity: int = CAPACITY) -> DataFrame:
    """Token pieces of every text: key, piece, start, length, ids_crc32, task, nth.

    ``nth`` counts the pieces of a length within a task, so that ranks need no sort.
    """
    kind = rows.schema[key].dataType.simpleString()
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        encoder, task, seen = word_ids(tokenizer), TaskContext.get().partitionId(), {}
        for b in slices(batches, 256):
            out = [[], [], [], [], [], []]
            for k, ids in zip(b.column(0).to_pylist(), encoder.encode_all(list(texts(b.column(1))))):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    length = len(part) // 4
                    nth = seen.get(length, 0)
                    seen[length] = nth + 1
                    for column, v in zip(out, (k, piece, at // 4, length, zlib.crc32(part), nth)):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([
                pa.array(out[0], b.schema.field(0).type), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()),
                pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64()), pa.array(out[5], pa.int64()),
                pa.array([task] * len(out[0]), pa.int32())],
                names=["key", "piece", "start", "length", "ids_crc32", "nth", "task"])
    return rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, nth bigint, task int")


def pack(rows: DataFrame, tokenizer: str, key: str = "name", text: str = "verdict", capacity: int = CAPACITY,
         grain: int = GRAIN) -> DataFrame:
    """Pack verdict texts into sequences of at most ``capacity`` tokens.

    A text's ids are followed by id 1; only longer ones are cut, into pieces of ``capacity``.  Returns per piece:
    key, piece, start, length, ids_crc32, sequence_id, offset.  Null or empty texts are one piece of length 1;
    repeated rows are packed each; an empty table gives none; other columns are not read.

    The histogram of lengths (at most ``capacity`` numbers) is all the driver sees.  Patterns of up to three
    lengths that fill a sequence are fitted to it by non-negative least squares, counts are rounded down, and what
    is left goes best-fit-decreasing into patterns and new sequences.  The plan has one entry per distinct pattern,
    a number bounded by the histogram, not by the rows.  ``grain`` rounds lengths only while patterns are enumerated and
    fitted; space is counted in exact lengths.
    """
    if capacity % grain:
        raise ValueError("capacity must be a multiple of grain")
    parts = written(pieces_of(rows, tokenizer, key, text, capacity), "pieces")
    counts = written(parts.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = slots(plan(histogram, capacity, grain))
    before = counts.select("length", "task", (F.sum("n").over(
        Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    ranked = parts.join(before.hint("merge"), ["length", "task"]).withColumn("rank", F.col("before") + F.col("nth"))

    def place(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, slot = np.zeros(len(length), "i8"), np.zeros(len(length), "i8")
            order = np.argsort(length, kind="stable")
            firsts = np.flatnonzero(np.diff(length[order], prepend=-1))
            for mine in np.split(order, firsts[1:]) if len(order) else []:
                run = runs[int(length[mine[0]])]
                at = np.searchsorted(run[:, 0], rank[mine], side="right") - 1
                sequence[mine], slot[mine] = run[at, 1] + rank[mine] - run[at, 0], run[at, 2]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("key", "piece", "start", "length", "ids_crc32")), pa.array(sequence),
                 pa.array(slot)], names=["key", "piece", "start", "length", "ids_crc32", "sequence_id", "slot"])
    kind = rows.schema[key].dataType.simpleString()
    placed = ranked.select("key", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        place, f"key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, slot bigint")
    earlier = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        F.col("key").alias(key), "piece", "start", "length", "ids_crc32", "sequence_id",
        F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("long").alias("offset"))
