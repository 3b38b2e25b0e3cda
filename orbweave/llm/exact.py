"""Exact duplicates of verdict texts: a minimal perfect hash over the digests seen before, then grouping."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orbweave.llm.common import join_back, slices, texts, written

BUCKET_KEYS = 4096


# --- digests ---------------------------------------------------------------------------------------------

def digests(rows: DataFrame, key: str = "name", text: str = "verdict") -> DataFrame:
    """One row per input row: key, SHA-256 of the text with A-Z lower-cased (null text counts as empty)."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        for b in slices(batches, 2000):
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([hashlib.sha256(t.lower()).digest() for t in texts(b.column(1))], pa.binary())],
                names=["key", "digest"])
    return rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"key {kind}, digest binary")


# --- the minimal perfect hash ----------------------------------------------------------------------------

def _parts(digest_matrix: np.ndarray) -> np.ndarray:
    """Four 64-bit words of each 32-byte digest."""
    return digest_matrix.view("<u8").reshape(-1, 4)


def _slot(words: np.ndarray, pilot: np.ndarray, n: int) -> np.ndarray:
    """Slot of a digest under its group's pilot: a multiplicative mix of two digest words."""
    with np.errstate(over="ignore"):
        x = words[:, 1] ^ (pilot.astype("u8") * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + words[:, 2]
        x ^= x >> np.uint64(29)
    return (x % np.uint64(n)).astype(np.int64)


def build_mph(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pilots per group and each key's slot, a bijection onto 0..n-1, for distinct 32-byte digests.

    Keys are dealt into groups of about four by a digest word; groups are placed largest first, each with the
    first pilot that sends all its keys to free, different slots.
    """
    words, n = _parts(keys), len(keys)
    groups = max(1, (n + 3) // 4)
    group = (words[:, 0] % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[order], np.arange(groups + 1))
    pilots, slots, taken = np.zeros(groups, "u4"), np.zeros(n, np.int64), np.zeros(n, bool)
    sizes = np.diff(starts)
    for g in np.argsort(-sizes, kind="stable"):
        k = sizes[g]
        if not k:
            break
        mine, first = order[starts[g]:starts[g + 1]], 0
        while True:
            tries = np.arange(first, first + 64)
            at = _slot(np.repeat(words[mine], 64, axis=0), np.tile(tries, k), n).reshape(k, 64)
            good = ~taken[at].any(axis=0)
            if k > 1:
                s = np.sort(at, axis=0)
                good &= (s[1:] != s[:-1]).all(axis=0)
            if good.any():
                t = int(np.argmax(good))
                pilots[g], slots[mine] = first + t, at[:, t]
                taken[at[:, t]] = True
                break
            first += 64
    return pilots, slots


def find_slots(pilots: np.ndarray, n: int, keys: np.ndarray) -> np.ndarray:
    """The slot each digest would have; only a comparison with the digest held there tells whether it is a member."""
    words = _parts(keys)
    group = (words[:, 0] % np.uint64(len(pilots))).astype(np.int64)
    return _slot(words, pilots[group], n)


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), "u1").reshape(-1, 32)


def _bucket(digest, buckets: int):
    return F.pmod(F.xxhash64(digest), F.lit(buckets)).cast("int")


def digest_index(history: DataFrame, buckets: int) -> DataFrame:
    """The index over distinct digests of ``history`` (digest, winner, copies): one row per bucket.

    A bucket holds about ``BUCKET_KEYS`` digests; ``slots`` has their 32 bytes at the place the hash gives, with
    the winner's key and the number of copies beside it.
    """
    key_type = history.schema["winner"].dataType.simpleString()

    def build(part: pa.Table) -> pa.Table:
        keys = _matrix(part["digest"].to_pylist())
        pilots, slot = build_mph(keys)
        order = np.argsort(slot)
        held = part.take(pa.array(order))
        return pa.table({
            "bucket": part["bucket"].slice(0, 1), "pilots": pa.array([pilots.tobytes()], pa.binary()),
            "slots": pa.array([keys[order].tobytes()], pa.binary()),
            "winners": pa.array([held["winner"].to_pylist()], pa.list_(part.schema.field("winner").type)),
            "copies": pa.array([held["copies"].to_pylist()], pa.list_(pa.int64()))})
    return history.withColumn("bucket", _bucket(F.col("digest"), buckets)).groupBy("bucket").applyInArrow(
        build, f"bucket int, pilots binary, slots binary, winners array<{key_type}>, copies array<bigint>")


def look_up(new: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """Distinct digests of ``new`` (digest, winner, copies) with ``old_winner`` and ``old_copies`` of the index.

    ``old_copies`` is null for a digest that is not a member: the full 32 bytes in its slot differ.
    """
    key_type = new.schema["winner"].dataType.simpleString()

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        winners, copies = [None] * left.num_rows, [None] * left.num_rows
        if left.num_rows and right.num_rows:
            row = right.slice(0, 1).to_pylist()[0]
            held = _matrix([row["slots"]])
            keys = _matrix(left["digest"].to_pylist())
            at = find_slots(np.frombuffer(row["pilots"], "u4"), len(held), keys)
            for i in np.flatnonzero((held[at] == keys).all(axis=1)).tolist():
                winners[i], copies[i] = row["winners"][at[i]], row["copies"][at[i]]
        out = left.select(["digest", "winner", "copies"])
        return (out.append_column("old_winner", pa.array(winners, left.schema.field("winner").type))
                .append_column("old_copies", pa.array(copies, pa.int64())))
    left = new.withColumn("bucket", _bucket(F.col("digest"), buckets))
    return left.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(
        probe, f"digest binary, winner {key_type}, copies bigint, old_winner {key_type}, old_copies bigint")


# --- the operator ----------------------------------------------------------------------------------------

def exact_duplicates(rows: DataFrame, is_history, key: str = "name", text: str = "verdict") -> DataFrame:
    """Every verdict row with the row that stays for its text.

    Texts are equal when identical after lower-casing A-Z; of equal texts the largest key stays.  ``is_history``
    (a condition on the columns of ``rows``) marks the rows seen before: their distinct digests get a minimal
    perfect hash whose slots hold the full digest and the winner, and the digests of the other rows are looked up
    in it byte for byte.  Members join their old group; the rest forms groups of its own.

    Returns key, keep_key, group_size, kept, text_sha256, seen_before (the text is in the history) for each
    row.  Null texts count as empty.  Null keys lose against others; among rows of equal text and equal (or
    only null) key all are kept, since nothing tells them apart.  Other columns of ``rows`` are not read; an
    empty table gives an empty result.

    Digests are aggregated before any shuffle that brings equal ones together, so a text with a third of all
    rows is one row per task there.  The way back to the rows sends the texts with more than a thousandth of all
    rows (at most 1,000 of them) to every task, and joins the rest.
    """
    flagged = rows.select(F.struct(F.col(key), F.coalesce(is_history, F.lit(False)).alias("old")).alias("key"),
                          F.col(text).alias("text"))
    hashed = written(digests(flagged, "key", "text").select(
        F.col(f"key.{key}").alias("key"), F.col("key.old").alias("old"), "digest"), "digests")
    per_text = lambda df: df.groupBy("digest").agg(
        F.max("key").alias("winner"), F.count(F.lit(1)).alias("copies"))
    total = hashed.count()
    buckets = max(1, -(-total // BUCKET_KEYS))
    history = per_text(hashed.where("old"))
    found = written(look_up(per_text(hashed.where(~F.col("old"))), digest_index(history, buckets), buckets), "lookups")
    members = found.where("old_copies is not null")
    groups = written(
        found.select("digest", F.greatest("winner", "old_winner").alias("keep_key"),     # greatest skips nulls
                     (F.col("copies") + F.coalesce("old_copies", F.lit(0))).alias("group_size"),
                     F.col("old_copies").isNotNull().alias("seen_before"))
        .unionByName(history.join(members, "digest", "left_anti").select(
            "digest", F.col("winner").alias("keep_key"), F.col("copies").alias("group_size"),
            F.lit(True).alias("seen_before"))), "text-groups")
    both = join_back(hashed, groups, "digest", "group_size", total)
    return both.select(
        F.col("key").alias(key), F.col("keep_key"), F.col("group_size"),
        F.col("key").eqNullSafe(F.col("keep_key")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), F.col("seen_before"))
