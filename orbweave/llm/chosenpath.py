"""Similarity join of verdict texts on word n-grams: chosen-path splitting, then exact comparison."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from orbweave.llm.common import join_back, slices, texts, written

WORDS = 5
SIMILAR = 0.8
COORDINATES = 128        # sampled tokens that stand for a text while it is split
RUNS = 10                # independent runs; each splits twice at the second step
LIMIT = 256              # buckets up to this size are compared by brute force
LEVELS = 4               # steps of further splitting for larger buckets
BRANCHES = 3             # ways in which each larger bucket is split
DENSE = 0.3              # a bucket whose pairs agree this often on two sampled tokens is not split further
SKETCH_SLACK = 0.2       # pairs whose sketches agree on less than SIMILAR - this are not compared (over 5 deviations)
_ODD = np.uint64(0x9E3779B97F4A7C15)


# --- texts as sets ---------------------------------------------------------------------------------------

def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def shingles(words: list[bytes], size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; of all words where there are fewer, none for no words."""
    if not words:
        return np.zeros(0, "u8")
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "u8", len(words))
    n = max(1, len(h) - size + 1)
    total = np.zeros(n, "u8")
    for i in range(min(size, len(h))):
        total = total * _ODD + h[i:i + n]
    return np.unique(mix(total + np.uint64(min(size, len(h)))))


_rng = np.random.default_rng(11)
_A = (_rng.integers(0, 1 << 32, (COORDINATES, 1), dtype="u4") | np.uint32(1))
_B = _rng.integers(0, 1 << 32, (COORDINATES, 1), dtype="u4")


def sketch(tokens: np.ndarray) -> np.ndarray:
    """The sampled tokens of a set: for each of 128 orders of all tokens the first of the set, as 16 bits."""
    x = (tokens >> np.uint64(32)).astype("u4")[None, :]
    least = np.full(COORDINATES, 0xFFFFFFFF, "u4")
    for at in range(0, x.shape[1], 2048):
        least = np.minimum(least, (x[:, at:at + 2048] * _A + _B).min(axis=1))
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2")


# --- paths -----------------------------------------------------------------------------------------------

def _first_paths() -> np.ndarray:
    """Coordinates of the first splits: per run one, then twice two more; a row per leaf."""
    rng = np.random.default_rng(5)
    out = []
    for _ in range(RUNS):
        first = int(rng.integers(COORDINATES))
        for _ in range(2):
            out.append([first, *rng.integers(0, COORDINATES, 2).tolist()])
    return np.array(out)


def first_buckets(sketches: np.ndarray) -> np.ndarray:
    """Bucket of every text (row) at every leaf of the first splits (column)."""
    paths = _first_paths()
    key = np.broadcast_to(mix(np.arange(1, len(paths) + 1).astype("u8")), (len(sketches), len(paths)))
    for step in range(paths.shape[1]):
        key = mix(key * _ODD + sketches[:, paths[:, step]].astype("u8"))
    return key.view("i8")


def next_buckets(parents: np.ndarray, sketches: np.ndarray) -> np.ndarray:
    """Buckets below each row's parent bucket, one column per branch; the path decides which two tokens are looked at."""
    parent, rows, out = parents.view("u8"), np.arange(len(parents)), []
    for branch in range(BRANCHES):
        key = seed = mix(parent + np.uint64(branch + 1))
        for step in range(2):
            looked_at = (mix(seed + np.uint64(step + 1)) % np.uint64(COORDINATES)).astype("i8")
            key = mix(key * _ODD + sketches[rows, looked_at].astype("u8"))
        out.append(key)
    return np.stack(out, axis=1).view("i8")


# --- comparison ------------------------------------------------------------------------------------------

def first_met(bucket: int, keys: list[np.ndarray]) -> np.ndarray:
    """Which pairs share no smaller bucket than this one: each pair of texts is taken in one bucket only."""
    flat = np.concatenate(keys)
    owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    less = flat < bucket
    values, place, n = np.unique(flat[less], return_inverse=True, return_counts=True)
    shared = n[place] > 1
    if not shared.any():
        return np.ones((len(keys), len(keys)), bool)
    _, column = np.unique(place[shared], return_inverse=True)
    inside = np.zeros((len(keys), column.max() + 1), "f4")
    inside[owner[less][shared], column] = 1
    return inside @ inside.T == 0


def sketch_pairs(sketches: np.ndarray) -> np.ndarray:
    """Which pairs' sketches agree often enough to be compared."""
    n = len(sketches)
    out = np.zeros((n, n), bool)
    for i in range(n):
        out[i] = (sketches == sketches[i]).sum(axis=1) >= (SIMILAR - SKETCH_SLACK) * COORDINATES
    return out


def similar_pairs(sets: list[np.ndarray]) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of at least ``SIMILAR``, exactly.

    Tokens of one set only add nothing to an intersection; the others make a 0/1 matrix whose product counts them.
    """
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.diff(flat, prepend=flat[:1] ^ np.uint64(1)) != 0
    place = np.cumsum(new) - 1
    n = np.bincount(place)
    shared = n[place] > 1
    both = np.zeros((len(sets), len(sets)), "f4")
    place, owner = place[shared], owner[shared]
    if len(place):
        _, place = np.unique(place, return_inverse=True)
        for at in range(0, int(place.max()) + 1, 8192):
            mine = (place >= at) & (place < at + 8192)
            inside = np.zeros((len(sets), 8192), "f4")
            inside[owner[mine], place[mine] - at] = 1
            both += inside @ inside.T
    union = sizes[:, None] + sizes[None, :] - both
    return (both > 0) & (both * 5 >= union * 4) if SIMILAR == 0.8 else (both > 0) & (both >= SIMILAR * union - 1e-9)


def roots(linked: np.ndarray) -> np.ndarray:
    """The smallest member of each one's component."""
    label = np.arange(len(linked))
    while True:
        new = np.where(linked, label[None, :], len(label)).min(axis=1, initial=len(label))
        new = np.minimum(label, new)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _units(batches):
    """Rows of each unit, from batches sorted by unit: (unit, table)."""
    held, unit = [], None
    for b in batches:
        if not b.num_rows:
            continue
        ids = list(zip(*(b.column(n).to_pylist() for n in ("bucket", "low", "high"))))
        at = 0
        while at < len(ids):
            stop = at + 1
            while stop < len(ids) and ids[stop] == ids[at]:
                stop += 1
            if ids[at] != unit and held:
                yield unit, pa.Table.from_batches(held)
                held = []
            unit = ids[at]
            held.append(b.slice(at, stop - at))
            at = stop
    if held:
        yield unit, pa.Table.from_batches(held)


def _in_tile(unit, blocks: np.ndarray) -> np.ndarray:
    """The pairs that a tile of a large bucket is for: of its two different blocks, or within its one."""
    _, low, high = unit
    return np.ones((len(blocks), len(blocks)), bool) if low == high else blocks[:, None] != blocks[None, :]


def _by_unit(df: DataFrame) -> DataFrame:
    return df.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")


# --- on Spark --------------------------------------------------------------------------------------------

def similarity_classes(rows: DataFrame, key: str = "name", text: str = "verdict") -> DataFrame:
    """Near-duplicate classes of verdict texts: key, class_id, n_links, copies.

    Texts are compared as sets of five-word n-grams of their words (cut at ASCII white space, A-Z lower-cased; a
    text of fewer words is one n-gram of all); a link is a Jaccard similarity of at least 0.8.  ``n_links``: other texts
    (of different words) linked with the row's; ``copies``: rows of the same words; ``class_id``: smallest key among
    all rows connected by links.  Null and empty texts have no n-grams and only the rows of the same (no) words as
    class.  Null keys never name a class; a class of null keys only has a null id.  Other columns are not read.

    Equal texts are one text throughout.  The sets are split recursively by sampled tokens that their members share:
    ten runs give twenty paths of three tokens, and a bucket of more than ``LIMIT`` texts is split in
    three ways by two more tokens, again and again, unless its texts mostly agree.  A pair at 0.8 is missed by all runs
    with a probability of about 1e-5.  Buckets are compared by brute force, first by sketches, then by whole sets, each
    pair in the first bucket it shares; large buckets of alike texts in tiles of two blocks.  Tasks hand on counts
    and one root per text, never pairs.
    """
    kind = rows.schema[key].dataType.simpleString()

    def read(batches):
        for b in slices(batches):
            digest, found = [], []
            for t in texts(b.column(1)):
                words = t.lower().split()
                s = shingles(words)
                digest.append(xxhash.xxh3_128_digest(b" ".join(words)))
                found.append(sketch(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digest, pa.binary()), pa.array(found, pa.binary())],
                                             names=["key", "digest", "sketch"])
    base = written(rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        read, f"key {kind}, digest binary, sketch binary"), "sketches")
    each = written(base.groupBy("digest").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("copies"),
                                              F.first("sketch").alias("sketch")), "texts")

    final = written(_split(each), "buckets")
    found = written(_compare(rows, each, final, key, text), "links")
    links = found.groupBy("digest").agg(F.sum("n_links").alias("n_links"))
    label = _components(found.where("digest <> root").select("digest", "root").distinct())
    labelled = each.select("digest", "rep", "copies").join(label, "digest", "left").withColumn(
        "label", F.coalesce("label", "digest"))
    names = labelled.groupBy("label").agg(F.min("rep").alias("class_id"))
    described = written(labelled.join(names, "label").join(links, "digest", "left").select(
        "digest", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "copies"), "classes")
    return join_back(base.select("key", "digest"), described, "digest", "copies", base.count()).select(
        F.col("key").alias(key), "class_id", "n_links", "copies")


def _split(each: DataFrame) -> DataFrame:
    """Final buckets of each text: bucket, digest, blocks (1, or the number of blocks of a large bucket)."""
    def first(batches):
        for b in slices(batches, 2000):
            s = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u2").reshape(-1, COORDINATES)
            buckets = first_buckets(s)
            yield pa.RecordBatch.from_arrays(
                [pa.array(buckets.ravel()), b.column(0).take(pa.array(np.repeat(np.arange(len(s)), buckets.shape[1])))],
                names=["bucket", "digest"])

    def following(batches):
        for b in slices(batches, 2000):
            s = np.frombuffer(b"".join(b.column("sketch").to_pylist()), "<u2").reshape(-1, COORDINATES)
            buckets = next_buckets(b.column("bucket").to_numpy(), s)
            take = pa.array(np.repeat(np.arange(len(s)), BRANCHES))
            yield pa.RecordBatch.from_arrays(
                [b.column("bucket").take(take), pa.array(np.tile(np.arange(BRANCHES, dtype="i4"), len(s))),
                 pa.array(buckets.ravel()), b.column("digest").take(take), b.column("n").take(take)],
                names=["parent", "branch", "bucket", "digest", "n"])
    has = each.where("sketch is not null").select("digest", "sketch")
    members = written(has.mapInArrow(first, "bucket bigint, digest binary"), "paths")
    final = None
    for level in range(LEVELS + 1):
        sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sized = written(members.select("bucket", "digest").join(sizes, "bucket"), "sized")
        done = sized.where(F.col("n") <= LIMIT).select("bucket", "digest", F.lit(1).alias("blocks"))
        large = sized.where(F.col("n") > LIMIT)
        blocks = F.ceil(F.col("n") / LIMIT).cast("int")
        final = done if final is None else final.unionByName(done)
        if large.isEmpty():
            break
        if level == LEVELS:
            final = final.unionByName(large.select("bucket", "digest", blocks.alias("blocks")))
            break
        below = written(large.join(has, "digest").select("bucket", "digest", "n", "sketch").mapInArrow(
            following, "parent bigint, branch int, bucket bigint, digest binary, n bigint"), "paths")
        agree = below.groupBy("parent", "branch", "bucket").agg(F.count(F.lit(1)).alias("m"), F.first("n").alias("n")) \
            .groupBy("parent").agg((F.sum(F.col("m") * F.col("m")) / (F.first("n") * F.first("n") * BRANCHES)).alias("share"))
        dense = agree.where(F.col("share") >= DENSE).select("parent")
        final = final.unionByName(large.join(dense.withColumnRenamed("parent", "bucket"), "bucket", "left_semi").select(
            "bucket", "digest", blocks.alias("blocks")))
        members = below.join(dense, "parent", "left_anti")
    return final


def _compare(rows: DataFrame, each: DataFrame, final: DataFrame, key: str, text: str) -> DataFrame:
    """Links found in the buckets: digest, root (of its component in a unit), n_links (pairs met there first)."""
    keys = final.groupBy("digest").agg(F.array_sort(F.collect_set("bucket")).alias("keys"))
    about = keys.join(each.select("digest", "rep", "sketch"), "digest")
    block = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    unit = final.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "bucket", "digest", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def filtered(batches):
        for unit_, t in _units(batches):
            near = sketch_pairs(np.frombuffer(b"".join(t["sketch"].to_pylist()), "<u2").reshape(-1, COORDINATES))
            near &= _in_tile(unit_, t["block"].to_numpy())
            np.fill_diagonal(near, False)
            if near.any():
                near &= first_met(unit_[0], [np.array(k, "i8") for k in t["keys"].to_pylist()])
            mine = np.flatnonzero(near.any(axis=1))
            if len(mine):
                yield t.select(["bucket", "low", "high", "block", "digest", "keys", "rep"]).take(
                    pa.array(mine)).combine_chunks().to_batches()[0]
    kind = each.schema["rep"].dataType.simpleString()
    picked = written(_by_unit(unit.join(about, "digest")).select(
        "bucket", "low", "high", "block", "digest", "keys", "sketch", "rep").mapInArrow(
            filtered, f"bucket bigint, low int, high int, block int, digest binary, keys array<bigint>, rep {kind}"), "picked")

    def sets_of(batches):
        for b in slices(batches):
            digest, sets = [], []
            for t in texts(b.column(0)):
                words = t.lower().split()
                digest.append(xxhash.xxh3_128_digest(b" ".join(words)))
                sets.append(shingles(words).astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(sets, pa.binary())],
                                             names=["digest", "tokens"])
    def digest_of(batches):
        for b in slices(batches):
            digest = [xxhash.xxh3_128_digest(b" ".join(t.lower().split())) for t in texts(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), b.column(0)], names=["digest", "text"])
    # the texts needed again grow with the table: always joined by a shuffle, never sent to every task
    needed = picked.where("rep is not null").select(F.col("rep").alias(key)).distinct().hint("merge")
    named = rows.select(key, text).join(needed, key, "left_semi").select(text)
    # a text with null keys only has no rep: it is found by its digest, one row of each
    unnamed = picked.where("rep is null").select("digest").distinct().hint("merge")
    by_digest = rows.where(F.col(key).isNull()).select(text).mapInArrow(digest_of, "digest binary, text string").groupBy(
        "digest").agg(F.first("text").alias(text)).join(unnamed, "digest", "left_semi").select(text)
    sets = named.unionByName(by_digest).mapInArrow(sets_of, "digest binary, tokens binary")

    def verified(batches):
        for unit_, t in _units(batches):
            digests = t["digest"].to_pylist()
            once = sorted({d: i for i, d in enumerate(digests)}.items())       # a key may stand for equal rows
            digests, t = [d for d, _ in once], t.take(pa.array([i for _, i in once]))
            linked = similar_pairs([np.frombuffer(s, "<u8") for s in t["tokens"].to_pylist()])
            np.fill_diagonal(linked, False)
            linked &= _in_tile(unit_, t["block"].to_numpy())
            if linked.any():
                linked &= first_met(unit_[0], [np.array(k, "i8") for k in t["keys"].to_pylist()])
            n = linked.sum(axis=1)
            mine = np.flatnonzero(n)
            if len(mine):
                root = roots(linked)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([digests[i] for i in mine], pa.binary()), pa.array([digests[root[i]] for i in mine], pa.binary()),
                     pa.array(n[mine].astype("i8"))], names=["digest", "root", "n_links"])
    return _by_unit(picked.drop("rep").join(sets, "digest")).select(
        "bucket", "low", "high", "block", "digest", "keys", "tokens").mapInArrow(
            verified, "digest binary, root binary, n_links bigint")


def _components(edges: DataFrame) -> DataFrame:
    """Smallest digest of each one's component: digest, label.  Labels spread along links and skip ahead each round."""
    both = written(edges.select(F.col("digest").alias("a"), F.col("root").alias("b")).unionByName(
        edges.select(F.col("root").alias("a"), F.col("digest").alias("b"))), "edges")
    label = written(both.groupBy(F.col("a").alias("digest")).agg(F.least(F.min("b"), F.col("digest")).alias("label")), "labels")
    while True:
        heard = both.join(label.withColumnRenamed("digest", "b"), "b").groupBy(F.col("a").alias("digest")).agg(
            F.min("label").alias("near"))
        nearer = label.join(heard, "digest").select("digest", F.least("label", "near").alias("via"), F.col("label").alias("was"))
        ahead = label.select(F.col("digest").alias("via"), F.col("label").alias("next"))
        new = written(nearer.join(ahead, "via").select("digest", F.least("via", "next").alias("label"), "was"), "labels")
        changed = not new.where("label <> was").isEmpty()
        label = new.select("digest", "label")
        if not changed:
            return label
