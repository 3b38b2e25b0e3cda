"""Passages that verdict texts repeat, found by merging Burrows-Wheeler transforms of shards of text."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from orbweave.llm.common import discard, join_back, slices, written
from orbweave.llm.sieve import BITS_EACH, BYTE_POWERS, BYTES, HIGHEST, LOWEST, Prefix, held, mix

SPAN = 50                  # bytes of a repeated string
GRAM = 16                  # bytes of an anchor
RUN = 64                   # most starts in one segment
JOINED = 8                 # segments in a stretch, on average
LONGEST = 32               # most segments in a stretch
BLOCK = 1 << 20            # bytes of text looked at at once
CHUNK = 1 << 15            # starts whose anchors are looked for at once, which stay in a core's cache
PLACE_BITS = 24            # bits of a place in texts looked at at once
PLACE = np.uint64((1 << PLACE_BITS) - 1)
PRINTS = 1 << 20           # prints counted at once
BUCKET = 1 << 18           # bytes of segments whose transforms are merged by one task
STEP = 5                   # symbols by which a round of the merge refines its interleave
SHARDS = 2                 # transforms of a bucket, each built by a task of its own
LEVELS = 8                 # times that the segments of a hot anchor are dealt out anew


# --- anchors and segments --------------------------------------------------------------------------------

def anchored(data: np.ndarray, stops: np.ndarray, span: int, seed: int = 0, bits: np.ndarray | None = None):
    """Runs of starts of strings of ``span`` bytes in joined texts: (anchor, its place, first start, number of starts), and
    the prints of each run.

    Every start of such a string has an anchor, the smallest hash of the short strings in it, at the first place that has
    it, so equal strings have equal anchors at equal places.  ``stops``: where each text ends; strings never cross one.

    A string holds half of its other bytes before its anchor or half of them after it, or both.  So two prints tell of every string
    around an anchor whether another text can have it: that of the anchor with the bytes before it and that of the anchor
    with those after it (zero where a text ends too early for it, so that no string holds them).  ``bits``: prints to which
    the runs are confined.
    """
    gram, n = min(GRAM, span), len(data) - span + 1
    if n < 1:
        return (np.zeros(0, "u8"), *(np.zeros(0, "i8") for _ in range(3)), np.zeros((2, 0), "u8"))
    side, after = (span - gram) // 2, span - gram - (span - gram) // 2
    if len(data) >> PLACE_BITS:
        raise ValueError(f"{len(data)} bytes are too many to be looked at at once")
    prefix = Prefix(BYTES[data], BYTE_POWERS)
    low, width = np.empty(n, "u8"), span - gram + 1
    for at in range(0, n, CHUNK):
        stop = min(at + CHUNK, n) + width - 1
        part = mix(prefix.each(gram, at, stop) + np.uint64(seed))
        part &= ~PLACE
        part |= np.arange(at, stop, dtype="u8")
        size = 1
        while size * 2 <= width:
            part = np.minimum(part[:-size], part[size:])
            size *= 2
        if size < width:
            part = np.minimum(part[:size - width], part[width - size:])
        low[at:at + CHUNK] = part
    fresh = np.append(True, low[1:] != low[:-1])
    edge = stops[stops < n]
    fresh[edge] = True                                           # a run ends with its text
    start = np.flatnonzero(fresh)
    value = low[start]
    row = np.searchsorted(stops, start, side="right")
    last = np.minimum(np.append(start[1:], n), stops[row] - span + 1)
    whole = last > start                                         # strings that begin here end in their text
    value, start, last, row = value[whole], start[whole], last[whole], row[whole]
    place = (value & PLACE).astype("i8")
    head = np.append(0, stops)[row]
    prints = np.zeros((2, len(place)), "u8")
    left, right = place - side >= head, place + gram + after <= stops[row]
    prints[0, left] = print_of(prefix.hash(place[left] - side, place[left] + gram))
    prints[1, right] = print_of(prefix.hash(place[right], place[right] + gram + after))
    if bits is not None:
        with_left, with_right = (p.astype(bool) & known(bits, p) for p in prints)
        middle = place - side                                    # the last start whose string holds the bytes before the anchor
        start = np.where(with_left, start, np.maximum(start, middle))
        last = np.where(with_right, last, np.minimum(last, middle + 1))
        mine = (with_left | with_right) & (last > start)
        value, place, start, last, prints = value[mine], place[mine], start[mine], last[mine], prints[:, mine]
    return value >> np.uint64(PLACE_BITS), place, start, last - start, prints


def print_of(hashes: np.ndarray) -> np.ndarray:
    """44 bits, never zero: 12 for the bucket in which prints are counted, 32 inside it."""
    return np.maximum(mix(hashes) >> np.uint64(20), np.uint64(1))


def bit_places(prints: np.ndarray, exponent: int):
    """The two bits of each print in a set of 2 ** ``exponent`` bits, of which each bucket of prints has an equal part."""
    part = np.uint64(exponent - 12)
    low = (np.uint64(1) << part) - np.uint64(1)
    bucket = prints >> np.uint64(32) << part
    return bucket | (prints & low), bucket | (mix(prints) & low)


def known(bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Which prints may be in a set: those both of whose bits are."""
    exponent = (len(bits) * 8).bit_length() - 1
    one, other = bit_places(prints, exponent)
    out = held(bits, one)
    out[out] = held(bits, other[out])
    return out


def segments(data: np.ndarray, stops: np.ndarray, span: int, seed: int = 0, bits: np.ndarray | None = None):
    """Segments of joined texts: (anchor, first start, number of starts) of each.

    Neighbouring starts with one anchor form a segment of at most ``RUN`` starts.  The arguments are those of
    :func:`anchored`.
    """
    anchor, _, first, count, _ = anchored(data, stops, span, seed, bits)
    fresh = np.ones(len(anchor), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (first[1:] != first[:-1] + count[:-1])
    if not fresh.all():                                          # one anchor at several places, as in a repeated letter
        at = np.flatnonzero(fresh)
        anchor, first, count = anchor[at], first[at], np.add.reduceat(count, at)
    pieces = -(-count // RUN)                                    # long runs of one anchor are cut
    nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return (np.repeat(anchor, pieces), np.repeat(first, pieces) + nth * RUN,
            np.minimum(RUN, np.repeat(count, pieces) - nth * RUN))


class Block:
    """Joined stretches of texts with what each needs to be found again."""

    def __init__(self, rows: list[tuple], span: int, bits: np.ndarray | None = None):
        self.rows, self.raw = rows, b"".join(r[-1] for r in rows)
        self.stops = np.cumsum([len(r[-1]) for r in rows])
        self.anchor, self.start, self.count = segments(np.frombuffer(self.raw, "u1"), self.stops, span, 0, bits)
        self.row = np.searchsorted(self.stops, self.start, side="right")


def blocks(batches, span: int):
    """Groups of at most twice ``BLOCK`` bytes: rows of key, text hash, place in the text, bytes.  Long texts come in stretches that
    overlap by ``span - 1`` bytes, so that each start is in one of them."""
    out, total = [], 0
    for b in slices(batches, 64):
        for key, digest, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            data = value.as_buffer().to_pybytes()
            for at in range(0, len(data) - span + 1, BLOCK):
                part = data[at:at + BLOCK + span - 1]
                out.append((key, digest, at, part))
                total += len(part)
                if total >= BLOCK:
                    yield out
                    out, total = [], 0
    if out:
        yield out


def digest_of(anchor: int, part: bytes) -> bytes:
    return hashlib.blake2b(part, digest_size=16, key=anchor.to_bytes(8, "little")).digest()


# --- transforms ------------------------------------------------------------------------------------------

def transform(parts: list[bytes]) -> np.ndarray:
    """Burrows-Wheeler transform of a set of strings: 0 ends a string, byte b is b + 1.  Equal suffixes come in the
    order of their strings."""
    symbols = np.zeros(sum(map(len, parts)) + len(parts), "u2")
    stops = np.cumsum([len(p) + 1 for p in parts]) - 1
    mask = np.ones(len(symbols), bool)
    mask[stops] = False
    symbols[mask] = np.frombuffer(b"".join(parts), "u1").astype("u2") + 1
    n = len(symbols)
    size = np.diff(stops, prepend=-1)
    left = np.repeat(stops, size) - np.arange(n)                 # symbols before the string ends
    bits = n.bit_length()

    def after(values, by):
        """Values so many symbols further on in the string, 0 beyond its end."""
        out = np.zeros(n, "u8")
        out[:n - by] = values[by:]
        out[left < by] = 0
        return out
    depth = max(1, (64 - bits) // 9)                             # as many symbols of nine bits as leave room for a place
    key = np.zeros(n, "u8")
    for j in range(min(depth, n)):
        key |= after(symbols, j) << np.uint64(9 * (depth - 1 - j))
    used = 9 * depth
    while True:
        if used + bits <= 64:                                    # places sorted along with keys: faster, and stable
            both = np.sort(key << np.uint64(bits) | np.arange(n, dtype="u8"))
            order = (both & np.uint64((1 << bits) - 1)).astype("i8")
            both >>= np.uint64(bits)
        else:
            order = np.argsort(key, kind="stable")
            both = key[order]
        fresh = np.append(True, both[1:] != both[:-1])
        if fresh.all() or depth > size.max():
            break
        rank = np.empty(n, "u8")
        rank[order] = np.cumsum(fresh).astype("u8")
        used = 2 * bits
        key = rank << np.uint64(bits) | (after(rank, depth) if depth < n else np.uint64(0))
        depth *= 2
    before = symbols[order - 1]
    start = np.zeros(n, bool)
    start[np.append(0, stops[:-1] + 1)] = True
    before[start[order]] = 0
    return before.astype("u1") if before.max() < 256 else before


def walk(bwt: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """String and place of the suffix at every rank of a transform, all strings walked backwards at once."""
    order = np.argsort(bwt, kind="stable")
    to = np.empty(len(bwt), "i8")
    to[order] = np.arange(len(bwt))
    owner, place = np.zeros(len(bwt), "i8"), np.zeros(len(bwt), "i8")
    rank, string, at = np.arange(len(sizes)), np.arange(len(sizes)), sizes.copy()
    while len(rank):
        owner[rank], place[rank] = string, at
        more = bwt[rank] != 0
        rank, string, at = to[rank[more]], string[more], at[more] - 1
    return owner, place


def grams(joined: np.ndarray, to: np.ndarray, lead: np.ndarray, q: int):
    """The ``q`` symbols before every suffix as one number, and the suffix that begins with them: (numbers, suffixes).

    Strings' own short suffixes, of 1 to ``q - 1`` symbols, come first, in the order of ``lead``, the suffixes without any
    symbol.  Numbers are in the order of the symbols and dense; 0: the string has not so many.
    """
    numbers, suffixes = [], []
    for start, steps in [*((lead, m) for m in range(1, q)), (np.arange(len(joined)), q)]:
        number, at, whole = np.zeros(len(start), "u8"), start, np.ones(len(start), bool)
        for step in range(steps):
            symbol = joined[at]
            whole &= symbol > 0
            number |= symbol.astype("u8") << np.uint64(9 * (q - steps + step))
            at = to[at]
        number[~whole] = 0
        numbers.append(number)
        suffixes.append(at)
    found, dense = np.unique(np.concatenate([np.zeros(1, "u8"), *numbers]), return_inverse=True)
    return dense[1:].astype("u2" if len(found) <= 1 << 16 else "u4"), np.concatenate(suffixes)


def interleave(shards: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge transforms: the shard of every suffix in the order of all, and the number of its interval, the run of
    suffixes that share their first ``depth`` symbols.

    Each round takes the interleave that is right for ``STEP`` symbols less, reads the shards' next symbols along it and
    deals the suffixes out by them, keeping their order; no suffix is compared.  An interval is cut where the symbols
    differ or where the intervals they lead to did, so the round in which neighbours part tells their common prefix.
    Ends of strings differ from each other.
    """
    joined = np.concatenate(shards)
    base = np.cumsum([0] + [len(s) for s in shards])
    to = np.empty(len(joined), "i8")
    for s, bwt in enumerate(shards):
        to[base[s] + np.argsort(bwt, kind="stable")] = np.arange(base[s], base[s + 1])
    lead = np.concatenate([np.arange(b, b + int((s == 0).sum())) for b, s in zip(base, shards)])
    ends, order, interval = len(lead), np.arange(len(joined)), np.zeros(len(joined), "i4")
    step = STEP
    while True:
        number, suffix = grams(joined, to, lead, step)
        if number.itemsize == 2 or step == 1:                    # more kinds of symbols in a row are dealt too slowly
            break
        step -= 1
    rounds = [(step, number, suffix)] * (depth // step)
    if depth % step:
        rounds.insert(0, (depth % step, *grams(joined, to, lead, depth % step)))
    for q, number, suffix in rounds:
        short = ends * (q - 1)
        symbol = np.concatenate([number[:short], number[short:][order]])
        deal = np.argsort(symbol, kind="stable")[int((number == 0).sum()):]
        c, old = symbol[deal], np.concatenate([-1 - np.arange(short, dtype="i4"), interval])[deal]
        cut = np.ones(len(deal), bool)
        cut[1:] = (c[1:] != c[:-1]) | (old[1:] != old[:-1])
        order = np.concatenate([lead, np.concatenate([suffix[:short], suffix[short:][order]])[deal]])
        interval = np.concatenate([np.arange(ends, dtype="i4"), np.cumsum(cut, dtype="i4") + (ends - 1)])
        if interval[-1] + 1 == len(interval):
            break
    return (np.searchsorted(base, order, side="right") - 1).astype("u1"), interval


def repeated_runs(shards: list[np.ndarray], sizes: list[np.ndarray], lows: np.ndarray, span: int):
    """Runs of starts of each string with the lowest value any equal string of ``span`` bytes has: (string, place, number
    of starts, lowest).  ``lows``: a number per string, in the order of the shards."""
    source, interval = interleave(shards, span)
    owner, place, before = [], [], 0
    for bwt, size in zip(shards, sizes):
        o, p = walk(bwt, size)
        owner.append(o + before)
        place.append(p)
        before += len(size)
    rank = np.empty(len(source), "i8")
    rank[np.argsort(source, kind="stable")] = np.arange(len(source))
    owner, place = np.concatenate(owner)[rank], np.concatenate(place)[rank]
    best = np.minimum.reduceat(lows[owner], np.flatnonzero(np.diff(interval, prepend=-1)))[interval]
    whole = place + span <= np.concatenate(sizes)[owner]
    owner, place, best = owner[whole], place[whole], best[whole]
    order = np.lexsort((place, owner))
    owner, place, best = owner[order], place[order], best[order]
    fresh = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (best[1:] != best[:-1]))[:len(owner)])
    return owner[fresh], place[fresh], np.diff(np.append(fresh, len(owner))), best[fresh]


# --- on Spark --------------------------------------------------------------------------------------------

def _batch(columns: dict, types: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, types.get(n)) for n, v in columns.items()], names=list(columns))


def _repeated_prints(texts: DataFrame, span: int) -> DataFrame:
    """Prints that texts of different keys may share: bucket, n (how many it has), blob (their 32 bits inside it).

    A task hands on the sorted prints of each million it has met, once each, and those of several keys again.  What
    comes in twice from anywhere may be shared; too many cost time only.
    """
    def run(batches):
        kept, names = [], {}

        def counted():
            both = np.sort(np.concatenate(kept))                 # 44 bits of the print, 20 of the key's number
            prints = both >> np.uint64(20)
            edge = np.append(True, prints[1:] != prints[:-1])
            other = np.flatnonzero(~edge[1:] & (both[1:] != both[:-1])) + 1
            out = np.sort(np.concatenate([prints[edge], np.unique(prints[other])]))
            bucket = (out >> np.uint64(32)).astype("i4")
            at = np.flatnonzero(np.diff(bucket, prepend=-1))
            low = out.astype("u4")
            return _batch({"bucket": bucket[at], "blob": [x.tobytes() for x in np.split(low, at[1:])]}, {"blob": pa.binary()})
        for rows in blocks(batches, span):
            stops = np.cumsum([len(r[-1]) for r in rows])
            _, place, start, _, prints = anchored(np.frombuffer(b"".join(r[-1] for r in rows), "u1"), stops, span)
            key = np.array([names.setdefault(r[0], len(names)) for r in rows], "u8")[np.searchsorted(stops, start, side="right")]
            kept += [(p[p > 0] << np.uint64(20)) | key[p > 0] for p in prints]
            if sum(map(len, kept)) >= PRINTS or len(names) >= 1 << 19:
                yield counted()
                kept, names = [], {}
        if any(map(len, kept)):
            yield counted()

    def twice(t: pa.Table) -> pa.Table:
        low = np.sort(np.concatenate([np.frombuffer(v.as_buffer(), "u4") for v in t["blob"]]))
        again = np.unique(low[1:][low[1:] == low[:-1]])
        return pa.table({"bucket": t["bucket"][:1], "n": pa.array([len(again)], pa.int64()), "blob": pa.array([again.tobytes()], pa.binary())})
    return texts.mapInArrow(run, "bucket int, blob binary").groupBy("bucket").applyInArrow(twice, "bucket int, n bigint, blob binary")


def _set_of(prints: DataFrame) -> np.ndarray:
    """Bits of the prints of :func:`_repeated_prints`, as bytes: 128 MB at most, which cost time only when they are too few.

    Spark builds the part of each bucket, the driver gets the finished set.
    """
    count = prints.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    exponent = min(max((2 * BITS_EACH * count).bit_length(), LOWEST), HIGHEST)

    def run(batches):
        for b in batches:
            parts = []
            for bucket, blob in zip(b.column("bucket").to_pylist(), b.column("blob")):
                bits = np.zeros(1 << (exponent - 12), "u1")
                found = np.frombuffer(blob.as_buffer(), "u4").astype("u8") | np.uint64(bucket << 32)
                for places in bit_places(found, exponent):
                    bits[(places & np.uint64(len(bits) - 1)).astype("i8")] = 1
                parts.append(np.packbits(bits, bitorder="little").tobytes())
            yield _batch({"bucket": b.column("bucket"), "bits": parts}, {"bits": pa.binary()})
    parts = prints.select("bucket", "blob").mapInArrow(run, "bucket int, bits binary").toArrow()
    size = 1 << (exponent - 15)
    out = np.zeros(size << 12, "u1")
    for bucket, bits in zip(parts["bucket"].to_pylist(), parts["bits"]):
        out[bucket * size:(bucket + 1) * size] = np.frombuffer(bits.as_buffer(), "u1")
    return out


def stretches(block: Block, mine: np.ndarray):
    """Neighbouring segments of a block joined into stretches: (row, first start, number of starts) of each.

    ``mine``: the segments looked at.  One whose anchor is a multiple of ``JOINED`` begins a stretch, so texts that
    agree over a long way are cut alike; where a stretch is cut decides what is held once, never what repeats.
    """
    row, start, count = block.row[mine], block.start[mine], block.count[mine]
    fresh = np.ones(len(mine), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + count[:-1]) | (mix(block.anchor[mine])[1:] % np.uint64(JOINED) == 0)
    nth = np.arange(len(mine))
    nth -= np.maximum.accumulate(np.where(fresh, nth, 0))
    first = np.flatnonzero(nth % LONGEST == 0)
    return row[first], start[first], np.add.reduceat(count, first) if len(first) else count[:0]


def _occurrences(texts: DataFrame, bits, span: int) -> DataFrame:
    """Stretches of repeated prints: digest, key, text_hash, at; the first of equal ones in a block also has its bytes
    (part), the smallest key there (low) and their number (copies)."""
    kind = texts.schema["key"].dataType
    types = {"part": pa.binary(), "digest": pa.binary(), "key": to_arrow_type(kind), "low": to_arrow_type(kind),
             "text_hash": pa.int64(), "at": pa.int64(), "copies": pa.int64()}

    def run(batches):
        for rows in blocks(batches, span):
            block = Block(rows, span, bits.value)
            seen: dict[bytes, list] = {}
            out: dict[str, list] = {n: [] for n in ("digest", "key", "text_hash", "at", "part", "low", "copies")}
            first = np.append(0, block.stops[:-1])
            row, start, count = stretches(block, np.arange(len(block.anchor)))
            stop = (start + count + span - 1).tolist()
            for r, s, e, at in zip(row.tolist(), start.tolist(), stop, (start - first[row]).tolist()):
                part, source = block.raw[s:e], block.rows[r]
                known = seen.get(part)
                if known is None:
                    known = seen[part] = [digest_of(0, part), len(out["at"])]
                    for n, v in (("part", part), ("low", source[0]), ("copies", 0)):
                        out[n].append(v)
                else:
                    for n in ("part", "low", "copies"):
                        out[n].append(None)
                    out["low"][known[1]] = min(out["low"][known[1]], source[0])
                out["copies"][known[1]] += 1
                out["digest"].append(known[0])
                out["key"].append(source[0])
                out["text_hash"].append(source[1])
                out["at"].append(source[2] + at)
            if out["at"]:
                yield _batch(out, types)
    k = kind.simpleString()
    return texts.mapInArrow(run, f"digest binary, key {k}, text_hash bigint, at bigint, part binary, low {k}, copies bigint")


def _dealt(units: DataFrame, span: int, level: int, bits=None) -> DataFrame:
    """Units cut into segments by the hash of a level: owner (digest of the unit), n (its copies), off (place in it) and
    fp, digest, part, low, copies (1).  ``bits``: prints to which this is confined."""
    kind = units.schema["low"].dataType
    types = {"owner": pa.binary(), "digest": pa.binary(), "part": pa.binary(), "low": to_arrow_type(kind), "n": pa.int64()}

    def run(batches):
        for b in slices(batches, 3000):
            parts, fps = b.column("part").to_pylist(), b.column("fp").to_numpy().view("u8")
            stops = np.cumsum([len(p) for p in parts])
            raw = b"".join(parts)
            anchor, start, count = segments(np.frombuffer(raw, "u1"), stops, span, level, None if bits is None else bits.value)
            row = np.searchsorted(stops, start, side="right")
            fp = mix(anchor ^ fps[row])
            pieces = [raw[s:s + c + span - 1] for s, c in zip(start.tolist(), count.tolist())]
            yield _batch({
                "owner": b.column("digest").take(pa.array(row)), "n": b.column("copies").take(pa.array(row)),
                "off": (start - np.append(0, stops)[row]).astype("i4"), "fp": fp.view("i8"),
                "digest": [digest_of(f, p) for f, p in zip(fp.tolist(), pieces)], "part": pieces,
                "low": b.column("low").take(pa.array(row)), "copies": np.ones(len(row), "i8")}, types)
    return units.select("fp", "digest", "part", "low", "copies").mapInArrow(
        run, f"owner binary, n bigint, off int, fp bigint, digest binary, part binary, low {kind.simpleString()}, copies bigint")


def _merged(units: DataFrame, span: int, total: int) -> DataFrame:
    """Runs of starts of every segment with the lowest key that has the same strings: digest, runs, copies.

    Segments are dealt into buckets by anchor and into shards of a bucket by digest.  One task builds the transform of a
    shard, one merges those of a bucket; segments whose every string is theirs alone are left out.
    """
    kind = units.schema["low"].dataType
    low, k = to_arrow_type(kind), kind.simpleString()
    n = max(1, -(-total // BUCKET))
    dealt = units.select(F.pmod("fp", F.lit(n)).alias("bucket"), F.pmod(F.xxhash64("digest"), F.lit(SHARDS)).cast("int").alias("shard"),
                         "digest", "part", "low", "copies")

    def build(t: pa.Table) -> pa.Table:
        parts = t["part"].to_pylist()
        bwt = transform(parts)
        return pa.table({
            "bucket": t["bucket"][:1], "shard": t["shard"][:1], "bwt": pa.array([bwt.tobytes()], pa.binary()), "width": pa.array([bwt.itemsize], pa.int32()),
            "sizes": pa.array([[len(p) for p in parts]], pa.list_(pa.int32())),
            "digests": pa.array([t["digest"].to_pylist()], pa.list_(pa.binary())),
            "lows": pa.array([t["low"].to_pylist()], pa.list_(low)), "copies": pa.array([t["copies"].to_pylist()], pa.list_(pa.int64()))})

    run_type = pa.list_(pa.struct([("off", pa.int32()), ("n", pa.int32()), ("low", low)]))

    def merge(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["shard"])
        digests, values, copies = ([v for r in rows for v in r[c]] for c in ("digests", "lows", "copies"))
        names = sorted(set(values))
        number = {v: i for i, v in enumerate(names)}
        own = np.array([number[v] for v in values])
        string, off, count, best = repeated_runs([np.frombuffer(r["bwt"], f"u{r['width']}") for r in rows],
                                                 [np.array(r["sizes"], "i8") for r in rows], own, span)
        useful = (best < own[string]) | (np.array(copies)[string] > 1)
        out: dict[int, list] = {}
        for s, o, c, b in zip(*(x[useful].tolist() for x in (string, off, count, best))):
            out.setdefault(s, []).append({"off": o, "n": c, "low": names[b]})
        return pa.table({"digest": pa.array([digests[s] for s in out], pa.binary()), "runs": pa.array(list(out.values()), run_type),
                         "copies": pa.array([copies[s] for s in out], pa.int64())})
    shards = dealt.groupBy("bucket", "shard").applyInArrow(
        build, f"bucket bigint, shard int, bwt binary, width int, sizes array<int>, digests array<binary>, lows array<{k}>, copies array<bigint>")
    return shards.groupBy("bucket").applyInArrow(merge, f"digest binary, runs array<struct<off: int, n: int, low: {k}>>, copies bigint")


def repeated_starts(texts: DataFrame, span: int = SPAN) -> DataFrame:
    """Starts of strings of ``span`` bytes that a smaller key has too: key, text_hash, runs (start, n: starts in a row), of which
    a text has several rows and places may be in several runs.

    ``texts``: key, text_hash, text (binary).  Equal strings have equal anchors.  So segments around anchors of one key
    alone are not looked at.  Neighbouring others are joined into stretches, and equal stretches are held once with their
    smallest key.  Only segments around anchors that different stretches share go on: equal ones are held once, one that
    is the only one of its anchor shares no string with another, and the transforms are built of the rest.  Segments of
    an anchor that has more than a bucket of them are dealt out again by other hashes of what they hold.
    """
    spark = texts.sparkSession
    prints = written(_repeated_prints(texts, span), "prints")
    found = written(_occurrences(texts, spark.sparkContext.broadcast(_set_of(prints)), span), "stretches")
    discard(prints)

    def once(df, *on):
        return df.groupBy(*on).agg(F.first("part").alias("part"), F.min("low").alias("low"), F.sum("copies").alias("copies"))

    whole = written(once(found.where(F.col("part").isNotNull()), "digest").withColumn("fp", F.lit(0).cast("long")), "distinct")
    shared = written(_repeated_prints(whole.select(
        F.col("digest").alias("key"), F.lit(0).cast("long").alias("text_hash"), F.col("part").alias("text")), span), "shared")
    pieces = written(_dealt(whole, span, 0, spark.sparkContext.broadcast(_set_of(shared))), "pieces")
    discard(shared)
    kept = [whole, pieces]
    parts = pieces.select("fp", "digest", "part", "low", "copies")

    def too_many(df):
        """Anchors with more than a bucket of segments: at most bytes / BUCKET rows."""
        kept.append(written(df.groupBy("fp").agg(F.sum(F.length("part")).alias("b")).where(F.col("b") > BUCKET).select("fp"), "hot"))
        return F.broadcast(kept[-1]), not kept[-1].isEmpty()

    def as_one(df):
        """Units of several copies repeat as a whole."""
        return df.where("copies > 1").select("digest", F.array(F.struct(
            F.lit(0).alias("off"), (F.length("part") - (span - 1)).alias("n"), "low")).alias("runs"), "copies")

    def runs_of(parts):
        units = written(once(parts.repartition("fp"), "fp", "digest").withColumn(
            "variants", F.count(F.lit(1)).over(Window.partitionBy("fp"))), "units")
        several = units.where("variants > 1")
        total = several.agg(F.coalesce(F.sum(F.length("part")), F.lit(0))).first()[0]
        out = written(_merged(several, span, total).unionByName(as_one(units.where("variants = 1"))), "runs")
        discard(units)
        return out

    def moved(link, owners, runs):
        """Runs of the units that pieces were cut from."""
        out = join_back(link.select("owner", "n", "off", "digest"), runs, "digest", "copies", link.count()).select(
            "owner", "n", F.expr("transform(runs, x -> struct(x.off + off AS off, x.n AS n, x.low AS low))").alias("r"))
        out = out.groupBy(F.col("owner").alias("digest")).agg(F.flatten(F.collect_list("r")).alias("runs"), F.max("n").alias("copies"))
        return out.unionByName(as_one(owners))                          # their pieces count for one copy each

    hot, some = too_many(parts)
    hot_runs = None
    if some:
        hot_parts = written(once(parts.join(hot, "fp"), "fp", "digest"), "hot-segments")
        kept.append(hot_parts)
        parts, settled, links = parts.join(hot, "fp", "left_anti"), [], []
        for level in range(1, LEVELS + 1):
            hot, some = too_many(hot_parts)
            if not some:
                break
            owners = hot_parts.join(hot, "fp")
            anew = written(_dealt(owners, span, level), "dealt-anew")
            links.append((anew, owners))
            kept.append(anew)
            settled.append(hot_parts.join(hot, "fp", "left_anti"))
            hot_parts = written(once(anew, "fp", "digest"), "hot-segments")
            kept.append(hot_parts)
        for more in settled:
            hot_parts = hot_parts.unionByName(more)
        hot_runs = runs_of(hot_parts)                                   # few, so that levels do not carry the other runs along
        kept.append(hot_runs)
        for link, owners in reversed(links):
            hot_runs = written(moved(link, owners, hot_runs).unionByName(hot_runs), "hot-runs")
            kept.append(hot_runs)
    runs = runs_of(parts)
    kept.append(runs)
    runs = written(moved(pieces, whole, runs.unionByName(hot_runs) if hot_runs is not None else runs), "runs")
    discard(*kept)
    places = join_back(found.select("digest", "key", "text_hash", "at"), runs, "digest", "copies", found.count())
    return places.select("key", "text_hash", F.expr(
        "transform(filter(runs, r -> r.low < key), r -> struct(at + r.off AS start, r.n AS n))").alias("runs")).where(F.size("runs") > 0)


def drop_repeats(rows: DataFrame, key: str = "name", text: str = "verdict", span: int = SPAN) -> DataFrame:
    """Verdict texts without the passages that a text of a smaller key has already.

    A text counts as its bytes.  Each byte goes that lies in a string of ``span`` bytes that also starts in a text with
    a smaller key; strings may overlap, never cross texts, and are judged on the texts as given.  Returns per
    row: key, n_bytes, n_removed, spans (start and stop of the maximal removed stretches), kept (what is left, binary, as a
    cut may fall into a letter).

    A null or empty text has no bytes.  A row whose key is null keeps its text and takes nothing from others; rows of
    one key take nothing from each other; an empty table gives no rows; other columns are not read.  A long text is
    read in stretches of a megabyte.
    """
    named = rows.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text")).select(
        "key", F.xxhash64("text").alias("text_hash"), "text")
    starts = repeated_starts(named.where(F.col("key").isNotNull() & (F.length("text") >= span)), span)
    spans = starts.groupBy("key", "text_hash").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        for b in slices(batches, 64):
            value, runs = b.column("text"), b.column("runs")
            data = [v.as_buffer().to_pybytes() for v in value]
            base = np.cumsum([0] + [len(d) + 1 for d in data])       # texts laid out with a gap after each
            row = np.repeat(np.arange(len(data)), runs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            start, n = (x.to_numpy(zero_copy_only=False).astype("i8") for x in runs.flatten().flatten())
            start = start + base[row]
            order = np.argsort(start, kind="stable")
            start, row = start[order], row[order]
            reach = np.maximum.accumulate(start + n[order] + span - 1)
            fresh = np.append(True, start[1:] > reach[:-1])[:len(start)]
            first = np.flatnonzero(fresh)
            row, begin = row[first], start[first] - base[row[first]]
            end = reach[np.append(first[1:], len(start))[:len(first)] - 1] - base[row]
            edge = np.searchsorted(row, np.arange(len(data) + 1))
            gone = np.zeros(len(data), "i8")
            np.add.at(gone, row, end - begin)
            kept = data.copy()
            for i in np.unique(row).tolist():
                mine = slice(edge[i], edge[i + 1])
                kept[i] = b"".join(data[i][x:y] for x, y in zip([0, *end[mine].tolist()], [*begin[mine].tolist(), len(data[i])]))
            spans = pa.StructArray.from_arrays([pa.array(begin), pa.array(end)], names=["start", "stop"])
            yield pa.RecordBatch.from_arrays([
                b.column("key"), pa.array(np.diff(base) - 1), pa.array(gone), pa.ListArray.from_arrays(pa.array(edge.astype("i4")), spans),
                pa.array(kept, pa.binary())], names=["key", "n_bytes", "n_removed", "spans", "kept"])
    return named.join(spans, ["key", "text_hash"], "left").select("key", "text", "runs").mapInArrow(
        run, f"key {kind}, n_bytes bigint, n_removed bigint, spans array<struct<start: bigint, stop: bigint>>, kept binary"
    ).withColumnRenamed("key", key)
