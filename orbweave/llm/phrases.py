"""Recurring phrases of verdict texts: Rabin-Karp fingerprints of all word n-grams, counted by shuffle, read back as text."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from orbweave.functions.skew import attach
from orbweave.llm.common import slices, texts, utf8, written
from orbweave.llm.sieve import BYTE_POWERS, BYTES, WORD_POWERS, Prefix, held, mix, sieve

BLOCK = 1 << 20            # bytes of text hashed at once
PRINTS = 1 << 20           # fingerprints counted at once
PHRASES = 100_000          # phrases a task adds up before it hands them on
LONGEST = 4
_BREAK = np.zeros(256, "u1")
_BREAK[[0x20, 0x09]] = 1
_BREAK[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_EDGE = re.compile(rb"[\x20\x09.,;:!?\x0A-\x0D]")
_STEP = np.arange(1, LONGEST + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15)


# --- blocks of text --------------------------------------------------------------------------------------

def cut_text(data: bytes, size: int = BLOCK) -> Iterator[tuple[bytes, int]]:
    """A text in stretches of about ``size`` bytes that end between words, each after up to three words of its piece
    that came before it: (bytes, how many words came before)."""
    at, lead, seen = 0, b"", 0
    while True:
        edge = _EDGE.search(data, at + size) if len(data) - at > size else None
        stop = edge.start() if edge else len(data)
        yield lead + data[at:stop], seen
        if not edge:
            return
        tail = lead + data[at:stop]
        piece = re.split(rb"[.,;:!?\x0A-\x0D]", tail)[-1]
        words = [w for w in re.split(rb"[\x20\x09]+", piece) if w][1 - LONGEST:]
        lead, seen, at = b" ".join(words), len(words), stop


def blocks(batches, size: int = BLOCK):
    """Lower-cased texts in groups of about ``size`` bytes: [(group value, bytes, words before)]."""
    out, total = [], 0
    for b in slices(batches, 64):
        for group, data in zip(b.column(0).to_pylist(), texts(b.column(1))):
            for part, seen in cut_text(utf8(data).lower(), size):
                out.append((group, part, seen))
                total += len(part)
                if total >= size:
                    yield out
                    out, total = [], 0
    if out:
        yield out


class Block:
    """Words of a group of texts and the fingerprints of their n-grams.

    Texts are joined by a line break, which no phrase crosses.  A fingerprint covers the words of an n-gram, their
    number and the text's group.
    """

    def __init__(self, rows: list[tuple]):
        self.data = np.frombuffer(b"\n".join(r[1] for r in rows), "u1")
        kind = _BREAK[self.data]
        edge = np.diff((kind == 0).astype("i1"), prepend=0, append=0)
        self.start, self.stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        ends = np.cumsum([len(r[1]) + 1 for r in rows])
        self.text = np.searchsorted(ends, self.start, side="right")
        piece = np.cumsum(kind == 2, dtype="i4")[self.start] if len(self.start) else np.zeros(0, "i4")
        first = np.searchsorted(self.text, np.arange(len(rows)))
        before = np.array([r[2] for r in rows])
        own = np.arange(len(self.text)) - first[self.text] >= before[self.text]
        self.words = Prefix(BYTES[self.data], BYTE_POWERS).hash(self.start, self.stop)
        self._chain = Prefix(mix(self.words), WORD_POWERS)
        salt = {g: int.from_bytes(hashlib.blake2b(repr(g).encode(), digest_size=8).digest(), "little")
                for g in {r[0] for r in rows}}
        self._salt = np.array([salt[r[0]] for r in rows], "u8")
        self._piece, self._own = piece, own

    def places(self, n: int) -> np.ndarray:
        """First words of the n-grams that lie in one piece and end in this block's own text."""
        if len(self.start) < n:
            return np.zeros(0, "i8")
        last = self._piece[n - 1:]
        return np.flatnonzero((self._piece[:len(last)] == last) & self._own[n - 1:])

    def prints(self, at: np.ndarray, n: int) -> np.ndarray:
        return mix(self._chain.hash(at, at + n) + _STEP[n - 1] ^ self._salt[self.text[at]])

    def frequent(self, n: int, sets: list[np.ndarray]) -> np.ndarray:
        """Places of the n-grams all of whose shorter parts may be frequent by the sets found so far."""
        at = self.places(n)
        if n > 1:
            part = self.prints(np.arange(max(0, len(self.start) - n + 2)), n - 1)
            good = held(sets[n - 2], part)
            at = at[good[at] & good[at + 1]]
        return at

    def word_numbers(self) -> np.ndarray:
        """A number per word that two words share exactly when their bytes are equal: equal hashes are compared."""
        _, first, number = np.unique(self.words, return_index=True, return_inverse=True)
        a, b, size = self.start, self.start[first[number]], self.stop - self.start
        same = (size == (self.stop - self.start)[first[number]]).all()
        if same:
            offset = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            same = (self.data[np.repeat(a, size) + offset] == self.data[np.repeat(b, size) + offset]).all()
        if not same:                                             # two words share a hash: number them by their bytes
            names: dict[bytes, int] = {}
            number = np.array([names.setdefault(self.data[i:j].tobytes(), len(names)) for i, j in zip(self.start, self.stop)])
        return number

    def phrase(self, at: int, n: int) -> bytes:
        return b" ".join(self.data[self.start[i]:self.stop[i]].tobytes() for i in range(at, at + n))

    def groups(self, at: np.ndarray, n: int, number: np.ndarray, kinds: np.ndarray):
        """Place and size of every distinct phrase among the places: (first places, counts), compared word by word."""
        _, first, mine = np.unique(self.prints(at, n), return_index=True, return_inverse=True)
        shape = np.column_stack([kinds[self.text[at]], *(number[at + i] for i in range(n))])
        if (shape != shape[first[mine]]).any():                  # a collision: group by the words themselves
            _, first, mine = np.unique(shape, axis=0, return_index=True, return_inverse=True)
        return at[first], np.bincount(mine.ravel(), minlength=len(first))


# --- on Spark --------------------------------------------------------------------------------------------

def _frequent_prints(rows: DataFrame, n: int, sets: list, least: int) -> DataFrame:
    """Fingerprints of n-grams that occur ``least`` times or more: the shuffle adds up what blocks have counted."""
    def run(batches):
        kept, size = [], 0

        def counted():
            fp, c = np.unique(np.concatenate(kept), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(fp.view("i8")), pa.array(c.astype("i8"))], names=["fp", "c"])
        for rows_ in blocks(batches):
            block = Block(rows_)
            kept.append(block.prints(block.frequent(n, [s.value for s in sets]), n))
            size += len(kept[-1])
            if size >= PRINTS:
                yield counted()
                kept, size = [], 0
        if size:
            yield counted()
    return rows.mapInArrow(run, "fp bigint, c bigint").groupBy("fp").agg(F.sum("c").alias("c")).where(
        F.col("c") >= least).select("fp")


def _phrases(rows: DataFrame, sets: list) -> DataFrame:
    """Text and count of the phrases whose fingerprints may be frequent; words 0 holds a group's number of words."""
    kind = rows.schema["grp"].dataType
    group_type = to_arrow_type(kind)

    def run(batches):
        added: dict[tuple, int] = {}

        def out():
            keys = list(added)
            return pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in keys], group_type), pa.array([k[2] for k in keys], pa.binary()),
                pa.array([k[1] for k in keys], pa.int32()), pa.array(list(added.values()), pa.int64())],
                names=["grp", "phrase", "words", "f"])
        for rows_ in blocks(batches, 4 * BLOCK):
            block = Block(rows_)
            number, names = block.word_numbers(), {}
            kinds = np.array([names.setdefault(r[0], len(names)) for r in rows_])
            values = list(names)
            total = np.bincount(kinds[block.text[block.places(1)]], minlength=len(values)).tolist()
            for g, c in zip(values, total):
                added[g, 0, b""] = added.get((g, 0, b""), 0) + c
            for n in range(1, LONGEST + 1):
                at = block.places(n)
                at = at[held(sets[n - 1].value, block.prints(at, n))]
                if len(at):
                    for i, c in zip(*map(np.ndarray.tolist, block.groups(at, n, number, kinds))):
                        k = values[kinds[block.text[i]]], n, block.phrase(i, n)
                        added[k] = added.get(k, 0) + c
            if len(added) >= PHRASES:
                yield out()
                added = {}
        if added:
            yield out()
    return rows.mapInArrow(run, f"grp {kind.simpleString()}, phrase binary, words int, f bigint").groupBy("grp", "words", "phrase").agg(
        F.sum("f").alias("f")).select("grp", "words", F.col("phrase").cast("string").alias("phrase"), "f")


def phrase_counts(rows: DataFrame, group: str, text: str, least: int) -> DataFrame:
    """Exact counts of all phrases of one to four words that occur at least ``least`` times in a group, and one row of
    words 0 with the group's number of words: grp, words, phrase, f.

    One pass per length: every n-gram is hashed by prefix polynomials over bytes and words, and those whose two shorter
    parts are both frequent are counted by fingerprint.  The sets of frequent fingerprints go to all tasks as bits,
    whose size ends at 128 MB each.  The last pass reads the text at the first place of each frequent fingerprint of a
    block, after comparing all other places with it word by word, and the shuffle adds up by text: a collision costs
    time and changes no count.
    """
    sc = rows.sparkSession.sparkContext
    source = rows.select(F.col(group).alias("grp"), F.col(text).alias("text"))
    sets: list = []
    for n in range(1, LONGEST + 1):
        found = written(_frequent_prints(source, n, sets, least), f"frequent-{n}")
        sets.append(sc.broadcast(sieve(found)))
    return _phrases(source, sets).where((F.col("f") >= least) | (F.col("words") == 0))


def collocations(rows: DataFrame, group: str = "system", text: str = "verdict", least: int = 30, top: int = 2000,
                 share: int = 80) -> DataFrame:
    """The phrases of two to four words that stick together most, per group (such as the system a verdict is from).

    Texts are lower-cased (A-Z), cut at ``.,;:!?`` and line breaks into pieces and those at blanks and tabs into words.
    ``n``: words of the group; ``a``: the phrase's occurrences, overlaps included, at least ``least``.  A cut after
    the first words gives ``l`` and ``r``, the occurrences of the two parts, and the score floor(2000000 a / (l + r)); the
    lowest cut counts, ties the shortest first part.  A phrase that lies inside a longer one with at least ``share``
    percent of its occurrences is left out.  Returns the first ``top`` of each group by falling score and a,
    then phrase in byte order: group, rank, phrase, a, l, r, n, score.

    A null group is ``und`` (if groups are strings), a null or empty text has no words; repeated rows count each; an
    empty table gives no rows; other columns are not read.  Bytes that are not UTF-8 count as U+FFFD.  A text
    of any length is read in stretches of a megabyte; only one word or piece of three words is held beyond that.
    No table of phrases is broadcast, however small its file looks to Spark.
    """
    kind = rows.schema[group].dataType.simpleString()
    value = F.coalesce(group, F.lit("und")) if kind == "string" else F.col(group)
    counts = written(phrase_counts(rows.select(value.alias("grp"), F.col(text).alias("text")), "grp", "text", least), "phrases")
    known = counts.where("words > 0").select("grp", "phrase", "f")
    found = counts.where("words > 1").withColumn("w", F.split("phrase", " "))
    joined = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cuts = found.select("grp", "phrase", F.col("f").alias("a"), "words", "w", F.explode(
        F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
            "grp", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("first"),
            joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = attach(cuts, known.withColumnsRenamed({"phrase": part, "f": name}), ["grp", part], ["phrase"], "inner", shuffled=True)
    score = F.expr("(cast(a as decimal(20,0)) * 2000000BD) div cast(l + r as decimal(20,0))")
    scored = cuts.withColumn("score", score.cast("long")).groupBy("grp", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("m")).select("grp", "phrase", "a", "m.l", "m.r", "m.score")
    inner = found.where("words > 2").select("grp", "f", "w", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("s"), "words") \
        .select("grp", "f", "w", "s", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("s") + 1)).alias("at")) \
        .select("grp", joined(F.col("at"), F.col("s")).alias("phrase"), "f").groupBy("grp", "phrase").agg(F.max("f").alias("longer"))
    kept = scored.join(inner.hint("merge"), ["grp", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * share))
    best = Window.partitionBy("grp").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    sizes = counts.where("words = 0").select("grp", F.col("f").alias("n")).hint("merge")
    return ranked.join(sizes, "grp").select(
        F.col("grp").alias(group), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
