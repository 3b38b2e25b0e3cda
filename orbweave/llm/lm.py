"""Language-model scores of verdict texts: a log-bilinear model trained by noise-contrastive estimation."""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from orbweave.llm.common import slices, texts, written

END = b"\n"              # never a word: words have no white space
WORDS = 1023             # most frequent words with an output of their own
GROUPS = 128             # outputs for all other words, by their last two bytes
KNOWN = 65_536           # most frequent words whose counts every task holds; the others' come by a join
DIM = 16
NOISE = 32
BATCH = 2048
ROUNDS = 2
RATE = 0.15
FLUSH = 200_000
CLASSES = WORDS + 1 + GROUPS


def words_of(text: bytes) -> list[bytes]:
    """Words of a text: A-Z lower-cased, cut at ASCII white space."""
    return text.lower().split()


# --- corpus counts ---------------------------------------------------------------------------------------

def word_counts(rows: DataFrame, learn, text: str) -> DataFrame:
    """Counts of every training token (word, c), the end of each text among them.  Counted per task first."""
    def run(batches):
        counts, ends = Counter(), 0

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
                                             names=["word", "c"])
            counts.clear()
            return out
        for b in slices(batches):
            for t in texts(b.column(0)):
                counts.update(words_of(t))
                ends += 1
            if len(counts) > FLUSH:
                yield flush()
        if ends:
            counts[END] += ends
            yield flush()
    return rows.where(learn).select(F.col(text)).mapInArrow(run, "word binary, c bigint").groupBy("word").agg(
        F.sum("c").alias("c"))


class Classes(dict):
    """Class of each word: its rank among the frequent words, 0 for the end, or the group of its last two bytes."""

    def __init__(self, frequent: list[bytes]):
        super().__init__({w: i + 1 for i, w in enumerate(frequent)})
        self._own = dict(self)
        self[END] = 0

    def __missing__(self, word: bytes) -> int:
        if len(self) > FLUSH:
            self.clear()
            self.update(self._own)
            self[END] = 0
            if word in self:
                return self[word]
        c = self[word] = WORDS + 1 + zlib.crc32(word[-2:]) % GROUPS
        return c

    def of(self, text: bytes) -> np.ndarray:
        words = words_of(text)
        words.append(END)
        return np.fromiter(map(self.__getitem__, words), "i2", len(words))


# --- the model -------------------------------------------------------------------------------------------

class LogBilinear:
    """p(w | u, v) is proportional to exp(q_w . (A r_u + B r_v) + b_w) for the two tokens u, v before w.

    Parameters are one flat vector, so that tasks' models can be averaged by Spark.
    """

    def __init__(self, unigram: np.ndarray, flat: np.ndarray | None = None):
        shapes = [(CLASSES + 1, DIM), (CLASSES, DIM), (CLASSES,), (DIM, DIM), (DIM, DIM)]
        sizes = np.cumsum([0, *(int(np.prod(s)) for s in shapes)])
        self.noise = unigram / unigram.sum()
        self._upto, self._log_kq = np.cumsum(self.noise), np.log(NOISE * self.noise).astype("f4")
        if flat is None:
            rng = np.random.default_rng(7)
            flat = np.zeros(sizes[-1])
            flat[:sizes[2]] = rng.normal(0, 0.3, sizes[2])
            flat[sizes[2]:sizes[3]] = np.log(self.noise)
            flat[sizes[3]:] = np.concatenate([np.eye(DIM).ravel(), 0.5 * np.eye(DIM).ravel()])
        self.flat = flat.astype("f4")
        self.r, self.q, self.b, self.a1, self.a2 = (
            self.flat[i:j].reshape(s) for i, j, s in zip(sizes, sizes[1:], shapes))
        self._seen = [np.full(p.shape, 0.1, "f4") for p in (self.r, self.q, self.b, self.a1, self.a2)]

    @staticmethod
    def _sum_rows(index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(index.astype("i2"), kind="stable")        # classes fit 16 bits: a radix sort
        i = index[order]
        starts = np.flatnonzero(np.diff(i, prepend=-1))
        return i[starts], np.add.reduceat(values.take(order, 0), starts, axis=0)

    def _move(self, which: int, index, gradient) -> None:
        """AdaGrad ascent on the rows ``index`` of a parameter."""
        p, seen = (self.r, self.q, self.b, self.a1, self.a2)[which], self._seen[which]
        seen[index] += gradient * gradient
        p[index] += RATE * gradient / np.sqrt(seen[index])

    def step(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, rng: np.random.Generator) -> None:
        """One noise-contrastive step: tell the tokens ``w`` from ``NOISE`` draws of the unigram distribution.

        The draws are shared by the batch, so that scores and gradients are matrix products.
        """
        n = len(w)
        drawn = np.searchsorted(self._upto, rng.random(NOISE)).clip(0, CLASSES - 1)
        log_kq = self._log_kq
        ru, rv, qw, qd = self.r.take(u, 0), self.r.take(v, 0), self.q.take(w, 0), self.q.take(drawn, 0)
        h = ru @ self.a1 + rv @ self.a2
        edge = self.b - log_kq
        true = 1 / (1 + np.exp(np.einsum("ij,ij->i", h, qw) + edge.take(w)))       # 1 - p(true)
        false = 1 / (1 + np.exp(-edge.take(drawn) - h @ qd.T))                     # p(true) of a draw
        gh = true[:, None] * qw - false @ qd
        targets = np.concatenate([w, drawn])
        ones = np.ones((n, 1), "f4")
        h1 = np.concatenate([h, ones], axis=1)               # the last column sums up for the biases
        i, g = self._sum_rows(targets, np.concatenate([true[:, None] * h1, -(false.T @ h1)]).astype("f4"))
        k, gr = self._sum_rows(np.concatenate([u, v]), np.concatenate([gh @ self.a1.T, gh @ self.a2.T]).astype("f4"))
        scale = np.float32(32.0 / n)
        self._move(1, i, g[:, :DIM] * scale)
        self._move(2, i, g[:, DIM] * scale)
        self._move(0, k, gr * scale)
        self._move(3, slice(None), (ru.T @ gh) * scale)
        self._move(4, slice(None), (rv.T @ gh) * scale)

    def log_normalisers(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """log of the sum over all classes, for each context."""
        e1, e2 = self.r @ self.a1, self.r @ self.a2
        out = np.empty(len(u), "f4")
        for at in range(0, len(u), 1024):
            scores = (e1[u[at:at + 1024]] + e2[v[at:at + 1024]]) @ self.q.T + self.b
            top = scores.max(axis=1)
            scores -= top[:, None]
            np.exp(scores, out=scores)
            out[at:at + 1024] = np.log(scores.sum(axis=1)) + top
        return out

    def scores(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        e1, e2 = self.r @ self.a1, self.r @ self.a2
        out = self.b.take(w)
        for at in range(0, len(w), 8192):            # stretches that stay in the cache
            part = slice(at, at + 8192)
            h = e1.take(u[part], 0)
            h += e2.take(v[part], 0)
            out[part] += np.einsum("ij,ij->i", h, self.q.take(w[part], 0))
        return out


def contexts(tokens: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two classes before each token of texts that begin at ``firsts``; before a text stands the start symbol."""
    u, v = np.full_like(tokens, CLASSES), np.full_like(tokens, CLASSES)
    v[1:], u[2:] = tokens[:-1], tokens[:-2]
    v[firsts] = u[firsts] = CLASSES
    seconds = firsts + 1
    u[seconds[seconds < np.append(firsts[1:], len(tokens))]] = CLASSES
    return u, v


def class_chains(rows: DataFrame, learn, text: str, frequent: list[bytes]) -> DataFrame:
    """The classes of each training text's tokens as 16-bit numbers, one text a row: what the rounds read."""
    def run(batches):
        classes = Classes(frequent)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([classes.of(t).tobytes() for t in texts(b.column(0))], pa.binary())], names=["chain"])
    return rows.where(learn).select(F.col(text)).mapInArrow(run, "chain binary")


def train_round(chains: DataFrame, unigram: np.ndarray, flat: np.ndarray | None) -> np.ndarray:
    """One pass over all training texts: every task trains a copy, and Spark averages them by tokens seen.

    A task sends its vector in rows of 64 values, whose sums stay on the executors; the driver gets one vector.
    """
    width = 64

    def run(batches):
        model = LogBilinear(unigram, flat)
        rng = np.random.default_rng(TaskContext.get().partitionId() + 1)
        chains, held, seen = [], 0, 0

        def learn_from(chains):
            w = np.concatenate(chains).astype("i4")
            u, v = contexts(w, np.cumsum([0, *map(len, chains[:-1])]))
            order = rng.permutation(len(w))
            for at in range(0, len(order), BATCH):
                mine = order[at:at + BATCH]
                model.step(u[mine], v[mine], w[mine], rng)
            return len(w)
        for b in slices(batches):
            for t in texts(b.column(0)):
                chains.append(np.frombuffer(t, "i2"))
                held += len(chains[-1])
                if held > 64 * BATCH:
                    seen += learn_from(chains)
                    chains, held = [], 0
        if chains:
            seen += learn_from(chains)
        if seen:
            vector = np.concatenate([model.flat, np.zeros(-len(model.flat) % width, "f4")]).astype("f8") * seen
            vector = vector.reshape(-1, width)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(vector))), pa.array([float(seen)] * len(vector)),
                 *(pa.array(vector[:, i]) for i in range(width))], names=["i", "n", *(f"v{i}" for i in range(width))])
    columns = [f"v{i}" for i in range(width)]
    summed = chains.mapInArrow(
        run, "i bigint, n double, " + ", ".join(f"{c} double" for c in columns)).groupBy("i").agg(
            F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in columns)).toPandas().sort_values("i")
    if not len(summed):
        return LogBilinear(unigram, flat).flat
    size = len(LogBilinear(unigram, flat).flat)
    return (summed[columns].to_numpy() / summed["n"].to_numpy()[:, None]).ravel()[:size].astype("f4")


# --- scoring ---------------------------------------------------------------------------------------------

_held: dict = {}


def lm_scores(rows: DataFrame, learn, key: str = "name", text: str = "verdict") -> DataFrame:
    """Log10 probability of every whole verdict text under a log-bilinear model and under smoothed counts.

    ``learn`` (a condition on the columns of ``rows``) marks the texts to learn from; all texts are scored.
    Returns per row: key, learned_from, n_tokens, n_known (tokens seen in training), train_tokens, base_score
    (unigram counts + 0.5), score (the model).  Tokens are words with A-Z lower-cased, then one end.  Null texts
    count as empty (only the end); repeated rows are scored each; an empty table gives none; without any text to
    learn from all counts are 0.  Other columns are not read.

    The model predicts 1,023 frequent words, the end, and 128 groups of all other words from the two tokens
    before; within a group a word has its share by counts, with room for one unknown word.  So the probabilities
    of a position sum to one.  Training sees every token of the texts to learn from, ``ROUNDS`` times.  Normalisers
    are computed once per context that occurs.

    Counts of all words stay a table.  Tasks hold those of the ``KNOWN`` most frequent words; a text's other words
    are joined to the table, each once per text, and are too rare to make a hot key.
    """
    kind = rows.schema[key].dataType.simpleString()
    learn = F.coalesce(learn, F.lit(False))
    counts = written(word_counts(rows, learn, text), "word-counts")
    total, distinct = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    total = total or 0
    top = counts.orderBy(F.desc("c"), "word").limit(KNOWN).collect()
    known = {bytes(r["word"]): r["c"] for r in top}
    frequent = [w for w in known if w != END][:WORDS]

    group = np.zeros(CLASSES)
    group[0] = known.get(END, 0)
    for i, w in enumerate(frequent):
        group[i + 1] = known[w]
    own = Classes(frequent)

    def group_sums(batches):                         # counts of all words without an output of their own
        sums = np.zeros((GROUPS, 2))
        for b in batches:
            for w, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if w not in own:
                    sums[zlib.crc32(w[-2:]) % GROUPS] += (c, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(GROUPS)), pa.array(sums[:, 0]), pa.array(sums[:, 1])],
                                         names=["g", "c", "n"])
    words_in = np.zeros(GROUPS)
    for r in counts.mapInArrow(group_sums, "g bigint, c double, n double").groupBy("g").agg(
            F.sum("c").alias("c"), F.sum("n").alias("n")).collect():
        group[WORDS + 1 + r["g"]], words_in[r["g"]] = r["c"], r["n"]
    unigram = group + 0.5
    chains = written(class_chains(rows, learn, text, frequent), "class-chains")
    flat = None
    for _ in range(ROUNDS):
        flat = train_round(chains, unigram, flat)
    share = np.log10(group[WORDS + 1:] + 0.5 * (words_in + 1))      # what a group's words share, one unknown included
    base_all = np.log10(total + 0.5 * (distinct + 1))
    at_hand = {w: i for i, w in enumerate(known)}
    own_class = [0 if w == END else own[w] for w in known] + [0]
    own_log = np.array([np.log10(c + 0.5) for c in known.values()] + [0.0])
    stamp = zlib.crc32(flat.tobytes())

    def run(batches):
        model, classes = LogBilinear(unigram, flat), Classes(frequent)
        if _held.get("stamp") != stamp:              # normalisers met so far; one float per pair of classes
            _held.update(stamp=stamp, z=np.full((CLASSES + 1) ** 2, np.nan, "f4"))
        class_of = np.array(own_class, "i4")
        z, task, row = _held["z"], TaskContext.get().partitionId(), 0
        for b in slices(batches, 1000):
            keys, held_out, sizes, n_known, base, score, tails, tail_n = b.column(0), b.column(2), [], [], [], [], [], []
            chains, rest = [], []
            for t in texts(b.column(1)):
                words = words_of(t)
                words.append(END)
                place = np.fromiter(map(at_hand.get, words, repeat(-1)), "i4", len(words))
                chain, logs = class_of[place], own_log[place]
                far = np.flatnonzero(place < 0)
                unknown = Counter([words[i] for i in far.tolist()])
                if len(far):
                    chain[far] = np.fromiter((classes[words[i]] for i in far.tolist()), "i4", len(far))
                chains.append(chain)
                sizes.append(len(words))
                n_known.append(len(words) - len(far))
                base.append(float(logs.sum()) - len(words) * base_all)
                # of the words in groups the model still needs their counts, as far as they are at hand
                rest.append(float(logs[chain > WORDS].sum()))
                tails.append(list(unknown))
                tail_n.append(list(unknown.values()))
            w = np.concatenate(chains)
            firsts = np.cumsum(sizes) - sizes
            u, v = contexts(w, firsts)
            pair = u.astype("i8") * (CLASSES + 1) + v
            new = np.unique(pair[np.isnan(z[pair])])
            z[new] = model.log_normalisers(new // (CLASSES + 1), new % (CLASSES + 1))
            each = (model.scores(u, v, w).astype("f8") - z[pair]) / np.log(10)
            each -= np.where(w > WORDS, share[np.maximum(w - WORDS - 1, 0)], 0.0)
            score = np.add.reduceat(each, firsts) + np.array(rest)
            yield pa.RecordBatch.from_arrays([
                pa.array([(task << 33) + row + i for i in range(len(sizes))], pa.int64()), keys, held_out,
                pa.array(sizes, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(score),
                pa.array(tails, pa.list_(pa.binary())), pa.array(tail_n, pa.list_(pa.int64()))],
                names=["row", "key", "learned", "n_tokens", "n_known", "base", "score", "tail", "tail_n"])
            row += len(sizes)
    parts = written(rows.select(F.col(key).alias("key"), F.col(text).alias("text"), learn.alias("learned")).mapInArrow(
        run, f"row bigint, key {kind}, learned boolean, n_tokens bigint, n_known bigint, base double, score double, "
             "tail array<binary>, tail_n array<bigint>"), "text-scores")
    tail = parts.select("row", F.explode(F.arrays_zip("tail", "tail_n")).alias("t")).select(
        "row", F.col("t.tail").alias("word"), F.col("t.tail_n").alias("n"))
    extra = tail.join(counts, "word", "left").select(
        "row", (F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))).alias("more"),
        F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0).alias("seen"))
    more = extra.groupBy("row").agg(F.sum("more").alias("more"), F.sum("seen").alias("seen"))
    none = F.lit(0.0)
    return parts.drop("tail", "tail_n").join(more, "row", "left").select(
        F.col("key").alias(key), F.col("learned").alias("learned_from"), "n_tokens",
        (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", none)).alias("base_score"),
        (F.col("score") + F.coalesce("more", none)).alias("score"))
