"""Language of verdict texts: the nearest of several centroids of TF-IDF n-gram vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orbweave.llm.common import slices, texts
from orbweave.llm.toxicity import LETTERS

SAMPLE = 600             # bound of the training texts per language that centroids are fitted on
CENTROIDS = 3
PAIRS, TRIPLES = 4096, 8192
SIZE = 256 + PAIRS + TRIPLES
REJECT = 0.25            # share of the least training similarity at that length below which a text is rejected
UNKNOWN = "und"


def has_letter(text: bytes) -> bool:
    """Any letter of any script."""
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def ngram_counts(text: bytes) -> np.ndarray:
    """Counts of byte 1-, 2- and 3-grams of the words of a text; the longer ones by hash."""
    words = b" " + b" ".join(text.translate(LETTERS).split()) + b" "
    b = np.frombuffer(words, "u1").astype("u4")
    two = (b[:-1] << np.uint32(8)) | b[1:]
    three = (two[:-1] << np.uint32(8)) | b[2:]
    one = np.bincount(b, minlength=256)
    one[32] = 0
    return np.concatenate([one, np.bincount((two * np.uint32(0x9E3779B1)) >> np.uint32(20), minlength=PAIRS),
                           np.bincount((three * np.uint32(0x85EBCA6B)) >> np.uint32(19), minlength=TRIPLES)])


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit rows of log term frequency times inverse document frequency."""
    x = np.log1p(counts, dtype="f4") * idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def length_bin(counts: np.ndarray) -> np.ndarray:
    """log2 of the number of letters, by which short texts are compared with short ones."""
    return np.log2(1 + counts[:, :256].sum(axis=1))


def centroids(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means: unit means of the rows nearest to each; seeds are far apart."""
    c = [x.mean(axis=0)]
    for _ in range(min(k, len(x)) - 1):
        c.append(x[np.argmin(np.max(x @ np.array(c).T, axis=1))])
    c = np.array(c)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        near = np.argmax(x @ c.T, axis=1)
        c = np.array([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


class Model:
    """Centroids of all languages, their idf, and per language the least similarity seen by text length."""

    def __init__(self, idf, langs, points, floors):
        self.idf, self.langs, self.points, self.floors = idf, langs, points, floors

    def predict(self, counts: np.ndarray):
        """Language, cosine and whether the text is too far from every centroid, for rows of counts."""
        similar = vectors(counts, self.idf) @ self.points.T
        best = np.argmax(similar, axis=1)
        cosine = np.clip(similar[np.arange(len(best)), best], 0, 1).astype("f8")
        bins = length_bin(counts)
        out = [self.langs[i] for i in best]
        far = [c < REJECT * np.interp(at, *self.floors[lang]) for c, at, lang in zip(cosine, bins, out)]
        return out, cosine, far


def fit(rows: DataFrame, learn, lang: str = "lang", text: str = "verdict") -> Model | None:
    """Centroids from the texts that ``learn`` marks and whose language is known; ``None`` if there are none.

    Document frequencies cover all of them; centroids are fitted on at most ``SAMPLE`` different texts per language,
    picked by a hash of the text.
    """
    training = rows.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(lang, text)

    def frequencies(batches):
        df, n = np.zeros(SIZE, "i8"), 0
        for b in slices(batches):
            for t in texts(b.column(0)):
                df += ngram_counts(t) > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SIZE + 1)), pa.array(np.append(df, n))], names=["i", "n"])
    df = {r["i"]: r["n"] for r in training.select(text).mapInArrow(frequencies, "i bigint, n bigint").groupBy("i").agg(
        F.sum("n").alias("n")).collect()}
    n = df.pop(SIZE, 0)
    if not n:
        return None
    idf = np.log((1 + n) / (1 + np.array([df[i] for i in range(SIZE)]))).astype("f4") + np.float32(0.1)
    per_lang = {r[lang]: r["n"] for r in training.groupBy(lang).agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.create_map(*(F.lit(x) for k, c in per_lang.items() for x in (k, int(min(1.0, 2 * SAMPLE / c) * (1 << 30)) + 1)))
    place = F.pmod(F.xxhash64(text), F.lit(1 << 30))
    sample = training.where(place < F.element_at(share, F.col(lang))).dropDuplicates([lang, text])

    def fit_one(part: pa.Table) -> pa.Table:
        picked = sorted(texts(part[text].combine_chunks()))[:4 * SAMPLE]
        rng = np.random.default_rng(0)
        picked = [picked[i] for i in sorted(rng.permutation(len(picked))[:SAMPLE])]
        counts = np.array([ngram_counts(t) for t in picked], "f4")
        x = vectors(counts, idf)
        c = centroids(x, CENTROIDS)
        nearest, at = (x @ c.T).max(axis=1), np.floor(length_bin(counts))
        where = np.unique(at)
        return pa.table({lang: part[lang].slice(0, 1), "points": pa.array([c.ravel().tolist()], pa.list_(pa.float64())),
                         "bins": pa.array([where.tolist()], pa.list_(pa.float64())),
                         "floors": pa.array([[float(nearest[at == b].min()) for b in where]], pa.list_(pa.float64()))})
    fitted = sample.groupBy(lang).applyInArrow(
        fit_one, f"`{lang}` string, points array<double>, bins array<double>, floors array<double>").collect()
    langs, points, floors = [], [], {}
    for r in sorted(fitted, key=lambda r: r[lang]):
        c = np.array(r["points"], "f4").reshape(-1, SIZE)
        langs += [r[lang]] * len(c)
        points.append(c)
        floors[r[lang]] = (r["bins"], r["floors"])
    return Model(idf, langs, np.concatenate(points), floors)


def languages(rows: DataFrame, learn, lang: str = "lang", key: str = "name", text: str = "verdict",
              keep: tuple[str, ...] = ()) -> DataFrame:
    """Language of every whole verdict text: key, lang_pred, score (cosine to its centroid), rejected.

    ``learn`` marks the rows whose ``lang`` may be used; language and key are never inputs of a prediction.  A text
    that is null or has no letter, and every text if nothing could be learned, is ``und`` with score 0 and rejected.
    Others get the language of the nearest centroid, and are rejected when their cosine is below ``REJECT``
    times the least that training texts of this language and length have.  Ties go to the language first in
    the alphabet; repeated rows are predicted each; an empty table gives none.  ``keep`` names columns to hand on.
    """
    model = fit(rows, learn, lang, text)

    def run(batches):
        for b in slices(batches, 128):
            values = list(texts(b.column("__text")))
            out, score, far = [UNKNOWN] * len(values), [0.0] * len(values), [True] * len(values)
            mine = [i for i, t in enumerate(values) if model is not None and has_letter(t)]
            if mine:
                for i, l_, s, f in zip(mine, *model.predict(np.array([ngram_counts(values[i]) for i in mine], "f4"))):
                    out[i], score[i], far[i] = l_, float(s), bool(f)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(n) for n in (key, *keep)), pa.array(out, pa.string()), pa.array(score, pa.float64()),
                 pa.array(far, pa.bool_())], names=[key, *keep, "lang_pred", "score", "rejected"])
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (key, *keep))
    return rows.select(key, *keep, F.col(text).alias("__text")).mapInArrow(
        run, f"{kinds}, lang_pred string, score double, rejected boolean")
