"""Toxicity of verdict texts: non-negative positive-unlabelled learning of numpy classifiers."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orbweave.llm.common import slices, texts

POSITIVES = 4_000        # bound of the sample of confirmed toxic texts
UNLABELLED = 12_000      # bound of the sample of unlabelled texts
CANDIDATES = 20_000      # bound of the words considered
FEATURES = 1024          # words and stems used
MEMBERS = 2              # classifiers, averaged
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def word_set(text: bytes) -> set[bytes]:
    """Distinct words of a text: runs of letters (and of bytes beyond ASCII), A-Z lower-cased; and their stems.

    A stem is the first five bytes of a longer word, marked so that it differs from any word.
    """
    words = set(text.translate(LETTERS).split())
    return words | {b"^" + w[:5] for w in words if len(w) > 5}


# --- the classifier --------------------------------------------------------------------------------------

def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.1,
             decay: float = 0.1, seed: int = 0) -> np.ndarray:
    """Linear weights (bias last) that minimise the non-negative positive-unlabelled risk with logistic loss.

    The risk is ``prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)])``.  Where the second term falls
    below zero the step goes the other way along its gradient, which keeps the model from fitting the unlabelled
    sample as if it were all negative.  Steps are Adam's, on random halves of both samples, with a rate that falls
    evenly to zero, so that the turns between the two directions die out; weights shrink by ``decay`` over the number
    of positives.
    """
    rng = np.random.default_rng(seed)
    positive, unlabelled = (rng.permutation(x).astype("f4") for x in (positive, unlabelled))
    w = np.zeros(positive.shape[1] + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)

    def half(x):
        """A random run of half the rows, without a copy; small samples whole."""
        n = len(x) if len(x) <= 20 else len(x) // 2
        at = int(rng.integers(len(x) - n + 1))
        return x[at:at + n]

    def terms(x):
        g = (x @ w[:-1].astype("f4")).astype("f8") + w[-1]
        p = 1 / (1 + np.exp(-g))
        up = lambda weight: np.append(weight.astype("f4") @ x, weight.sum()) / len(x)
        return np.logaddexp(0, g).mean(), up(p), up(p - 1)      # loss as negative, its gradient, gradient as positive
    for t in range(1, steps + 1):
        loss_p, down_p, up_p = terms(half(positive))
        loss_u, down_u, _ = terms(half(unlabelled))
        rest = loss_u - prior * loss_p
        gradient = prior * up_p + down_u - prior * down_p if rest >= 0 else prior * down_p - down_u
        gradient[:-1] += decay / len(positive) * w[:-1]
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient ** 2
        w -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w


# --- on Spark --------------------------------------------------------------------------------------------

def _document_counts(rows: DataFrame, text: str, wanted: set[bytes] | None) -> DataFrame:
    """Number of texts with each word (of ``wanted``, if given); one more row, with a null word, counts the texts."""
    def run(batches):
        counts, n = Counter(), 0
        for b in slices(batches):
            for t in texts(b.column(0)):
                found = word_set(t)
                counts.update(found if wanted is None else found & wanted)
                n += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([None, *counts], pa.binary()), pa.array([n, *counts.values()], pa.int64())], names=["word", "n"])
    return rows.select(F.col(text)).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _sampled(rows: DataFrame, bound: int, total: int, *by) -> DataFrame:
    """At most ``bound`` rows, picked by a hash of ``by``; the hash alone thins them before any are gathered."""
    if not total:
        return rows.limit(0)
    place = F.pmod(F.xxhash64(*by), F.lit(1 << 30))
    return rows.where(place < int(min(1.0, 1.3 * bound / total) * (1 << 30)) + 1).orderBy(place, *by).limit(bound)


def _sampled_found(rows: DataFrame, bound: int, total: int, key: str, text: str, features) -> DataFrame:
    """What ``features`` finds in at most ``bound`` rows, picked by a hash of key and text: copies count by their share.

    Texts never leave their tasks; the hash alone thins the rows before any are gathered.
    """
    place = F.pmod(F.xxhash64(key, text), F.lit(1 << 30))
    share = int(min(1.0, 1.3 * bound / max(1, total)) * (1 << 30)) + 1
    return rows.where(place < share).select(place.alias("place"), text).mapInArrow(
        features, "place bigint, found array<int>").orderBy("place", "found").limit(bound)


def fit(rows: DataFrame, labels: DataFrame, learn, label: str = "toxic", key: str = "name", text: str = "verdict",
        prior: float | None = None):
    """Words and weights learned from the texts that ``learn`` marks; ``None`` if no text is confirmed toxic.

    Confirmed texts are those with label 1; all texts to learn from are the unlabelled ones.  The class prior is the
    share of label 1 among their labels unless given.  Word counts cover all texts to learn from; the classifiers are
    fitted on samples of at most ``POSITIVES`` and ``UNLABELLED`` texts.
    """
    known = labels.where(learn(F.col(key)) & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias("y"))
    n_known, n_toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n_toxic:
        return None
    prior = min(0.95, max(0.001, prior or n_toxic / n_known))
    chosen = _sampled(known.where("y = 1").select(key), POSITIVES, n_toxic, key)
    # at most POSITIVES keys: bounded, so it may go to every task
    chosen = F.broadcast(rows.sparkSession.createDataFrame(chosen.collect(), chosen.schema))
    training = rows.where(learn(F.col(key))).select(key, text)
    toxic = training.join(chosen, key, "left_semi")
    found = {bytes(r["word"]) if r["word"] is not None else None: r["n"] for r in _document_counts(toxic, text, None)
             .where("word is null or n >= 5").orderBy(F.desc("n"), "word").limit(CANDIDATES + 1).collect()}
    n_p = found.pop(None, 0)
    overall = {bytes(r["word"]) if r["word"] is not None else None: r["n"]
               for r in _document_counts(training, text, set(found)).collect()}
    n_u = overall.pop(None, 0)
    if not n_p or not n_u:
        return None
    z = {}
    for w, a in found.items():                       # difference of two shares in standard errors
        p, q = a / n_p, overall.get(w, 0) / n_u
        z[w] = (p - q) / np.sqrt(max(1e-12, q * (1 - q) + 1e-6) * (1 / n_p + 1 / n_u))
    words = sorted((w for w in z if abs(z[w]) >= 5), key=lambda w: (-abs(z[w]), w))[:FEATURES] or \
        sorted(z, key=lambda w: (-abs(z[w]), w))[:8]
    place = {w: i for i, w in enumerate(words)}

    def features(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(
                [[place[w] for w in word_set(t) & place.keys()] for t in texts(b.column(1))], pa.list_(pa.int32()))],
                names=["place", "found"])

    def matrix(found):
        rows_ = found.collect()
        x = np.zeros((len(rows_), len(words)), "f4")
        for i, r in enumerate(rows_):
            x[i, r["found"]] = 1
        return x
    positive = matrix(toxic.select(F.lit(0).cast("long"), text).mapInArrow(features, "place bigint, found array<int>"))
    unlabelled = matrix(_sampled_found(training, UNLABELLED, n_u, key, text, features))
    members = [fit_nnpu(positive, unlabelled, prior, seed=s) for s in range(MEMBERS)]
    return place, np.mean(members, axis=0)


def toxicity(rows: DataFrame, labels: DataFrame, learn, label: str = "toxic", key: str = "name", text: str = "verdict",
             keep: tuple[str, ...] = ()) -> DataFrame:
    """Probability that each whole verdict text is toxic: key, score (0 to 1), predicted (1 from 0.5 on).

    ``labels``: key and a 0/1 label of some rows; ``learn``: a function of the key column that marks the keys whose
    labels may be used.  Labels and keys are never inputs of a score.  Null texts count as empty; repeated rows are
    scored each; null labels are no labels, of several for a key the largest counts; without a confirmed toxic text
    all scores are 0.  ``keep`` names columns to hand on; the other columns are not read.  An empty table gives none.
    """
    model = fit(rows, labels, learn, label, key, text)
    place, weights = model or ({}, np.array([-np.inf]))

    def run(batches):
        for b in slices(batches):
            scores = []
            for t in texts(b.column("__text")):
                g = weights[-1] + sum(weights[place[w]] for w in word_set(t) & place.keys())
                scores.append(float(1 / (1 + np.exp(-g))))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(n) for n in (key, *keep)), pa.array(scores, pa.float64()),
                 pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=[key, *keep, "score", "predicted"])
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (key, *keep))
    return rows.select(key, *keep, F.col(text).alias("__text")).mapInArrow(run, f"{kinds}, score double, predicted int")
