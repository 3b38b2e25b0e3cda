"""Language-model scores, language, toxicity and nearest neighbours: exact parts by brute force, learned ones held out."""
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F, types as T

from orbweave.llm import langid, lm, neighbours, toxicity


def split5(key, not_):
    return key is not None and zlib.crc32(str(key).encode()) % 5 != not_


# --- language model --------------------------------------------------------------------------------------

def lower(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


def brute_base(rows, learned):
    counts = Counter()
    for (_, t), on in zip(rows, learned):
        if on:
            counts.update(lower(t).split())
            counts[b"\n"] += 1
    n, v = sum(counts.values()), len(counts)
    out = []
    for (k, t), on in zip(rows, learned):
        words = [*lower(t).split(), b"\n"]
        out.append((k, on, len(words), sum(counts[w] > 0 for w in words), n,
                    sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)))
    return out


def scores_of(spark, df, learn):
    return [(r["name"], r["learned_from"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"])
            for r in lm.lm_scores(df, learn).collect()]


def test_base_scores(spark, verdicts, odd_rows, monkeypatch):
    monkeypatch.setattr(lm, "KNOWN", 3)              # most words' counts come by the join
    learned = [k is not None and k % 2 == 0 for k, _ in odd_rows]
    got = scores_of(spark, verdicts(odd_rows), F.col("name") % 2 == 0)
    want = brute_base(odd_rows, learned)
    assert sorted((g[:5] for g in got), key=repr) == sorted((w[:5] for w in want), key=repr)
    assert sorted(round(g[5], 6) for g in got) == pytest.approx(sorted(round(w[5], 6) for w in want), rel=1e-9)
    assert all(np.isfinite(g[6]) and g[6] < 0 for g in got)


def test_nothing_to_learn_from(spark, verdicts):
    got = scores_of(spark, verdicts([(1, "rim"), (2, None)]), F.lit(False))
    assert {g[4] for g in got} == {0} and {g[3] for g in got} == {0} and all(np.isfinite(g[6]) for g in got)
    assert lm.lm_scores(verdicts([]), F.lit(True)).count() == 0


def test_probabilities_sum_to_one(spark, verdicts):
    """Over all known words and one unknown word per group, the scores of one-word texts add up."""
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"w{j}" for j in rng.zipf(1.5, 12) if j < 5000)) for i in range(400)]
    words = sorted({w for _, t in rows for w in t.split()})
    probe = [(1000 + i, w) for i, w in enumerate(words)]
    got = {g[0]: g for g in scores_of(spark, verdicts(rows + probe + [(999, "")]), F.col("name") < 900)}
    end_after_start = got[999][6]
    assert end_after_start < 0
    model_mass = sum(10 ** got[k][6] for k, _ in probe)          # p(word) * p(end | word): at most p(word)
    assert model_mass + 10 ** end_after_start < 1 + 1e-6


def test_normalisers():
    rng = np.random.default_rng(2)
    model = lm.LogBilinear(rng.random(lm.CLASSES) + 0.1)
    u, v = rng.integers(0, lm.CLASSES, 5), rng.integers(0, lm.CLASSES, 5)
    z = model.log_normalisers(u, v)
    every = np.array([[model.scores(u[i:i + 1], v[i:i + 1], np.array([w]))[0] for w in range(lm.CLASSES)] for i in range(2)])
    assert np.allclose(np.exp(every - z[:2, None]).sum(axis=1), 1, atol=1e-4)


def test_model_beats_counts_on_held_out_texts(spark, verdicts):
    rng = np.random.default_rng(3)
    tongue = [[f"{p}{i}" for i in range(40)] for p in "abc"]
    rows = [(i, " ".join(rng.choice(tongue[i % 3], 80))) for i in range(600)]
    got = lm.lm_scores(verdicts(rows), F.col("name") % 5 != 1).where(~F.col("learned_from")).agg(
        F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1] * 0.95


# --- language --------------------------------------------------------------------------------------------

SYLLABLES = {"en": ["th", "ing", "er", "ou", "ed"], "fr": ["eau", "é", "que", "oi", "aux"], "de": ["sch", "ung", "ei", "ä", "tz"]}


def language_rows(n=450):
    rng = np.random.default_rng(4)
    out = []
    for i in range(n):
        lang = ["en", "fr", "de"][i % 3]
        out.append((i, " ".join("".join(rng.choice(SYLLABLES[lang], rng.integers(1, 4))) for _ in range(rng.integers(2, 60))), lang))
    return out


def with_lang(spark, rows):
    return spark.createDataFrame(rows, "name bigint, verdict string, lang string").withColumn("score", F.lit("clash"))


def test_languages_held_out(spark):
    rows = language_rows() + [(900, None, "en"), (901, "", None), (902, "12 !?", "fr"), (903, "éé eau", None),
                              (None, "the thing ing", "en"), (904, "ing " * 40_000, "en"), (0, rows0 := "eau oi", "fr")]
    df = with_lang(spark, rows)
    got = langid.languages(df, F.coalesce(F.crc32(F.col("name").cast("string").cast("binary")) % 5 != 0, F.lit(False)),
                           keep=("lang",)).collect()
    assert len(got) == len(rows)
    by = {r["name"]: r for r in got}
    for k in (900, 901, 902):
        assert by[k]["lang_pred"] == "und" and by[k]["score"] == 0 and by[k]["rejected"]
    held = [r for r in got if r["name"] is not None and r["name"] < 450 and not split5(r["name"], 0)]
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["rejected"] for r in held) <= 1
    assert by[903]["lang_pred"] == "fr" and rows0


def test_far_texts_are_rejected(spark):
    df = with_lang(spark, language_rows() + [(999, "кириллица совсем другая письменность " * 5, None)])
    got = {r["name"]: r for r in langid.languages(df, F.lit(True)).collect()}
    assert got[999]["rejected"]


def test_languages_without_training(spark):
    df = with_lang(spark, [(1, "abc", None), (2, None, None)])
    assert {r["lang_pred"] for r in langid.languages(df, F.lit(True)).collect()} == {"und"}
    assert langid.languages(with_lang(spark, language_rows()).limit(0), F.lit(True)).count() == 0


def test_centroids_are_unit_and_cover_clusters():
    rng = np.random.default_rng(5)
    x = np.concatenate([np.eye(6)[i] + rng.random((40, 6)) * 0.05 for i in range(3)]).astype("f4")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = langid.centroids(x, 3)
    assert np.allclose(np.linalg.norm(c, axis=1), 1, atol=1e-5) and (x @ c.T).max(axis=1).min() > 0.95


# --- toxicity --------------------------------------------------------------------------------------------

def test_toxicity_held_out(spark):
    rng = np.random.default_rng(6)
    words = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    rows, labels = [], []
    for i in range(1500):
        t = rng.choice(words, 40).tolist()
        bad = i % 10 == 0
        if bad:
            for _ in range(3):
                t[rng.integers(40)] = str(rng.choice(["awful", "nasty", "vilestuff"]))
        rows.append((i, " ".join(t)))
        if i % 2 == 0:
            labels.append((i, int(bad)))
    rows += [(9000, None), (9001, ""), (None, "nasty awful"), (9002, "word " * 40_000), (9003, "nasty nasty"), (9003, "nasty nasty")]
    labels += [(None, 1), (9001, None), (0, None)]
    df = spark.createDataFrame(rows, "name bigint, verdict string").withColumn("score", F.lit("clash"))
    marks = spark.createDataFrame(labels, "name bigint, toxic int")
    learn = lambda k: F.coalesce(F.crc32(k.cast("string").cast("binary")) % 5 != 0, F.lit(False))
    got = toxicity.toxicity(df, marks, learn).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["name"] is not None and r["name"] < 1500 and not split5(r["name"], 0)]
    wrong = [r["name"] for r in held if r["predicted"] != int(r["name"] % 10 == 0)]
    assert len(wrong) <= 2
    assert all(r["predicted"] == 1 for r in got if r["name"] == 9003)
    assert all(r["predicted"] == 0 for r in got if r["name"] in (9000, 9001, 9002))


def test_toxicity_without_labels(spark, verdicts):
    none = spark.createDataFrame([], "name bigint, toxic int")
    assert [r["score"] for r in toxicity.toxicity(verdicts([(1, "a"), (2, None)]), none, lambda k: F.lit(True)).collect()] == [0, 0]
    assert toxicity.toxicity(verdicts([]), none, lambda k: F.lit(True)).count() == 0


def test_risk_stays_non_negative():
    """More features than the positives need: the fit keeps the unlabelled positives' share near the prior."""
    rng = np.random.default_rng(7)
    p, u = (rng.random((300, 200)) < 0.2).astype("f4"), (rng.random((2000, 200)) < 0.2).astype("f4")
    p[:, 0] = 1
    u[:, 0] = np.arange(2000) < 400
    w = toxicity.fit_nnpu(p, u, 0.2)
    g = u @ w[:-1] + w[-1]
    assert (g[:400] > 0).mean() > 0.9 and (g[400:] > 0).mean() < 0.1


# --- nearest neighbours ----------------------------------------------------------------------------------

WAVES = T.StructType([T.StructField("clip", T.LongType()), T.StructField("wave", T.ArrayType(T.FloatType())), T.StructField("score", T.StringType())])


def brute_nearest(rows, k):
    good = [(i, np.array(v, "f4").astype("f8")) for i, v in rows if i is not None and v is not None and None not in v
            and np.isfinite(np.array(v, "f8")).all() and any(v)]
    out = []
    for q, x in good:
        if q % 10:
            continue
        found = []
        for i, y in good:
            if i != q and len(x) == len(y):
                s = lambda a: float(np.cumsum(a)[-1])
                found.append((-s(x * y) / (np.sqrt(s(x * x)) * np.sqrt(s(y * y))), i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize("tile", [16, 4096])
def test_nearest(spark, tile):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=24).astype("f4").tolist()) for i in range(300)]
    rows += [(300 + i, rows[5][1]) for i in range(60)] + [(400, None), (401, [0.0] * 24), (402, [1.0, None] * 12),
             (403, [float("nan")] * 24), (404, [float("inf")] + [1.0] * 23), (None, rows[1][1]), (410, [1.0, 2.0]), (411, [2.0, 1.0]),
             (420, []), (430, [1e-30] * 24), (440, [3e30] + [1.0] * 23)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], WAVES).repartition(3)
    got = neighbours.nearest(df, F.col("clip") % 10 == 0, tile=tile).collect()
    want = brute_nearest(rows, 5)
    assert sorted((r["query_id"], r["rank"], r["clip"]) for r in got) == [w[:3] for w in want]
    assert sorted(r["score"] for r in got) == sorted(w[3] for w in want)


def test_nearest_sends_no_copies_to_the_driver(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v, "x") for i, v in enumerate(rng.normal(size=(600, 24)).astype("f4").tolist())]
    df = spark.createDataFrame(rows, WAVES)
    found = neighbours.nearest(df, F.col("clip") % 100 == 0, tile=40)       # the 6 queries are small, their 15 copies are not
    assert len(found.collect()) == 30
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_tiles_are_cut_and_trimmed(monkeypatch):
    monkeypatch.setattr(neighbours, "TILE", 7)
    monkeypatch.setattr(neighbours, "PART", 3)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 5))
    x[30:] = x[3]
    q, c, s = neighbours.tile_best(np.arange(40), x, np.arange(10), x[:10], 4)
    assert list(zip(q.tolist(), c.tolist())) == [
        (i, j) for i in range(10) for _, j in sorted((-neighbours.cosines(x[i:i + 1], x[j:j + 1])[0], j) for j in range(40) if j != i)[:4]]


def test_nearest_none(spark):
    df = spark.createDataFrame([], WAVES)
    assert neighbours.nearest(df, F.col("clip") % 10 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0, 0.0], "x")], WAVES)
    assert neighbours.nearest(one, F.col("clip") % 10 == 0).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(9)
    for d in (3, 64, 2100):
        x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (rng.normal(size=(50, d)), rng.normal(size=(70, d)) ** 3))
        estimate, off = neighbours.tile_bounds(neighbours.quantise(x), neighbours.quantise(y))
        assert (np.abs(estimate - x @ y.T) <= off).all()


def test_unlabelled_sample_is_bounded_and_takes_copies_by_share(spark, verdicts):
    def lengths(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([[len(t)] for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], names=["place", "found"])
    rows = verdicts([(i, "copy" if i % 3 == 0 else f"text {i} of its own") for i in range(6000)])
    got = [r["found"][0] for r in toxicity._sampled_found(rows, 600, 6000, "name", "verdict", lengths).collect()]
    assert len(got) == 600
    assert 140 < sum(n == 4 for n in got) < 260
