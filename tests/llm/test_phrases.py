"""Phrases against plain counting, whitening against a full eigendecomposition."""
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from orbweave.llm import phrases, sieve, whitening


def plain(rows, least, top, share=80):
    f, words = Counter(), Counter()
    for g, t in rows:
        g = "und" if g is None else g
        low = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        words[g] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            words[g] += len(w)
            for n in range(1, 5):
                for i in range(len(w) - n + 1):
                    f[g, tuple(w[i:i + n])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (g, p), a in found.items():
        if any(h == g and len(q) > len(p) and 100 * b >= share * a and
               any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (h, q), b in found.items()):
            continue
        cuts = [(2000000 * a // (f[g, p[:k]] + f[g, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(g, []).append((-score, -a, " ".join(p).encode(), f[g, p[:k]], f[g, p[k:]]))
    return {(g, i + 1, p.decode(), -a, left, r, words[g], -s)
            for g, x in out.items() for i, (s, a, p, left, r) in enumerate(sorted(x)[:top])}


def grouped(spark, rows, parts=3):
    return spark.createDataFrame([(g, t, "x", 1) for g, t in rows], "gt string, verdict string, grp string, a int").repartition(parts)


def test_collocations_equal_counting(spark):
    rng = np.random.default_rng(4)
    vocabulary = ["rim", "Net", "make", "miss", "ball", "été", "cross"]
    rows = [(["A", "B", None][i % 3], " ".join(rng.choice(vocabulary, int(rng.integers(0, 40))).tolist()).replace("ball ", "ball, ")
             + "\tno\nrim  net") for i in range(150)]
    rows += [("A", None), ("A", ""), ("C", None), ("B", "one " * 500), ("B", "MAKE cross r=12cm"), ("B", "MAKE cross r=12cm")]
    got = phrases.collocations(grouped(spark, rows), "gt", "verdict", least=8, top=25)
    assert got.columns == ["gt", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r) for r in got.collect()} == plain(rows, 8, 25)


def test_ties_repeats_and_empty_tables(spark):
    rows = [("A", "x y. z w"), ("A", "z w! x y")] * 5
    got = phrases.collocations(grouped(spark, rows), "gt", "verdict", least=10, top=1).collect()
    assert [tuple(r) for r in got] == [("A", 1, "x y", 10, 10, 10, 40, 1000000)]
    assert phrases.collocations(grouped(spark, []), "gt", "verdict").collect() == []
    numbers = spark.createDataFrame([(3, "a b"), (3, "a b"), (None, "a b")], "gt int, verdict string")
    assert {tuple(r) for r in phrases.collocations(numbers, "gt", "verdict", least=2).collect()} == {(3, 1, "a b", 2, 2, 2, 4, 1000000)}


def test_phrase_tables_are_not_broadcast(spark):
    df = spark.sql("SELECT concat('A', id % 2) AS gt, 'one two three, four five six' AS verdict FROM range(12)")
    found = phrases.collocations(df, "gt", "verdict", least=3)
    assert sorted({(r["gt"], r["phrase"], r["a"], r["n"]) for r in found.collect()}) == [
        (g, p, 6, 36) for g in ("A0", "A1") for p in ("four five six", "one two three")]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_bytes_that_are_not_text(spark):
    df = spark.sql("SELECT 'A' AS gt, cast(X'61FF6220C3' AS string) AS verdict FROM range(3)")
    got = phrases.collocations(df, "gt", "verdict", least=3).select("phrase", "a").collect()
    assert [tuple(r) for r in got] == [("a\ufffdb \ufffd", 3)]


@given(st.text(alphabet="ab .\t\n", max_size=120), st.integers(1, 20))
@settings(deadline=None, max_examples=200)
def test_stretches_hold_every_phrase_once(text, size):
    whole, cut = Counter(), Counter()
    for into, rows in ((whole, [("g", text.encode(), 0)]), (cut, [("g", p, s) for p, s in phrases.cut_text(text.encode(), size)])):
        block = phrases.Block(rows)
        for n in range(1, 5):
            into.update(block.phrase(i, n) for i in block.places(n).tolist())
    assert whole == cut


def test_collisions_are_told_apart(monkeypatch):
    monkeypatch.setattr(phrases, "BYTES", np.ones(256, "u8"))           # words of one length share their hash
    block = phrases.Block([("g", b"ab cd ab cd cd", 0), ("h", b"ab cd", 0)])
    number, kinds = block.word_numbers(), np.array([0, 1])
    assert number.tolist() == [0, 1, 0, 1, 1, 0, 1]
    at, c = block.groups(block.places(2), 2, number, kinds)
    assert sorted((block.text[i], block.phrase(i, 2), n) for i, n in zip(at, c.tolist())) == [
        (0, b"ab cd", 2), (0, b"cd ab", 1), (0, b"cd cd", 1), (1, b"ab cd", 1)]


def test_sieve_has_all_members(spark):
    rng = np.random.default_rng(0)
    prints = rng.integers(-(1 << 63), (1 << 63) - 1, 5000)
    bits = sieve.sieve(spark.createDataFrame([(int(p),) for p in prints], "fp long"))
    assert sieve.held(bits, prints.view("u8")).all()
    assert sieve.held(bits, rng.integers(0, 1 << 63, 20_000, dtype="u8")).mean() < 0.1


# --- whitening ---------------------------------------------------------------------------------------------

def table(spark, rows, parts=4):
    return spark.createDataFrame([(k, v, "x") for k, v in rows], "clip long, wave array<double>, n string").repartition(parts)


@pytest.mark.parametrize("d,n,k", [(70, 400, 9), (12, 300, 5), (40, 20, 32), (100, 300, 32)])
def test_whitening_equals_the_eigenvectors(spark, d, n, k):
    rng = np.random.default_rng(d)
    waves = rng.standard_normal((n, d)) * np.linspace(1, 3, d) + 5
    got = whitening.whiten(table(spark, list(enumerate(waves.tolist()))), components=k).toPandas()
    x = np.floor(64 * waves)
    e, q = np.linalg.eigh(np.cov(x.T, bias=True))
    keep = min(k, d, n - 1)
    e, q = e[::-1][:keep], q[:, ::-1][:, :keep]
    wide = got.pivot(index="clip", columns="component", values="whitened").to_numpy()
    assert wide.shape == (n, keep)
    expect = (x - x.mean(0)) @ q / np.sqrt(e)
    assert np.abs(np.abs((wide * expect).sum(0)) / n - 1).max() < 1e-9
    assert got.identity_error.max() < 1e-9
    first = got.groupby("component").explained.first().to_numpy()
    assert np.allclose(first, e / np.trace(np.cov(x.T, bias=True)), rtol=1e-9)
    exact = {i: sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, x.sum(0))) for i, r in enumerate(x)}
    assert {r.clip: r.deviation for r in got.itertuples()} == exact


def test_a_missed_direction_is_found():
    d = 60
    e = np.concatenate([np.linspace(5, 4, 10), np.full(50, 1.0)])
    values, basis = whitening.leading(lambda q: e[:, None] * q, d, 10)
    assert np.allclose(values, e[:10], rtol=1e-12)
    assert np.allclose(np.abs(basis[:10, :10]), np.eye(10), atol=1e-9)


def test_odd_signals(spark):
    good = [(1, [1.0, 2.0, 4.0]), (2, [2.0, 1.0, 4.0]), (2, [2.0, 1.0, 4.0]), (None, [9.0, 1.0, 4.0])]
    bad = [(3, None), (4, []), (5, [1.0, None, 2.0]), (6, [float("nan"), 1.0, 2.0]), (7, [float("inf"), 1.0, 2.0]), (8, [1.0, 2.0])]
    got = whitening.whiten(table(spark, good + bad)).collect()
    assert sorted((r.clip or 0, r.component, r.n) for r in got) == [(0, 1, 4), (0, 2, 4), (1, 1, 4), (1, 2, 4), (2, 1, 4), (2, 1, 4), (2, 2, 4), (2, 2, 4)]
    assert whitening.whiten(table(spark, bad[:5])).collect() == []
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0])] * 3)).collect() == []
    huge = whitening.whiten(table(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 0.0])])).collect()
    assert {r.deviation for r in huge} == {None, (3 * 0 - 64) ** 2}
