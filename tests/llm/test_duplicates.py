"""Exact duplicates, recurring lines and near copies against brute force."""
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.llm import chosenpath, exact, linetemplates


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- exact -----------------------------------------------------------------------------------------------

@pytest.mark.parametrize("n", [1, 2, 5, 257, 3000])
def test_hash_is_minimal_and_perfect(n):
    keys = np.random.default_rng(n).integers(0, 256, (n, 32), dtype="u1")
    pilots, slots = exact.build_mph(keys)
    assert sorted(slots.tolist()) == list(range(n))
    assert (exact.find_slots(pilots, n, keys) == slots).all()


def brute_exact(rows):
    groups = {}
    for k, t in rows:
        groups.setdefault(lower(t), []).append(k)
    out = []
    for k, t in rows:
        mine = groups[lower(t)]
        keep = max((x for x in mine if x is not None), default=None)
        out.append((k, keep, len(mine), k == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("history", ["name % 2 = 0", "true", "false", "name is null"])
def test_exact_duplicates(spark, verdicts, odd_rows, history):
    rows = odd_rows + [(100 + i, f"MISS {i % 7}") for i in range(200)] + [(400 + i, "SAME") for i in range(150)]
    got = exact.exact_duplicates(verdicts(rows), F.expr(history)).drop("seen_before").collect()
    assert sorted(map(tuple, got), key=repr) == brute_exact(rows)


def test_exact_members_and_text_keys(spark):
    df = spark.createDataFrame([("a", "X", True), ("b", "x", False), ("c", "y", False), ("d", "z", True)], "name string, verdict string, old boolean")
    got = {r["name"]: (r["keep_key"], r["seen_before"]) for r in exact.exact_duplicates(df, F.col("old")).collect()}
    assert got == {"a": ("b", True), "b": ("b", True), "c": ("c", False), "d": ("d", True)}


def test_exact_empty(spark, verdicts):
    assert exact.exact_duplicates(verdicts([]), F.lit(True)).count() == 0


# --- lines -----------------------------------------------------------------------------------------------

def brute_lines(rows):
    def keys(line):
        words = line.split()
        k, n = ["<*>" if any(c in "0123456789" for c in w) else w for w in words], len(words)
        if n == 0:
            return []
        if n < linetemplates.SHORT_TOKENS and set(k) == {"<*>"}:
            k = words
        rest, out = k[2:], [("all", n, *k)]
        if n >= linetemplates.VARY_TOKENS:
            s = len(rest) // 4
            for i in range(4):
                end = len(rest) if i == 3 else s * (i + 1)
                out.append((i, n, *k[:2], *rest[:s * i], None, *rest[end:]))
        return out
    first = {}
    for k, t in rows:
        if k is not None and t is not None:
            for line in t.split("\n"):
                for key in keys(line):
                    first[key] = min(first.get(key, k), k)
    out = []
    for k, t in rows:
        lines = [] if t is None else t.split("\n")
        gone = [k is not None and any(first[x] < k for x in keys(x_)) for x_ in lines]
        out.append((k, None if t is None else "\n".join(x for x, g in zip(lines, gone) if not g), len(lines), sum(gone)))
    return sorted(out, key=repr)


def test_recurring_lines(spark, verdicts, odd_rows):
    long = "MAKE left cross at the near rim with r {} and a bounce of {} towards the {} camera"
    rows = odd_rows + [(100 + i, "\n".join([
        f"shot {i} only here w{i} x{i} alone", long.format("12cm", "3cm", "far") if i % 3 == 0 else "short line",
        "", long.format("small", "high", f"side{'abc'[i % 3]}"), "the same five words here", "the same five words here"]))
        for i in range(30)]
    got = linetemplates.drop_recurring_lines(verdicts(rows), "name", "verdict").select("name", "verdict", "n_lines", "n_dropped").collect()
    assert sorted(map(tuple, got), key=repr) == brute_lines(rows)
    assert linetemplates.drop_recurring_lines(verdicts([])).count() == 0


def test_lines_keep_columns_and_one_copy(spark, verdicts):
    passage = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    df = linetemplates.drop_recurring_lines(verdicts([(i, f"own line of text {'abcdefgh'[i]} here\n{passage}") for i in range(8)]))
    rows = df.collect()
    assert df.columns == ["name", "verdict", "key", "digest", "gt", "n_lines", "n_dropped"]
    assert [r["name"] for r in rows if passage in r["verdict"]] == [0]
    assert "ArrowEvalPython" not in df._jdf.queryExecution().toString() and "MapInArrow" not in df._jdf.queryExecution().toString()


def test_short_lines_are_templates_too(spark, verdicts):
    rows = [(1, "All rights reserved.\n12\n\nPage 3 of 9\n所有权利保留\n7 8"),
            (2, "All  rights reserved.\n13\n\nPage 4 of 9\n所有权利保留\n7 9\nown"), (3, "12\n所有权利\n7 8\n ")]
    got = {r["name"]: (r["verdict"], r["n_dropped"]) for r in linetemplates.drop_recurring_lines(verdicts(rows)).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("13\n\n7 9\nown", 3), 3: ("所有权利\n ", 2)}
    assert sorted(got.items()) == [(k, (t, d)) for k, t, _, d in brute_lines(rows)]


def test_lines_beside_clashing_columns(spark):
    names = ("__lines", "__print", "__gone", "gone", "row", "print", "key", "lines", "own_key", "n_lines", "a.b")
    df = spark.createDataFrame([(1, "same line\nown", *names), (2, "same line\nother", *names)],
                               "name long, verdict string, " + ", ".join(f"`{c}` string" for c in names))
    out = linetemplates.drop_recurring_lines(df)
    assert out.columns == ["name", "verdict", *(c for c in names if c != "n_lines"), "n_lines", "n_dropped"]
    rows = sorted(map(tuple, out.collect()))
    kept = tuple(c for c in names if c != "n_lines")
    assert rows == [(1, "same line\nown", *kept, 2, 0), (2, "other", *kept, 2, 1)]


# --- near copies -----------------------------------------------------------------------------------------

def brute_near(rows):
    def grams(t):
        w = lower(t).encode().split()
        return w, frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    classes = {}
    for k, t in rows:
        w, g = grams(t)
        classes.setdefault(tuple(w), (g, []))[1].append(k)
    ids = list(classes)
    links = {i: set() for i in ids}
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            x, y = classes[a][0], classes[b][0]
            if x and y and 5 * len(x & y) >= 4 * len(x | y):
                links[a].add(b), links[b].add(a)
    out = []
    for a in ids:
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        keys = [k for b in seen for k in classes[b][1] if k is not None]
        out += [(k, min(keys, default=None), len(links[a]), len(classes[a][1])) for k in classes[a][1]]
    return sorted(out, key=repr)


def near_rows():
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(3000)]
    rows, k = [], 1000
    for group in range(25):
        base = rng.choice(words, rng.integers(6, 200)).tolist()
        for _ in range(rng.integers(1, 12)):
            t = list(base)
            for _ in range(rng.integers(0, 4)):
                t[rng.integers(len(t))] = str(rng.choice(words))
            rows.append((k, " ".join(t)))
            k += 1
    passage = " ".join(words[:40])
    rows += [(k + i, passage + " " + " ".join(rng.choice(words, 60))) for i in range(60)]
    return rows


def test_near_copies(spark, verdicts, odd_rows):
    rows = odd_rows + near_rows()
    got = chosenpath.similarity_classes(verdicts(rows)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_near(rows)


def test_near_copies_in_split_and_tiled_buckets(spark, verdicts, monkeypatch):
    monkeypatch.setattr(chosenpath, "LIMIT", 6)
    rng = np.random.default_rng(4)
    base = [f"v{i}" for i in range(150)]
    many = [(5000 + i, " ".join(base[:j] + [f"z{i}"] + base[j + 1:])) for i, j in enumerate(rng.integers(0, 150, 50))]
    rows = near_rows() + many
    got = chosenpath.similarity_classes(verdicts(rows)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_near(rows)


def test_near_copies_of_null_keys(spark, verdicts):
    """A text with null keys only links its neighbours, also where many rows have it."""
    words = [f"n{i}" for i in range(76)]
    chain = [" ".join(words[:n]) for n in (60, 68, 76)]
    rows = [(40, chain[0]), *[(None, chain[1])] * 30, (41, chain[2]), (42, "a text of its own")]
    got = chosenpath.similarity_classes(verdicts(rows)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_near(rows)
    assert sum(r["n_links"] > 0 for r in got) == 32


def test_near_empty(spark, verdicts):
    assert chosenpath.similarity_classes(verdicts([])).count() == 0
    assert chosenpath.similarity_classes(verdicts([(1, None), (2, "")])).count() == 2


def test_recall_at_the_limit():
    """Sketches that agree on four fifths share a first bucket nearly always."""
    rng = np.random.default_rng(6)
    a = rng.integers(0, 1 << 16, (4000, chosenpath.COORDINATES)).astype("u2")
    b = a.copy()
    for i in range(len(b)):
        at = rng.permutation(chosenpath.COORDINATES)[:round(0.2 * chosenpath.COORDINATES)]
        b[i, at] ^= 1
    same = (chosenpath.first_buckets(a) == chosenpath.first_buckets(b)).any(axis=1)
    assert same.mean() > 0.9985
