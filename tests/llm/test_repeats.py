"""Repeated passages against plain comparison of all strings."""
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from orbweave.llm import repeats


def plain(rows, span):
    """rows: (key, text); the spans and what is left of each, by a dictionary of all strings."""
    low = {}
    data = [(k, b"" if t is None else t.encode() if isinstance(t, str) else t) for k, t in rows]
    for k, d in data:
        for i in range(len(d) - span + 1):
            if k is not None:
                w = d[i:i + span]
                low[w] = min(low.get(w, k), k)
    out = []
    for k, d in data:
        gone = np.zeros(len(d) + 2, bool)
        for i in range(len(d) - span + 1):
            if k is not None and low[d[i:i + span]] < k:
                gone[i + 1:i + 1 + span] = True
        edge = np.flatnonzero(np.diff(gone.astype("i1")))
        out.append((k, len(d), int(gone.sum()), tuple(zip(edge[::2].tolist(), edge[1::2].tolist())),
                    bytes(b for b, g in zip(d, gone[1:]) if not g)))
    return sorted(out, key=repr)


def got(df):
    return sorted([(r[0], r.n_bytes, r.n_removed, tuple(tuple(s) for s in r.spans), bytes(r.kept)) for r in df.collect()], key=repr)


def passages(seed, n):
    rng = np.random.default_rng(seed)
    words = ["rim", "cross", "été", "z_min", "net", "MAKE", "🎯", "over", "back", "a", "bb"]
    shared = [" ".join(rng.choice(words, 25).tolist()) for _ in range(5)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choice(words, int(rng.integers(0, 30))).tolist())]
        if i % 3:
            s = shared[int(rng.integers(5))]
            a = int(rng.integers(0, len(s) // 2))
            parts += [s[a:a + int(rng.integers(20, 150))], str(i)]
        rows.append((int(rng.permutation(n)[i % n]), "\n".join(parts)))
    return rows


@given(st.lists(st.text(alphabet="abc\x00é", max_size=40), min_size=1, max_size=12), st.integers(1, 3), st.integers(1, 9))
@settings(deadline=None, max_examples=300)
def test_merged_transforms_give_all_repeats(parts, n_shards, span):
    data = [p.encode() for p in parts]
    shards = [data[i::n_shards] for i in range(n_shards) if data[i::n_shards]]
    order = [p for s in shards for p in s]
    lows = np.array([(7 * i) % 5 for i in range(len(order))])
    found = repeats.repeated_runs([repeats.transform(s) for s in shards], [np.array([len(p) for p in s]) for s in shards], lows, span)
    expect = {}
    for p, low in zip(order, lows.tolist()):
        for i in range(len(p) - span + 1):
            expect[p[i:i + span]] = min(low, expect.get(p[i:i + span], 9))
    seen = {(s, o + i): b for s, o, n, b in zip(*(x.tolist() for x in found)) for i in range(n)}
    assert seen == {(s, i): expect[p[i:i + span]] for s, p in enumerate(order) for i in range(len(p) - span + 1)}


@given(st.lists(st.binary(max_size=60), min_size=1, max_size=6))
@settings(deadline=None)
def test_transform_walks_back(parts):
    bwt = repeats.transform(parts)
    owner, place = repeats.walk(bwt, np.array([len(p) for p in parts]))
    suffix = [parts[o][p:] for o, p in zip(owner.tolist(), place.tolist())]
    assert suffix == sorted(suffix) and len(suffix) == sum(map(len, parts)) + len(parts)


@given(st.lists(st.binary(max_size=300), max_size=5), st.integers(0, 3))
@settings(deadline=None)
def test_every_start_has_one_segment(parts, seed):
    stops = np.cumsum([len(p) for p in parts])
    raw = b"".join(parts)
    anchor, start, count = repeats.segments(np.frombuffer(raw, "u1"), stops, 20, seed)
    held = [s + i for s, n in zip(start.tolist(), count.tolist()) for i in range(n)]
    assert held == [int(e) - len(p) + i for p, e in zip(parts, stops) for i in range(len(p) - 19)]
    by = {}
    for a, s, n in zip(anchor.tolist(), start.tolist(), count.tolist()):
        for i in range(n):
            assert by.setdefault(raw[s + i:s + i + 20], a) == a


@given(st.lists(st.text(alphabet="ab\x00é", max_size=60), min_size=2, max_size=6), st.integers(2, 24))
@settings(deadline=None, max_examples=200)
def test_runs_with_shared_prints_hold_every_shared_string(parts, span):
    data = [p.encode() for p in parts]
    stops = np.cumsum([len(p) for p in data])
    raw = np.frombuffer(b"".join(data), "u1")
    _, _, start, _, prints = repeats.anchored(raw, stops, span)
    row = np.searchsorted(stops, start, side="right")
    owners = {}
    for r, *both in zip(row.tolist(), *prints.tolist()):
        for p in both:
            owners.setdefault(p, set()).add(r)
    shared = np.array([p for p, o in owners.items() if p and len(o) > 1], "u8")
    bits = np.zeros(1 << 17, "u1")
    for places in repeats.bit_places(shared, 17):
        bits[places.astype("i8")] = 1
    bits = np.packbits(bits, bitorder="little")
    _, start, count = repeats.segments(raw, stops, span, 0, bits)
    held = {s + i for s, n in zip(start.tolist(), count.tolist()) for i in range(n)}
    strings = [{p[i:i + span] for i in range(len(p) - span + 1)} for p in data]
    for r, p in enumerate(data):
        for i in range(len(p) - span + 1):
            if any(p[i:i + span] in s for o, s in enumerate(strings) if o != r):
                assert int(stops[r]) - len(p) + i in held


@given(st.integers(0, 9), st.integers(2, 4), st.sampled_from([2, 17, 256]))
@settings(deadline=None, max_examples=20)
def test_rounds_of_several_symbols_give_what_rounds_of_one_give(seed, span, letters):
    rng = np.random.default_rng(seed)
    data = [rng.integers(0, letters, int(n)).astype("u1").tobytes() for n in rng.integers(0, 90, 40)]
    data += [data[3] + data[5], data[7][2:]]
    shards = [repeats.transform(data[::2]), repeats.transform(data[1::2])]
    for depth in (span, 5 * span + 1, 50):
        many, one = repeats.interleave(shards, depth), []
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(repeats, "STEP", 1)
            one = repeats.interleave(shards, depth)
        assert (many[0] == one[0]).all() and (many[1] == one[1]).all()


def test_strangers_with_a_common_phrase_do_not_go_on(spark, verdicts, monkeypatch):
    """Texts that share short phrases, but no string of the asked length, are not dealt out to be merged."""
    rows_of, write = {}, repeats.written

    def counted(df, label, *more):
        out = write(df, label, *more)
        rows_of[label] = out.count()
        return out
    monkeypatch.setattr(repeats, "written", counted)
    rng = np.random.default_rng(2)

    def noise():
        return "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 40).tolist())
    strangers = [(i, noise() + " over the front of the rim " + noise()) for i in range(300)]
    assert got(repeats.drop_repeats(verdicts(strangers))) == plain(strangers, 50)
    assert rows_of["stretches"] == rows_of["pieces"] == 0
    copied = strangers + [(500, noise() + strangers[7][1] + noise())]
    assert got(repeats.drop_repeats(verdicts(copied))) == plain(copied, 50)
    assert 0 < rows_of["stretches"] < 30


def test_stretches_hold_every_start_once():
    rows = [(k, 0, 0, t.encode()) for k, t in passages(4, 60)] + [(99, 0, 0, b"a" * 9000)]
    block = repeats.Block(rows, 50)
    for mine in (np.arange(len(block.anchor)), np.flatnonzero(block.anchor % np.uint64(3) > 0), np.zeros(0, "i8")):
        row, start, count = repeats.stretches(block, mine)
        assert [s + i for s, n in zip(start.tolist(), count.tolist()) for i in range(n)] == [
            s + i for s, n in zip(block.start[mine].tolist(), block.count[mine].tolist()) for i in range(n)]
        assert (np.searchsorted(block.stops, start, side="right") == row).all()
        assert len(count) == 0 or count.max() <= repeats.LONGEST * repeats.RUN


def test_passages_equal_plain_comparison(spark, verdicts):
    rows = passages(3, 120)
    assert got(repeats.drop_repeats(verdicts(rows))) == plain(rows, 50)


def test_small_blocks_and_hot_anchors(spark, verdicts, monkeypatch):
    monkeypatch.setattr(repeats, "BUCKET", 2000)                        # in tests tasks fork from this process
    rng = np.random.default_rng(1)
    rows = [(i, "the ball is released by the shooter at second " + str(rng.integers(10 ** 9)) + " and goes over the rim") for i in range(150)]
    rows += [(200 + i, t) for i, (_, t) in enumerate(passages(5, 40))] + [(300, "a" * 700), (301, "a" * 400 + "b" * 300), (302, "ab" * 200)]
    assert got(repeats.drop_repeats(verdicts(rows), span=30)) == plain(rows, 30)


def test_copies_around_hot_anchors(spark, verdicts, monkeypatch):
    """Segments of a hot anchor that several stretches hold, each string of which is in no other segment."""
    monkeypatch.setattr(repeats, "BUCKET", 1500)
    rng = np.random.default_rng(7)

    def noise(n):
        return "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n).tolist())
    shared = noise(16)                                           # a short string whose hash is the smallest of all
    for _ in range(3000):
        other = noise(16)
        shared = min(shared, other, key=lambda g: repeats.segments(np.frombuffer(g.encode(), "u1"), np.array([16]), 16)[0][0])
    parts = [noise(14) + shared + noise(14) for _ in range(120)]
    rows = [(i, noise(60) + p + noise(60)) for i, p in enumerate(parts)]
    rows += [(200 + i, noise(60) + p + noise(60)) for i, p in enumerate(parts)]
    assert got(repeats.drop_repeats(verdicts(rows), span=30)) == plain(rows, 30)


def test_long_text_in_stretches(spark, verdicts, monkeypatch):
    text = " ".join(str(i * 7919 % 10007) for i in range(4000))
    rows = [(1, text), (2, "x" + text[5:]), (3, text[9000:12000])]
    monkeypatch.setattr(repeats, "BLOCK", 4096)
    assert got(repeats.drop_repeats(verdicts(rows))) == plain(rows, 50)


def test_odd_rows(spark, verdicts, odd_rows):
    assert got(repeats.drop_repeats(verdicts(odd_rows))) == plain(odd_rows, 50)
    assert repeats.drop_repeats(verdicts([])).collect() == []
    names = spark.createDataFrame([("b", "rim " * 20), ("a", "rim " * 20), ("a", "rim " * 20 + "x")], "name string, verdict string")
    assert got(repeats.drop_repeats(names)) == plain([tuple(r) for r in names.collect()], 50)
    raw = spark.sql("SELECT id AS name, cast(unhex(repeat('FF00C3', 30)) AS string) AS verdict FROM range(2)")
    assert got(repeats.drop_repeats(raw)) == plain([(i, b"\xff\x00\xc3" * 30) for i in range(2)], 50)
