"""Byte-level BPE, token files and packing against the tokenizer libraries."""
import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from orbweave.llm import bytebpe, packing, tokenfiles, wordbpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(RANKS),
                             special_tokens={})


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


def numbers(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<u4").tolist()


TEXTS = st.one_of(st.text(max_size=60), st.text(alphabet="abAB .,'\n", max_size=80),
                  st.lists(st.sampled_from(["the", "ing", "tion", " ", "rim", "ß", "日本", "=="]), max_size=30).map("".join))


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_transducer_equals_the_library(text):
    encoder, decoder = bytebpe.coder(RANKS, public_tokenizers.PATTERN)
    enc = test_transducer_equals_the_library.__dict__.setdefault("ref", tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(RANKS), special_tokens={}))
    ids = encoder.encode(text)
    assert numbers(ids) == enc.encode_ordinary(text)
    assert decoder.text(ids) == text


def test_long_matches_are_written_early(reference):
    encoder, _ = bytebpe.coder(RANKS, public_tokenizers.PATTERN)
    data = ("ab" * 700 + "tion" * 300).encode()
    seen = []

    def feed():
        for i, b in enumerate(data):
            seen.append(i)
            yield b
    stream = encoder.machine.tokens_of(feed())
    first = next(stream)
    assert len(seen) < 3 * max(map(len, encoder.machine.ranks))
    assert [first, *stream] == reference.encode_ordinary(data.decode())


def test_memory_starts_anew(reference, monkeypatch):
    monkeypatch.setattr(bytebpe, "STATES", 50)
    monkeypatch.setattr(bytebpe, "PIECES", 20)
    encoder = bytebpe.TextEncoder(bytebpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    for i in range(30):
        text = f"attempt {i} rebounds off rimside number{i * 37} undecidedly"
        assert numbers(encoder.encode(text)) == reference.encode_ordinary(text)


@given(st.text(max_size=40), st.lists(st.integers(0, 40), max_size=8))
@settings(deadline=None)
def test_utf8_stream_any_cuts(text, cuts):
    data, stream = text.encode(), bytebpe.Utf8Stream()
    at = sorted({min(c, len(data)) for c in cuts} | {0, len(data)})
    assert "".join([*(stream.feed(data[a:b]) for a, b in zip(at, at[1:])), stream.close()]) == text


def test_utf8_stream_bad_bytes():
    stream = bytebpe.Utf8Stream()
    assert stream.feed(b"a\xe2\x82") == "a"
    assert stream.feed(b"\xacb\xed") == "€b"
    assert stream.feed(b"\xa0") == "��"
    assert stream.feed(b"c\xf0\x9f") == "c"
    assert stream.close() == "�"


def test_encode_digests(spark, verdicts, odd_rows, reference):
    got = bytebpe.encode_digests(verdicts(odd_rows), RANKS, public_tokenizers.PATTERN).collect()
    want = []
    for k, t in odd_rows:
        ids = reference.encode_ordinary(t or "")
        want.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    full = bytebpe.encode_texts(verdicts(odd_rows[:3]), RANKS, public_tokenizers.PATTERN).collect()
    assert {r["decoded"] for r in full} == {odd_rows[0][1], ""}
    assert bytebpe.encode_digests(verdicts([]), RANKS, public_tokenizers.PATTERN).count() == 0


@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2 ** 64 - 1)), max_size=300),
       st.sampled_from([1, 7, 64, 4096]))
@settings(deadline=None, max_examples=200)
def test_simple8b_round_trip(values, chunk):
    ids = np.array(values, "u8")
    words, chunks = tokenfiles.simple8b_encode(ids, chunk)
    stops = [*chunks.tolist()[1:], None]
    out = [tokenfiles.simple8b_decode(words[a:b], min(chunk, len(ids) - i * chunk))
           for i, (a, b) in enumerate(zip(chunks.tolist(), stops))]
    assert np.concatenate([np.zeros(0, "u8"), *out]).tolist() == values


def test_simple8b_packs_small_ids():
    words, _ = tokenfiles.simple8b_encode(np.ones(60 * 64, "u8"))
    assert len(words) == 64
    assert len(tokenfiles.simple8b_encode(np.full(40, 49_000, "u8"))[0]) == 14


@pytest.mark.parametrize("text", ["", " ", "Make. make, MAKE", "a.b.c x... y.,", "don't it's we'll.", "<|endoftext|> A<|startoftext|>B",
                                  "É́ ﬁ İ ΑΣ. ǅ.", "été, ñandú. 12.5", "日本語。テキスト"])
def test_word_ids_equal_the_library(library, text):
    assert numbers(wordbpe.word_ids(WORDS).encode_all([text.encode()])[0]) == library.encode(text, add_special_tokens=False).ids


@given(st.lists(TEXTS, max_size=5))
@settings(deadline=None, max_examples=150)
def test_word_ids_any_text(texts):
    lib = test_word_ids_any_text.__dict__.setdefault("lib", Tokenizer.from_file(WORDS))
    got = wordbpe.word_ids(WORDS).encode_all([t.encode() for t in texts])
    assert [numbers(g) for g in got] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_word_memory_starts_anew(library, monkeypatch):
    monkeypatch.setattr(wordbpe, "CACHE_WORDS", 5)
    encoder = wordbpe.WordIds(WORDS)
    for i in range(10):
        batch = [f"shot{i} rim{i}. net, {j} apex" for j in range(4)]
        assert [numbers(g) for g in encoder.encode_all([t.encode() for t in batch])] == [
            library.encode(t, add_special_tokens=False).ids for t in batch]


def test_token_files(spark, verdicts, odd_rows, library):
    got = tokenfiles.token_files(verdicts(odd_rows), WORDS).orderBy("start").collect()
    want, start = [], 0
    ids_of = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, (_, t) in enumerate(odd_rows)}
    keys = [g["name"] for g in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k))
    for g in got:                                    # rows of equal key may come in any order
        assert g["start"] == start
        start += g["n_tokens"]
    pair = lambda k, ids: (k, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    want = [pair(k, ids_of[i]) for i, (k, _) in enumerate(odd_rows)]
    assert sorted(((g["name"], g["n_tokens"], g["ids_crc32"]) for g in got), key=repr) == sorted(want, key=repr)
    assert tokenfiles.token_files(verdicts([]), WORDS).count() == 0


def test_blocks_hold_ids(spark, verdicts, library, monkeypatch):
    monkeypatch.setattr(tokenfiles, "BLOCK_IDS", 8)
    rows = [(i, f"shot {i} rim {'net ' * (i % 4)}") for i in range(40)]
    files = tokenfiles.token_blocks(verdicts(rows), WORDS)
    got = tokenfiles.read_tokens(files.cache()).orderBy("key").collect()
    assert [numbers(g["ids"]) for g in got] == [[*library.encode(t, add_special_tokens=False).ids, 1] for _, t in rows]


# --- other vocabularies -----

def small_vocabulary(path, lower):
    """A byte-level BPE of single letters and two merges, with or without lower-casing."""
    from tokenizers import models, normalizers, pre_tokenizers
    letters = [chr(c) for c in range(33, 127)]
    vocab = {t: i for i, t in enumerate([*letters, "ab", "AB", "Ġ"])}
    t = Tokenizer(models.BPE(vocab=vocab, merges=[("a", "b"), ("A", "B")]))
    if lower:
        t.normalizer = normalizers.Lowercase()
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    t.save(str(path))
    return str(path)


@pytest.mark.parametrize("lower", [False, True])
def test_case_and_spaces_of_another_vocabulary(tmp_path, lower):
    path = small_vocabulary(tmp_path / "own.json", lower)
    ids, own = wordbpe.WordIds(path), Tokenizer.from_file(path)
    values = ["AB ab aB", "", " ab  AB ", "a.b,AB1"]
    assert not ids.by_word
    assert [numbers(i) for i in ids.encode_all([v.encode() for v in values])] == [own.encode(v, add_special_tokens=False).ids for v in values]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abZ'stlv019.,-<|>éß ñ日\n", max_size=40), st.sampled_from(["", "<|endoftext|>", "<|StartOfText|>", "it's 12.5x"]))
def test_runs_of_words_equal_the_library(text, more):
    ids = wordbpe.word_ids(WORDS)
    own = test_runs_of_words_equal_the_library.__dict__.setdefault("own", Tokenizer.from_file(WORDS))
    assert ids.by_word
    assert numbers(ids.encode_all([(text + more).encode()])[0]) == own.encode(text + more, add_special_tokens=False).ids


def test_bytes_that_are_not_utf8(library):
    assert numbers(wordbpe.word_ids(WORDS).encode_all([b"ab\xff cd"])[0]) == library.encode("ab\ufffd cd", add_special_tokens=False).ids


# --- packing ---------------------------------------------------------------------------------------------

@given(st.dictionaries(st.integers(1, 32), st.integers(1, 60), max_size=20))
@settings(deadline=None, max_examples=100)
def test_plan_places_everything_once(histogram):
    plan = packing.plan(histogram, 32)
    used = {}
    for pattern, n in plan:
        assert n > 0 and sum(pattern) <= 32
        for k in pattern:
            used[k] = used.get(k, 0) + n
    assert used == histogram
    first_fit = []                                   # no worse than first-fit decreasing, but for one sequence
    for k in sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True):
        for i, left in enumerate(first_fit):
            if left >= k:
                first_fit[i] -= k
                break
        else:
            first_fit.append(32 - k)
    assert sum(n for _, n in plan) <= len(first_fit) + 1


def test_fit_reproduces_a_mixture_of_patterns():
    histogram = {20: 300, 12: 300, 16: 200, 10: 90, 11: 180}
    plan = packing.plan(histogram, 32)
    assert sum(n for _, n in plan) == -(-sum(k * n for k, n in histogram.items()) // 32)


def sequences(plan):
    return sum(n for _, n in plan)


def test_never_more_sequences_than_best_fit():
    rng = np.random.default_rng(11)
    for _ in range(1000):
        lengths = rng.choice(np.arange(1, 33), int(rng.integers(1, 20)), replace=False).tolist()
        histogram = dict(zip(lengths, rng.integers(1, 60, len(lengths)).tolist()))
        assert sequences(packing.plan(histogram, 32)) <= sequences(packing.best_fit(dict(histogram), {}, 32))


def test_most_sequences_come_from_fitted_patterns(library):
    import pyarrow.parquet as pq
    values = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    sizes = [len(e.ids) + 1 for e in library.encode_batch([v or "" for v in values], add_special_tokens=False)]
    histogram = Counter(n % 4096 for n in sizes if n % 4096) + Counter({4096: sum(n // 4096 for n in sizes)})
    fitted, whole = sequences(packing._fitted(histogram, 4096, 8)), sequences(packing.plan(histogram, 4096, 8))
    assert whole == -(-sum(sizes) // 4096) and fitted > whole / 2


def test_fit_is_non_negative_and_close():
    rng = np.random.default_rng(3)
    found = packing.patterns_of(np.arange(1, 33), 32)
    columns = np.full((len(found), 3), -1)
    for i, p in enumerate(found):
        columns[i, :len(p)] = p
    target = np.append(0, rng.integers(0, 500, 32)).astype(float)
    x = packing.non_negative_fit(columns, target)
    made = np.zeros(33)
    for p, n in zip(found, x):
        for k in p:
            made[k] += n
    assert (x >= 0).all() and np.square(made - target).sum() < 0.2 * np.square(target).sum()


def check_packing(got, rows, library, capacity):
    by_sequence, by_row = {}, {}
    for g in got:
        by_sequence.setdefault(g["sequence_id"], []).append((g["offset"], g["length"]))
        by_row.setdefault(g["name"], []).append(g)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    pieces = []
    for k, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for i, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at:at + capacity]
            pieces.append((k, i, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(((g["name"], g["piece"], g["start"], g["length"], g["ids_crc32"]) for g in got), key=repr) == sorted(
        pieces, key=repr)
    return len(by_sequence), sum(p[3] for p in pieces)


def test_pack(spark, verdicts, odd_rows, library):
    got = packing.pack(verdicts(odd_rows), WORDS).collect()
    n, total = check_packing(got, odd_rows, library, 4096)
    assert n == -(-total // 4096)
    assert packing.pack(verdicts([]), WORDS).count() == 0


def test_pack_many(spark, verdicts, library):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["rim"] * int(k))) for i, k in enumerate(rng.integers(0, 60, 900))] + [(1000 + i, "net") for i in range(400)]
    n, total = check_packing(packing.pack(verdicts(rows), WORDS, capacity=64, grain=1).collect(), rows, library, 64)
    assert n <= -(-total // 64) * 1.02


def test_short_pieces_take_only_their_tokens(spark, verdicts):
    got = packing.pack(verdicts([(i, None if i % 2 else "") for i in range(4096)]), WORDS).collect()
    assert {r["sequence_id"] for r in got} == {0}
    assert sorted(r["offset"] for r in got) == list(range(4096))


def test_plan_places_every_exact_length_once():
    rng = np.random.default_rng(3)
    histogram = dict(Counter(np.minimum(4096, rng.lognormal(6, 1.2, 20_000).astype(int) + 1).tolist()))
    placed, packs = Counter(), 0
    for pattern, n in packing.plan(histogram, 4096, 8):
        assert sum(pattern) <= 4096
        packs += n
        for k in pattern:
            placed[k] += n
    assert placed == histogram
    need = -(-sum(k * n for k, n in histogram.items()) // 4096)
    assert packs <= need + max(1, need // 500)
