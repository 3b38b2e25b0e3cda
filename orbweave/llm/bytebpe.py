"""Byte-level BPE: the merges as a lazily determinised transducer, and a streaming decoder."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orbweave.llm.common import slices, texts

STATES = 200_000
PIECES = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a rank file: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


class Transducer:
    """Byte-level BPE of one match of the pattern, read byte by byte.

    A sequence of tokens is the BPE of its bytes exactly when each token is the BPE of its own bytes and each
    neighbouring pair is the BPE of the pair's bytes.  The nondeterministic transducer therefore walks down the
    trie of tokens and, at a token, may end it if the pair with the token before is good.  Its subsets are
    determinised as they are met: a state is the set of (token before, trie node) that are possible, and at any
    byte exactly one member has just ended a token, the arc's token.  Tokens are written once every member goes
    back to them: at once where one member is left, and else from the members' common past, looked for when more
    than two of the longest tokens' bytes wait.  States are kept up to ``STATES``; then the memory starts anew.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self._children: list[dict[int, int]] = [{}]
        self._ends: list[int] = [-1]
        self._depth: list[int] = [0]
        self._longest = max(map(len, ranks))
        for token, rank in ranks.items():
            at = 0
            for b in token:
                step = self._children[at]
                if b not in step:
                    step[b] = len(self._children)
                    self._children.append({})
                    self._ends.append(-1)
                    self._depth.append(self._depth[at] + 1)
                at = step[b]
            self._ends[at] = rank
        self._stories: dict[int, tuple | None] = {}
        self._reset()

    def _reset(self):
        self._ids: dict[tuple, int] = {((-1, 0),): 0}
        self._states: list[tuple] = [((-1, 0),)]
        self._arcs: list[dict[int, tuple[int, int, bool]]] = [{}]

    def merge(self, data: bytes, steps: list | None = None) -> list[int]:
        """BPE by merging the pair of lowest rank, leftmost first, until none is left: the definition.

        ``steps`` gets (rank, first part, last part) after each merge.
        """
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            if steps is not None:
                steps.append((rank, parts[0], parts[-1]))
        return [self.ranks[p] for p in parts]

    def _story(self, token: int):
        """How a token arises: merge ranks with the first and last parts before each; None if it is not its own BPE."""
        if token not in self._stories:
            data, steps = self.tokens[token], []
            stands = self.merge(data, steps) == [token]
            ranks = [*(r for r, _, _ in steps), 1 << 60]
            self._stories[token] = (ranks, [data[:1], *(f for _, f, _ in steps)],
                                    [data[-1:], *(la for _, _, la in steps)]) if stands else None
        return self._stories[token]

    def _follows(self, before: int, token: int) -> bool:
        """Is the BPE of both tokens' bytes these two tokens?

        Their own merges go on side by side, lowest rank first, until one across the border is due before them.
        """
        right = self._story(token)
        if right is None or before < 0:
            return right is not None
        left, i, j = self._story(before), 0, 0
        while True:
            x, y = left[0][i], right[0][j]
            across = self.ranks.get(left[2][i] + right[1][j], 1 << 60)
            if across < x and across <= y:           # of equal ranks the leftmost goes first
                return False
            if x <= y:
                if x == 1 << 60:
                    return True
                i += 1
            else:
                j += 1

    def _arc(self, state: int, byte: int) -> tuple[int, int, bool]:
        """Follow the subset by one byte: the next state, the token that ends there, whether one member is left."""
        members, ended = [], []
        for before, node in self._states[state]:
            child = self._children[node].get(byte)
            if child is not None:
                if self._children[child]:
                    members.append((before, child))
                if self._ends[child] >= 0:
                    ended.append((self._depth[child], before, self._ends[child]))
        for _, before, token in sorted(ended, reverse=True):      # one of them stands; mostly the longest
            if self._follows(before, token):
                members.append((token, 0))
                break
        else:
            raise ValueError("a byte is missing among the ranks")
        subset = tuple(members)
        number = self._ids.get(subset)
        if number is None:
            number = self._ids[subset] = len(self._states)
            self._states.append(subset)
            self._arcs.append({})
        arc = self._arcs[state][byte] = (number, token, len(members) == 1)
        return arc

    def _back(self, ends: list[int], at: int, to: int) -> list[int]:
        """Tokens from byte ``to`` up to byte ``at``."""
        out = []
        while at > to:
            out.append(ends[at])
            at -= len(self.tokens[ends[at]])
        return out[::-1]

    def _common(self, ends: list[int], state: int, at: int, written: int) -> int:
        """The last byte, from ``written`` on, where all members of the state had ended a token."""
        starts = {at - self._depth[node] for _, node in self._states[state]}
        while len(starts) > 1:
            latest = max(starts)
            starts.remove(latest)
            starts.add(max(written, latest - len(self.tokens[ends[latest]])))
        return starts.pop()

    def tokens_of(self, data):
        """Tokens of one match, given out as soon as they are certain; ``data`` gives bytes one by one."""
        if len(self._states) > STATES:
            self._reset()
        state, at, written = 0, 0, 0
        ends = [-1]                                       # token that ends at each byte
        arcs = self._arcs
        for byte in data:
            arc = arcs[state].get(byte) or self._arc(state, byte)
            state = arc[0]
            ends.append(arc[1])
            at += 1
            if arc[2]:
                yield from self._back(ends, at, written)
                written = at
            elif at - written > 2 * self._longest:
                sure = self._common(ends, state, at, written)
                yield from self._back(ends, sure, written)
                written = sure
        yield from self._back(ends, at, written)

    def encode(self, data: bytes) -> bytes:
        """Ids of one match, as little-endian 32-bit integers."""
        whole = self.ranks.get(data)
        if whole is not None:                        # a match that is a token is that token
            return whole.to_bytes(4, "little")
        if len(data) > 2 * self._longest:
            return np.array(list(self.tokens_of(data)), "<u4").tobytes()
        state, ends, arcs = 0, [-1], self._arcs      # a short match ends before anything need be written
        for byte in data:
            arc = arcs[state].get(byte) or self._arc(state, byte)
            state = arc[0]
            ends.append(arc[1])
        if len(self._states) > STATES:
            self._reset()
        return b"".join([t.to_bytes(4, "little") for t in self._back(ends, len(data), 0)])


class _Matches(dict):
    """Ids of each match met so far; a new one goes through the transducer."""

    def __init__(self, machine: Transducer):
        super().__init__()
        self._machine = machine

    def __missing__(self, match: str) -> bytes:
        ids = self[match] = self._machine.encode(match.encode())
        return ids


class TextEncoder:
    """Ids of whole texts: matches of the pattern, each through the transducer once and then from memory."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        self.machine = Transducer(ranks)
        self._find = regex.compile(pattern).findall
        self._known = _Matches(self.machine)

    def encode(self, text: str) -> bytes:
        if len(self._known) > PIECES:
            self._known.clear()
        return b"".join(map(self._known.__getitem__, self._find(text)))


class Utf8Stream:
    """Incremental UTF-8: feed bytes in any cuts, get text as soon as its characters are whole.

    The state is the number of continuation bytes still due, the range the next one must be in, and the bytes held.
    Only the bytes at the end of a cut go through the machine; the rest is decoded at once.  Bytes that cannot
    be part of a character become U+FFFD.
    """

    # first byte from -> (continuation bytes, lowest and highest next byte)
    _LEADS = ((0xF5, None), (0xF4, (3, 0x80, 0x8F)), (0xF1, (3, 0x80, 0xBF)), (0xF0, (3, 0x90, 0xBF)),
              (0xEE, (2, 0x80, 0xBF)), (0xED, (2, 0x80, 0x9F)), (0xE1, (2, 0x80, 0xBF)), (0xE0, (2, 0xA0, 0xBF)),
              (0xC2, (1, 0x80, 0xBF)), (0x80, None), (0x00, (0, 0, 0)))

    def __init__(self):
        self._held = b""

    @classmethod
    def _step(cls, due, byte):
        """State after a byte: (bytes due, low, high), or None where no character goes on like this."""
        if due is None or due[0] == 0:
            return next(v for k, v in cls._LEADS if byte >= k)
        return (due[0] - 1, 0x80, 0xBF) if due[1] <= byte <= due[2] else None

    def feed(self, data: bytes) -> str:
        data = self._held + data
        self._held = b""
        for back in range(1, min(3, len(data)) + 1):          # where may an unfinished character begin?
            if data[-back] >= 0xC0:
                due = None
                for byte in data[-back:]:
                    due = self._step(due, byte)
                    if due is None:
                        break
                if due is not None and due[0]:
                    data, self._held = data[:-back], data[-back:]
                break
            if data[-back] < 0x80:
                break
        return data.decode("utf-8", "replace")

    def close(self) -> str:
        rest, self._held = self._held, b""
        return rest.decode("utf-8", "replace")


class Decoder:
    """Ids back to bytes, a chunk of ids at a time, by gathering from one array of all tokens' bytes."""

    def __init__(self, ranks: dict[bytes, int], chunk: int = 65_536):
        size = max(ranks.values()) + 1
        table = [b""] * size
        for token, rank in ranks.items():
            table[rank] = token
        self._table, self._chunk = table, chunk

    def chunks(self, ids: bytes):
        """Bytes of each chunk of the ids (little-endian 32-bit)."""
        numbers = np.frombuffer(ids, "<u4")
        for at in range(0, len(numbers), self._chunk):
            yield b"".join(map(self._table.__getitem__, numbers[at:at + self._chunk].tolist()))

    def text(self, ids: bytes) -> str:
        stream = Utf8Stream()
        return "".join([*(stream.feed(c) for c in self.chunks(ids)), stream.close()])


_held: dict[tuple[str, str], tuple[TextEncoder, Decoder]] = {}


def coder(path: str, pattern: str) -> tuple[TextEncoder, Decoder]:
    """One encoder and decoder per Python worker, rank file and pattern."""
    if (path, pattern) not in _held:
        ranks = read_ranks(path)
        _held[path, pattern] = TextEncoder(ranks, pattern), Decoder(ranks)
    return _held[path, pattern]


def encode_texts(rows: DataFrame, path: str, pattern: str, key: str = "name", text: str = "verdict") -> DataFrame:
    """Encode every whole verdict text and decode its ids again: key, ids, n_tokens, decoded.

    ``ids``: little-endian 32-bit ids by the rank file ``path``, each match of ``pattern`` separately, no special
    tokens.  ``decoded``: the text of the streaming decoder.  Null counts as empty (no ids); repeated rows give
    repeated rows; an empty table gives none; other columns are not read.  No shuffle.
    """
    return _run(rows, path, pattern, key, text, "ids binary, decoded string", lambda ids, back: (ids, back))


def encode_digests(rows: DataFrame, path: str, pattern: str, key: str = "name", text: str = "verdict") -> DataFrame:
    """As ``encode_texts``, with SHA-256 of ids and of decoded bytes in place of both."""
    return _run(rows, path, pattern, key, text, "ids_sha256 string, decoded_sha256 string", lambda ids, back: (
        hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))


def _run(rows, path, pattern, key, text, columns, made) -> DataFrame:
    kind = rows.schema[key].dataType.simpleString()
    kinds = [pa.binary() if c.split()[1] == "binary" else pa.string() for c in columns.split(", ")]
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches):
        encoder, decoder = coder(path, pattern)
        for b in slices(batches, 128):
            sizes, first, second = [], [], []
            for t in texts(b.column(1)):
                ids = encoder.encode(t.decode())
                x, y = made(ids, decoder.text(ids))
                sizes.append(len(ids) // 4)
                first.append(x)
                second.append(y)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(first, kinds[0]), pa.array(second, kinds[1])],
                names=[key, "n_tokens", *names])
    return rows.select(F.col(key), F.col(text).alias("__text")).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, {columns}")
