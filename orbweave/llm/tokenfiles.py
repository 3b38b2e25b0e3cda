"""Token files of verdict texts: Simple-8b words in blocks, written in key order and read back."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from orbweave.llm.common import slices, texts, written
from orbweave.llm.wordbpe import END_ID, word_ids

# selector -> (values per word, bits per value); 15 announces a full 64-bit value in the next word
PACKING = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20),
           (2, 30), (1, 60)]
ESCAPE = 15
CHUNK = 4096
BLOCK_IDS = 65_536
_BITS = np.array([v.bit_length() for v in range(1 << 16)], "u1")


# --- the code --------------------------------------------------------------------------------------------

def simple8b_encode(ids: np.ndarray, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """64-bit words of the ids, and the first word of each ``chunk`` of them.

    A word has a selector in its four highest bits and as many ids as fit, each with the selector's bits; the most
    ids are taken that all have room.  An id of 60 bits or more is an escape: a word with selector 15, then the
    id.  Words never cross a chunk, so any chunk decodes by itself.
    """
    ids = np.ascontiguousarray(ids, "u8")
    n = len(ids)
    if not n:
        return np.zeros(0, "u8"), np.zeros(0, "i8")
    if ids.max() < len(_BITS):
        bits = _BITS[ids]
    else:
        bits = np.where(ids < (1 << 53), np.frexp(ids.astype("f8"))[1], 64).astype("u1")
        wide = ids >= (1 << 53)
        bits[wide] = [int(v).bit_length() for v in ids[wide]]
    choice = np.full(n, ESCAPE, "i1")
    step = np.ones(n, "i8")
    for selector in range(len(PACKING) - 1, -1, -1):          # from few wide values to many narrow ones
        count, width = PACKING[selector]
        narrow = np.flatnonzero(bits <= width)
        if len(narrow) < count:
            break
        first = narrow[:len(narrow) - count + 1]              # ids from which ``count`` in a row are narrow enough
        fits = first[(narrow[count - 1:] - first == count - 1) & (first % chunk <= chunk - count)]
        choice[fits], step[fits] = selector, count
    following = (np.arange(n) + step).tolist()
    starts, i = [], 0
    while i < n:                                              # the chain of words; all else is by array
        starts.append(i)
        i = following[i]
    starts = np.array(starts, "i8")
    picked = choice[starts]
    size = np.where(picked == ESCAPE, 2, 1)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), "u8")
    for selector, (count, width) in enumerate(PACKING):
        mine = picked == selector
        if mine.any():
            values = ids[starts[mine][:, None] + np.arange(count)]
            shifts = (np.arange(count) * width).astype("u8")
            words[place[mine]] = np.bitwise_or.reduce(values << shifts, axis=1) | np.uint64(selector << 60)
    escaped = picked == ESCAPE
    words[place[escaped]] = np.uint64(ESCAPE << 60)
    words[place[escaped] + 1] = ids[starts[escaped]]
    return words, place[np.searchsorted(starts, np.arange(0, n, chunk))]


def simple8b_decode(words: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of encoded words (whole chunks, from a chunk's first word on)."""
    words = np.ascontiguousarray(words, "u8")
    selector = (words >> np.uint64(60)).astype("i8")
    if (selector == ESCAPE).any():                            # a word after an escape has no selector of its own
        marks = np.flatnonzero(selector == ESCAPE)
        runs = np.split(marks, np.flatnonzero(np.diff(marks) != 1) + 1)
        for run in runs:                                      # in a row of apparent escapes every second is a value
            selector[run[1::2]] = -1
            if len(run) % 2 and run[-1] + 1 < len(words):
                selector[run[-1] + 1] = -1
    counts = np.array([c for c, _ in PACKING] + [0, 1, 0])    # the last: a raw value, reached by -1
    held = counts[selector]
    start = np.cumsum(held) - held
    out = np.zeros(int(held.sum()), "u8")
    for s, (count, width) in enumerate(PACKING):
        mine = np.flatnonzero(selector == s)
        if len(mine):
            shifts = (np.arange(count) * width).astype("u8")
            out[start[mine][:, None] + np.arange(count)] = (words[mine][:, None] >> shifts) & np.uint64((1 << width) - 1)
    escaped = np.flatnonzero(selector == ESCAPE)
    out[start[escaped]] = words[escaped + 1]
    assert len(out) == n, "the words hold another number of ids"
    return out


# --- files -----------------------------------------------------------------------------------------------

FILE_SCHEMA = ("part int, block int, first bigint, n_ids bigint, chunk_words array<bigint>, words binary, "
               "keys array<{key}>, lengths array<bigint>")


def token_blocks(rows: DataFrame, tokenizer: str, key: str = "name", text: str = "verdict") -> DataFrame:
    """Rows of the file format: blocks of whole texts, in ascending key order over parts and blocks.

    ``first``: ids before the block in its part; ``chunk_words``: first word of each chunk of 4,096 ids;
    ``words``: the Simple-8b words; ``keys``, ``lengths``: the block's texts and their numbers of ids.
    """
    kind = rows.schema[key].dataType.simpleString()
    ordered = rows.select(F.col(key).alias("key"), F.col(text).alias("text")).repartitionByRange("key") \
        .sortWithinPartitions("key")
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        encoder, part = word_ids(tokenizer), TaskContext.get().partitionId()
        state = {"block": 0, "first": 0}
        keys, held, size = [], [], 0

        def block(key_type):
            ids = np.frombuffer(b"".join(held), "<u4")
            words, chunks = simple8b_encode(ids)
            lengths = [len(h) // 4 for h in held]
            out = pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([state["block"]], pa.int32()),
                pa.array([state["first"]], pa.int64()), pa.array([len(ids)], pa.int64()),
                pa.array([chunks.tolist()], pa.list_(pa.int64())), pa.array([words.astype("<u8").tobytes()], pa.binary()),
                pa.array([keys], pa.list_(key_type)), pa.array([lengths], pa.list_(pa.int64()))],
                names=["part", "block", "first", "n_ids", "chunk_words", "words", "keys", "lengths"])
            state["block"] += 1
            state["first"] += len(ids)
            return out
        key_type = None
        for b in slices(batches, 64):
            key_type = b.schema.field(0).type
            for k, ids in zip(b.column(0).to_pylist(), encoder.encode_all(list(texts(b.column(1))))):
                keys.append(k)
                held.append(ids + end)
                size += len(ids) // 4 + 1
                if size >= BLOCK_IDS:
                    yield block(key_type)
                    keys, held, size = [], [], 0
        if keys:
            yield block(key_type)
    return ordered.mapInArrow(run, FILE_SCHEMA.format(key=kind))


def decode_block(row: dict) -> memoryview:
    """The ids of one block as little-endian 32-bit bytes."""
    words, chunks = np.frombuffer(row["words"], "<u8"), [*row["chunk_words"], None]
    ids = [simple8b_decode(words[chunks[i]:chunks[i + 1]], min(CHUNK, row["n_ids"] - i * CHUNK))
           for i in range(len(chunks) - 1)]
    return memoryview(np.concatenate([np.zeros(0, "u8"), *ids]).astype("<u4").tobytes())


def read_tokens(files: DataFrame, with_ids: bool = True) -> DataFrame:
    """Each text of the files: key, start (ids of all texts before it), n_tokens, ids_crc32, ids (32-bit bytes)."""
    kind = files.schema["keys"].dataType.elementType.simpleString()
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))            # one row per file part
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                flat, stops = decode_block(row), np.cumsum(row["lengths"]).tolist()
                each = [bytes(flat[4 * (s - n):4 * s]) for s, n in zip(stops, row["lengths"])]
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["part"]] * len(stops), pa.int32()),
                    pa.array(row["keys"], b.schema.field("keys").type.value_type),
                    pa.array([s - n + row["first"] for s, n in zip(stops, row["lengths"])], pa.int64()),
                    pa.array(row["lengths"], pa.int64()), pa.array([zlib.crc32(e) for e in each], pa.int64()),
                    pa.array(each if with_ids else [None] * len(each), pa.binary())], names=["part", "key", "at", "n_tokens", "ids_crc32", "ids"])
    decoded = files.select("part", "first", "n_ids", "chunk_words", "words", "keys", "lengths").mapInArrow(
        run, f"part int, key {kind}, at bigint, n_tokens bigint, ids_crc32 bigint, ids binary")
    return decoded.join(before, "part").select(
        "key", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "ids")


def token_files(rows: DataFrame, tokenizer: str, key: str = "name", text: str = "verdict") -> DataFrame:
    """Encode every verdict text, write the token files, read them back: key, start, n_tokens, ids_crc32.

    Texts are encoded whole by the tokenizers file ``tokenizer`` (a special token's string is that token, as the
    library does by default), followed by id 1.  Files are in ascending key order, null keys first; the order
    of equal keys is open.  A null or empty text has the one id 1; an empty table gives no rows; other columns
    are not read.  The only shuffle brings the texts into key order; ids exist in the files alone.
    """
    files = written(token_blocks(rows, tokenizer, key, text), "token-files")
    return read_tokens(files, with_ids=False).select(F.col("key").alias(key), "start", "n_tokens", "ids_crc32")
