"""Ids of a word-level BPE vocabulary, looked up word by word.

Where the vocabulary's file says that its pattern never crosses white space, the ids of a text are those of its words one
after the other, and the ids of an ASCII word those of its runs of letters, digits and marks.  Runs that a worker has
not met go through the library's merges; all later ones cost one dictionary access.
"""

from __future__ import annotations

import json
import os
import re

from orbweave.llm.common import utf8

END_ID = 1
CACHE_WORDS = 600_000
#: What the file must say for texts to be cut into words and runs (fixed values of the format).
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Lower-case letters that no normalisation changes: a to z and those of the Latin blocks up to U+024F.
_LETTERS = "a-z" + "".join(c for c in map(chr, range(0xDF, 0x250)) if c.isalpha() and c.lower() == c)
_RUNS = re.compile(f"[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")
_PLAIN = re.compile(f"[!-&(-;=@\\[-~{_LETTERS}]+")      # with other ASCII but space, capitals, apostrophe and the sign of special tokens


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it prints, else one after U+0100."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


def cut_at_words(spec: dict) -> bool:
    """Whether a tokenizers file normalises and splits texts in the way that words can be looked up."""
    split = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return ((spec.get("normalizer") or {}).get("normalizers") == NORMALIZERS and len(split) == 2
            and (split[0].get("type"), split[0].get("behavior"), split[0].get("invert")) == ("Split", "Removed", True)
            and split[0].get("pattern") == {"Regex": PATTERN}
            and (split[1].get("type"), split[1].get("use_regex"), split[1].get("add_prefix_space")) == ("ByteLevel", False, False)
            and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and not spec["model"].get("ignore_merges")
            and not spec.get("truncation") and not spec.get("padding")
            and all(t["special"] and not t["normalized"] and t["content"].startswith("<") for t in spec.get("added_tokens", ())))


class _Words(dict):
    """Ids by word; a word that is missing is learned when it is asked for."""

    def __init__(self, lib):
        self._lib, self._merges, self._letters = lib, lib.model.tokenize, byte_letters()

    def _run(self, run: str) -> bytes:
        data = run.encode()
        if data not in self:
            self[data] = b"".join([t.id.to_bytes(4, "little") for t in self._merges(
                run if run.isascii() else "".join([self._letters[b] for b in data]))])
        return self[data]

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if _PLAIN.fullmatch(text):
            ids = b"".join(map(self._run, _RUNS.findall(text)))
        else:
            ids = b"".join([i.to_bytes(4, "little") for i in self._lib.encode(text, add_special_tokens=False).ids])
        self[word] = ids
        return ids


class WordIds:
    """Little-endian 32-bit ids of texts; ``tokenizer`` is the path of a tokenizers file.

    A file of another kind is used as it is: whole texts go through the library.  Bytes that are not UTF-8 count as
    U+FFFD.  When more than ``CACHE_WORDS`` words are remembered the memory starts anew with the next texts.
    """

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        import numpy as np
        self._np, self._lib = np, Tokenizer.from_file(tokenizer)
        with open(tokenizer, encoding="utf-8") as f:
            self.by_word = cut_at_words(json.load(f))
        self._known = _Words(self._lib)

    def encode_all(self, values: list[bytes]) -> list[bytes]:
        """The ids of each text as bytes."""
        values = [utf8(v) for v in values]
        if not self.by_word:
            return [self._np.array(e.ids, dtype="<u4").tobytes() for e in self._lib.encode_batch_fast(
                [v.decode() for v in values], add_special_tokens=False)]
        if len(self._known) > CACHE_WORDS:
            self._known.clear()
        ids = self._known.__getitem__
        # the vocabulary lower-cases itself; a "<" may begin a special token, whose case counts
        return [b"".join(map(ids, [w if b"<" in w else w.lower() for w in v.split()] if b"<" in v else v.lower().split()))
                for v in values]


_held: dict[str, WordIds] = {}


def word_ids(tokenizer: str) -> WordIds:
    """One encoder per Python worker and file."""
    if tokenizer not in _held:
        _held[tokenizer] = WordIds(tokenizer)
    return _held[tokenizer]
