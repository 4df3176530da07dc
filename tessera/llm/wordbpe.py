"""Whole-text encoding with a file of the tokenizers library, with a memory of the words of a worker."""

from __future__ import annotations

import string
import struct
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

from tessera.llm.common import gather, sums, words_of

#: Words of these letters keep their code points under NFC and lower-case one by one.
PLAIN = regex.compile(r"[!-~¡-įı-ɏ]+")


@cache
def byte_letters() -> dict[int, str]:
    """The letters by which byte-level BPE writes bytes: printable ones as they are, others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordEncoder(dict):
    """word -> its ids as little-endian unsigned 32-bit integers; forgets all beyond `limit` words.

    by_word: the tokenizer lower-cases and drops white space, so a text's ids are those of its words.
    """

    def __init__(self, path: str, by_word: bool, limit: int = 1_000_000) -> None:
        super().__init__()
        self.tokenizer, self.by_word, self.limit = Tokenizer.from_file(path), by_word, limit
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.units: dict[str, bytes] = {}
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    @staticmethod
    @cache
    def shared(path: str, by_word: bool) -> WordEncoder:
        """One for each Python worker."""
        return WordEncoder(path, by_word)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def unit(self, unit: str) -> bytes:
        found = self.units.get(unit)
        if found is None:
            if len(self.units) > self.limit:
                self.units.clear()
            written = unit if unit.isascii() else unit.encode().decode("latin-1").translate(byte_letters())
            ids = [t.id for t in self.tokenizer.model.tokenize(written)]
            found = self.units[unit] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def __missing__(self, word: str) -> bytes:
        if word.isascii() and word.isprintable() or PLAIN.fullmatch(word):
            core = word.rstrip(string.punctuation)
            if core.isalpha():  # letters, and signs after them
                out = self.unit(core.lower()) + (self.unit(word[len(core) :]) if len(core) < len(word) else b"")
            else:
                out = b"".join(map(self.unit, self.split.findall(word.lower())))
        else:
            out = self.whole(word)
        self[word] = out
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts one after the other, and each text's number of ids. A null text has none."""
        apart = [True] * len(texts)
        if self.by_word:
            hits = [pc.match_substring(texts, s).fill_null(False) for s in self.special]
            apart = np.any([h.to_numpy(zero_copy_only=False) for h in hits], axis=0).tolist() if hits else [False] * len(texts)
        if any(apart):
            parts = [(np.frombuffer(self.whole(t or ""), "<u4"), None) if a else self._by_word(pa.array([t], pa.string())) for t, a in zip(texts.to_pylist(), apart, strict=True)]
            return np.concatenate([p[0] for p in parts]), np.array([len(p[0]) for p in parts])
        return self._by_word(texts)

    def _by_word(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > self.limit:
            self.clear()
        codes, offsets, words = words_of(texts)
        known = [self[w] for w in words]
        sizes = np.array([len(k) for k in known], np.int64) // 4
        starts = np.cumsum(sizes) - sizes
        each = sizes[codes]
        ids = np.frombuffer(b"".join(known), "<u4")[gather(starts[codes], each)]
        return ids, sums(each, offsets)
