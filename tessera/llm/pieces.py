"""Operator 2: sampled SentencePiece segmentations by forward filtering and backward sampling.

A piece weighs exp(temperature * log weight), its weight by rank of its score in the model file (1 / (rank + OFFSET), as
merges carry ranks and not probabilities); a code point outside the vocabulary becomes its byte pieces. The
forward pass sums all segmentations up to each node of a text's lattice; a segmentation is then drawn backwards
from the end, each edge in proportion to the forward sum that comes with it. No piece goes from other code points
into a space, so a text's lattice is a chain of its words' lattices: their forward sums are remembered by
word, and each occurrence draws for itself. Draws are a function of the row key, the seed and the place in
the text alone, whichever worker makes them.

Decoding is lossless: spaces are written as the meta symbol, and a meta symbol of the text itself as bytes.

Defined results: a null text has null ids, an empty one none; a null key draws as key 0; rows with one key
and one text have one segmentation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Slots, gather, mix64, sums
from tessera.llm.lattice import Pieces, build, forward

META = "▁"
#: Text between places where a lattice falls apart: spaces and what follows, and line ends, which no piece holds.
UNITS = re.compile(r" +[^ \n]*|\n|[^ \n]+")
OFFSET, SURE = 3.0, -30.0
#: Units and edges of lattices that a worker remembers, characters that are learnt and texts that are drawn at once.
REMEMBERED, EDGES, LEARNT, TOGETHER = 250_000, 3_000_000, 150_000, 256
_GOLD = np.uint64(0x9E3779B97F4A7C15)


class Growing:
    """An array that grows at its end."""

    def __init__(self, kind: type) -> None:
        self.data, self.size = np.zeros(1 << 12, kind), 0

    def extend(self, more: np.ndarray) -> None:
        end = self.size + len(more)
        if end > len(self.data):
            grown = np.empty(max(end, len(self.data) * 3 // 2), self.data.dtype)
            grown[: self.size] = self.data[: self.size]
            self.data = grown
        self.data[self.size : end] = more
        self.size = end

    @property
    def all(self) -> np.ndarray:
        return self.data[: self.size]


def split_units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """A code for each unit, offsets by text, and the units behind the codes; one of them may be empty.

    Single spaces and line ends part units by Arrow's functions; texts with runs of spaces go by UNITS.
    """
    texts = texts.fill_null("")
    mark = next((chr(c) for c in (*range(9), 0xFDD0, 0xFDD1) if not pc.any(pc.match_substring(texts, chr(c))).as_py()), None)
    begun = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
    runs = pc.match_substring(begun, "  ").to_numpy(zero_copy_only=False)
    if mark is None:
        lists = pa.array([UNITS.findall(t) for t in begun.to_pylist()], pa.list_(pa.string()))
    else:
        parted = pc.replace_substring(pc.replace_substring(begun, " ", mark + " "), "\n", mark + "\n" + mark)
        if runs.any():
            own = [mark.join(UNITS.findall(begun[int(i)].as_py())) for i in np.flatnonzero(runs)]
            parted = pc.replace_with_mask(parted, pa.array(runs), pa.array(own, pa.string()))
        lists = pc.split_pattern(parted, mark)
    first, offsets = lists.offsets[0].as_py(), lists.offsets.to_numpy()
    coded = lists.flatten().dictionary_encode()
    return coded.indices.to_numpy(), offsets - first, coded.dictionary.to_numpy(zero_copy_only=False).tolist()


class Sampler:
    """Samples segmentations; remembers the lattices of up to REMEMBERED units."""

    def __init__(self, path: str, temperature: float) -> None:
        self.pieces = Pieces.shared(path)
        self.logw = -temperature * np.log(np.arange(len(self.pieces.ids)) + OFFSET)
        self.forget()

    @staticmethod
    @cache
    def shared(path: str, temperature: float) -> Sampler:
        return Sampler(path, temperature)

    def forget(self) -> None:
        self.slots = Slots()
        self.first, self.last = Growing(np.int64), Growing(np.int64)  # start and end node of each unit
        self.keys = Growing(np.uint64)  # end node and upper bound of the share, of each edge
        self.code = Growing(np.int32)  # piece id, or -1 - code point
        self.span = Growing(np.uint8)
        self.count = 0

    def _learn(self, units: list[str]) -> None:
        # A meta symbol of the text itself is no space: it goes by a code point that no piece has.
        lattice = build([u.replace(META, "\U0010FFFF").replace(" ", META) for u in units], self.pieces)
        weight = np.where(lattice.piece >= 0, self.logw[np.maximum(lattice.piece, 0)], SURE)
        alpha = forward(lattice, weight)
        share = np.exp(alpha[lattice.start] + weight - alpha[lattice.end])
        order = np.argsort(lattice.end, kind="stable")
        end, share = lattice.end[order], share[order]
        total = np.cumsum(share)
        fresh = np.append(True, end[1:] != end[:-1]) if len(end) else np.zeros(0, bool)
        at = np.flatnonzero(fresh)
        bound = total - np.repeat(total[at] - share[at], np.diff(np.append(at, len(end))))
        bound = np.minimum(bound * 2.0**32, 2.0**32 - 1).astype(np.uint64)
        bound[np.append(at[1:], len(end)) - 1] = 2**32 - 1  # the last edge of a node takes what rounding left
        point = np.where(lattice.point == 0x10FFFF, ord(META), lattice.point)
        code = np.where(lattice.piece >= 0, self.pieces.ids[np.maximum(lattice.piece, 0)], -1 - point)[order]
        self.keys.extend((end + self.count).astype(np.uint64) << np.uint64(32) | bound)
        self.code.extend(code)
        self.span.extend((lattice.end - lattice.start)[order])
        self.first.extend(lattice.base + self.count)
        self.last.extend(lattice.base + lattice.length + self.count)
        self.count += lattice.nodes

    def encode(self, keys: np.ndarray, texts: pa.Array, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of the texts one after the other, and how many each has."""
        if len(self.slots) > REMEMBERED or self.keys.size > EDGES:
            self.forget()
        codes, offsets, units = split_units(texts)
        slots = self.slots
        at = np.fromiter((slots[u] for u in units), np.int64, len(units))
        held: list[str] = []
        size = 0
        for unit in slots.new:
            held.append(unit)
            size += len(unit)
            if size > LEARNT:
                self._learn(held)
                held, size = [], 0
        if held:
            self._learn(held)
        slots.new.clear()
        counts = np.diff(offsets)
        unit = at[codes] if len(codes) else np.zeros(0, np.int64)
        place = gather(np.zeros(len(counts), np.int64), counts).astype(np.uint64)
        stream = mix64(np.repeat(mix64(keys.astype(np.int64).view(np.uint64) ^ mix64(np.uint64([seed]) + _GOLD)), counts) + place * _GOLD)
        who = np.argsort(unit)  # neighbours in the table are drawn together
        who = who[self.last.all[unit[who]] > self.first.all[unit[who]]]
        node, stop, stream = self.last.all[unit[who]], self.first.all[unit[who]], stream[who]
        edges, code, span = self.keys.all, self.code.all, self.span.all
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        drawn = np.zeros(len(unit), np.int64)
        while len(who):
            stream = mix64(stream + _GOLD)
            edge = np.searchsorted(edges, node.astype(np.uint64) << np.uint64(32) | stream >> np.uint64(32))
            steps.append((who, code[edge]))
            drawn[who] += 1
            node = node - span[edge]
            live = node > stop
            who, node, stop, stream = who[live], node[live], stop[live], stream[live]
        ends = np.cumsum(drawn)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
        for k, (w, c) in enumerate(steps):
            out[ends[w] - 1 - k] = c
        return self._bytes(out, sums(drawn, offsets))

    def _bytes(self, codes: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points without a piece become byte pieces."""
        odd = np.flatnonzero(codes < 0)
        if not len(odd):
            return codes, per_text
        raw = [chr(-1 - c).encode("utf-8", "surrogatepass") for c in codes[odd].tolist()]
        size = np.ones(len(codes), np.int64)
        size[odd] = [len(r) for r in raw]
        at = np.cumsum(size) - size
        out = np.repeat(codes, size)
        out[gather(at[odd], size[odd])] = self.pieces.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return out, sums(size, np.concatenate([[0], np.cumsum(per_text)]))


class Decoder:
    """Piece ids -> text."""

    def __init__(self, path: str) -> None:
        pieces = Pieces.shared(path)
        self.bytes = [b""] * pieces.size
        for i, t in zip(pieces.ids.tolist(), pieces.text, strict=True):
            self.bytes[i] = t.replace(META, " ").encode()
        for b, i in enumerate(pieces.byte_ids.tolist()):
            self.bytes[i] = bytes([b])

    @staticmethod
    @cache
    def shared(path: str) -> Decoder:
        return Decoder(path)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


def with_pieces(df: DataFrame, path: str, key_col: str = "doc_id", text_col: str = "text", ids_col: str = "ids", lossless_col: str = "lossless", seed: int = 0, temperature: float = 1.0) -> DataFrame:
    """Adds a sampled segmentation of each whole text, array<int>, and whether it decodes to the text; columns of these names are replaced."""
    drop = {ids_col.lower(), lossless_col.lower()}
    if {key_col.lower(), text_col.lower()} & drop:
        raise ValueError("the new columns take the place of the key or the text")
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in drop])
    schema = T.StructType([*df.schema, T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(lossless_col, T.BooleanType())])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, decoder = Sampler.shared(path, temperature), Decoder.shared(path)
        for whole in batches:
            for lo in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(lo, TOGETHER)
                texts = batch.column(text_col)
                keys = batch.column(key_col).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
                ids, counts = sampler.encode(keys, texts, seed)
                ends = np.cumsum(counts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32()), mask=texts.is_null())
                back = [None if t is None else decoder.decode(ids[a:b].tolist()) == t for t, a, b in zip(texts.to_pylist(), ends - counts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(back, pa.bool_())], [*batch.schema.names, ids_col, lossless_col])

    return df.mapInArrow(draw, schema)


def decode_pieces(ids: Column, path: str) -> Column:
    @F.pandas_udf("string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = Decoder.shared(path)
        for series in batches:
            yield pd.Series([None if x is None else decoder.decode(x.tolist()) for x in series], dtype=object)

    return read(ids)
