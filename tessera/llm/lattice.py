"""Segmentation lattices of many strings at once, over the pieces of a SentencePiece model file.

A string of n code points has nodes 0..n; an edge from node i to node j is a piece that equals the code points
between them. Where no piece of one code point exists, that code point has an edge of its own, piece -1 (its
bytes). Strings are held flat: string s has its nodes at `base[s]` .. `base[s] + n`.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import sentencepiece

from tessera.llm.common import mix64

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MASK = np.uint64((1 << 21) - 1)


def _extend(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    return mix64((h ^ points) + _STEP)


class Pieces:
    """The pieces that a lattice may use: all but control, unknown and byte pieces."""

    def __init__(self, path: str, fold: bool = False) -> None:
        """fold: only pieces that lower-casing leaves alone."""
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.ids = np.array([i for i in range(self.size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)) and (not fold or model.id_to_piece(i) == model.id_to_piece(i).lower())], np.int32)
        self.text = [model.id_to_piece(int(i)) for i in self.ids]
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.longest = max(map(len, self.text))
        ends = np.zeros(len(self.text), np.uint64)
        self.prefix = np.zeros(int(_MASK) + 1, bool)
        order = np.argsort([len(t) for t in self.text], kind="stable")
        lengths = np.array([len(self.text[i]) for i in order])
        points = np.frombuffer("".join(self.text[i] for i in order).encode("utf-32-le"), "<u4").astype(np.uint64)
        first = np.cumsum(lengths) - lengths
        h = np.zeros(len(order), np.uint64)
        for k in range(self.longest):
            live = lengths > k
            h[live] = _extend(h[live], points[first[live] + k])
            self.prefix[(h[live] & _MASK).astype(np.int64)] = True
        ends[order] = h
        by = np.argsort(ends)
        self.keys, self.at = ends[by], by.astype(np.int32)

    @staticmethod
    @cache
    def shared(path: str, fold: bool = False) -> Pieces:
        return Pieces(path, fold)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Indices of pieces by hash, -1 where there is none."""
        i = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[i] == h, self.at[i], -1)


@dataclass
class Lattice:
    """Edges in order of their end's place in its string, then of their end node."""

    base: np.ndarray  # first node of each string
    length: np.ndarray  # code points of each string
    start: np.ndarray  # start node of each edge
    end: np.ndarray
    piece: np.ndarray  # index into Pieces.ids, or -1
    point: np.ndarray  # the code point of edges with piece -1
    steps: np.ndarray  # edges of end place p are steps[p - 1] : steps[p]

    @property
    def nodes(self) -> int:
        return int(self.length.sum() + len(self.length))


def build(strings: list[str], pieces: Pieces) -> Lattice:
    length = np.fromiter(map(len, strings), np.int64, len(strings))
    points = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    base = np.cumsum(length) - length + np.arange(len(strings))
    owner = np.repeat(np.arange(len(strings)), length)
    ends = np.cumsum(length)[owner]
    at = np.arange(len(points))
    live, h = at, np.zeros(len(points), np.uint64)
    starts, sizes, found = [], [], []
    for k in range(pieces.longest):
        keep = live + k < ends[live]
        live, h = live[keep], h[keep]
        h = _extend(h, points[live + k])
        keep = pieces.prefix[(h & _MASK).astype(np.int64)]
        if k == 0:
            hit = np.full(len(live), -1, np.int32)
            hit[keep] = pieces.find(h[keep])
            starts.append(live)
            found.append(hit)
            sizes.append(np.ones(len(live), np.int64))
            live, h = live[keep], h[keep]
            continue
        live, h = live[keep], h[keep]
        if not len(live):
            break
        hit = pieces.find(h)
        got = hit >= 0
        starts.append(live[got])
        found.append(hit[got])
        sizes.append(np.full(int(got.sum()), k + 1))
    start, size, piece = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (starts, sizes, found))
    place = start + size - (ends[start] - length[owner[start]]) if len(start) else start
    node = start + (owner[start] if len(start) else 0)
    order = np.lexsort((node + size, place))
    start, size, piece, place, node = (x[order] for x in (start, size, piece, place, node))
    steps = np.searchsorted(place, np.arange(1, (int(length.max()) if len(length) else 0) + 1), side="right")
    return Lattice(base, length, node, node + size, piece, points[start].astype(np.int64) if len(start) else start, steps)


def _logsum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """log(sum(exp)) of the runs of rows that begin at `first`."""
    top = np.maximum.reduceat(values, first, axis=0)
    runs = np.diff(np.append(first, len(values)))
    return top + np.log(np.add.reduceat(np.exp(values - np.repeat(top, runs, axis=0)), first, axis=0))


def forward(lattice: Lattice, weight: np.ndarray) -> np.ndarray:
    """log of the summed weight of all segmentations up to each node; weight: log, by edge (and column)."""
    alpha = np.zeros((lattice.nodes, *weight.shape[1:]))
    lo = 0
    for hi in lattice.steps:
        if hi > lo:
            end = lattice.end[lo:hi]
            first = np.flatnonzero(np.append(True, end[1:] != end[:-1]))
            alpha[end[first]] = _logsum(alpha[lattice.start[lo:hi]] + weight[lo:hi], first)
        lo = hi
    return alpha


def backward(lattice: Lattice, weight: np.ndarray) -> np.ndarray:
    """log of the summed weight of all segmentations from each node to its string's end."""
    beta = np.full((lattice.nodes, *weight.shape[1:]), -np.inf)
    beta[lattice.base + lattice.length] = 0
    place = lattice.start - np.repeat(lattice.base, lattice.length + 1)[lattice.start] if len(lattice.start) else lattice.start
    order = np.lexsort((lattice.start, -place))
    cuts = np.append(np.flatnonzero(np.append(True, place[order][1:] != place[order][:-1])) if len(order) else [], len(order)).astype(int)
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        e = order[lo:hi]
        start = lattice.start[e]
        first = np.flatnonzero(np.append(True, start[1:] != start[:-1]))
        beta[start[first]] = _logsum(beta[lattice.end[e]] + weight[e], first)
    return beta
