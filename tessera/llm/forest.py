"""Operator 7: near duplicates by an LSH forest over MinHash signatures.

A signature holds `trees * depth` minima. Tree t orders documents by the signature rotated to start at its own
`depth` minima; what follows are the other trees' minima, so that a tree can be descended further. Documents
with a common prefix form a region. Candidates come from regions as deep as their population asks for:

1. Texts with equal shingle sets are one node, named by its smallest doc_id, so exact copies never meet in a region.
2. Every region at depths DEPTH and DEEP has a leader, its smallest node. A node is tried with the smallest of its
   leaders and with the one that leads most of its regions. Verified links are contracted to components, so a
   large group of near copies costs two tries a node; what this misses is left to the next step.
3. Regions at DEPTH that still hold several components: all pairs across components if they have at most `crowd`
   nodes. Nodes of larger ones get a second forest of their own, whose trees begin at DEEP, with as many trees as
   keep the chance of a miss; all pairs again in its regions of at most `crowd` nodes.
4. Regions of the second forest that are larger, and still hold several components after step 3's likeliest links,
   are compared whole: see `_exact`. Its cost grows with the square of the nodes that share such regions, but
   for pairs of large components' own nodes.

Pairs of step 3 are candidates unless their sizes or sketches (bytes of minima) rule them out. Each node's likeliest
pair is tried first and links are contracted, then step 4 and all other pairs that still lie across components. Every link is
confirmed on the full sets of 64-bit shingle hashes; sets are told apart by 128 bits. The numbers of trees follow the
threshold: a pair just at the threshold meets in no tree with a probability under `miss`.

Defined results: null or empty texts, and those without words, have an empty set and are linked with nothing
(component: their own id); fewer words than `width` make one shingle of all of them; rows with one doc_id are one
document for linking and give one row each; a null doc_id has a null component and is kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import counted, materialise, mix64, parts, words_of

#: Minima of which a sketch keeps the low bytes, in the first forest and in the second, where more pairs lie near the
#: threshold; and by how many standard deviations it may fall short of the threshold.
SKETCH, WIDE, SLACK = 64, 512, 5.0
#: Nodes to a file of what regions hold of them, where Spark would make more files.
NODES = 2000
#: Minima of a tree's own in the first forest and in the second.
DEPTH, DEEP = 3, 8


def trees_for(num: int, den: int, miss: float, depth: int = DEPTH) -> int:
    return math.ceil(math.log(miss) / math.log(1 - (num / den) ** depth))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    codes, offsets, words = words_of(texts, lower=True)
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    blank = np.array([not w for w in words], bool)
    out = []
    hashes = known[codes] if len(codes) else np.zeros(0, np.uint64)
    empty = blank[codes] if len(codes) else np.zeros(0, bool)
    salt = mix64(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        h = hashes[a:b]
        if b > a and (empty[a] or empty[b - 1]):
            h = h[~empty[a:b]]
        if not len(h):
            out.append(h)
            continue
        k = min(width, len(h))
        x = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            x = mix64((x ^ h[i : len(h) - k + 1 + i]) + salt[i])
        x.sort()
        out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
    return out


def _signatures(sets: list[np.ndarray], n: int, seed: int) -> np.ndarray:
    """n minima of each non-empty set, as unsigned 32-bit integers."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, n, dtype=np.uint64)
    out = np.empty((len(sets), n), np.uint32)
    step = max(64, (1 << 17) // n)  # a piece of the products stays in a megabyte
    for row, x in enumerate(sets):
        for lo in range(0, len(x), step):
            part = x[None, lo : lo + step] * a[:, None]
            part += b[:, None]
            least = (part.min(axis=1) >> np.uint64(32)).astype(np.uint32)
            out[row] = least if not lo else np.minimum(out[row], least)
    return out


_DESCRIBED = "doc_id long, n_shingles long, set_key binary, sig binary, sketch binary"


def _describe(width: int, n: int, sketch: int = SKETCH, seed: int = 1, kept: tuple[str, ...] = ()):
    """(doc_id, text, kept columns) -> doc_id, n_shingles, set key, signature and its sketch, kept columns; null for empty sets."""
    n = max(n, sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sets = shingle_sets(batch.column(1), width)
                full = np.array([len(s) > 0 for s in sets])
                signed = iter(_signatures([s for s in sets if len(s)], n, seed))
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                sigs = [next(signed) if f else None for f in full]
                columns = [[None if x is None else x.tobytes() for x in sigs], [None if x is None else x[:sketch].astype(np.uint8).tobytes() for x in sigs]]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), *[pa.array(c, pa.binary()) for c in (keys, *columns)], *[batch.column(c) for c in kept]], ["doc_id", "n_shingles", "set_key", "sig", "sketch", *kept])

    return run


def _prefixes(trees: int, depth: int, levels: tuple[int, ...], kept: tuple[str, ...]):
    """(kept columns, sig) -> kept columns and the hash of each tree's prefix at each level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(batch.num_rows, -1).astype(np.uint64)
                known = [pa.array(np.repeat(batch.column(c).to_numpy(), trees)) for c in kept]
                keys = np.empty((len(levels), batch.num_rows, trees), np.int64)
                for t in range(trees):
                    h = np.full(batch.num_rows, t + 1, np.uint64)
                    for k in range(max(levels)):
                        h = mix64((h ^ sigs[:, (t * depth + k) % sigs.shape[1]]) + np.uint64(0x9E3779B97F4A7C15))
                        if k + 1 in levels:
                            keys[levels.index(k + 1), :, t] = h.view(np.int64)
                yield pa.RecordBatch.from_arrays([*known, *[pa.array(k.ravel()) for k in keys]], [*kept, *[f"k{x}" for x in levels]])

    return run


def _sets(width: int):
    """(doc_id, text) -> node, shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sets = shingle_sets(batch.column(1), width)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["node", "shingles"])

    return run


def _likely(texts: DataFrame, ids: DataFrame, bits: int = 1 << 25) -> DataFrame:
    """Texts whose id may be among `ids`, by a bitmap of `bits` hashed places (4 MB at most, whatever the input).

    What the join after it shuffles is then the texts that are asked for, not all of them.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    spots = ids.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("map"))
    spots = F.broadcast(spots.coalesce(8))
    at = F.bitmap_bit_position(place)
    known = texts.withColumns({"bucket": F.bitmap_bucket_number(place), "at": at}).join(spots, "bucket")
    byte = F.conv(F.hex(F.substring("map", F.call_function("div", F.col("at"), F.lit(8)).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return known.where(F.call_function("getbit", byte, (F.col("at") % 8).cast("int")) == 1).select("doc_id", "text")


def _asked(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id, text of some nodes. Sides that grow are merged: the size of a file says little of the rows in it."""
    nodes = nodes.withColumnRenamed("node", "doc_id")
    return _likely(texts, nodes).join(nodes.hint("merge"), "doc_id")


def _read_sets(asked: DataFrame, most: int, texts: DataFrame, width: int) -> DataFrame:
    """node, shingles: the full sets of the nodes that are asked for, `most` of them at most."""
    asked, n = counted(asked.select("node").distinct(), "forest-asked", parts(most))
    return materialise(_asked(texts, asked).select("doc_id", "text").mapInArrow(_sets(width), "node long, shingles array<long>"), "forest-sets", parts(n, 500))


def _verified(pairs: DataFrame, n: int, texts: DataFrame, width: int, num: int, den: int) -> tuple[DataFrame, int]:
    """The n pairs (a, b) with den * intersection >= num * union, on the full sets of only those nodes that are asked for."""
    if not n:
        return pairs, 0
    sets = _read_sets(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))), 2 * n, texts, width)
    left = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")).hint("merge"), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")).hint("merge"), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - F.col("shared")
    return counted(both.withColumn("shared", shared).where(F.col("shared").cast("long") * den >= union.cast("long") * num).select("a", "b"), "forest-links", parts(n, 2_000))


def components(links: DataFrame, name: str = "components", most: int | None = None) -> tuple[DataFrame, int]:
    """node, component (its smallest member) of every node that has a link, and about how many these are.

    A large-star and a small-star step at a time, each a grouped minimum and a join, until the edges are stars: no
    node has two edges upwards, and none that is pointed at points further. The steps keep what is connected, so the
    stars are the components. most: a bound on the number of links, if known.
    """
    edges, n = counted(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name, parts(most))
    while n:
        # Large star: each larger neighbour of a node goes to the smallest of the node and its neighbours.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: each smaller neighbour, and the node itself, goes to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges, n = counted(small.union(low.select("u", F.col("m").alias("v"))).distinct(), name, parts(2 * n))
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
        if not ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up + down > 1").agg(F.count("*").alias("n")).first().n:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), 2 * n


def _of(comps: DataFrame, c: str) -> DataFrame:
    return comps.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")).hint("merge")


def _across(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs (a, b) with the components ca, cb that they lie in, where these differ."""
    known = pairs.join(_of(comps, "a"), "a", "left").join(_of(comps, "b"), "b", "left")
    return known.withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")}).where("ca != cb")


def _merged(comps: DataFrame, size: int, links: DataFrame, n: int) -> tuple[DataFrame, int]:
    """Components after n more links: the links are drawn between components, whose own components follow."""
    if not n:
        return comps, size
    upper, more = components(_across(links, comps).select(F.col("ca").alias("a"), F.col("cb").alias("b")), "forest-upper", n)
    top = upper.select(F.col("node").alias("component"), F.col("component").alias("top"))
    joined = comps.join(top.hint("merge"), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    fresh = upper.join(comps.select("node").hint("merge"), "node", "left_anti").select("node", "component")
    return materialise(joined.union(fresh), "forest-comps", parts(size + more)), size + more


def _mixed(rows: DataFrame, key: str) -> DataFrame:
    """Rows of the regions at a key that hold several components, with the region's `key` and number of nodes `n`."""
    size = rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("key", "n")
    return rows.withColumn("key", F.col(key)).join(size.hint("merge"), "key")


def _placed(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """Rows with the component of their node; a node without links is its own."""
    return rows.join(comps.hint("merge"), "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")


#: Two nodes, and the part of their sketches that agrees.
_PAIRS = "a long, b long, alike double"


def _close(num: int, den: int, wide: int):
    """Regions as lists of nodes -> pairs across components that size and sketch do not rule out.

    A sketch agrees in a binomial number of its bytes; SLACK deviations below what the threshold gives lose about one
    pair in three million.
    """
    p = num / den + (1 - num / den) / 256
    least = wide * p - SLACK * math.sqrt(wide * p * (1 - p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0),)]
            for region in batch.column("g"):
                g = region.values
                node, comp, size = (g.field(c).to_numpy() for c in ("node", "comp", "size"))
                sketch = np.frombuffer(b"".join(g.field("sketch").to_pylist()), np.uint8).reshape(len(node), wide)
                x, y = np.nonzero((comp[:, None] != comp[None, :]) & (node[:, None] < node[None, :]) & (np.minimum(size[:, None], size[None, :]) * den >= np.maximum(size[:, None], size[None, :]) * num))
                alike = (sketch[x] == sketch[y]).sum(axis=1)
                x, y, alike = (v[alike >= least] for v in (x, y, alike))
                out.append((node[x], node[y], alike / wide))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in zip(*out, strict=True)], ["a", "b", "alike"])

    return run


def _pairs_across(rows: DataFrame, about: DataFrame, n: int, num: int, den: int, wide: int = SKETCH) -> DataFrame:
    """Pairs across components within regions, which are small. rows: key, node, comp, size; about: n nodes, sketch of `wide` bytes."""
    known = rows.join(about.select("node", "sketch").hint("merge"), "node")
    few = known.groupBy("key").agg(F.collect_list(F.struct("node", "comp", "size", "sketch")).alias("g"))
    return few.select("g").coalesce(parts(n, NODES)).mapInArrow(_close(num, den, wide), _PAIRS)


def _shared(left: list[np.ndarray], right: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """How many values each sorted set on the left has in common with each on the right."""
    flat = [np.concatenate(x) for x in (left, right)]
    row = [np.repeat(np.arange(len(x)), [len(v) for v in x]) for x in (left, right)]
    common = np.intersect1d(*flat)
    out = np.zeros((len(left), len(right)), np.int64)
    if not len(common):
        return out
    place = [np.minimum(np.searchsorted(common, x), len(common) - 1) for x in flat]
    known = [common[at] == x for at, x in zip(place, flat, strict=True)]
    for lo in range(0, len(common), columns):
        dense = []
        for n, r, at, ok in zip((len(left), len(right)), row, place, known, strict=True):
            ok = ok & (at >= lo) & (at < lo + columns)
            m = np.zeros((n, min(columns, len(common) - lo)), np.float32)
            m[r[ok], at[ok] - lo] = 1
            dense.append(m)
        out += (dense[0] @ dense[1].T).astype(np.int64)
    return out


def _links_between(num: int, den: int, tile: int = 256):
    """Two blocks of nodes with their full sets, or one block -> links across components, as many as join these."""

    def run(group: pa.Table) -> pa.Table:
        side, node, comp = (group.column(c).to_numpy() for c in ("side", "node", "comp"))
        lists = group.column("shingles").combine_chunks()
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        size, comp, out = np.diff(ends), np.unique(comp, return_inverse=True)[1], []
        parts = []
        for s in (0, 1):
            own = np.nonzero(side == s)[0]
            own = own[np.argsort(comp[own], kind="stable")]
            parts.append([own[lo : lo + tile] for lo in range(0, len(own), tile)])
        sets = lambda rows: [flat[ends[i] : ends[i + 1]] for i in rows]
        for k, x in enumerate(parts[0]):
            for y in parts[1] or parts[0][k:]:
                if (comp[x] == comp[x[0]]).all() and (comp[y] == comp[x[0]]).all():
                    continue
                shared = _shared(sets(x), sets(y))
                i, j = np.nonzero((shared * den >= (size[x][:, None] + size[y][None, :] - shared) * num) & (comp[x][:, None] != comp[y][None, :]))
                i, j = x[i], y[j]
                ends_of = np.sort(np.stack([comp[i], comp[j]], axis=1), axis=1)
                parent: dict[int, int] = {}

                def find(c: int) -> int:
                    while (up := parent.get(c, c)) != c:
                        parent[c] = parent.get(up, up)
                        c = up
                    return c

                for (c, d), at in zip(*(v.tolist() for v in np.unique(ends_of, axis=0, return_index=True)), strict=True):
                    c, d = find(c), find(d)
                    if c != d:
                        parent[max(c, d)] = min(c, d)
                        out.append(sorted((int(node[i[at]]), int(node[j[at]]))))
                if parent:
                    root = np.arange(comp.max() + 1)
                    for c in parent:
                        root[c] = find(c)
                    comp = root[comp]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


#: Nodes and shingles of a block, of which two are compared at once.
BLOCK, BLOCK_SHINGLES = 1024, 500_000


def _exact(rows: DataFrame, comps: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> tuple[DataFrame, int]:
    """Links that join all components with linked nodes in one region; rows: key, node, size of crowded regions.

    Regions with common nodes make a family. A family is dealt into blocks by set size, and every two blocks whose
    sizes allow a link are compared on full sets, but for those that lie wholly within one component.
    """
    here, n = counted(_mixed(_placed(rows, comps).withColumnRenamed("key", "region"), "region").select("key", "node", "size", "comp"), "forest-here")
    if not n:
        return here.select(F.col("node").alias("a"), F.col("node").alias("b")), 0
    least = here.groupBy("key").agg(F.min("node").alias("a"))
    family, _ = components(here.select("key", F.col("node").alias("b")).join(least.hint("merge"), "key").select("a", "b"), "forest-family", n)
    # Sets that may be linked are in one band or in neighbouring ones.
    band = F.floor(F.log("size") / F.lit(math.log(den / num) + 1e-4))
    known = family.withColumnRenamed("component", "family").join(here.select("node", "comp", "size").distinct().hint("merge"), "node").withColumn("band", band)
    known = materialise(known, "forest-bands", parts(n))
    large = known.groupBy("family", "band", "comp").count().where(F.col("count") >= BLOCK).select("family", "band", "comp", F.col("comp").alias("own"))
    known = known.join(large, ["family", "band", "comp"], "left")
    group = F.xxhash64("family", "band", F.coalesce("own", F.lit(0)), F.col("own").isNull())
    known = materialise(known.withColumn("group", group), "forest-owned", parts(n))
    shares = known.groupBy("group").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES)).alias("shares"))
    dealt = known.join(shares, "group").withColumn("block", F.xxhash64("group", F.pmod(F.xxhash64("node"), "shares")))
    dealt, n = counted(dealt.select("family", "band", "own", "block", "node", "comp"), "forest-dealt", parts(n))
    blocks = materialise(dealt.select("family", "band", "own", "block").distinct(), "forest-blocks", parts(n))
    x, y = blocks.alias("x"), blocks.alias("y")
    order = (F.col("y.band") == F.col("x.band") + 1) | (F.col("y.band") == F.col("x.band")) & (F.col("x.block") <= F.col("y.block"))
    both = x.join(y, (F.col("x.family") == F.col("y.family")) & order).where(~F.coalesce(F.col("x.own") == F.col("y.own"), F.lit(False)))
    both = materialise(both.select(F.col("x.block").alias("x"), F.col("y.block").alias("y")), "forest-meetings")
    meets = both.select("x", "y", F.col("x").alias("block"), F.lit(0).alias("side")).union(both.where("x != y").select("x", "y", F.col("y").alias("block"), F.lit(1).alias("side")))
    sets = _read_sets(dealt, n, texts, width)
    full = dealt.select("block", "node", "comp").join(sets.hint("merge"), "node").join(meets, "block")
    links = full.select("x", "y", "side", "node", "comp", "shingles").groupBy("x", "y").applyInArrow(_links_between(num, den), "a long, b long")
    return counted(links, "forest-links")


def _crowded(open_nodes: DataFrame, n: int, texts: DataFrame, width: int, num: int, den: int, trees: int, crowd: int) -> tuple[DataFrame, DataFrame]:
    """Candidates among the n nodes of crowded regions, by a forest of their own; key, node, size of what is crowded there too."""
    again = _asked(texts, open_nodes).select("doc_id", "text", "comp").coalesce(parts(n, 500)).mapInArrow(_describe(width, trees * DEEP, WIDE, 2, ("comp",)), f"{_DESCRIBED}, comp long")
    signed = materialise(again.where("set_key IS NOT NULL").select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("size"), "comp", "sig", "sketch"), "forest-signed")
    keys = signed.select("node", "size", "comp", "sig").mapInArrow(_prefixes(trees, DEEP, (DEEP,), ("node", "size", "comp")), f"node long, size long, comp long, k{DEEP} long")
    here = materialise(_mixed(materialise(keys, "forest-deep"), f"k{DEEP}").select("key", "n", "node", "size", "comp"), "forest-open", parts(n, 500))
    return _pairs_across(here.where(F.col("n") <= crowd), signed, n, num, den, WIDE), here.where(F.col("n") > crowd).select("key", "node", "size")


def _led(rows: DataFrame, key: str, num: int, den: int) -> DataFrame:
    """node, leader of its region at a key, where the sizes of both allow a link."""
    first = rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"), F.min("node").alias("leader"), F.min_by("size", "node").alias("of")).where("n > 1")
    led = rows.select("node", "size", F.col(key).alias("key")).join(first.drop("n").hint("merge"), "key").where("node != leader")
    return led.where(F.least("size", "of") * den >= F.greatest("size", "of") * num).select("node", "leader")


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", miss: float = 1e-6, crowd: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row; see the module for the method and edge cases."""
    trees = trees_for(num, den, miss)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    base, n_rows = counted(texts.mapInArrow(_describe(width, trees * DEPTH), _DESCRIBED), "forest-base")
    named = base.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    nodes = named.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("size"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch"))
    nodes, n = counted(nodes, "forest-nodes", parts(n_rows, 5000))
    # A doc_id may stand for several sets: their nodes belong together.
    several = named.groupBy("doc_id").agg(F.min("set_key").alias("a"), F.max("set_key").alias("z")).where("a != z").select("doc_id")
    several, found = counted(several, "forest-several", parts(n))
    known = [(nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0), 0)]
    if found:
        own = named.select("doc_id", "set_key").join(several, "doc_id").join(nodes.select("set_key", "node").hint("merge"), "set_key")
        first = own.groupBy("doc_id").agg(F.min("node").alias("a"))
        known = [counted(own.join(first.hint("merge"), "doc_id").select("a", F.col("node").alias("b")), "forest-repeated")]
    levels = f"node long, size long, k{DEPTH} long, k{DEEP} long"
    rows = materialise(nodes.select("node", "size", "sig").mapInArrow(_prefixes(trees, DEPTH, (DEPTH, DEEP), ("node", "size")), levels), "forest-rows")
    led = _led(rows, f"k{DEPTH}", num, den).union(_led(rows, f"k{DEEP}", num, den))
    led = led.groupBy("node", "leader").agg(F.count("*").alias("n")).groupBy("node")
    led = led.agg(F.min("leader").alias("first"), F.max_by("leader", F.struct("n", "leader")).alias("often"))
    tries = led.select(F.explode(F.array_distinct(F.array("first", "often"))).alias("a"), F.col("node").alias("b"))
    tries, n_tries = counted(tries, "forest-tries", parts(2 * n))
    known.append(_verified(tries, n_tries, texts, width, num, den))
    comps, size = components(known[0][0].union(known[1][0]), "components", known[0][1] + known[1][1])
    comps = materialise(comps, "forest-comps", parts(size))
    here = materialise(_mixed(_placed(rows.select("node", "size", f"k{DEPTH}"), comps), f"k{DEPTH}").select("key", "n", "node", "size", "comp"), "forest-open", parts(n, NODES))
    more = _pairs_across(here.where(F.col("n") <= crowd), nodes, n, num, den)
    crowds, n_crowds = counted(here.where(F.col("n") > crowd).select("node", "comp").distinct(), "forest-crowds", parts(n))
    left = None
    if n_crowds:
        pairs, left = _crowded(crowds, n_crowds, texts, width, num, den, trees_for(num, den, miss, DEEP), crowd)
        more = more.union(pairs)
    more = more.groupBy("a", "b").agg(F.max("alike").alias("alike")).join(tries.hint("merge"), ["a", "b"], "left_anti")
    more, n_more = counted(more, "forest-pairs", parts(n, NODES))
    best = [more.groupBy(c).agg(F.max_by(F.struct("a", "b"), F.struct("alike", "a", "b")).alias("p")).select("p.*") for c in "ab"]
    best, n_best = counted(best[0].union(best[1]).distinct(), "forest-best", parts(2 * n_more))
    comps, size = _merged(comps, size, *_verified(best, n_best, texts, width, num, den))
    rest = _across(more.join(best.hint("merge"), ["a", "b"], "left_anti"), comps).select("a", "b")
    last = [_verified(*counted(rest, "forest-rest", parts(n_more)), texts, width, num, den)]
    if left is not None:
        last.append(_exact(left, comps, texts, width, num, den))
    links, n_links = last[0][0].select("a", "b"), sum(x[1] for x in last)
    comps, size = _merged(comps, size, links.union(last[1][0]) if left is not None else links, n_links)
    classes = nodes.select("set_key", "node").join(comps.hint("merge"), "node", "left").select("set_key", F.coalesce("component", "node").alias("component"))
    out = base.select("doc_id", "n_shingles", "set_key").join(materialise(classes, "forest-class", parts(n, 10_000)).hint("merge"), "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
