"""Operator 9: exact top k by integer inner product, pruning blocks of documents.

Documents are blocks of `block` following ids. A block has a forward index (its documents' components) and, for
each term (component), its maximum and minimum over the block. For a query the sum over terms of the larger of
q * maximum and q * minimum bounds every score of the block. Blocks are visited in falling order of that bound;
once a bound is below the k-th score found so far, no later block can change the result. Equal bounds are
still scored, as a tie may go to a smaller id.

On Spark this takes three steps, of which only the last moves forward indexes in bulk:

1. Summaries (maxima and minima, no documents) meet the queries in tiles of `query_tile` by `summary_tile` blocks; each
   query keeps its `seeds` blocks of the highest bounds.
2. Those blocks score their queries. A query's k-th score there is its floor: no block with a bound below it can matter.
3. Summaries meet queries and floors again, and give the pairs of query block and block in which some query's bound reaches
   its floor. Forward indexes go to the tiles (`query_tile` by `doc_tile` blocks) in which they have such a pair, and are
   searched there block at a time from the floors on. `visits` reports how many pairs there were and how many were left.

Defined results: vectors that are null or hold null or non-finite components take no part; shorter vectors count as
ending in zeros; rows with a null id take no part; a query never meets rows of its own id; repeated ids are
rows of their own; scores wrap beyond 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import counted, materialise

_BLOCK = "block_no long, n int, dims int, ids binary, forward binary, top binary, low binary"


def _matrix(lists: list[list[int]]) -> np.ndarray:
    dims = max(map(len, lists), default=0)
    out = np.zeros((len(lists), dims), np.int64)
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def _pack(size: int):
    """Rows in id order -> blocks of `size` rows at most."""

    def flush(rows: list, number: int) -> pa.RecordBatch:
        ids, m = np.array([r[0] for r in rows], np.int64), _matrix([r[1] for r in rows])
        data = [ids, m, m.max(axis=0), m.min(axis=0)]
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([len(ids)], pa.int32()), pa.array([m.shape[1]], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in data]], ["block_no", "n", "dims", "ids", "forward", "top", "low"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append(row)
                if len(held) == size:
                    yield flush(held, number)
                    held, number = [], number + 1
        if held:
            yield flush(held, number)

    return run


def _score(q: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Inner products; by floating point where that is exact, which is faster."""
    dims = min(q.shape[1], docs.shape[1])
    q, docs = q[:, :dims], docs[:, :dims]
    if dims and np.abs(q).max(initial=0).astype(float) * np.abs(docs).max(initial=0).astype(float) * dims < 2**52:
        return (q.astype(float) @ docs.T.astype(float)).astype(np.int64)
    return q @ docs.T


def _bounds(q: np.ndarray, tops: list[np.ndarray], lows: list[np.ndarray]) -> np.ndarray:
    """No score of a query (row) in a block (column) is higher."""
    out = np.empty((len(q), len(tops)), np.int64)
    for j, (top, low) in enumerate(zip(tops, lows, strict=True)):
        part = q[:, : len(top)]
        out[:, j] = _score(np.maximum(part, 0), top[None, :])[:, 0] + _score(np.minimum(part, 0), low[None, :])[:, 0]
    return out


def search_tile(queries: list[tuple[np.ndarray, np.ndarray]], blocks: list[tuple[np.ndarray, ...]], k: int, floors: list[np.ndarray] | None = None) -> tuple[list[tuple[int, int, int]], int]:
    """(query id, id, score) of each query's best k in the blocks, and how many block visits were pruned.

    floors: for each query a score that k rows are known to reach; lower ones may be left out.
    """
    out, pruned = [], 0
    for n, (qids, q) in enumerate(queries):
        floor = floors[n] if floors else np.full(len(qids), np.iinfo(np.int64).min)
        bounds = _bounds(q, [b[2] for b in blocks], [b[3] for b in blocks])
        order = np.argsort(-bounds, axis=1, kind="stable")
        best: list[list[tuple[int, int]]] = [[] for _ in qids]
        open_ = np.arange(len(qids))
        for step in range(len(blocks)):  # all queries take their step-th block, those with one block together
            kth = np.array([max(-best[i][-1][0], floor[i]) if len(best[i]) == k else floor[i] for i in open_])
            going = bounds[open_, order[open_, step]] >= kth
            pruned += int((~going).sum()) * (len(blocks) - step)
            open_ = open_[going]
            if not len(open_):
                break
            target = order[open_, step]
            for j in np.unique(target):
                mine = open_[target == j]
                ids, docs = blocks[j][:2]
                scores = _score(q[mine], docs)
                for i, s in zip(mine, scores, strict=True):
                    ok = (ids != qids[i]) & (s >= floor[i])
                    if len(best[i]) == k:
                        ok &= s >= -best[i][-1][0]
                    keep = np.flatnonzero(ok)
                    if len(keep):
                        keep = keep[np.lexsort((ids[keep], -s[keep]))[:k]]
                        best[i] = sorted([*best[i], *zip((-s[keep]).tolist(), ids[keep].tolist(), strict=True)])[:k]
        out += [(int(qid), d, -s) for qid, b in zip(qids, best, strict=True) for s, d in b]
    return out, pruned


def _load(t: pa.Table) -> dict[int, tuple[np.ndarray, ...]]:
    """Blocks by number: ids, forward index, maxima, minima."""
    return {r["block_no"]: (np.frombuffer(r["ids"], np.int64), np.frombuffer(r["forward"], np.int64).reshape(r["n"], r["dims"]), np.frombuffer(r["top"], np.int64), np.frombuffer(r["low"], np.int64)) for r in t.sort_by("block_no").to_pylist()}


def _longs(names: str, rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [[] for _ in names.split()]
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names.split(), cols, strict=True)})


def _seed(count: int):
    """Of the blocks summarised here, each query's `count` of the highest bounds."""

    def run(summaries: pa.Table, queries: pa.Table) -> pa.Table:
        known = summaries.sort_by("block_no").to_pylist()
        tops, lows = ([np.frombuffer(r[c], np.int64) for r in known] for c in ("top", "low"))
        out = []
        for number, (qids, q, *_) in _load(queries).items():
            bounds = _bounds(q, tops, lows)
            for row, best in enumerate(np.argsort(-bounds, axis=1, kind="stable")[:, :count] if known else []):
                out += [(number, row, known[j]["block_no"], int(bounds[row, j])) for j in best]
        return _longs("query_block row block_no bound", out)

    return run


def _seeded(k: int):
    """Scores of one block for the queries that chose it: the best k of each."""

    def run(asked: pa.Table, docs: pa.Table) -> pa.Table:
        if not docs.num_rows or not asked.num_rows:
            return _longs("query_block row score", [])
        ids, m, *_ = next(iter(_load(docs).values()))
        vectors = asked["terms"].to_pylist()
        scores = _score(_matrix(vectors), m)
        out = []
        for number, row, qid, got in zip(*(asked[c].to_pylist() for c in ("query_block", "row", "query_id")), scores, strict=True):
            out += [(number, row, s) for s in np.sort(got[ids != qid])[::-1][:k].tolist()]
        return _longs("query_block row score", out)

    return run


def _surviving(summaries: pa.Table, queries: pa.Table) -> pa.Table:
    """Pairs of query block and block in which some query's bound reaches its floor, and for how many queries."""
    known = summaries.sort_by("block_no").to_pylist()
    tops, lows = ([np.frombuffer(r[c], np.int64) for r in known] for c in ("top", "low"))
    floors = dict(zip(queries["block_no"].to_pylist(), queries["floors"].to_pylist(), strict=True))
    out = []
    for number, (_, q, *_) in _load(queries).items():
        n = (_bounds(q, tops, lows) >= np.array(floors[number], np.int64)[:, None]).sum(axis=0)
        out += [(number, known[j]["block_no"], int(n[j]), len(q)) for j in np.flatnonzero(n)]
    return _longs("query_block block_no left queries", out)


def _tile(k: int):
    def run(blocks: pa.Table, queries: pa.Table) -> pa.Table:
        asked = _load(queries)
        floors = dict(zip(queries["block_no"].to_pylist(), queries["floors"].to_pylist(), strict=True))
        found, _ = search_tile([x[:2] for x in asked.values()], list(_load(blocks).values()), k, [np.array(floors[n], np.int64) for n in asked])
        return _longs("query_id vec_id score", found)

    return run


def _search(vectors: DataFrame, is_query: Column, k: int, id_col: str, vector_col: str, scale: int, block: int, query_tile: int, doc_tile: int, summary_tile: int, seeds: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Blocks of documents, blocks of queries, the pairs of them that are left, and what these give."""
    whole = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & whole).select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("terms"))
    ordered = lambda t: t.repartitionByRange("vec_id").sortWithinPartitions("vec_id", "terms").mapInArrow(_pack(block), _BLOCK)
    (docs, n_blocks), (asked, n_asked) = counted(ordered(rows), "topk-blocks"), counted(ordered(rows.where(is_query)), "topk-queries")
    n_asked, n_docs, n_sums = (-(-n // size) or 1 for n, size in ((n_asked, query_tile), (n_blocks, doc_tile), (n_blocks, summary_tile)))
    at = lambda n, c="block_no": F.pmod(F.xxhash64(c), F.lit(n))
    grid = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    met = lambda left, right: left.groupBy("d", "q").cogroup(right.groupBy("d", "q"))
    # Summaries meet queries in a grid of n_sums x n_asked groups.
    summaries = docs.select("block_no", "top", "low", at(n_sums).alias("d")).withColumn("q", grid(n_asked))
    dealt = lambda t: t.withColumn("q", at(n_asked)).withColumn("d", grid(n_sums))
    chosen = met(summaries, dealt(asked)).applyInArrow(_seed(seeds), "query_block long, row long, block_no long, bound long")
    each = Window.partitionBy("query_block", "row").orderBy(F.desc("bound"), "block_no")
    chosen = materialise(chosen.withColumn("nth", F.row_number().over(each)).where(F.col("nth") <= seeds).select("query_block", "row", "block_no"), "topk-seeds")
    # A block that many queries choose is scored in as many shares as they fill.
    shares = chosen.groupBy("block_no").agg(F.ceil(F.count("*") / (block * query_tile)).alias("shares"))
    texts = asked.select(F.col("block_no").alias("query_block"), "n", "dims", "ids", "forward").mapInArrow(_unpack, "query_block long, row long, query_id long, terms array<long>")
    asking = chosen.join(texts, ["query_block", "row"]).join(shares, "block_no").withColumn("share", F.pmod(F.xxhash64("query_block", "row"), "shares"))
    split = shares.select(F.col("block_no").alias("seed"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("of"))
    scored = asking.groupBy("block_no", "share").cogroup(docs.join(split, F.col("block_no") == F.col("seed")).drop("seed").groupBy("block_no", "of")).applyInArrow(_seeded(k), "query_block long, row long, score long")
    # The k-th of what the seeds gave; a query with fewer than k scores has no floor.
    kth = scored.withColumn("nth", F.row_number().over(Window.partitionBy("query_block", "row").orderBy(F.desc("score")))).where(F.col("nth") == k)
    known = kth.groupBy("query_block").agg(F.map_from_entries(F.collect_list(F.struct("row", "score"))).alias("known"))  # a block of queries each
    none = F.lit(np.iinfo(np.int64).min)
    floors = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1), lambda i: F.coalesce(F.try_element_at("known", i), none))
    floored = materialise(asked.join(known, F.col("block_no") == F.col("query_block"), "left").withColumn("floors", floors).drop("known", "query_block"), "topk-floors")
    pairs = materialise(met(summaries, dealt(floored)).applyInArrow(_surviving, "query_block long, block_no long, left long, queries long"), "topk-pairs")
    # Each block goes to the tiles of queries in which it has a pair, and each block of queries to the tiles of blocks.
    tiles = lambda side: pairs.select(F.col(side).alias("block_no"), at(n_docs).alias("d"), at(n_asked, "query_block").alias("q")).distinct()
    left, right = docs.join(tiles("block_no"), "block_no"), floored.join(tiles("query_block"), "block_no")
    return docs, asked, pairs, met(left, right).applyInArrow(_tile(k), "query_id long, vec_id long, score long")


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of queries -> a row for each."""
    for batch in batches:
        for r in batch.to_pylist():
            m = np.frombuffer(r["forward"], np.int64).reshape(r["n"], r["dims"])
            offsets = pa.array(np.arange(r["n"] + 1) * r["dims"], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r["query_block"]] * r["n"], pa.int64()), pa.array(np.arange(r["n"])), pa.array(np.frombuffer(r["ids"], np.int64)), pa.ListArray.from_arrays(offsets, pa.array(m.ravel()))], ["query_block", "row", "query_id", "terms"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, block: int = 256, query_tile: int = 4, doc_tile: int = 16, summary_tile: int = 512, seeds: int = 2) -> DataFrame:
    """query_id, rank, vec_id, score. is_query: a condition on a column `vec_id`.

    query_tile, doc_tile and summary_tile count blocks of queries, of documents and of summaries that meet in one group.
    """
    *_, found = _search(vectors, is_query, k, id_col, vector_col, scale, block, query_tile, doc_tile, summary_tile, seeds)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def visits(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, block: int = 256, query_tile: int = 4, doc_tile: int = 16, summary_tile: int = 512, seeds: int = 2) -> tuple[int, int]:
    """Pairs of query and block that there are, and those left after pruning by the floors."""
    docs, asked, pairs, _ = _search(vectors, is_query, k, id_col, vector_col, scale, block, query_tile, doc_tile, summary_tile, seeds)
    n = asked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    return n * docs.count(), pairs.agg(F.coalesce(F.sum("left"), F.lit(0)).alias("n")).first().n
