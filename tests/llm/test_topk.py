from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.llm.blocktopk import search_tile, top_k, visits


def brute(rows, k=5):
    kept = [(i, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, (qi, qv) in enumerate(kept):
        if qi % 50:
            continue
        scored = sorted((-int(v[: len(qv)] @ qv[: len(v)]), i) for i, v in kept if i != qi)[:k]
        out |= {(qi, n, i, -s) for n, (s, i) in enumerate(scored, 1)}
        assert q >= 0
    return out


def run(df, **more):
    return {tuple(r) for r in top_k(df, F.col("vec_id") % 50 == 0, **more).collect()}


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.2, 16).astype(np.float32).tolist()) for i in range(700)]
    rows += [(700 + i, rows[3][1]) for i in range(120)]  # ties
    rows += [(900, None), (901, [None, *rows[0][1][1:]]), (950, [float("nan")] * 16), (951, [float("inf")] * 16), (952, []), (1000, [0.5] * 4), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"n": F.lit(1), "score": F.lit("x"), "d": F.lit(2)})
    expected = brute(rows)
    assert run(df, block=16, query_tile=1, doc_tile=3, summary_tile=7) == expected and run(df) == expected


def test_few_rows_and_empty_table(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (3, [-1.0])], "vec_id long, embedding array<float>")
    assert run(df) == {(0, 1, 1, 256 * 512), (0, 2, 3, -256 * 256)}
    assert run(df.where("false")) == set()


def test_blocks_are_pruned():
    rng = np.random.default_rng(0)
    blocks = []
    for b in range(20):  # blocks whose documents are alike
        m = np.rint(rng.normal(0, 100, 8) + rng.normal(0, 3, (32, 8))).astype(np.int64)
        blocks.append((np.arange(32) + 32 * b + 1000, m, m.max(axis=0), m.min(axis=0)))
    q = (np.array([1]), blocks[4][1][:1])
    found, pruned = search_tile([q], blocks, 5)
    scores = sorted(((-int(d @ q[1][0]), int(i)) for ids, m, _, _ in blocks for i, d in zip(ids, m, strict=True)))[:5]
    assert [(s, i) for _, i, s in found] == [(-s, i) for s, i in scores] and pruned >= 15


def test_forward_indexes_of_pruned_blocks_stay(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (40, 8))
    rows = [(i, (centres[i // 50] + rng.normal(0, 0.01, 8)).tolist()) for i in range(2000)]  # ids in order of likeness
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert run(df, block=50, query_tile=1, doc_tile=2, summary_tile=8) == brute(rows)
    every, left = visits(df, F.col("vec_id") % 50 == 0, block=50, query_tile=1, doc_tile=2, summary_tile=8)
    assert every == 40 * 40 and left < every / 4
