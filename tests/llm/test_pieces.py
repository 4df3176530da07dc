from __future__ import annotations

import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers

from tessera.llm.lattice import Pieces, backward, build, forward
from tessera.llm.pieces import Decoder, Sampler, decode_pieces, with_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["Hello  world\nfoo", "  a  ▁b\n\n", "\U0001f600x\t y", "▁", " ", "\n", " x", "x\x00y", "\x00 \x01  ", "日本語 text", "", "a" * 3000, None]


def test_forward_sums_all_segmentations():
    pieces = Pieces.shared(PATH)
    known = set(pieces.text)
    strings = ["▁hello", "▁été", "日x", "ab"]
    lattice = build(strings, pieces)
    weight = np.where(lattice.piece >= 0, -1.0, -5.0)
    alpha, beta = forward(lattice, weight), backward(lattice, weight)
    for k, s in enumerate(strings):
        total = 0.0
        for cuts in itertools.product([0, 1], repeat=len(s) - 1):
            parts, last = [], 0
            for i, c in enumerate([*cuts, 1], 1):
                if c:
                    parts.append(s[last:i])
                    last = i
            if all(p in known or len(p) == 1 for p in parts):
                total += np.exp(sum(-1.0 if p in known else -5.0 for p in parts))
        assert np.isclose(alpha[lattice.base[k] + len(s)], np.log(total)) and np.isclose(beta[lattice.base[k]], np.log(total))


def test_samples_follow_the_lattice():
    sampler = Sampler(PATH, 1.0)
    ids, counts = sampler.encode(np.arange(20_000), pa.array(["hello"] * 20_000), 0)
    seen = Counter(tuple(x.tolist()) for x in np.split(ids, np.cumsum(counts)[:-1]))
    weight = dict(zip(sampler.pieces.ids.tolist(), sampler.logw, strict=True))
    mass = {k: np.exp(sum(weight[i] for i in k)) for k in seen}
    for k, n in seen.most_common(3):
        assert abs(n / 20_000 - mass[k] / sum(mass.values())) < 0.015


def test_lossless_reproducible_and_keyed(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0]), (None, "abc def")], "doc_id long, text string")
    a = with_pieces(df.repartition(3), PATH).collect()
    b = with_pieces(df.coalesce(1), PATH).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")
    assert sorted(a, key=key) == sorted(b, key=key)
    assert all(r.lossless or r.text is None for r in a) and all((r.ids is None) == (r.text is None) for r in a) and [r.ids for r in a if r.text == ""] == [[]]
    same = with_pieces(spark.createDataFrame([(i, "a longer sentence of several words") for i in range(50)], "doc_id long, text string"), PATH)
    assert len({tuple(r.ids) for r in same.collect()}) > 5
    back = with_pieces(df, PATH).select("text", decode_pieces("ids", PATH).alias("back")).collect()
    assert all(r.text == r.back for r in back)
    assert Decoder.shared(PATH).decode([]) == ""


def test_extra_columns_and_empty_tables(documents):
    got = with_pieces(documents().drop("ids"), PATH)
    assert got.count() == 12 and got.where("text IS NOT NULL AND NOT lossless").count() == 0 and "rule" in got.columns
    assert with_pieces(documents(edges=False, clash=False), PATH).count() == 0
