from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.llm.langid import OTHER, is_held_out, letters, predict, train
from tessera.llm.lattice import Pieces
from tessera.llm.op5_langid import op5_langid

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_held_out_accuracy(spark, sample):
    got = op5_langid(spark, sample).join(table(spark, sample, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 200 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97 and all(0 <= r.score <= 1 for r in got)


@pytest.fixture(scope="module")
def model(spark, sample):
    return train(table(spark, sample, "documents"), PATH, per_lang=50, rounds=1)


def test_edges(spark, documents, model):
    rows = {(r.doc_id, r.text): r.p for r in documents().select("doc_id", "text", predict(model, F.col("text")).alias("p")).collect()}
    for key, p in rows.items():
        und = key[1] is None or not any(c.isalpha() for c in key[1])
        assert (p.lang == "und" and p.score == 0) == und
    assert documents(edges=False).select(predict(model, F.col("text"))).count() == 0


def test_nothing_to_learn_from(spark, documents):
    none = train(documents().where("false"), PATH)
    assert {r.p.lang for r in documents().select(predict(none, F.col("text")).alias("p")).collect()} == {"und"}
    assert spark.range(1).select(F.lit(None).cast("long").alias("doc_id")).where(is_held_out()).count() == 0


def test_numbers_are_no_letters(spark, sample):
    model = train(table(spark, sample, "documents"), PATH)
    texts = ["½", "12²", "① Ⅷ", "__", "a½b", "les mots français"]
    got = [tuple(r.p) for r in spark.createDataFrame([(t,) for t in texts], "text string").select(predict(model, F.col("text")).alias("p")).collect()]
    assert got[:4] == [("und", 0.0)] * 4 and all(lang != "und" for lang, _ in got[4:]) and letters("A½b² ǅx") == ["a", "b", "ǆx"]


def every(word, model, k):
    """A word's probability in a language: the sum over all its segmentations, each written out."""
    pieces = Pieces.shared(PATH, True)
    rank = {t: i for i, t in enumerate(pieces.text)}
    text, total, todo = "▁" + word, 0.0, [(0, 0.0)]
    while todo:
        at, logp = todo.pop()
        if at == len(text):
            total += np.exp(logp)
            continue
        found = [(j, model.logp[rank[text[at:j]], k]) for j in range(at + 1, len(text) + 1) if text[at:j] in rank]
        todo += [(j, logp + x) for j, x in (found if any(j == at + 1 for j, _ in found) else [*found, (at + 1, OTHER)])]
    return np.log(total)


def test_scores_against_every_segmentation(spark, sample):
    model = train(table(spark, sample, "documents"), PATH)
    words = ["the", "maison", "straße", "niño", "q", "zzxqj", "日本", "unknowable"]
    got = model.words(words)
    for i, w in enumerate(words):
        for k in range(len(model.langs)):
            assert abs(got[i, k] - every(w, model, k)) < 1e-9, w
