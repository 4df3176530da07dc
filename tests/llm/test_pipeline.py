from __future__ import annotations

import hashlib

import corpus_pipeline as pipeline
from pyspark.sql import functions as F
from test_containment import brute as held
from test_forest import brute as copies

from tessera.llm.pieces import decode_pieces
from tessera.llm.secrets import redact, scan


def test_stages_keep_columns_and_decide(spark, sample):
    docs, counts = pipeline.table(spark, sample, "documents"), []
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        docs = pipeline.materialise(stage(spark, docs, sample), name)
        counts.append(docs.count())
        assert docs.columns == columns or name == pipeline.STAGES[-1][0]
    assert counts[0] >= counts[1] >= counts[2] == counts[3] == counts[4] > 100
    assert docs.where("NOT lossless").count() == 0


def test_edges(spark, sample, documents):
    docs = documents([(1, "the plain words of one english text"), (1, "the plain words of one english text"), (2, "the plain words of one english text"), (3, "the token = abcdefgh12345 is in this one")])
    labelled = docs.union(pipeline.table(spark, sample, "documents").selectExpr("doc_id + 10000 AS doc_id", "text", "lang", "source", "n_chars", *["CAST(NULL AS STRING)" if t == "string" else "CAST(NULL AS INT)" for t in [f.dataType.simpleString() for f in docs.schema][5:]]))
    for name, stage in pipeline.STAGES[:-1]:
        labelled = pipeline.materialise(stage(spark, labelled, sample), name)
        assert labelled.columns == docs.columns
    got = {r.doc_id: r for r in labelled.where("doc_id < 10000 OR doc_id IS NULL").collect()}
    assert 900 not in got and 901 not in got and 903 not in got and 2 not in got and 1 in got
    assert "[SECRET]" in got[3].text and got[3].n_chars == len(got[3].text) and labelled.where("doc_id = 1").count() == 1 and None in got


def test_rows_without_ids_and_ids_that_repeat(spark, sample, documents):
    """Null ids escape no stage, and the order of rows does not matter."""
    item = pipeline.table(spark, sample, "benchmark").orderBy("item_id").first().text
    more = item + " " + " ".join(f"more{i}" for i in range(200))
    long = " ".join(f"word{i} of" for i in range(60))
    rows = [(None, item), (7, more), (None, long), (8, long), (8, long + " changed"), (9, "short one here"), (9, "another text of that id"), (None, "no id but a text of its own")]
    for order in (rows, rows[::-1]):
        df = documents(order, edges=False)
        kept = pipeline.materialise(pipeline.deduplicate(spark, df, sample), "kept")
        assert sorted(((r.doc_id or -1), r.text) for r in kept.collect()) == sorted([(-1, item), (7, more), (8, min(long, long + " changed", key=lambda t: hashlib.sha256(t.encode()).hexdigest())), (9, "short one here"), (9, "another text of that id"), (-1, "no id but a text of its own")])
        left = pipeline.decontaminate(spark, kept, sample)
        assert left.columns == df.columns and not any(item in r.text for r in left.collect()) and left.count() == kept.count() - 2


def test_stages_against_brute_force(spark, sample):
    """Near copies, leaks and masks of the given documents, each worked out plainly from the stage's own input."""
    docs = pipeline.materialise(pipeline.language(spark, pipeline.table(spark, sample, "documents"), sample), "language")
    before = {r.doc_id: r.text for r in docs.collect()}
    classes = copies(list(before.items()), 5, 80, 100)
    docs = pipeline.materialise(pipeline.deduplicate(spark, docs, sample), "deduplicate")
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert kept == {i: before[i] for i, (_, c) in classes.items() if c == i}
    items = [tuple(r) for r in pipeline.table(spark, sample, "benchmark").select("item_id", "text").collect()]
    leaks = {d for d, _ in held(list(kept.items()), items)}
    docs = pipeline.materialise(pipeline.decontaminate(spark, docs, sample), "decontaminate")
    clean = {r.doc_id: r.text for r in docs.collect()}
    assert clean == {i: t for i, t in kept.items() if i not in leaks} and leaks
    path = pipeline.public_tokenizers.path("word_bpe_49k.json")
    docs = pipeline.materialise(pipeline.secrets(spark, docs, sample), "secrets")
    masked = {r.doc_id: r.text for r in docs.collect()}
    assert masked == {i: redact(t, scan(t, path)) for i, t in clean.items()}
    model = pipeline.public_tokenizers.path("piece_bpe_32k.model")
    drawn = {r.doc_id: r.text for r in pipeline.encode(spark, docs, sample).select("doc_id", decode_pieces(F.col("ids"), model).alias("text")).collect()}
    assert drawn == masked


def test_empty_table(spark, sample, documents):
    docs = documents(edges=False, clash=False)
    for name, stage in pipeline.STAGES:
        docs = pipeline.materialise(stage(spark, docs, sample), name)
    assert docs.count() == 0
