from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.dac import Segment, pack, read_token_file, token_at, tokens_at, write_token_file
from tessera.llm.wordbpe import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=40), max_size=8), st.sampled_from([(8, 8, 16), (4, 4, 8, 16), (5, 11, 16), (16, 16)]))
def test_random_access_equals_what_was_packed(docs, widths):
    flat = np.array([x for d in docs for x in d], np.uint32)
    s = Segment(pack([None if i == 1 else i for i in range(len(docs))], np.array([len(d) for d in docs], np.int64), flat, widths))
    assert s.ids().tolist() == flat.tolist() and [s.token(i) for i in range(len(flat))] == flat.tolist()
    assert [s.document(k) for k in range(len(docs))] == docs and s.doc_ids == [None if i == 1 else i for i in range(len(docs))]


def test_rank_directories_over_many_strides():
    ids = np.random.default_rng(1).integers(0, 70_000, 5000).astype(np.uint32)
    s = Segment(pack([7], np.array([5000]), ids))
    assert all(s.token(i) == ids[i] for i in range(0, 5000, 13))
    with pytest.raises(IndexError):
        s.token(5000)


TEXTS = ["It's HE'LL l'été don't 12a ²½", "x\x1cq \x85y  z", "H̱T̈ İstanbul ΑΣ 北京大学", "a <|endoftext|> b", "", "  ", "'S 's's a's!! B's", "é" * 300, "A" + "b" * 5000, "tab\tnew\nline\r\x0b\x0c", "ǅ Ŀ ŉ ß ​﻿"]


def test_words_encode_as_the_whole_text():
    encoder, whole = WordEncoder(PATH, True), Tokenizer.from_file(PATH)
    for texts in (TEXTS, [t for t in TEXTS if "<|" not in t]):
        ids, sizes = encoder.encode(pa.array([*texts, None]))
        expected = [whole.encode(t, add_special_tokens=False).ids for t in texts] + [[]]
        assert np.split(ids, np.cumsum(sizes)[:-1].tolist())[: len(texts)] and [len(e) for e in expected] == sizes.tolist()
        assert ids.tolist() == [x for e in expected for x in e]


def test_file_round_trip(spark, documents, tmp_path):
    docs = documents([(i, t) for i, t in enumerate(TEXTS)])
    write_token_file(docs, str(tmp_path / "f"), PATH, segment_tokens=500, partitions=3)
    got = read_token_file(spark, str(tmp_path / "f")).orderBy("start").collect()
    whole = Tokenizer.from_file(PATH)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    start = 0
    assert len(got) == len(rows)
    for r, (doc_id, text) in zip(got, rows, strict=True):
        ids = [*whole.encode(text, add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert r.middle_id == ids[len(ids) // 2]
        start += len(ids)


def test_tokens_are_found_in_the_file(spark, documents, tmp_path, monkeypatch):
    monkeypatch.setattr("tessera.llm.dac.LOOKUPS", 7)
    path = str(tmp_path / "f")
    docs = documents([(i, t) for i, t in enumerate(TEXTS)])
    write_token_file(docs, path, PATH, segment_tokens=50, partitions=3)
    whole = Tokenizer.from_file(PATH)
    by_id: dict = {}
    for r in docs.collect():
        by_id.setdefault(r.doc_id, []).append([*whole.encode(r.text or "", add_special_tokens=False).ids, 1])
    asked = [(d, i) for d, each in by_id.items() for i in range(-1, max(map(len, each)) + 1, 3)] + [(0, 0)] * 40 + [(None, 0), (0, None), (10**9, 0)]
    got = tokens_at(spark, path, spark.createDataFrame(asked, "doc_id long, position long").withColumn("data", F.lit(1))).collect()
    expected = [(d, i, ids[i]) for d, i in set(asked) if d is not None and i is not None for ids in by_id.get(d, []) if 0 <= i < len(ids)]
    assert sorted(map(tuple, got)) == sorted(expected)
    one = next(d for d, each in by_id.items() if d is not None and len(each) == 1 and len(each[0]) > 3)
    assert token_at(spark, path, one, 2) == by_id[one][0][2]
    with pytest.raises(IndexError):
        token_at(spark, path, one, len(by_id[one][0]))
    for f in (tmp_path / "f").glob("*.parquet"):
        meta = pq.read_metadata(f)
        assert all(meta.row_group(g).num_rows == 1 for g in range(meta.num_row_groups))
        assert not meta.num_row_groups or meta.row_group(0).column(meta.num_columns - 1).compression == "UNCOMPRESSED"


def test_empty_table(spark, documents, tmp_path):
    write_token_file(documents(edges=False), str(tmp_path / "f"), PATH)
    assert read_token_file(spark, str(tmp_path / "f")).count() == 0
