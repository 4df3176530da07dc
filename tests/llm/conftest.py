from __future__ import annotations

import random

import pytest
from pyspark.sql import DataFrame

#: Names that operators use inside; tables may have columns of the same names.
CLASHES = "node string, comp int, key int, w int, h int, n int, ids int, v int, value string, rank int, score int, bucket int, at int, terms int, rule string"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(2, 8))) for _ in range(400)]


@pytest.fixture(scope="session")
def documents(spark, words):
    """Documents with nulls, empty and long texts, repeated rows and ids, and columns with clashing names."""

    def make(extra: list[tuple] = (), edges: bool = True, clash: bool = True) -> DataFrame:
        rows = list(extra)
        if edges:
            long = " ".join(words[i * 7 % 400] for i in range(30_000))
            rows += [(None, "a row without an id says so here"), (900, None), (901, ""), (902, " \n\t "), (903, "..., 12 34 !!"), (904, long), (905, "one two"), (905, "one two"), (906, "first text of this id"), (906, "second text of this id is another"), (907, None), (None, None)]
        full = [(i, t, "en", "s", None if t is None else len(t), *([None] * 15 if clash else [])) for i, t in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint" + (f", {CLASHES}" if clash else ""))

    return make


@pytest.fixture(scope="session")
def sample(spark):
    """The smallest folder of the given tables."""
    return "/root/testdata/sf0.001"
