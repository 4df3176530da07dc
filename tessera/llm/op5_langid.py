"""op5_langid: the language of every document, learnt from three quarters of the labelled ones."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.llm.langid import is_held_out, predict, train


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~is_held_out()), public_tokenizers.path("piece_bpe_32k.model"))
    judged = docs.select("doc_id", is_held_out().alias("held_out"), predict(model, F.col("text")).alias("p"))
    return judged.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


QUERIES = {"op5_langid": op5_langid}
ORACLES: dict[str, str] = {}
