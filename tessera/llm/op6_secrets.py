"""op6_secrets: secrets in every document."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.llm.secrets import find_secrets

RESULT = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", find_secrets(F.col("text"), public_tokenizers.path("word_bpe_49k.json")).alias("s"))
    return found.select("doc_id", *[f"s.{c}" for c in RESULT])


QUERIES = {"op6_secrets": op6_secrets}
ORACLES: dict[str, str] = {}
