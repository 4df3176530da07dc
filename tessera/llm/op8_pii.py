"""op8_pii: personal data in every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.llm.pii import find_pii

RESULT = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", find_pii(F.col("text")).alias("s")).select("doc_id", *[f"s.{c}" for c in RESULT])


QUERIES = {"op8_pii": op8_pii}
ORACLES: dict[str, str] = {}
