"""op1_dac: every document's token ids, written in directly addressable codes and read back."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import scratch, table
from tessera.llm.dac import read_token_file, write_token_file


def op1_dac(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "op1")
    write_token_file(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_file(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32", "part", "seq", "middle_id")


QUERIES = {"op1_dac": op1_dac}
ORACLES: dict[str, str] = {}
