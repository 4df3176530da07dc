"""op2_pieces: a sampled segmentation of every document and whether it decodes to the text."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.llm.pieces import with_pieces


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    drawn = with_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return drawn.select("doc_id", F.size("ids").alias("n_pieces"), "ids", "lossless")


QUERIES = {"op2_pieces": op2_pieces}
ORACLES: dict[str, str] = {}
