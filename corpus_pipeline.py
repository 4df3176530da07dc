"""The corpus pipeline: language, near duplicates, benchmark leaks, secrets, then token ids.

Each stage takes all that its predecessor kept, as (spark, docs, sf_dir), and its result is written and read again.
All stages but the last return the columns of documents, whichever those are. Each row is a document: rows that
share a doc_id, or have none, are judged each for itself.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialise, small_batches, table
from tessera.llm.containment import find_items
from tessera.llm.forest import near_duplicates
from tessera.llm.langid import predict, train
from tessera.llm.pieces import with_pieces
from tessera.llm.secrets import mask_secrets

#: A text whose language is less sure than this is rejected, as is one without letters.
LEAST_SURE = 0.5
#: The name of the rows' own id while a stage works.
ROW = "__row_id"


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents with a row id: doc_id where it tells all rows apart, else a number in a table written for it."""
    seen = docs.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids")).first()
    if seen.n == seen.ids:
        return docs.withColumn(ROW, F.col("doc_id").cast("long"))
    return materialise(docs.withColumn(ROW, F.monotonically_increasing_id()), "pipeline-keyed")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; empty texts, null texts and those without letters go."""
    small_batches(spark)
    model = train(docs, public_tokenizers.path("piece_bpe_32k.model"))
    judged = docs.withColumn("__language", predict(model, F.col("text")))
    return judged.where((F.col("__language.lang") != "und") & (F.col("__language.score") >= LEAST_SURE)).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, five-word shingles and a similarity of 0.8.

    The one with the smallest doc_id stays, of equal ones the one with the smallest digest, whatever the order of the
    rows; a row without a doc_id stays only where no other does. Texts without words are no copies of each other.
    """
    small_batches(spark)
    keyed = _keyed(docs)
    found = near_duplicates(keyed, id_col=ROW).select(F.col("doc_id").alias("__id"), F.col("component_id").alias("__component"))
    names = [c for c in docs.columns if c not in ("doc_id", "text")]
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.xxhash64(*[F.col(f"`{c}`") for c in names], F.lit(0)).alias("rest"), F.col(ROW).alias("row"))
    asked = keyed.select(ROW, first.alias("first"))
    kept = asked.join(found.hint("merge"), F.col(ROW) == F.col("__id")).groupBy("__component").agg(F.min("first").alias("first")).select(F.col("first.row").alias("__kept"))
    return keyed.join(kept.hint("merge"), F.col(ROW) == F.col("__kept"), "left_semi").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; every distinct text of an item counts, whatever its id."""
    keyed = _keyed(docs)
    items = table(spark, sf_dir, "benchmark").select(F.xxhash64("text").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    found = find_items(keyed, items, doc_col=ROW).select(F.col("doc_id").alias("__found")).distinct()
    return keyed.join(found, F.col(ROW) == F.col("__found"), "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked; n_chars follows the text."""
    small_batches(spark)
    masked = docs.withColumn("text", mask_secrets(F.col("text"), public_tokenizers.path("word_bpe_49k.json")))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else masked


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source (where there are such), each document's sampled piece ids, whether these decode to its text,
    and their number. Other columns, the text among them, end here."""
    small_batches(spark)
    known = docs.select("doc_id", *[c for c in ("lang", "source") if c in docs.columns], "text")
    drawn = with_pieces(known, public_tokenizers.path("piece_bpe_32k.model"))
    return drawn.drop("text").withColumn("n_pieces", F.size("ids"))


STAGES = [("language", language), ("deduplicate", deduplicate), ("decontaminate", decontaminate), ("secrets", secrets), ("encode", encode)]

#: No stage but the third can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
