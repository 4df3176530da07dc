"""Helpers shared by the operators: table reads, shared scratch tables and per-worker word tables."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: Rows of an Arrow batch: texts may be long, and a batch is held by Spark and by the Python worker.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Holds the session's Arrow batches to so many rows, unless they are smaller."""
    if not 0 < int(spark.conf.get(BATCH)) <= rows:
        spark.conf.set(BATCH, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the session's spark.checkpoint.dir, which executors share. Where it is unset, a local session gets
    one of this machine; elsewhere that would lose tables without a word, so it fails."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        root = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"


def parts(rows: int | None, each: int = 50_000) -> int | None:
    """Into how many files a table of at most so many rows goes; None leaves it to Spark."""
    return None if rows is None else max(1, -(-rows // each))


def materialise(df: DataFrame, name: str, into: int | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back: later jobs neither recompute it nor lose it.

    into: at most so many files, so that a small table is not many tasks for each job that reads it.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    (df.coalesce(into) if into else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str, into: int | None = None) -> tuple[DataFrame, int]:
    """As `materialise`, and how many rows it wrote, observed on the way."""
    seen = Observation()
    out = materialise((df.coalesce(into) if into else df).observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, seen.get["n"]


class Slots(dict):
    """Gives each new key the next integer; `new` lists the keys that no one has worked out yet."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list = []

    def __missing__(self, key):
        slot = self[key] = len(self)
        self.new.append(key)
        return slot


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on unsigned 64-bit arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words between ASCII white space: a code for each word, offsets by text, and the words behind the codes.

    Texts may be null (no words); one of the words behind the codes may be empty. lower: A-Z only.
    """
    texts = texts.fill_null("")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    first, offsets = lists.offsets[0].as_py(), lists.offsets.to_numpy()
    coded = lists.flatten().dictionary_encode()
    return coded.indices.to_numpy(), offsets - first, coded.dictionary.to_numpy(zero_copy_only=False).tolist()


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs [start, start + length) one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[a:b] for following offsets a, b; 0 for empty runs."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    return total[offsets[1:]] - total[offsets[:-1]]
