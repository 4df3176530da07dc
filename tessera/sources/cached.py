"""Row policies decided in code: each row once per scope and version, remembered as a table of decisions.

The decision is a function of pandas frames, run where the rows are. What is remembered is one (key, version,
allowed) row per decided row; a new or newer row is decided when it is met. Rows are kept by a join to the
decisions, which Spark broadcasts or shuffles by their size.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.catalog import Context, Policy


class CachedPolicy:
    """decide: a frame of rows and the context -> a boolean series. scope: what of the context decisions depend on."""

    def __init__(self, name: str, key: str, version: str, folder: str, decide: Callable[[pd.DataFrame, Context], pd.Series], scope: Callable[[Context], Any], most: int = 16) -> None:
        self.name, self.key, self.version, self.folder, self.decide, self.scope = name, key, version, folder, decide, scope
        self.generation, self.most = 0, most
        self.parts: dict[str, list[str]] = {}

    def invalidate(self) -> None:
        """Forgets every decision."""
        self.generation += 1
        self.parts.clear()

    def _undecided(self, df: DataFrame, known: DataFrame | None) -> DataFrame:
        if known is None:
            return df
        latest = known.groupBy(F.col("k").alias("__k")).agg(F.max("v").alias("__v"))
        joined = df.join(latest, df[self.key] == F.col("__k"), "left")
        return joined.where(F.col("__k").isNull() | (F.col(self.version) > F.col("__v"))).select(*df.columns)

    def apply(self, df: DataFrame, ctx: Context) -> DataFrame:
        place = hashlib.sha256(json.dumps([self.generation, self.scope(ctx)], default=str).encode()).hexdigest()[:16]
        parts = self.parts.setdefault(place, [])
        spark = df.sparkSession
        kinds = dict(df.dtypes)
        schema = f"k {kinds[self.key]}, v {kinds[self.version]}, allowed boolean"
        known = spark.read.schema(schema).parquet(*parts) if parts else None
        todo = self._undecided(df, known)
        decide, key, version = self.decide, self.key, self.version

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in frames:
                yield pd.DataFrame({"k": rows[key], "v": rows[version], "allowed": decide(rows, ctx).astype(bool)})

        # A row without a key cannot be remembered, and so is not allowed.
        todo = todo.where(F.col(self.key).isNotNull())
        if not todo.isEmpty():
            path = f"{self.folder}/{self.name}-{place}-{uuid.uuid4().hex}"
            todo.mapInPandas(run, schema).write.parquet(path)
            parts.append(path)
            if len(parts) > self.most:  # the newest decision of each key, in one table again
                path = f"{self.folder}/{self.name}-{place}-{uuid.uuid4().hex}"
                spark.read.schema(schema).parquet(*parts).groupBy("k").agg(F.max(F.struct("v", "allowed")).alias("x")).select("k", "x.v", "x.allowed").write.parquet(path)
                parts[:] = [path]
        if not parts:
            return df.limit(0)
        decisions = spark.read.schema(schema).parquet(*parts)
        newest = decisions.groupBy("k").agg(F.max_by("allowed", "v").alias("allowed")).where("allowed").select(F.col("k").alias("__k"))
        return df.join(newest, df[self.key] == F.col("__k"), "left_semi")

    def policy(self) -> Policy:
        return Policy(self.name, narrow=self.apply)
