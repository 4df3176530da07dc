"""The disclosure audit: what each caller was sent, as tables.

`answers` has a row for each chunk of an answer (who, when, how, of which source, by which request), chained by digests;
`units` a row for each row sent (answer, chunk, source, key, shape, content address); `content` each distinct row, by
the SHA-256 of its canonical JSON; `shapes` the members of each kind of row; `reviews` and `erasures` what was asked and
removed. A chunk is written before its rows leave. The questions are joins over these tables, and so is the check
of the chain, whose groups are no larger than a chunk.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.catalog import Catalog

ANSWERS = "seq long, answer string, chunk int, kind string, caller string, at timestamp_ntz, source string, request string, rows int, units string, previous string, digest string"
UNITS = "answer string, chunk int, ordinal int, source string, key string, shape string, address string"
CONTENT = "address string, body string"
SHAPES = "shape string, source string, member string, sensitive boolean"
REVIEWS = "id string, at timestamp_ntz, reviewer string, question string, parameters string"
ERASURES = "at timestamp_ntz, `by` string, address string"
GENERATIONS = "n long, folder string"
TABLES = {"answers": ANSWERS, "units": UNITS, "shapes": SHAPES, "reviews": REVIEWS, "erasures": ERASURES, "generations": GENERATIONS}

#: What a chunk's digest covers, in this order, joined by line feeds; `at` as microseconds.
CHAINED = ("previous", "seq", "answer", "chunk", "kind", "caller", "at", "source", "request", "rows", "units")
UNIT = ("ordinal", "source", "key", "shape", "address")


def canonical(row: object) -> str:
    return json.dumps(row, sort_keys=True, default=str, ensure_ascii=False, separators=(",", ":"))


def digest(parts: Iterable[object]) -> str:
    return hashlib.sha256("\n".join("-" if p is None else str(p) for p in parts).encode()).hexdigest()


def _digest(*columns: str) -> F.Column:
    """As `digest`, of columns."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]), 256)


def _now() -> dt.datetime:
    return dt.datetime.now(dt.UTC).replace(tzinfo=None)


class Audit:
    """One writer for a folder; `chunk` bounds the rows that wait for their record."""

    def __init__(self, spark: SparkSession, folder: str, catalog: Catalog, chunk: int = 1000) -> None:
        self.spark, self.folder, self.catalog, self.chunk = spark, folder.rstrip("/"), catalog, chunk
        self._head: tuple[int, str] | None = None

    # Writing

    def head(self) -> tuple[int, str]:
        """The chain's length and last digest; read from the tables by a new writer."""
        if self._head is None:
            last = self._read("answers").agg(F.max(F.struct("seq", "digest")).alias("x")).first().x
            self._head = (last.seq + 1, last.digest) if last else (0, "")
        return self._head

    def recorded(self, request: dict, ctx: dict, kind: str, rows: Iterable[dict]) -> Iterator[dict]:
        """The rows again, each after its chunk has been written; what cannot be written is not sent."""
        name, held, chunk = uuid.uuid4().hex, [], 0
        for row in rows:
            held.append(row)
            if len(held) == self.chunk:
                self._write(name, chunk, request, ctx, kind, held)
                yield from held
                held, chunk = [], chunk + 1
        if held or not chunk:
            self._write(name, chunk, request, ctx, kind, held)
            yield from held

    def record(self, request: dict, ctx: dict, kind: str, rows: list[dict]) -> None:
        for _ in self.recorded(request, ctx, kind, rows):
            pass

    def _write(self, name: str, chunk: int, request: dict, ctx: dict, kind: str, rows: list[dict]) -> None:
        seq, previous = self.head()
        source, at = self.catalog[request["root"]], _now()
        bodies = [canonical(r) for r in rows]
        shapes = {s: digest([source.name, *s]) for s in {tuple(sorted(r)) for r in rows}}
        key = source.key if rows and set(source.key) <= set(rows[0]) else ()
        units = [(name, chunk, i, source.name, canonical({k: r[k] for k in key}) if key else None, shapes[tuple(sorted(r))], hashlib.sha256(b.encode()).hexdigest()) for i, (r, b) in enumerate(zip(rows, bodies, strict=True))]
        own = {
            "previous": previous, "seq": seq, "answer": name, "chunk": chunk, "kind": kind, "caller": str(ctx.get("caller", "")), "at": int(at.replace(tzinfo=dt.UTC).timestamp() * 1_000_000 + 0.5),
            "source": source.name, "request": canonical(request), "rows": len(rows), "units": digest(digest(u[2:]) for u in units),
        }
        made = digest(own[c] for c in CHAINED)
        self._append("content", sorted({(u[6], b) for u, b in zip(units, bodies, strict=True)}), self._content())
        self._append("shapes", [(a, source.name, m, m in source.sensitive) for s, a in shapes.items() for m in s])
        self._append("units", units)
        when = dt.datetime.fromtimestamp(0, dt.UTC).replace(tzinfo=None) + dt.timedelta(microseconds=own["at"])
        self._append("answers", [(seq, name, chunk, kind, own["caller"], when, own["source"], own["request"], own["rows"], own["units"], previous, made)])
        self._head = (seq + 1, made)

    def _append(self, table: str, rows: list, folder: str | None = None) -> None:
        if rows:
            self.spark.createDataFrame(rows, TABLES.get(table, CONTENT)).coalesce(1).write.mode("append").parquet(folder or f"{self.folder}/{table}")

    # Reading

    def _there(self, path: str) -> bool:
        found = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(found)

    def _read(self, table: str) -> DataFrame:
        path = f"{self.folder}/{table}"
        return self.spark.read.schema(TABLES[table]).parquet(path) if self._there(path) else self.spark.createDataFrame([], TABLES[table])

    def _content(self) -> str:
        """The folder of the newest whole generation of contents."""
        newest = self._read("generations").agg(F.max(F.struct("n", "folder")).alias("x")).first().x
        return f"{self.folder}/{newest.folder if newest else 'content'}"

    answers = property(lambda self: self._read("answers"))
    units = property(lambda self: self._read("units"))
    reviews = property(lambda self: self._read("reviews"))
    erasures = property(lambda self: self._read("erasures"))

    @property
    def content(self) -> DataFrame:
        """Each distinct row that was sent and not erased."""
        path = self._content()
        stored = self.spark.read.schema(CONTENT).parquet(path) if self._there(path) else self.spark.createDataFrame([], CONTENT)
        return stored.dropDuplicates(["address"]).join(self.erasures.select("address").distinct(), "address", "left_anti")

    def shape(self, address: str) -> DataFrame:
        """source, member, sensitive of a shape."""
        return self._read("shapes").where(F.col("shape") == address).drop("shape").distinct()

    def catalogue(self) -> DataFrame:
        """The sources and members of which anything was sent."""
        return self._read("shapes").drop("shape").distinct()

    def reviewed(self, reviewer: str, question: str, **parameters: object) -> None:
        """Notes that somebody asked."""
        self._append("reviews", [(uuid.uuid4().hex, _now(), reviewer, question, canonical(parameters))])

    def _sent(self) -> DataFrame:
        return self.answers.select("answer", "chunk", "caller", "at")

    def receivers_of(self, source: str, key: dict) -> DataFrame:
        """Who was sent a row: caller, first and last time, how often."""
        hits = self.units.where((F.col("source") == source) & (F.col("key") == canonical(key))).select("answer", "chunk")
        return self._sent().join(hits, ["answer", "chunk"]).groupBy("caller").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("times"))

    def received_by(self, caller: str) -> DataFrame:
        """What a caller was sent: source, key, content."""
        return self.units.join(self._sent().where(F.col("caller") == caller), ["answer", "chunk"]).select("source", "key", "address", "at")

    def member_received_by(self, caller: str, source: str, member: str) -> bool:
        shapes = self._read("shapes").where((F.col("source") == source) & (F.col("member") == member)).select("shape").distinct()
        hits = self.units.join(shapes, "shape", "left_semi").join(self._sent().where(F.col("caller") == caller), ["answer", "chunk"], "left_semi")
        return not hits.isEmpty()

    def reconstruct(self, answer: str) -> Iterator[dict]:
        """An answer's rows, in order, from their contents; an erased one is {"erased": address}."""
        found = self.units.where(F.col("answer") == answer).join(self.content, "address", "left").orderBy("chunk", "ordinal").select("address", "body")
        return (json.loads(r.body) if r.body is not None else {"erased": r.address} for r in found.toLocalIterator())

    def status(self) -> dict:
        """Chunks and answers recorded, rows sent, contents erased, and the chain's head."""
        got = self.answers.agg(F.count("*").alias("chunks"), F.count_distinct("answer").alias("answers"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
        return got.asDict() | {"erased": self.erasures.select("address").distinct().count(), "head": self.head()}

    # Erasing and checking

    def erase(self, addresses: DataFrame, by: str = "") -> None:
        """Removes these contents; the record that they were sent stays.

        They are gone for readers once `erasures` names them. The contents without them are then written to a new
        folder, which counts from the moment `generations` names it, and the old one is deleted last: whatever is cut
        short leaves a whole generation.
        """
        gone = addresses.select(F.current_timestamp().cast("timestamp_ntz").alias("at"), F.lit(by).alias("by"), "address").distinct()
        gone.write.mode("append").parquet(f"{self.folder}/erasures")
        old, n = self._content(), self._read("generations").count() + 1
        folder = f"content-{n}-{uuid.uuid4().hex}"
        self.content.write.parquet(f"{self.folder}/{folder}")
        self._append("generations", [(n, folder)])
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def verify(self, head: tuple[int, str] | None = None) -> bool:
        """Whether nothing was changed, moved, added or removed since it was written.

        Each chunk's digest covers caller, time, request and units and follows from exactly one other; no unit lacks its
        chunk; the chain ends where this writer left it (or at `head`, kept elsewhere); contents match their addresses.
        """
        seq, last = head or self.head()
        lines = self.units.select("answer", "chunk", "ordinal", _digest(*UNIT).alias("line"))
        per = lines.groupBy("answer", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "line"))), lambda x: x["line"]), "\n").alias("lines"))
        chunks = self.answers.join(per, ["answer", "chunk"], "left").withColumn("made", F.sha2(F.coalesce("lines", F.lit("")), 256))
        at = chunks.withColumn("at", F.unix_micros(F.col("at").cast("timestamp")))
        wrong = at.where((F.col("made") != F.col("units")) | (_digest(*CHAINED) != F.col("digest")))
        before = self.answers.select((F.col("seq") + 1).alias("seq"), F.col("digest").alias("due"))
        links = self.answers.select("seq", "previous").join(before, "seq", "left").where(F.col("previous") != F.coalesce("due", F.when(F.col("seq") == 0, F.lit("")), F.lit("?")))
        ends = self.answers.agg(F.count("*").alias("n"), F.count_distinct("seq").alias("seqs"), F.max(F.struct("seq", "digest")).alias("x")).first()
        whole = (ends.n, ends.seqs) == (seq, seq) and (not seq or (ends.x.seq, ends.x.digest) == (seq - 1, last))
        stray = self.units.join(self.answers, ["answer", "chunk"], "left_anti")
        forged = self.content.where(F.sha2("body", 256) != F.col("address"))
        return whole and all(x.isEmpty() for x in (wrong, links, stray, forged))
