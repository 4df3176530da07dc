"""Operator 1: token ids in directly addressable codes.

An id is cut into chunks of fixed widths, lowest bits first. Level k holds the k-th chunk of every id that
reaches it, a bitmap that tells which of those ids go on to level k + 1, and a directory of the bitmap's
ranks, so any token of a segment is found by following ranks and without decoding its neighbours.

A token file is a folder that Spark writes: each row is a segment (`part`, `seq`, `before`, `n_docs`, `n_tokens`, `docs`,
`data`), whole documents in ascending doc_id order. `data` is a self-contained binary; see `pack`. It is stored as it is,
not compressed, one segment to a row group; `docs` is a column of its own that tells where each document stands. So a token
is found by reading the narrow columns, then one row group, then a few bytes for each level of its code.

Defined results for positions: those outside a document, of null or unknown documents and null ones have no row.
Defined results: a null text is an empty one; an empty text holds the end id alone; rows with the same
doc_id each have an entry, ordered by text; null doc_ids come first; an empty table gives an empty file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.wordbpe import WordEncoder

MAGIC = b"DAC1"
#: Bits between two entries of a rank directory.
STRIDE = 512
SEGMENTS = "part int, seq int, before long, n_docs int, n_tokens long, docs array<struct<doc_id:long,at:long,n:long>>, data binary"
_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("at", pa.int64()), ("n", pa.int64())]))), ("data", pa.binary())])
#: Positions that one task looks up in one segment, about.
LOOKUPS = 1 << 16


def _chunk_bytes(chunks: np.ndarray, width: int) -> bytes:
    if width in (8, 16):
        return chunks.astype(f"<u{width // 8}").tobytes()
    bits = (chunks[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, widths: tuple[int, ...] = (8, 8, 16)) -> bytes:
    """One segment: magic, counts, level widths, doc ids and null flags, document offsets, then the levels."""
    if sum(widths) < 32 or any(not 0 < w <= 16 for w in widths):
        raise ValueError("level widths lie between 1 and 16 and cover 32 bits")
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    out = [MAGIC, struct.pack("<IQB", len(doc_ids), len(ids), len(widths)), bytes(widths)]
    out += [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), nulls.tobytes(), np.concatenate([[0], np.cumsum(lengths)]).astype("<u8").tobytes()]
    rest = ids.astype(np.uint32)
    for width in widths:
        chunks, rest = rest & np.uint32((1 << width) - 1), rest >> np.uint32(width)
        more = rest > 0
        ranks = np.concatenate([[0], np.cumsum(np.add.reduceat(more, np.arange(0, len(more), STRIDE)))]) if len(more) else np.zeros(1)
        parts = _chunk_bytes(chunks, width), np.packbits(more, bitorder="little").tobytes(), ranks.astype("<u4").tobytes()
        out += [struct.pack("<QQQQ", len(chunks), *map(len, parts)), *parts]
        rest = rest[more]
    return b"".join(out)


class Segment:
    """Reads one segment; `token` follows ranks, `ids` decodes all of it."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a segment")
        n_docs, self.n_tokens, levels = struct.unpack_from("<IQB", data, 4)
        at = 17
        self.widths = list(data[at : at + levels])
        at += levels
        nulls = np.frombuffer(data, np.uint8, n_docs, at + 8 * n_docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(np.frombuffer(data, "<i8", n_docs, at), nulls, strict=True)]
        at += 9 * n_docs
        self.offsets = np.frombuffer(data, "<u8", n_docs + 1, at).astype(np.int64)
        at += 8 * (n_docs + 1)
        self.levels = []
        for _ in self.widths:
            n, a, b, c = struct.unpack_from("<QQQQ", data, at)
            at += 32
            self.levels.append((n, memoryview(data)[at : at + a], np.frombuffer(data, np.uint8, b, at + a), np.frombuffer(data, "<u4", c // 4, at + a + b)))
            at += a + b + c

    def _chunk(self, level: int, i: int) -> int:
        width, data = self.widths[level], self.levels[level][1]
        at = i * width
        whole = int.from_bytes(data[at // 8 : (at + width + 7) // 8], "little")
        return (whole >> at % 8) & ((1 << width) - 1)

    def token(self, i: int) -> int:
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = shift = 0
        for level, width in enumerate(self.widths):
            value |= self._chunk(level, i) << shift
            bits, ranks = self.levels[level][2:]
            if not bits[i // 8] >> (i % 8) & 1:
                break
            low = i // STRIDE * STRIDE
            before = bits[low // 8 : i // 8]
            i = int(ranks[i // STRIDE]) + int(np.bitwise_count(before).sum()) + int(bits[i // 8] & ((1 << i % 8) - 1)).bit_count()
            shift += width
        return value

    def document(self, k: int) -> list[int]:
        return [self.token(i) for i in range(int(self.offsets[k]), int(self.offsets[k + 1]))]

    def ids(self) -> np.ndarray:
        out = np.zeros(self.n_tokens, np.uint32)
        at, shift = slice(None), 0
        for width, (n, data, bits, _) in zip(self.widths, self.levels, strict=True):
            if not n:
                break
            if width in (8, 16):
                chunks = np.frombuffer(data, f"<u{width // 8}")
            else:
                unpacked = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * width].reshape(n, width)
                chunks = unpacked @ (1 << np.arange(width, dtype=np.uint32))
            out[at] |= chunks.astype(np.uint32) << np.uint32(shift)
            go = np.flatnonzero(np.unpackbits(bits, bitorder="little")[:n])
            at, shift = (go if isinstance(at, slice) else at[go]), shift + width
        return out


def write_token_file(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, by_word: bool = True, segment_tokens: int = 1 << 18, widths: tuple[int, ...] = (8, 8, 16), partitions: int | None = None) -> None:
    """Encodes whole texts and writes the segments in ascending order of the id, `partitions` parts at once.

    by_word: the tokenizer drops white space between words, so that words are encoded one by one and
    remembered; false encodes each text in one piece.
    """
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.shared(tokenizer_path, by_word)
        part, seq, before, held = TaskContext.get().partitionId(), 0, 0, 0
        ids: list[int | None] = []
        lengths: list[int] = []
        codes: list[np.ndarray] = []
        end = np.array([end_id], "<u4")

        def segment() -> pa.RecordBatch:
            data = pack(ids, np.array(lengths), np.concatenate(codes), widths)
            starts = (np.cumsum(lengths) - lengths).tolist()
            docs = [{"doc_id": d, "at": at, "n": n} for d, at, n in zip(ids, starts, lengths, strict=True)]
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "before": before, "n_docs": len(ids), "n_tokens": held, "docs": docs, "data": data}], schema=_ARROW)

        for batch in batches:
            found, sizes = encoder.encode(batch.column(1))
            at = 0
            for doc_id, size in zip(batch.column(0).to_pylist(), sizes.tolist(), strict=True):
                codes += found[at : at + size], end
                at += size
                ids.append(doc_id)
                lengths.append(size + 1)
                held += size + 1
                if held >= segment_tokens:
                    yield segment()
                    before, seq, held, ids, lengths, codes = before + held, seq + 1, 0, [], [], []
        if ids:
            yield segment()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(encode, SEGMENTS).write.options(**{"compression": "none", "parquet.block.row.count.limit": 1, "parquet.enable.dictionary": "false"}).parquet(path)


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, its segment's place, and the id in its middle
    (at n_tokens // 2), drawn by itself.

    The driver sums the tokens of each part, one number for each partition of the writing job.
    """
    segments = spark.read.schema(SEGMENTS).parquet(path)
    base, total = {}, 0
    for part, n in sorted(map(tuple, segments.groupBy("part").agg(F.sum("n_tokens")).collect())):
        base[part], total = total, total + n

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, before, data in zip(*(batch.column(c) for c in ("part", "seq", "before", "data")), strict=True):
                s = Segment(data.as_py())
                ids, first = s.ids().astype("<u4"), base[part.as_py()] + before.as_py()
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(s.offsets[:-1], s.offsets[1:], strict=True)]
                n, middle = len(crcs), [s.token((a + b) // 2) for a, b in zip(s.offsets[:-1].tolist(), s.offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids, pa.int64()), pa.array(first + s.offsets[:-1]), pa.array(np.diff(s.offsets)), pa.array(crcs, pa.int64()), pa.array([part.as_py()] * n, pa.int32()), pa.array([seq.as_py()] * n, pa.int32()), pa.array(middle, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32", "part", "seq", "middle_id"])

    return segments.select("part", "seq", "before", "data").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long, part int, seq int, middle_id long")


def _places(spark: SparkSession, path: str) -> DataFrame:
    """Where each document stands: part, seq, at, n by doc_id, from the narrow columns alone."""
    return spark.read.schema(SEGMENTS).parquet(path).select("part", "seq", F.inline("docs"))


def token_at(spark: SparkSession, path: str, doc_id: int, position: int) -> int:
    """One id of one document, of the first in the file where several share the doc_id."""
    place = _places(spark, path).where((F.col("doc_id") == doc_id) & (F.lit(position) >= 0) & (F.lit(position) < F.col("n"))).orderBy("part", "seq", "at").first()
    if place is None:
        raise IndexError((doc_id, position))
    segment = spark.read.schema(SEGMENTS).parquet(path).where((F.col("part") == place.part) & (F.col("seq") == place.seq)).select("data").first()
    return Segment(segment.data).token(place.at + position)


def tokens_at(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """doc_id, position, token_id for each distinct doc_id and position of `wanted`; other columns end here.

    Documents that share a doc_id each answer. A segment goes to as many tasks as its lookups fill; none decodes it.
    """
    asked = wanted.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("position").cast("long").alias("position")).distinct()
    found = asked.join(_places(spark, path), "doc_id").where("position >= 0 AND position < n").select("doc_id", "position", "part", "seq", (F.col("at") + F.col("position")).alias("i"))
    shares = found.groupBy("part", "seq").agg(F.ceil(F.count("*") / LOOKUPS).alias("shares"))
    dealt = found.join(shares, ["part", "seq"]).withColumn("share", F.pmod(F.xxhash64("i"), "shares"))
    split = shares.select(F.col("part").alias("p"), F.col("seq").alias("s"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("of"))
    data = spark.read.schema(SEGMENTS).parquet(path).select(F.col("part").alias("p"), F.col("seq").alias("s"), "data").join(split, ["p", "s"])

    def look(lookups: pa.Table, segments: pa.Table) -> pa.Table:
        s = Segment(segments["data"][0].as_py()) if lookups.num_rows else None
        return pa.table({"doc_id": lookups["doc_id"], "position": lookups["position"], "token_id": pa.array([s.token(i) for i in lookups["i"].to_pylist()], pa.int64())})

    return dealt.groupBy("part", "seq", "share").cogroup(data.groupBy("p", "s", "of")).applyInArrow(look, "doc_id long, position long, token_id long")
