"""Token ids as binary files with Elias-Fano coded document boundaries.

The documents are ordered by doc_id over range partitions; each task writes its
part as shard files of about ``SHARD_TOKENS`` ids. A shard holds

    magic "LFTOK1\\0\\0"; 8 int64: documents, ids, bytes per id, documents without
    doc_id, least doc_id, and three section lengths;
    the doc_ids, Elias-Fano coded; the end offsets of the documents, Elias-Fano
    coded; the concatenated ids; the crc32 of all that, 4 bytes.

The end offset of document i is ``select(i)`` on the coded boundaries: it takes
about 2 + log2(ids / documents) bits a document, against 64 in a plain table.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.llm.common import slices
from lumenfold.llm.files import write_file
from lumenfold.llm.tokens import encoder
from lumenfold.session import keep, scratch_path

SHARD_TOKENS = 4 << 20
MAGIC = b"LFTOK1\0\0"
#: One position in the high bits is noted for every so many values.
SELECT_EVERY = 256


class EliasFano:
    """A non-decreasing sequence of n integers below u in n * (2 + log2(u / n)) bits.

    The low bits of each value are packed; the high bits are unary: value i sets
    bit (value >> low) + i. ``select`` jumps to a noted position and counts set
    bits from there, so it reads a few dozen bytes. An empty sequence is valid.
    """

    def __init__(self, n: int, low: int, lower: np.ndarray, upper: np.ndarray, notes: np.ndarray):
        self.n, self.low, self.lower, self.upper, self.notes = n, low, lower, upper, notes

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        low = max(0, int(math.log2((int(values[-1]) + 1) / n))) if n else 0
        lower = (values[:, None] >> np.arange(low)) & 1 if n else np.empty((0, 0), np.int64)
        at = (values >> low) + np.arange(n)
        bits = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        bits[at] = 1
        pack = lambda b: np.packbits(b.astype(np.uint8).ravel(), bitorder="little")
        return cls(n, low, pack(lower), pack(bits), at[::SELECT_EVERY].astype(np.uint32))

    def select(self, i: int) -> int:
        """Value i, without decoding the others."""
        at, left = int(self.notes[i // SELECT_EVERY]), i % SELECT_EVERY
        byte = at >> 3
        ones = int(self.upper[byte]) >> (at & 7)
        base = at
        while (count := ones.bit_count()) <= left:
            left -= count
            byte += 1
            base, ones = byte << 3, int(self.upper[byte])
        for _ in range(left):
            ones &= ones - 1
        high = base + (ones & -ones).bit_length() - 1 - i
        first = i * self.low
        word = int.from_bytes(self.lower[first >> 3 : (first + self.low + 7) >> 3].tobytes(), "little")
        return high << self.low | (word >> (first & 7)) & ((1 << self.low) - 1)

    def decode(self) -> np.ndarray:
        """All values."""
        at = np.nonzero(np.unpackbits(self.upper, bitorder="little"))[0][: self.n]
        low = np.unpackbits(self.lower, bitorder="little", count=self.n * self.low).reshape(self.n, self.low).astype(np.int64)
        return ((at - np.arange(self.n)) << self.low) + low @ (1 << np.arange(self.low, dtype=np.int64))

    def to_bytes(self) -> bytes:
        head = struct.pack("<5q", self.n, self.low, len(self.lower), len(self.upper), len(self.notes))
        return head + self.lower.tobytes() + self.upper.tobytes() + self.notes.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, low, a, b, c = struct.unpack_from("<5q", data)
        part = lambda kind, count, at: np.frombuffer(data, kind, count, at)
        return cls(n, low, part(np.uint8, a, 40), part(np.uint8, b, 40 + a), part("<u4", c, 40 + a + b))


def shard_bytes(doc_ids: list[int | None], ids: np.ndarray, ends: np.ndarray) -> bytes:
    """One shard. ``doc_ids`` ascend, null first; ``ends`` are the documents' end offsets."""
    known = np.array([i for i in doc_ids if i is not None], np.int64)
    nulls, least = len(doc_ids) - len(known), int(known[0]) if len(known) else 0
    wide = 4 if len(ids) and int(ids.max()) > 0xFFFF else 2
    sections = [EliasFano.encode(known - least).to_bytes(), EliasFano.encode(ends).to_bytes(), ids.astype(f"<u{wide}").tobytes()]
    head = struct.pack("<8q", len(doc_ids), len(ids), wide, nulls, least, *map(len, sections))
    body = MAGIC + head + b"".join(sections)
    return body + struct.pack("<I", zlib.crc32(body))


class Shard:
    """A shard read back: ``doc_ids``, ``boundaries`` (Elias-Fano) and ``ids``."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("not a whole token shard")
        n, total, wide, nulls, least, *lengths = struct.unpack_from("<8q", data, 8)
        a, b, c = 72, 72 + lengths[0], 72 + lengths[0] + lengths[1]
        self.doc_ids = [None] * nulls + (EliasFano.from_bytes(data[a:b]).decode() + least).tolist()
        self.boundaries = EliasFano.from_bytes(data[b:c])
        self.ids = np.frombuffer(data, f"<u{wide}", total, c)

    def document(self, i: int) -> np.ndarray:
        """Ids of the shard's document i, found by select."""
        return self.ids[self.boundaries.select(i - 1) if i else 0 : self.boundaries.select(i)]


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, path: str) -> DataFrame:
    """Write all texts of ``docs`` as shards below ``path``; a table of the shards in order.

    Columns: name, n_docs, n_tokens, start (ids in all shards before). Null text
    is empty and a document is then its end id alone. Documents ascend by doc_id,
    null first, equal ones by text. An empty table writes no shard.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        part, shard = TaskContext.get().partitionId(), 0
        doc_ids, ids, ends, total = [], [], [], 0

        def flush() -> pa.RecordBatch:
            name = f"tokens-{part:06d}-{shard:06d}.bin"
            write_file(f"{path}/{name}", shard_bytes(doc_ids, np.concatenate(ids), np.concatenate(ends)))
            return pa.record_batch(
                [pa.array([name]), pa.array([part], pa.int32()), pa.array([len(doc_ids)], pa.int64()), pa.array([total], pa.int64())],
                names=["name", "part", "n_docs", "n_tokens"],
            )

        for batch in slices(batches, "text"):
            got, offsets = encode(batch.column(1), end_id)
            doc_ids += batch.column(0).to_pylist()
            ids.append(got), ends.append(offsets[1:] + total)
            total += len(got)
            if total >= SHARD_TOKENS:
                yield flush()
                doc_ids, ids, ends, total, shard = [], [], [], 0, shard + 1
        if doc_ids:
            yield flush()

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "text"
    )
    shards = keep(ordered.mapInArrow(write, "name string, part int, n_docs long, n_tokens long"), "shards")
    # Shards are summed within their range partition; only a row per partition is ordered whole.
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("part").orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda n, window: F.coalesce(F.sum(n).over(window), F.lit(0))
    shift = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", before("n", whole).alias("shift"))
    return shards.withColumn("local", before("n_tokens", within)).join(shift, "part").select(
        "name", "n_docs", "n_tokens", (F.col("local") + F.col("shift")).alias("start")
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the shards below ``path``: name, doc_id, local_start, n_tokens, ids_crc32."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(content.as_py())
                # Each document's end by select: no table of 64-bit offsets is stored.
                ends = np.array([shard.boundaries.select(i) for i in range(shard.boundaries.n)], np.int64)
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                raw, view = shard.ids.astype("<u4").tobytes(), memoryview
                crc = [zlib.crc32(view(raw)[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)]
                yield pa.record_batch(
                    [
                        pa.array([name.rpartition("/")[2]] * len(ends)), pa.array(shard.doc_ids, pa.int64()),
                        pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64()),
                    ],
                    names=["name", "doc_id", "local_start", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path).select("path", "content")
    return files.mapInArrow(digest, "name string, doc_id long, local_start long, n_tokens long, ids_crc32 long")


def token_file_digest(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and describe each document as read back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-files")
    shards = keep(write_token_files(docs, vocabulary, end_id, path).select("name", "start"), "shard-starts")
    if shards.isEmpty():
        empty = "doc_id long, start long, n_tokens long, ids_crc32 long"
        return spark.createDataFrame([], empty)
    found = read_token_files(spark, path).join(shards, "name")
    return found.select("doc_id", (F.col("start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
