"""Packing documents into training sequences by cutting-stock column generation.

A document of n ids is cut into pieces of ``SEQUENCE`` ids and one rest. Whole
pieces are sequences of their own. The rests are packed whole: only their
length histogram (at most ``SEQUENCE`` rows) reaches the driver, where
:mod:`cutting_stock` turns it into patterns. Lengths enter the program rounded
up to ``UNIT`` ids; short rests would lose much by that, so up to ``SHORT`` ids
``UNIT`` rests of one length make a bundle, whose length is a multiple of UNIT.

The patterns go back as a table of rank ranges: within its length a rest of
rank k belongs to a sequence and slot that follow by arithmetic. Ranks are
counted per length and salt and shifted by the salts' totals, so a length that
very many documents share is spread over all tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.llm.common import slices
from lumenfold.llm.cutting_stock import cut
from lumenfold.llm.tokens import encoder
from lumenfold.session import keep

SEQUENCE = 4096
UNIT = 16
SHORT = 128


def pieces(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in slices(batches, "text"):
            ids, offsets = encode(batch.column(1), end_id)
            raw = memoryview(ids.astype("<u4").tobytes())
            sizes = np.diff(offsets)
            n = -(-sizes // SEQUENCE)
            doc = np.repeat(np.arange(len(sizes)), n)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * SEQUENCE
            length = np.minimum(SEQUENCE, sizes[doc] - start)
            at = offsets[doc] + start
            crc = [zlib.crc32(raw[4 * a : 4 * (a + b)]) for a, b in zip(at.tolist(), length.tolist(), strict=True)]
            yield pa.record_batch(
                [batch.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(sizes[doc])],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut_up, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def assignment(histogram: dict[int, int]) -> tuple[list[tuple], int]:
    """Rank ranges (length, low, high, base, per_sequence, bundle, slot) and the number of sequences.

    A piece of rank k in [low, high) of its length is item i = (k - low) // bundle
    of the range and lies in sequence base + i // per_sequence.
    """
    items: dict[int, list[list[int]]] = {}
    for length, n in sorted(histogram.items()):
        if length == SEQUENCE:
            continue
        bundled = n - n % UNIT if length <= SHORT else 0
        if bundled:
            items.setdefault(length, []).append([length, 0, bundled, UNIT])
        if n > bundled:
            items.setdefault(-(-length // UNIT), []).append([length, bundled, n, 1])
    demand = {size: sum((high - low) // bundle for _, low, high, bundle in runs) for size, runs in items.items()}
    ranges, sequence = [], 0
    for pattern, times in cut(demand, SEQUENCE // UNIT):
        for slot, (size, each) in enumerate(sorted(pattern.items(), reverse=True)):
            wanted, taken = each * times, 0
            while taken < wanted:
                run = items[size][0]
                length, low, high, bundle = run
                # A range starts at a sequence's first place in this slot, or ends up filling one begun before.
                inside = taken % each
                n = min(wanted - taken, (high - low) // bundle)
                ranges.append((length, low, low + n * bundle, sequence + taken // each, each, bundle, slot, inside))
                run[1] += n * bundle
                taken += n
                if run[1] == high:
                    items[size].pop(0)
        sequence += times
    if histogram.get(SEQUENCE):
        ranges.append((SEQUENCE, 0, histogram[SEQUENCE], sequence, 1, 1, 0, 0))
        sequence += histogram[SEQUENCE]
    return ranges, sequence


def ranked(table: DataFrame, spark: SparkSession) -> DataFrame:
    """``table`` with ``rank``: a number from 0 within each length, without gaps, equal on every run."""
    salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = table.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = salted.groupBy("length", "salt").count().select(
        "length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift")
    )
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    local = salted.withColumn("local", F.row_number().over(within) - 1)
    return local.join(shift, ["length", "salt"]).withColumn("rank", F.col("local") + F.col("shift")).drop("local", "shift", "salt")


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Pack all of ``docs`` (doc_id, text, ...) into sequences of at most ``SEQUENCE`` ids.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset. A null or empty text is its end id alone. Repeated rows are packed
    each; a null doc_id is a doc_id like others. An empty table gives no rows.
    """
    spark = docs.sparkSession
    cut_up = keep(pieces(docs, vocabulary, end_id), "pieces")
    histogram = {r["length"]: r["count"] for r in cut_up.groupBy("length").count().collect()}
    ranges, _ = assignment(histogram)
    schema = "length long, low long, high long, base long, each long, bundle long, slot long, inside long"
    # At most a few ranges for each of at most 2 * 512 patterns and their sizes: far below a megabyte.
    plan = spark.createDataFrame(ranges, schema).withColumnRenamed("length", "of")
    placed = ranked(cut_up, spark).join(
        F.broadcast(plan), (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    )
    item = F.floor((F.col("rank") - F.col("low")) / F.col("bundle")) + F.col("inside")
    at = placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.floor(item / F.col("each"))).alias("sequence_id"),
        "slot", "rank",
    )
    order = Window.partitionBy("sequence_id").orderBy("slot", "length", "rank").rowsBetween(Window.unboundedPreceding, -1)
    return at.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(order), F.lit(0)).alias("offset"),
    )
