"""Helpers that several training-data operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.batches import slices  # noqa: F401 (for the operators)
from lumenfold.session import keep

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Keys with at least so many rows are spread over tasks, and how many keys at most; all others have fewer rows than these.
HOT_ROWS, HOT_KEYS = 1024, 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column | str) -> Column:
    """Number of words, 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hot_keys(counts: DataFrame, keys: list[str]) -> DataFrame | None:
    """(keys, salts): into how many parts the rows of each frequent key are dealt. None if no key is frequent.

    ``counts`` has the keys and ``n``, the number of rows of each. At most
    ``HOT_KEYS`` keys come out, so the table may be broadcast; a key that is not
    among them has at most one ``HOT_KEYS``-th of all rows, or few rows at all.
    Most tables have no frequent key; what would look for its parts, two joins
    each time, is left out of the plan then, and out of the driver's work.
    """
    if (counts.agg(F.max("n")).first()[0] or 0) < HOT_ROWS:
        return None
    top = counts.where(F.col("n") >= HOT_ROWS).select(*keys, "n").orderBy(F.desc("n"), *keys).limit(HOT_KEYS)
    most = F.greatest(F.lit(HOT_ROWS), F.sum("n").over(Window.partitionBy()) / HOT_KEYS)  # a window over HOT_KEYS rows at most
    return keep(top.select(*keys, F.ceil(F.col("n") / most).cast("int").alias("salts")), "hot-keys")


def salted_join(rows: DataFrame, one: DataFrame, keys: list[str], hot: DataFrame | None, by: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``one``, which has a row per key at most; rows of a hot key are dealt by a hash of ``by``."""
    if hot is None:
        return rows.join(one, keys, how)
    few = F.broadcast(hot)  # HOT_KEYS rows at most
    salts = F.coalesce("salts", F.lit(1))
    left = rows.join(few, keys, "left").withColumn("_lf_salt", F.pmod(F.xxhash64(*by), salts).cast("int")).drop("salts")
    right = one.join(few, keys, "left").withColumn("_lf_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return left.join(right, [*keys, "_lf_salt"], how).drop("_lf_salt")


def texts_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 bytes of a text column, null as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.binary()).to_numpy(zero_copy_only=False)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
