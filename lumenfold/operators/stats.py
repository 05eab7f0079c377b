"""Per-source file counts: scans, snapshots and upserts as functions from table to table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.exprs import share_percent, trimmed
from lumenfold.operators.ranks import numbered


def count_by_source(files: DataFrame, source: str = "domain") -> DataFrame:
    """(source, file_count) of a table of files; blank sources and uploads do not count."""
    named = files.select(trimmed(source).alias("source")).where("source <> '' and lower(source) <> 'temporary'")
    return named.groupBy("source").agg(F.count("*").alias("file_count"))


def snapshot(stats: DataFrame) -> DataFrame:
    """One row: total_files and the number of sources; negative counts are skipped."""
    valid = stats.where("file_count >= 0")
    return valid.agg(F.coalesce(F.sum("file_count"), F.lit(0)).cast("long").alias("total_files"), F.count("*").alias("sources"))


def snapshot_items(stats: DataFrame) -> DataFrame:
    """The snapshot's rows, by source."""
    return stats.where("file_count >= 0").select("source", "file_count").orderBy("source")


def shares(stats: DataFrame) -> DataFrame:
    """Each source's percent of all files and its rank by count, ties by name."""
    ranked = numbered(stats.select("source", "file_count"), F.desc("file_count"), "source", name="rnk")
    total = F.broadcast(ranked.agg(F.sum("file_count").alias("total")))  # one row
    return ranked.join(total, F.lit(True)).select(
        "source", "file_count", share_percent(F.col("file_count"), F.col("total")).alias("pct"), "rnk"
    )


def increment(stats: DataFrame, changes: DataFrame) -> DataFrame:
    """``stats`` after adding ``changes`` (source, delta); blank sources and zero changes do nothing."""
    valid = changes.select(trimmed("source").alias("source"), F.col("delta").alias("file_count")).where("source <> '' and file_count <> 0")
    merged = stats.select("source", "file_count").unionByName(valid)
    return merged.groupBy("source").agg(F.sum("file_count").cast("long").alias("file_count"))


def decrement(stats: DataFrame, changes: DataFrame) -> DataFrame:
    """``stats`` after taking off ``changes`` (source, delta > 0); touched rows that reach 0 go, unknown sources are ignored."""
    off = changes.select(trimmed("source").alias("source"), "delta").where("source <> '' and delta > 0")
    off = off.groupBy("source").agg(F.sum("delta").alias("delta"))
    left = F.col("file_count") - F.coalesce("delta", F.lit(0))
    return stats.join(off, "source", "left").where(F.col("delta").isNull() | (left > 0)).select("source", left.cast("long").alias("file_count"))


def replace(new: DataFrame) -> DataFrame:
    """A whole new table of counts."""
    return new.select("source", F.col("file_count").cast("long").alias("file_count"))
