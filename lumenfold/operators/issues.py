"""Consistency findings as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.schemas import ISSUE_KINDS

COLUMNS = ["code", "severity", "store", "domain", "filename", "path", "document_ids", "message", "recoverable"]
KEY = ["severity", "store", "domain", "filename", "path", "document_ids", "message"]


def issue(rows: DataFrame, code: str, message=None) -> DataFrame:
    """Issues of one kind for rows that have some of domain, filename, path and document_ids."""
    severity, store, recoverable = ISSUE_KINDS[code]
    have = set(rows.columns)
    text = lambda name: F.col(name) if name in have else F.lit("").alias(name)
    ids = F.col("document_ids") if "document_ids" in have else F.lit(None).cast("array<string>").alias("document_ids")
    return rows.select(
        F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(store).alias("store"), text("domain"), text("filename"),
        text("path"), ids, (F.lit(code) if message is None else message).alias("message"), F.lit(recoverable).alias("recoverable"),
    )


def merge(*groups: DataFrame) -> DataFrame:
    """All issues of the groups, each once."""
    whole = groups[0]
    for group in groups[1:]:
        whole = whole.unionByName(group)
    return whole.withColumn("document_ids", F.coalesce("document_ids", F.array().cast("array<string>"))).dropDuplicates(KEY)


def ordered(issues: DataFrame) -> DataFrame:
    return issues.orderBy("store", "domain", "filename", "path", "message", "severity", "document_ids")


def label(*parts: str):
    """The parts of an issue's place that aren't empty, joined for reading."""
    return F.concat_ws(" / ", *[F.when(F.col(p) != "", F.col(p)) for p in parts])
