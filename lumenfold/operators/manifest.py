"""Checking an archive again by what has changed: a manifest of its files, and the difference to it."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.exprs import html_title
from lumenfold.operators import consistency, stats
from lumenfold.operators.issues import issue
from lumenfold.operators.lifecycle import Archive
from lumenfold.session import keep
from lumenfold.sources.archive import read_pages

MANIFEST = "domain string, filename string, request_path string, size long, time long, digest string, titled boolean"
KEY = ["domain", "filename"]


def measured(files: DataFrame) -> DataFrame:
    """``files`` with their size and time of change, by tasks; a file that went meanwhile is left out."""

    def look(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for row in part.itertuples(index=False):
                try:
                    found = os.stat(row.abs_path)
                except FileNotFoundError:
                    continue
                rows.append((*row, found.st_size, found.st_mtime_ns))
            yield pd.DataFrame(rows, columns=[*part.columns, "size", "time"])

    columns = files.select("domain", "filename", "request_path", "abs_path")
    return columns.mapInPandas(look, "domain string, filename string, request_path string, abs_path string, size long, time long")


def changed(archive: Archive, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files whose size or time differs from the manifest's, or that it lacks; all others with what it says)."""
    now = keep(measured(files), "measured")
    before = archive.store.read("manifest", MANIFEST).select(*KEY, F.col("size").alias("old_size"), F.col("time").alias("old_time"), "digest", "titled")
    both = now.join(before, KEY, "left")
    same = F.coalesce((F.col("size") == F.col("old_size")) & (F.col("time") == F.col("old_time")), F.lit(False))
    return both.where(~same).select(*now.columns), both.where(same).select(*[c.split()[0] for c in MANIFEST.split(", ")])


def recheck(archive: Archive) -> tuple[DataFrame, int]:
    """(all issues as ``Archive.check`` finds them, number of pages read): only pages that changed since the last time are read and parsed.

    Counts and titles of all others come from the manifest, which is written anew.
    """
    files, loose = archive.scan()
    new, kept = changed(archive, files)
    read = read_pages(new.select("domain", "filename", "request_path", "abs_path"))
    parsed = read.select(*KEY, F.sha2("html", 256).alias("digest"), html_title("html").isNotNull().alias("titled"))
    fresh = keep(new.drop("abs_path").join(parsed, KEY), "fresh")
    archive.store.write("manifest", kept.unionByName(fresh))
    manifest = archive.store.read("manifest", MANIFEST)
    bad = issue(manifest.where("not titled").select("domain", "filename", F.col("request_path").alias("path")), "html_unparseable")
    found = consistency.check(manifest, archive.docs(), stats.count_by_source(manifest), archive.counts(), bad.unionByName(loose))
    return found, fresh.count()
