"""The page archive as tables: files, parsed documents, and per-source counts."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.batches import slices
from lumenfold.functions.exprs import html_title, is_html_file, request_path, trimmed
from lumenfold.functions.html_text import extract_text
from lumenfold.operators.issues import issue
from lumenfold.schemas import ArchiveError
from lumenfold.session import keep

LISTING = "rel string, abs_path string, is_link boolean"
#: Names that a task of the listing passes on at a time, and tasks of one level at most.
NAMES, TASKS = 10_000, 1024
#: Characters of pages after which a task that reads them passes them on.
READ = 4 << 20


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(rel, abs_path, is_link) of all files below ``root``, names with a leading dot or underscore too.

    Level by level, tasks list the folders that the level before has found, so
    neither the driver nor one task walks a large domain. Links to folders are
    not followed. A blank root is an error, a missing one is empty.
    """
    if not root.strip():
        raise ArchiveError("archive location is empty")
    found = spark.createDataFrame([], LISTING)
    if not os.path.isdir(root):
        return found

    def children(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds = {"rel": "str", "is_dir": "bool", "is_link": "bool"}
        for part in parts:
            for folder in part["rel"]:
                rows = []
                with os.scandir(os.path.join(root, folder)) as entries:
                    for entry in entries:
                        rows.append((f"{folder}/{entry.name}" if folder else entry.name, entry.is_dir(follow_symlinks=False), entry.is_symlink()))
                        if len(rows) == NAMES:
                            yield pd.DataFrame(rows, columns=list(kinds)).astype(kinds)
                            rows = []
                yield pd.DataFrame(rows, columns=list(kinds)).astype(kinds)

    folders, n = spark.createDataFrame([("",)], "rel string"), 1
    while n:
        level = keep(folders.repartition(min(n, TASKS)).mapInPandas(children, "rel string, is_dir boolean, is_link boolean"), "listing")
        path = F.concat(F.lit(root.rstrip("/") + "/"), "rel")
        found = found.union(level.where("not is_dir").select("rel", path.alias("abs_path"), "is_link"))
        folders = level.where("is_dir").select("rel")
        n = folders.count()
    return found


def html_files(listing: DataFrame, *more: str) -> DataFrame:
    """(domain, filename, request_path, abs_path, more columns) of the pages; uploads under Temporary are none."""
    pages = listing.where(is_html_file("rel") & (F.lower(F.split("rel", "/")[0]) != "temporary") & F.col("rel").contains("/"))
    domain = trimmed(F.split("rel", "/", 2)[0])
    return pages.select(domain.alias("domain"), F.split("rel", "/", 2)[1].alias("filename"), "abs_path", *more).select(
        "domain", "filename", request_path("domain", "filename").alias("request_path"), "abs_path", *more
    )


def count_html(listing: DataFrame) -> DataFrame:
    """One row: how many pages the listing has at any depth."""
    return listing.where(is_html_file("rel")).agg(F.count("*").alias("html_files"))


def unattributed(listing: DataFrame) -> DataFrame:
    """Issues for pages that lie in no domain's folder."""
    loose = listing.where(is_html_file("rel") & ~F.col("rel").contains("/"))
    return issue(loose.select(F.lit("").alias("domain"), F.col("rel").alias("filename"), F.col("rel").alias("path")), "html_unattributed")


def read_pages(files: DataFrame) -> DataFrame:
    """``files`` with the pages' content as ``html``; bytes that are no UTF-8 are replaced."""
    names = ["domain", "filename", "request_path", "abs_path"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, contents, size = 0, [], 0
            for k, path in enumerate(batch.column(3).to_pylist(), 1):
                with open(path, encoding="utf-8", errors="replace", newline="") as file:
                    contents.append(file.read())
                size += len(contents[-1])
                if size >= READ or k - start == 64 or k == batch.num_rows:
                    yield pa.record_batch([*batch.slice(start, k - start).columns, pa.array(contents, pa.string())], names=[*names, "html"])
                    start, contents, size = k, [], 0

    return files.select(*names).mapInArrow(read, "domain string, filename string, request_path string, abs_path string, html string")


def _write(path: str, write) -> None:
    """Under its name at once, so that a task that runs again leaves the same file."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    write(temporary)
    os.replace(temporary, path)


def write_pages(pages: DataFrame, root: str) -> DataFrame:
    """Write ``html`` of ``pages`` (rel, html) as files below ``root``, by tasks; the rels that were written."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            for rel, html in zip(part.column("rel").to_pylist(), part.column("html").to_pylist(), strict=True):

                def write(path: str, content: str = html or "") -> None:
                    with open(path, "w", encoding="utf-8", newline="") as out:
                        out.write(content)

                _write(os.path.join(root, rel), write)
            yield part.select(["rel"])

    return keep(pages.select("rel", F.col("html").cast("string").alias("html")).mapInArrow(put, "rel string"), "written")


def present(pages: DataFrame, root: str) -> DataFrame:
    """(domain, rel, there) of ``pages``: whether a file stands at ``rel`` below ``root`` already."""

    def look(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(there=[os.path.exists(os.path.join(root, rel)) for rel in part["rel"]])

    return pages.select("domain", "rel").mapInPandas(look, "domain string, rel string, there boolean")


def copy_files(listing: DataFrame, root: str) -> DataFrame:
    """Copy the files of a listing to the same places below ``root``, by tasks; links are left out. The rels that were copied."""

    def put(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for rel, source in zip(part["rel"], part["abs_path"], strict=True):
                _write(os.path.join(root, rel), lambda path, source=source: shutil.copy(source, path))
            yield part[["rel"]]

    os.makedirs(root, exist_ok=True)
    return keep(listing.where("not is_link").select("rel", "abs_path").mapInPandas(put, "rel string"), "copied")


def with_text(pages: DataFrame, html: str, name: str) -> DataFrame:
    """``pages`` with the visible text of column ``html``, by depth, in its place under ``name``; null stays null."""
    others = [c for c in pages.columns if c != html]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_lf_html"):
            texts = [None if page is None else extract_text(page) for page in part.column(part.num_columns - 1).to_pylist()]
            yield pa.record_batch([*part.columns[:-1], pa.array(texts, pa.string())], names=[*others, name])

    rows = pages.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{html}`").cast("string").alias("_lf_html"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(run, ", ".join([*fields, f"`{name}` string"]))


def titled(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, title, filename, domain, html) of ``pages`` (domain, filename, html) that become documents, and issues for those without a title.

    The id is a digest of domain and filename, so building again gives equal rows.
    """
    held = pages.withColumn("title", html_title("html"))
    good = held.where(F.col("title").isNotNull()).select(
        F.sha2(F.concat_ws("\0", "domain", "filename"), 256).alias("id"), "title", "filename", "domain", "html"
    )
    bad = held.where(F.col("title").isNull()).select("domain", "filename", request_path("domain", "filename").alias("path"))
    return good, issue(bad, "html_unparseable")


def documents(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Search documents of ``pages``: what :func:`titled` gives, with the visible text as ``content``."""
    good, bad = titled(pages)
    return with_text(good, "html", "content"), bad
