"""Changes that touch files, documents and counts together: adding, deleting, rebuilding, saving and restoring."""

from __future__ import annotations

import json
import os
import shutil
import threading
import time
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.urls import archive_path
from lumenfold.operators import consistency, stats
from lumenfold.operators.segments import Index
from lumenfold.schemas import STATS, ArchiveError, Cancelled, DocumentMissing, FileMissing, InvalidPath
from lumenfold.session import keep
from lumenfold.sources.archive import copy_files, documents, html_files, list_files, present, read_pages, unattributed, write_pages
from lumenfold.sources.store import Store, stored_counts, stored_documents


#: The files of a scan, and the issues of files outside any domain.
Scanned = tuple[DataFrame, DataFrame]


def find_documents(docs: DataFrame, domain: str, filename: str) -> DataFrame:
    """Ids of the documents of exactly this page; the filter reaches the table's scan."""
    return docs.where((F.col("domain") == domain) & (F.col("filename") == filename) & (F.col("id") != "")).select("id")


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select("id"), "id", "left_anti")


class Archive:
    """A folder of pages with its document and count tables, and a search index if there is one.

    Adding and deleting write what they change and nothing else; rebuilding puts
    a whole table in place of all changes so far, those of streams too.
    """

    def __init__(self, spark: SparkSession, root: str, store: Store, index: Index | None = None):
        self.spark, self.root, self.store, self.index = spark, root, store, index

    def docs(self) -> DataFrame:
        return stored_documents(self.store)

    def counts(self) -> DataFrame:
        return stored_counts(self.store)

    def scan(self) -> tuple[DataFrame, DataFrame]:
        """(files, issues of files outside any domain)"""
        listing = list_files(self.spark, self.root)
        return html_files(listing), unattributed(listing)

    def rebuild(self, strict: bool = True, scanned: Scanned | None = None) -> DataFrame:
        """Build the documents, and the index, anew from the files (those of a scan just made, if given); strict fails on a page without a title, else it is an issue."""
        files, _ = scanned or self.scan()
        good, bad = documents(read_pages(files))
        if strict and (first := bad.first()):
            raise ArchiveError(f"no title found in {first['path']}")
        self.store.write("documents", good)
        if self.index:
            self.index.build(self.docs())
        return bad

    def refresh_counts(self, scanned: Scanned | None = None) -> DataFrame:
        self.store.write("stats", stats.count_by_source((scanned or self.scan())[0]))
        return self.counts()

    def check(self, scanned: Scanned | None = None, bad: DataFrame | None = None) -> DataFrame:
        """All issues; of a scan just made and its issues of pages without a title, if they are given."""
        files, loose = scanned or self.scan()
        if bad is None:
            _, bad = documents(read_pages(files))
        return consistency.check(files, self.docs(), stats.count_by_source(files), self.counts(), bad.unionByName(loose))

    def repair(self) -> DataFrame:
        """Rebuild both tables; issues that no rebuilding heals are carried over."""
        scanned = self.scan()
        bad = keep(documents(read_pages(scanned[0]))[1], "bad")
        lost = keep(self.check(scanned, bad).where("not recoverable"), "lost")
        self.rebuild(strict=False, scanned=scanned)
        self.refresh_counts(scanned)
        return consistency.ordered(consistency.merge(lost, self.check(scanned, bad)))

    def add(self, pages: DataFrame) -> None:
        """Index and write ``pages`` (domain, filename, html), by tasks; only files that were not there count.

        A page of the same name gives a second document, as a new one has its own id.
        """
        rel = F.concat_ws("/", "domain", "filename")
        pages = keep(pages.select("domain", "filename", "html", rel.alias("rel")), "pages")
        leaves = F.exists(F.split("rel", "/"), lambda x: x.isin("", ".", ".."))
        if wrong := pages.where(leaves | F.col("domain").contains("/")).first():
            raise InvalidPath(wrong["rel"])
        good, bad = documents(pages)
        if bad.head(1):
            raise ArchiveError("no title found")
        there = keep(present(pages, self.root), "present")
        new = keep(good.withColumn("id", F.uuid()), "documents")
        self.store.append("documents", new)
        if self.index:
            self.index.add(new)
        write_pages(pages, self.root)
        fresh = stats.count_by_source(there.where("not there").select("domain", "rel").distinct())
        self.store.append("stats", fresh)

    def add_file(self, domain: str, filename: str, html: str) -> None:
        self.add(self.spark.createDataFrame([(domain, filename, html)], "domain string, filename string, html string"))

    def delete(self, request: str) -> list[str]:
        """Delete a page by its request path: documents first, then the file, then its count. Returns the ids."""
        domain, filename = archive_path(request)
        target = os.path.join(self.root, domain, filename)
        if not os.path.exists(target):
            raise FileMissing(request)
        if os.path.isdir(target):
            raise InvalidPath(request)
        found = sorted(r["id"] for r in find_documents(self.docs(), domain, filename).collect())  # copies of one page
        if not found:
            raise DocumentMissing(request)
        ids = self.spark.createDataFrame([(i,) for i in found], "id string")
        self.store.append("documents", ids.withColumn("gone", F.lit(True)))
        if self.index:
            self.index.remove(ids)
        os.remove(target)
        counted = self.counts().where(F.col("source") == domain).first()
        if counted:  # a source that isn't counted stays so
            delta = -min(1, counted["file_count"])
            self.store.append("stats", self.spark.createDataFrame([(domain, delta)], STATS))
        return found

    def backup(self, target: str) -> dict:
        """Both tables and all pages below ``target``/backup, with a manifest; pages are copied by tasks."""
        base = f"{target.rstrip('/')}/backup"
        self.docs().write.mode("overwrite").parquet(f"{base}/documents.parquet")
        self.counts().write.mode("overwrite").parquet(f"{base}/stats.parquet")
        copy_files(list_files(self.spark, self.root), f"{base}/archive")
        now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        manifest = {"created_at": now, "documents": "documents.parquet", "stats": "stats.parquet", "archive_dir": "archive"}
        with open(f"{base}/manifest.json", "w") as out:
            json.dump(manifest, out, indent=2)
        return manifest

    def restore(self, source: str) -> None:
        """Pages from a backup folder; the tables are then built anew from them.

        The pages are copied beside the old ones first: until they are all there
        nothing changes, and a failed swap puts the old ones back.
        """
        entries = keep(entries_of(list_files(self.spark, source)), "entries")
        # A table is a folder as well: here all but folders named archive may be one.
        either = entries.withColumn("is_file", F.lower(F.element_at(F.split("path", "/"), -1)) != "archive")
        parts = discover(either, "documents.parquet", "stats.parquet", "stats.parquet").first()
        for name, what in (("dump", "documents table"), ("database", "stats table"), ("archive_dir", "archive folder")):
            if parts[name] is None:
                raise ArchiveError(f"the backup holds no {what}")
        new, old = f"{self.root}.{uuid.uuid4().hex}.new", f"{self.root}.{uuid.uuid4().hex}.old"
        copy_files(list_files(self.spark, f"{source.rstrip('/')}/{parts['archive_dir']}"), new)
        os.rename(self.root, old)
        try:
            os.rename(new, self.root)
        except OSError:
            os.rename(old, self.root)
            raise
        shutil.rmtree(old)
        self.rebuild(strict=True)
        self.refresh_counts()


def entries_of(listing: DataFrame) -> DataFrame:
    """(path, is_file) of a listing's files and of all folders around them."""
    parts = F.split("rel", "/")
    folders = listing.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("path"))
    nested = folders.where("path <> ''").distinct().select("path", F.lit(False).alias("is_file"))
    return listing.select(F.col("rel").alias("path"), F.lit(True).alias("is_file")).union(nested)


def discover(entries: DataFrame, dump: str = ".dump", database: str = ".sql", preferred: str = "database.sql") -> DataFrame:
    """One row (dump, database, archive_dir): what a restore takes of the entries (path, is_file) of a backup; null where there is none.

    Of several candidates: the preferred name, else the least depth, else the
    first path; of folders named archive the one of least depth. Names are
    compared in lower case.
    """
    name, depth = F.lower(F.element_at(F.split("path", "/"), -1)), F.size(F.split("path", "/"))
    best = lambda suffix, wanted: F.min(
        F.when(F.col("is_file") & name.endswith(suffix), F.struct((name != wanted).alias("other"), depth.alias("depth"), "path"))
    )["path"]
    folder = F.min(F.when(~F.col("is_file") & (name == "archive"), F.struct(depth.alias("depth"), "path")))["path"]
    return entries.agg(best(dump, "").alias("dump"), best(database, preferred).alias("database"), folder.alias("archive_dir"))


def wait_for_file(path: str, seconds: float = 15.0, pause: float = 0.5, cancel: threading.Event | None = None) -> str:
    """The path, once a file is there; :class:`FileMissing` after ``seconds``, :class:`Cancelled` as soon as ``cancel`` is set. A blank path is an error."""
    if not path.strip():
        raise InvalidPath("path is empty")
    cancel, end = cancel or threading.Event(), time.monotonic() + seconds
    while not cancel.is_set():
        if os.path.isfile(path):
            return path
        if (left := end - time.monotonic()) <= 0:
            raise FileMissing(path)
        cancel.wait(min(pause, left))
    raise Cancelled(path)
