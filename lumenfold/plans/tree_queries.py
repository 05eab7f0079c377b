"""Registered queries over an archive folder, which tasks write from the pages table first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.urls import resolved
from lumenfold.operators import lifecycle, manifest, stats
from lumenfold.operators.issues import label
from lumenfold.operators.lifecycle import Archive
from lumenfold.plans import tables
from lumenfold.session import mounted_path, scratch_path
from lumenfold.sources.archive import count_html, html_files, list_files, read_pages, unattributed, write_pages
from lumenfold.sources.store import Store
from lumenfold.sources.zip_files import safe_entry, unzip_backup, zip_backup


def placed(spark: SparkSession, sf_dir: str, untitled: bool = True) -> DataFrame:
    """(rel, html) of every page: most in their domain's folder, some elsewhere, some deeper, some without a title."""
    kind, name = F.col("page_id") % 50, F.col("page_id").cast("string")
    own = lambda before, after: F.concat(F.lit(before), "domain", F.lit("/"), *after)
    rel = (
        F.when(kind == 0, F.concat(F.lit("Temporary/"), name, F.lit(".html"))).when(kind == 1, F.concat(name, F.lit(".html")))
        .when(kind == 2, own("", [name, F.lit(".txt")])).when(kind == 3, own("", [F.lit("deep/er/"), name, F.lit(".HTM")]))
        .when(kind == 4, own("_", [name, F.lit(".html")])).otherwise(own("", [name, F.lit(".html")]))
    )
    plain = F.regexp_replace("html", "(?i)</?title>", "")
    html = F.when(F.col("page_id") % 13 == 0, plain).otherwise(F.col("html")) if untitled else F.col("html")
    return tables.pages(spark, sf_dir).select(rel.alias("rel"), html.alias("html"))


def _tree(spark: SparkSession, sf_dir: str, untitled: bool = True) -> str:
    root = mounted_path(spark, "tree")
    write_pages(placed(spark, sf_dir, untitled), root)
    return root


def _archive(spark: SparkSession, sf_dir: str, untitled: bool = True) -> Archive:
    """The folder with tables that partly disagree with it."""
    archive = Archive(spark, _tree(spark, sf_dir, untitled), Store(spark, scratch_path(spark, "store")))
    held = tables.pages(spark, sf_dir)
    row = lambda mark: [F.concat(F.lit(mark), F.col("page_id").cast("string")).alias("id"), F.lit("t").alias("title"), "filename", "domain", F.lit("").alias("content")]
    archive.store.write("documents", held.select(*row("d")).union(held.where("page_id % 11 = 0").select(*row("x"))))
    archive.store.write("stats", tables.counted(spark, sf_dir))
    return archive


def _files(spark: SparkSession, root: str) -> DataFrame:
    return html_files(list_files(spark, root))


def archive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, _tree(spark, sf_dir)).select("domain", "filename", "request_path")


def scan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.count_by_source(_files(spark, _tree(spark, sf_dir)))


def scan_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_html(list_files(spark, _tree(spark, sf_dir)))


def scan_unattributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unattributed(list_files(spark, _tree(spark, sf_dir))).select("code", "severity", "store", "filename", "path", "recoverable")


def scan_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page read back from its file."""
    read = read_pages(_files(spark, _tree(spark, sf_dir)))
    return read.select("domain", "filename", F.length("html").cast("long").alias("n"), F.md5("html").alias("h"))


def archive_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _archive(spark, sf_dir).check().select("code", "severity", "store", "domain", "filename", "message", "recoverable")


def archive_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues after some pages lost their titles, found by the manifest of a check before."""
    archive = _archive(spark, sf_dir, untitled=False)
    manifest.recheck(archive)
    write_pages(placed(spark, sf_dir).join(placed(spark, sf_dir, False).withColumnRenamed("html", "old"), "rel").where("html <> old").select("rel", "html"), archive.root)
    return manifest.recheck(archive)[0].select("code", "severity", "store", "domain", "filename", "message", "recoverable")


def zip_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page after the folder was packed to one zip file and unpacked from it."""
    base = mounted_path(spark, "zipped")
    root = _tree(spark, sf_dir)
    zip_backup(spark, root, f"{root}.zip")
    unzip_backup(spark, f"{root}.zip", base)
    read = read_pages(_files(spark, base))
    return read.select("domain", "filename", F.length("html").cast("long").alias("n"), F.md5("html").alias("h"))


def issue_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each issue is, as one line, and how often that line comes."""
    lines = _archive(spark, sf_dir).check().select(label("store", "domain", "filename").alias("line"))
    return lines.groupBy("line").agg(F.count("*").alias("n"))


def archive_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left after both tables were built anew."""
    return _archive(spark, sf_dir).repair().select("code", "domain", "filename")


def archive_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = _archive(spark, sf_dir)
    archive.rebuild(strict=False)
    return archive.docs().select("id", "domain", "filename", "title")


def archive_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts after they were taken from the files."""
    return _archive(spark, sf_dir).refresh_counts()


def _one(spark: SparkSession, sf_dir: str) -> str:
    row = tables.pages(spark, sf_dir).where("page_id = 7").first()
    return f"/archive/{row['domain']}/{row['filename']}"


def archive_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and counts after one page was deleted by its path."""
    archive = _archive(spark, sf_dir)
    archive.delete(_one(spark, sf_dir))
    docs = archive.docs().groupBy(F.col("domain").alias("source")).agg(F.count("*").alias("documents"))
    return docs.join(archive.counts(), "source", "full_outer").select("source", "documents", "file_count")


def archive_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by title and counts after two pages were added, one of them in place of an old one."""
    archive = _archive(spark, sf_dir)
    _, _, domain, name = _one(spark, sf_dir).split("/")
    archive.add_file(domain, "added.html", "<title>Added</title>")
    archive.add_file(domain, name, "<title>Added</title>")
    added = archive.docs().where("title = 'Added'").groupBy(F.col("domain").alias("source")).agg(F.count("*").alias("added"))
    return added.join(archive.counts(), "source", "full_outer").select("source", "added", "file_count")


def archive_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages after a backup, a deletion and the restoring of the backup."""
    archive = _archive(spark, sf_dir, untitled=False)
    target = mounted_path(spark, "backup")
    archive.backup(target)
    archive.delete(_one(spark, sf_dir))
    archive.restore(target)
    read = read_pages(_files(spark, archive.root)).join(archive.docs().select("domain", "filename", "title"), ["domain", "filename"])
    return read.select("domain", "filename", "title", F.md5("html").alias("h"))


def restore_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a restore takes, for each of many backups: here a backup is a domain, and its pages' paths are the entries."""
    name = F.col("page_id").cast("string")
    kind = F.col("page_id") % 5
    path: Column = (
        F.when(kind == 0, F.concat(F.lit("a/b/"), name, F.lit(".DUMP"))).when(kind == 1, F.concat(F.lit("x/"), name, F.lit(".dump")))
        .when(kind == 2, F.concat(name, F.lit("/deep/Database.SQL"))).when(kind == 3, F.concat(name, F.lit(".sql"))).otherwise(F.concat(name, F.lit("/Archive")))
    )
    entries = tables.pages(spark, sf_dir).select(path.alias("path"), (kind != 4).alias("is_file"))
    return lifecycle.discover(entries)


def zip_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which names of a zip file would stay below its folder."""
    name, kind = F.col("page_id").cast("string"), F.col("page_id") % 5
    path = (
        F.when(kind == 0, F.concat(F.lit("backup/archive/"), name)).when(kind == 1, F.concat(F.lit("/etc/"), name)).when(kind == 2, F.concat(F.lit("a/../"), name))
        .when(kind == 3, F.concat(F.lit("..\\"), name)).otherwise(F.concat(F.lit("a..b/"), name))
    )
    return tables.pages(spark, sf_dir).select("page_id", path.alias("path")).select("page_id", safe_entry("path").alias("safe"))


def request_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request paths and urls resolved to domain and filename, or refused."""
    kind, path = F.col("page_id") % 5, F.concat(F.lit("archive/"), "domain", F.lit("/a%20b/"), "filename")
    raw = (
        F.when(kind == 0, F.concat(F.lit("/"), path)).when(kind == 1, F.concat(F.lit(" "), path)).when(kind == 2, F.concat(F.lit("https://h.example/"), path, F.lit("?q=1")))
        .when(kind == 3, F.concat(F.lit("/archive/"), "domain", F.lit("/../"), "filename")).otherwise(F.concat(F.lit("/other/"), "filename"))
    )
    found = resolved(tables.pages(spark, sf_dir).select("page_id", raw.alias("path")))
    return found.select("page_id", "domain", "filename", F.col("error").isNotNull().alias("refused"))


QUERIES = {
    f.__name__: f
    for f in (
        archive_scan, scan_counts, scan_total, scan_unattributed, scan_content, archive_check, archive_recheck, zip_content, issue_labels, archive_repair, archive_rebuild, archive_refresh,
        archive_delete, archive_add, archive_restore, restore_candidates, zip_entries, request_paths,
    )
}
