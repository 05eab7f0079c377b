"""Reconciling page files, search documents and counts with each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.exprs import request_path, trimmed
from lumenfold.operators.issues import issue, merge, ordered

KEY = ["domain", "filename"]


def _keyed(table: DataFrame) -> DataFrame:
    return table.withColumns({c: trimmed(F.coalesce(c, F.lit(""))) for c in KEY})


def grouped_documents(documents: DataFrame) -> DataFrame:
    """(domain, filename, n, document_ids) of documents with a whole key."""
    whole = _keyed(documents).where("domain <> '' and filename <> ''")
    ids = F.array_sort(F.collect_list(F.when(F.col("id") != "", F.col("id"))))
    return whole.groupBy(*KEY).agg(F.count("*").alias("n"), ids.alias("document_ids"))


def compare_files(files: DataFrame, documents: DataFrame, parse_issues: DataFrame | None = None) -> DataFrame:
    """Issues between files and documents: blank keys, missing, duplicate and orphan documents.

    One full join of both sides on the key finds the last three at once.
    """
    blank = documents.where((trimmed(F.coalesce("domain", F.lit(""))) == "") | (trimmed(F.coalesce("filename", F.lit(""))) == ""))
    blanks = issue(blank.select("domain", "filename", F.array("id").alias("document_ids")), "doc_blank_key")
    here = _keyed(files).select(*KEY).withColumn("on_disk", F.lit(True))
    both = here.join(grouped_documents(documents), KEY, "full_outer")
    found = both.select(
        *KEY, "document_ids", request_path("domain", "filename").alias("path"),
        F.when(F.col("n").isNull(), "doc_missing").when(F.col("on_disk").isNull(), "doc_orphan").when(F.col("n") > 1, "doc_duplicate").alias("code"),
    ).where("code is not null")
    missing = found.where("code = 'doc_missing'")
    if parse_issues is not None:
        missing = missing.join(_keyed(parse_issues).select(*KEY), KEY, "left_anti")
    parts = [blanks, issue(missing, "doc_missing")]
    parts += [issue(found.where(F.col("code") == c), c) for c in ("doc_duplicate", "doc_orphan")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def compare_stats(disk: DataFrame, database: DataFrame) -> DataFrame:
    """(source, disk_count, db_count, code) where counts on disk and in the table differ; an absent row counts 0 there."""
    a = disk.select("source", F.col("file_count").alias("disk_count"))
    b = database.select("source", F.col("file_count").alias("db_count"))
    code = F.when(F.col("disk_count").isNull(), "stat_source_stale").otherwise("stat_source_mismatch")
    both = a.join(b, "source", "full_outer").withColumn("code", code)
    return both.where(F.col("disk_count").isNull() | (F.coalesce("db_count", F.lit(0)) != F.col("disk_count")))


def stat_issues(disk: DataFrame, database: DataFrame) -> DataFrame:
    """Issues of single sources and of the total."""
    differ = compare_stats(disk, database)
    text = F.format_string("%d files, %d counted", F.coalesce("disk_count", F.lit(0)), F.coalesce("db_count", F.lit(0)))
    by_source = [
        issue(differ.where(F.col("code") == c).withColumnRenamed("source", "domain"), c, text) for c in ("stat_source_mismatch", "stat_source_stale")
    ]
    totals = disk.agg(F.coalesce(F.sum("file_count"), F.lit(0)).alias("disk_count")).join(
        F.broadcast(database.agg(F.coalesce(F.sum("file_count"), F.lit(0)).alias("db_count"))), F.lit(True)
    ).where("disk_count <> db_count")
    return by_source[0].unionByName(by_source[1]).unionByName(issue(totals, "stat_total_mismatch", text))


def check(files: DataFrame, documents: DataFrame, disk: DataFrame, database: DataFrame, parse_issues: DataFrame | None = None) -> DataFrame:
    """All issues, each once, in a fixed order."""
    groups = [compare_files(files, documents, parse_issues), stat_issues(disk, database)]
    return ordered(merge(*groups, *([] if parse_issues is None else [parse_issues])))


def report(issues: DataFrame, files: DataFrame, documents: DataFrame) -> DataFrame:
    """One row of counts, and whether there is no issue at all."""
    counts = issues.agg(
        F.count_if("recoverable").alias("recoverable"), F.count_if(~F.col("recoverable")).alias("unrecoverable"), (F.count("*") == 0).alias("consistent")
    )
    sizes = files.agg(F.count("*").alias("html_files")).join(F.broadcast(documents.agg(F.count("*").alias("meili_documents"))), F.lit(True))
    return sizes.join(F.broadcast(counts), F.lit(True))


def repair(files_with_html: DataFrame, documents: DataFrame, database: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, counts, issues left) after building both anew from the files.

    What was lost for good before stays on record: unrecoverable issues of the
    first check are carried over.
    """
    from lumenfold.operators.stats import count_by_source
    from lumenfold.sources.archive import titled, with_text

    disk = count_by_source(files_with_html)
    good, parse_issues = titled(files_with_html)
    before = check(files_with_html, documents, disk, database, parse_issues).where("not recoverable")
    after = check(files_with_html, good.drop("html"), disk, disk, parse_issues)  # keys alone are compared: no text is made for that
    return with_text(good, "html", "content"), disk, ordered(merge(before, after))
