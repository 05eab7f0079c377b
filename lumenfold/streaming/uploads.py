"""Pages that arrive in a folder, as a stream into the document and count tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lumenfold.operators import stats
from lumenfold.operators.segments import Index
from lumenfold.schemas import DOCUMENTS
from lumenfold.sources.archive import documents, html_files
from lumenfold.sources.store import Store, resolved, stored_counts, stored_documents


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """(domain, filename, html, arrived) of html files that appear below ``folder``/<domain>/, at any depth, as a scan finds them."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    root = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/") + "/"
    outside = F.raise_error(F.concat(F.lit(f"not below {root}: "), "path"))
    rel = F.when(F.startswith("path", F.lit(root)), F.substring("path", len(root) + 1, 1 << 30)).otherwise(outside)
    listing = files.select(
        rel.alias("rel"), F.col("path").alias("abs_path"), F.decode("content", "UTF-8").alias("html"), F.col("modificationTime").alias("arrived")
    )
    return html_files(listing, "html", "arrived").select("domain", "filename", "html", "arrived")


def hourly_counts(pages: DataFrame, late: str = "1 hour") -> DataFrame:
    """Files per domain and hour of arrival; state older than the watermark is dropped."""
    windowed = pages.withWatermark("arrived", late).groupBy(F.window("arrived", "1 hour"), F.col("domain").alias("source"))
    return windowed.agg(F.count("*").alias("file_count")).select("window.start", "source", "file_count")


def ingest(pages: DataFrame, store: Store, checkpoint: str, index: Index | None = None) -> DataStreamWriter:
    """Writer that adds each batch to the stored documents and counts, and to the index if there is one.

    A batch writes its own documents and the counts of those that were not there
    before; nothing else is written again. Of what is stored only the ids are
    read. A batch that runs again after a failure replaces itself.
    """

    def add(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("domain", "filename").agg(F.max_by("html", "arrived").alias("html"))
        key = (checkpoint, number)
        part = store.append("documents", documents(newest)[0], key=key)
        if part < 0:  # a whole table has taken this batch in
            return
        own = store.read("documents", DOCUMENTS, parts=[part])
        listed = store.parts("documents")
        before = resolved(store, "documents", DOCUMENTS, listed[: listed.index(part)]).select("id")
        store.append("stats", stats.count_by_source(own.join(before, "id", "left_anti")), key=key)
        if index:
            index.add(own, key=key)

    return pages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)


def compact(store: Store) -> None:
    """Make one part of each table's changes, once a stream has caught up."""
    for name, table in (("documents", stored_documents(store)), ("stats", stored_counts(store))):
        store.write(name, table)
        store.vacuum(name)
