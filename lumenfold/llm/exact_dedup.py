"""Exact deduplication against a persistent index of text digests.

The index is a table (digest, keep_id), bucketed and sorted by digest. New data
is reduced to one row per digest, deduplicated by a sort-merge anti-join with
the index and appended; the index side of that join is not shuffled. Of equal
texts the row with the largest doc_id stays, so a text that comes again under a
larger doc_id is appended once more, and an entry counts as long as no larger
one of its digest exists. Adding the same data again appends nothing.

Everything runs as DataFrame functions. Digests, not texts, are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import hot_keys, salted_join
from lumenfold.session import keep


def digest_of(text: Column | str) -> Column:
    """SHA-256 of the text in UTF-8 as it is; null counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


class DigestIndex:
    """A catalog table of digests; with ``path``, one that a later session finds there again."""

    def __init__(self, spark: SparkSession, name: str, path: str | None = None, buckets: int | None = None):
        self.spark, self.name = spark, name
        if not spark.catalog.tableExists(name):
            n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            place = f" LOCATION '{path}'" if path else ""
            spark.sql(
                f"CREATE TABLE {name} (digest BINARY, keep_id BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {n} BUCKETS{place}"
            )

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def current(self) -> DataFrame:
        """(digest, keep_id): one row per digest; the buckets hold a digest's entries together, so nothing is shuffled."""
        return self.entries().groupBy("digest").agg(F.max("keep_id").alias("keep_id"))

    def fresh(self, groups: DataFrame) -> DataFrame:
        """The rows of ``groups`` (digest, keep_id, ...) that no entry covers: new digests, and known ones with a larger id."""
        known = self.entries().hint("merge").alias("i")
        covered = F.coalesce(F.col("i.keep_id") >= F.col("g.keep_id"), F.col("g.keep_id").isNull())
        return groups.alias("g").join(known, (F.col("g.digest") == F.col("i.digest")) & covered, "left_anti")

    def add(self, digests: DataFrame) -> None:
        """Take in rows (doc_id, digest, ...): what no entry covers is appended to its buckets."""
        groups = digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
        self.fresh(groups).select("digest", "keep_id").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def compacted(self, name: str, path: str | None = None, buckets: int | None = None) -> DigestIndex:
        """A new index of the current entries alone; this one stays as it is."""
        other = DigestIndex(self.spark, name, path, buckets)
        other.add(self.current().select(F.col("keep_id").alias("doc_id"), "digest"))
        return other

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def _digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, row) of each row, written once: ``row`` tells repeated rows apart."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of(F.col("text")).alias("digest"))
    return keep(plain.withColumn("row", F.monotonically_increasing_id()), "digests")


def exact_duplicates(docs: DataFrame, index: DigestIndex, arrivals: int = 1) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, ...): doc_id, keep_id, group_size, kept, text_sha256.

    The rows are taken into ``index`` in so many arrivals, each deduplicated
    against the entries of all before it. ``keep_id`` is the largest doc_id of
    the text in the index afterwards, ``group_size`` the number of rows of
    ``docs`` with the text. Of rows that share text and doc_id one is kept. A
    null text is an empty one. A row without doc_id ranks below all others; a
    group of such rows only has a null ``keep_id``, and one of them is kept.
    Other columns are ignored; an empty table gives an empty result and appends
    nothing.
    """
    digests = _digests(docs)
    for k in range(arrivals):
        index.add(digests.where(F.pmod(F.xxhash64("row"), F.lit(arrivals)) == k))
    sizes = digests.groupBy("digest").agg(
        F.count("*").alias("n"), F.max("doc_id").alias("largest"), F.max_by("row", "doc_id").alias("its_row"), F.min("row").alias("any_row")
    )
    # One row per digest on each side; the index's id decides.
    groups = keep(sizes.join(index.current(), "digest").select("digest", "n", "keep_id", F.coalesce("its_row", "any_row").alias("chosen")), "groups")
    joined = salted_join(digests, groups, ["digest"], hot_keys(groups, ["digest"]), ["row"])
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("row") == F.col("chosen"))
    return joined.select("doc_id", "keep_id", F.col("n").alias("group_size"), stays.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def new_documents(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of ``docs`` to store, one per text that ``index`` did not cover yet, with all their columns; the index then covers them.

    Rows that share text and doc_id are brought down to one before any join, so
    every key of the join has a single row. Nulls are as in :func:`exact_duplicates`.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), digest_of(F.col("text")).alias("digest"), F.col("doc_id").cast("long").alias("id"))
    once = whole.groupBy("digest", "id").agg(F.first("row").alias("row"))
    groups = whole.groupBy("digest").agg(F.max("id").alias("keep_id"))
    fresh = keep(index.fresh(groups).select(F.col("digest").alias("of"), "keep_id"), "fresh")
    found = once.join(fresh, (F.col("digest") == F.col("of")) & F.col("id").eqNullSafe(F.col("keep_id")))
    new = keep(found.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns]), "new-documents")
    index.add(fresh.select(F.col("keep_id").alias("doc_id"), F.col("of").alias("digest")))
    return new


ORACLE = """
with h as (select doc_id, sha256(coalesce(text, '')) text_sha256 from documents),
g as (select text_sha256, max(doc_id) keep_id, count(*) group_size from h group by 1)
select doc_id, keep_id, group_size, doc_id = keep_id kept, text_sha256 from h join g using (text_sha256)
"""
