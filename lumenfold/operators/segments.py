"""A stored search index that is kept up with the documents.

An index consists of segments, written once each: the postings of the documents
of one addition, a row per term of a document's field with the positions as an
array, sorted by term and stored as differences. Adding documents writes their own
segment; deleting writes tombstones. A document that is added again counts as
its newest segment has it. Segments of about the same size are merged from time
to time, which leaves out what is dead.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.terms import blocks, near_terms, neighbourhood
from lumenfold.session import keep
from lumenfold.sources.store import Store, newest

#: Bytes of text, and rows of a merge, whose postings make about one file of a segment: what a task sorts, in about 12 times the text's memory.
TEXT_PER_FILE, ROWS_PER_FILE = 4 << 20, 500_000
#: A merge takes together this many segments of about the same size.
FAN = 8
#: Up to so many matching terms are looked up by equality in the sorted files, more of them by their range.
LISTED = 24
# Integers and sorted strings as differences, by the file format.
_DELTAS = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false", "compression": "zstd"}
_POSTINGS = "term string, doc long, field int, positions array<int>, first boolean"
_TERMS = "term string, occurrences long, documents long"
_NEAR = "variant long, term string"
_DOCS = "id string, doc long, segment int, gone boolean"


class Index:
    KEYS = ["segment", "doc"]

    def __init__(self, store: Store, name: str = "search"):
        self.store = store
        self.postings, self.terms, self.near, self.docs = (f"{name}-{x}" for x in ("postings", "terms", "near", "docs"))

    def _write(self, held: DataFrame, postings: DataFrame, files: int, key: tuple[str, int] | None = None) -> tuple[DataFrame, int]:
        """A segment of ``postings`` (term, doc, field, positions, first; dealt over ``files`` tasks) and ``held`` (id, doc): its rows for the table of documents, and its number (-1: taken in already)."""
        rows = postings.select("term", F.col("doc").cast("long"), F.col("field").cast("int"), "positions", "first")
        # Each task sorts its own postings, which are not shuffled for it.
        segment = self.store.append(self.postings, rows.sortWithinPartitions("term", "doc", "field"), key=key, options=_DELTAS)
        if segment >= 0:
            own = self.store.read(self.postings, _POSTINGS, parts=[segment])
            counted = keep(own.groupBy("term").agg(F.sum(F.size("positions")).alias("occurrences"), F.count_if("first").alias("documents")), "terms")
            # A shuffle even for a single file: merging partitions without one would compute the table itself in one task.
            self.store.append(self.terms, counted.repartitionByRange(1 + files // 32, "term").sortWithinPartitions("term"), part=segment, options=_DELTAS)
            self.store.append(self.near, neighbourhood(counted), part=segment, options=_DELTAS)
        return held.select("id", "doc", F.lit(segment).alias("segment"), F.lit(False).alias("gone")), segment

    def build(self, documents: DataFrame) -> None:
        """One segment of all documents, in place of everything."""
        old = {name: self.store.parts(name) for name in (self.postings, self.terms, self.near)}
        rows, _ = self._write(*self._inverted(documents))
        self.store.write(self.docs, rows)  # from here on the new segment counts
        for name, parts in old.items():
            self.store.forget(name, parts)

    def _inverted(self, documents: DataFrame) -> tuple[DataFrame, DataFrame, int]:
        texts = ["id", "title", "filename", "domain", "content"]
        size = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in texts])
        named = keep(documents.select(*texts).withColumn("doc", F.monotonically_increasing_id()).withColumn("size", size), "numbered")
        total = named.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        files = 1 + total // TEXT_PER_FILE
        return named.select("id", "doc"), blocks(named.drop("size"), key="doc", tasks=files), files

    def add(self, documents: DataFrame, key: tuple[str, int] | None = None) -> None:
        """A segment of these documents; those that are there already under their ids are replaced. Nothing else is read or written."""
        rows, segment = self._write(*self._inverted(documents), key)
        if segment >= 0:
            self.store.append(self.docs, rows, key=key)

    def remove(self, ids: DataFrame) -> None:
        """Tombstones for ids (id)."""
        self.store.append(self.docs, ids.select("id", F.lit(None).cast("long").alias("doc"), F.lit(None).cast("int").alias("segment"), F.lit(True).alias("gone")))

    def alive(self) -> DataFrame:
        """(segment, doc, id) of the documents that count."""
        listed = self.store.parts(self.docs)
        rows = self.store.read(self.docs, _DOCS, True)
        order = F.get(F.lit([listed.index(k) if k in listed else -1 for k in range(max(listed, default=0) + 1)]), F.col("part"))
        rows = rows.withColumn("at", order)
        if len(listed) > 1:
            rows = newest(rows, rows.where("at > 0").select("id", "at"))
        return rows.where("not coalesce(gone, false)").select("segment", "doc", "id")

    def merge(self) -> list[int]:
        """Merge the smallest ``FAN`` or more segments of about the same size, if there are so many. The numbers of those merged."""
        alive = keep(self.alive(), "alive")
        sizes = {r["segment"]: r["count"] for r in alive.groupBy("segment").count().collect()}  # a row per segment
        parts = {r["part"]: r["segment"] for r in self.store.read(self.docs, _DOCS, True).where("segment is not null").select("part", "segment").distinct().collect()}
        tiers: dict[int, list[int]] = {}
        for segment in set(parts.values()):
            tiers.setdefault(int(math.log(max(1, sizes.get(segment, 0)), FAN)), []).append(segment)
        ready = [sorted(tiers[t]) for t in sorted(tiers) if len(tiers[t]) >= FAN]
        if not ready:
            return []
        old = ready[0]
        rows = keep(alive.where(F.col("segment").isin(old)).withColumn("new", F.monotonically_increasing_id()), "renumbered")
        held = self.store.read(self.postings, _POSTINGS, True, [k for k in self.store.parts(self.postings) if k in old])
        moved = held.join(rows, (F.col("part") == F.col("segment")) & (held["doc"] == rows["doc"])).select("term", F.col("new").alias("doc"), "field", "positions", "first")
        files = 1 + held.count() // ROWS_PER_FILE
        written, _ = self._write(rows.select("id", F.col("new").alias("doc")), moved.repartition(files, "term", "doc"), files)
        # One change makes the merged segment count and the others not.
        self.store.replace(self.docs, [p for p, s in parts.items() if s in old], written)
        for name in (self.postings, self.terms, self.near):
            self.store.forget(name, old)  # the parts of its three tables have a segment's number
        return old

    def matches(self, wanted: list[str]) -> DataFrame:
        """(term, no, typos, exact) of the stored terms that match; a written table."""
        return keep(near_terms(self.store.read(self.near, _NEAR), self.store.read(self.terms, _TERMS), wanted), "matches")

    def hits(self, matches: DataFrame, only: DataFrame | None = None) -> DataFrame:
        """The postings of matching terms; ``only`` (segment, doc, id: a page of hits) for some documents, with their ids."""
        rows = self.store.read(self.postings, _POSTINGS, True).withColumnRenamed("part", "segment")
        few = [r["term"] for r in matches.select("term").distinct().limit(LISTED + 1).collect()]
        if 0 < len(few) <= LISTED:
            rows = rows.where(reduce(lambda a, b: a | b, [F.col("term") == t for t in few]))
        else:
            low, high = matches.agg(F.min("term"), F.max("term")).first()
            rows = rows.where(F.col("term").between(low, high)) if low is not None else rows.limit(0)
        if only is not None:
            docs = [r["doc"] for r in only.select("doc").distinct().collect()]  # a page of hits
            rows = rows.where(F.col("doc").isin(docs)).join(F.broadcast(only.select("segment", "doc", "id")), self.KEYS)
        return rows.join(matches, "term")

    def named(self, ranked: DataFrame) -> DataFrame:
        """``ranked`` rows of documents that count, with their ids."""
        return ranked.join(self.alive(), self.KEYS)

    def counted(self) -> DataFrame:
        """(term, occurrences, documents) over all segments; dead documents count until they are merged away."""
        return self.store.read(self.terms, _TERMS).groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("documents").alias("documents"))
