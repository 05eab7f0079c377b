"""Parquet tables made of immutable parts: a change adds a part or puts one in place of others."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.schemas import DOCUMENTS, STATS


class Store:
    """Tables below a folder of any file system that Spark writes.

    A table's parts are numbered folders; the newest state file lists those that
    count. It is written after all data of a change is there, so a reader sees
    the table before or after a change. One writer at a time: of two, the later
    one fails. Parts no longer listed stay until ``vacuum``.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, name: str) -> list[str]:
        path = self._path(f"{self.root}/{name}")
        return [f.getPath().getName() for f in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def version(self, name: str) -> int:
        """The number of changes so far, 0 if the table is absent."""
        return max((int(n.removeprefix("STATE-")) for n in self._names(name) if n.startswith("STATE-")), default=0)

    def _state(self, name: str) -> dict:
        """parts, next free number, key of a part -> its number, stream -> number of its last batch that a whole write has taken in."""
        if not (version := self.version(name)):
            return {"parts": [], "next": 0, "keys": {}, "taken": {}}
        stream = self._fs.open(self._path(f"{self.root}/{name}/STATE-{version}"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _commit(self, name: str, state: dict) -> None:
        out = self._fs.create(self._path(f"{self.root}/{name}/STATE-{self.version(name) + 1}"), False)
        out.write(json.dumps(state).encode())
        out.close()

    def _put(self, name: str, part: int, table: DataFrame, partitions: tuple[str, ...], options: dict[str, str] | None) -> None:
        table.write.mode("overwrite").options(**(options or {})).partitionBy(*partitions).parquet(f"{self.root}/{name}/part={part}")

    def parts(self, name: str) -> list[int]:
        return self._state(name)["parts"]

    def read(self, name: str, schema: str | None = None, numbered: bool = False, parts: list[int] | None = None) -> DataFrame:
        """The rows of all parts (or of some), with their ``part`` if ``numbered``; a table that is absent is empty, or an error without a schema."""
        found = self.parts(name) if parts is None else parts
        if not found:
            if schema is None:
                raise KeyError(name)
            return self.spark.createDataFrame([], f"{schema}, part int" if numbered else schema)
        reader = self.spark.read.option("basePath", f"{self.root}/{name}")
        reader = reader if schema is None else reader.schema(f"{schema}, part int")
        table = reader.parquet(*[f"{self.root}/{name}/part={k}" for k in found])
        return table if numbered else table.drop("part")

    def write(self, name: str, table: DataFrame, *partitions: str, options: dict[str, str] | None = None) -> int:
        """``table``, which may read this one, in place of all parts."""
        return self.replace(name, self.parts(name), table, *partitions, options=options)

    def append(self, name: str, table: DataFrame, *partitions: str, key: tuple[str, int] | None = None, part: int | None = None, options: dict[str, str] | None = None) -> int:
        """Add a part, under the number ``part`` if one is given; a ``key`` (stream, batch) that comes again replaces its own part, and does nothing once a whole write has taken it in."""
        state = self._state(name)
        if key and key[1] <= state["taken"].get(key[0], -1):
            return -1
        written = f"{key[0]}:{key[1]}" if key else ""
        part = state["keys"].get(written, state["next"]) if part is None else part
        self._put(name, part, table, partitions, options)
        if part not in state["parts"]:
            state["parts"].append(part)
            state["next"] = max(state["next"], part + 1)
            if key:
                state["keys"][written] = part
            self._commit(name, state)
        return part

    def replace(self, name: str, old: list[int], table: DataFrame, *partitions: str, options: dict[str, str] | None = None) -> int:
        """``table`` as one part in place of the parts ``old``; it stands where the last of them stood."""
        state = self._state(name)
        part = state["next"]
        self._put(name, part, table, partitions, options)
        after = [k for k in state["parts"] if old and k > max(old)]
        before = [k for k in state["parts"] if k not in old and k not in after]
        for written, k in list(state["keys"].items()):
            if k in old:
                stream, _, batch = written.rpartition(":")
                state["taken"][stream] = max(state["taken"].get(stream, -1), int(batch))
                del state["keys"][written]
        state["parts"], state["next"] = [*before, part, *after], part + 1
        self._commit(name, state)
        return part

    def forget(self, name: str, old: list[int]) -> None:
        """Take parts off the list."""
        state = self._state(name)
        state["parts"] = [k for k in state["parts"] if k not in old]
        self._commit(name, state)

    def vacuum(self, name: str) -> None:
        """Delete what no state lists any more, while nobody reads it."""
        version, listed = self.version(name), {f"part={k}" for k in self.parts(name)}
        for entry in self._names(name):
            if entry.startswith("part=") and entry not in listed or entry.startswith("STATE-") and entry != f"STATE-{version}":
                self._fs.delete(self._path(f"{self.root}/{name}/{entry}"), True)


def newest(rows: DataFrame, order: DataFrame, key: str = "id") -> DataFrame:
    """Those of ``rows`` (key, ``at``, ...) that no row of ``order`` (key, at) of the same key comes after.

    ``order`` are the changes after the first part, as a rule few rows: what is
    large is neither shuffled nor sorted then.
    """
    later = order.groupBy(F.col(key).alias("_key")).agg(F.max("at").alias("_at"))
    return rows.join(later, (F.col(key) == F.col("_key")) & (F.col("at") < F.col("_at")), "left_anti")


def resolved(store: Store, name: str, schema: str, parts: list[int] | None = None) -> DataFrame:
    """A table of changes by ``id`` as of now: of each id the rows of its last part, without those marked ``gone``."""
    listed = store.parts(name) if parts is None else parts
    place = {part: k for k, part in enumerate(listed)}
    rows = store.read(name, f"{schema}, gone boolean", True, listed)
    numbered = rows.withColumn("at", F.get(F.lit([place.get(k, -1) for k in range(max(listed, default=0) + 1)]), F.col("part")))
    columns = [part.split()[0] for part in schema.split(", ")]
    if len(listed) > 1:
        numbered = newest(numbered, numbered.where("at > 0").select("id", "at"))
    return numbered.where("not coalesce(gone, false)").select(*columns)


def stored_documents(store: Store) -> DataFrame:
    """All documents, each as its last change has it: the one truth for lookups, checks and streams."""
    return resolved(store, "documents", DOCUMENTS)


def stored_counts(store: Store) -> DataFrame:
    """The counts: the first part's, with all changes added; a source that changes bring to 0 goes."""
    summed = store.read("stats", STATS).groupBy("source").agg(F.sum("file_count").alias("file_count"), F.count("*").alias("n"))
    return summed.where("file_count > 0 or n = 1").select("source", "file_count")
