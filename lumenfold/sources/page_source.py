"""Archive folders as a Spark data source: ``spark.read.format("archive_pages")``, its stream and its writer.

Rows are (domain, filename, html), a row per html file below <path>/<domain>/.
A partition reads some of the domains' folders; a filter on the domain is taken
by the source, so other folders are not even listed. The folder is on a file
system that driver and executors have mounted.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

_HTML = re.compile(r"\.html?\Z", re.IGNORECASE)
#: Partitions of a read at most.
PARTITIONS = 1024


@dataclass
class Folders(InputPartition):
    names: list[str]


@dataclass
class Files(InputPartition):
    rels: list[str]


@dataclass
class Written(WriterCommitMessage):
    folder: str


def _domains(root: str) -> list[str]:
    with os.scandir(root) as entries:
        return sorted(e.name for e in entries if e.is_dir(follow_symlinks=False) and e.name.lower() != "temporary" and not e.name.startswith(".write-"))


def _pages(root: str, domain: str) -> Iterator[str]:
    """Paths below the domain's folder of its pages; links to folders are not followed."""
    base = os.path.join(root, domain)
    for at, folders, names in os.walk(base):
        folders.sort()
        for name in sorted(names):
            if _HTML.search(name):
                yield os.path.relpath(os.path.join(at, name), base)


def _row(root: str, domain: str, filename: str) -> tuple[str, str, str]:
    with open(os.path.join(root, domain, filename), encoding="utf-8", errors="replace", newline="") as file:
        return domain.strip(), filename, file.read()


class PageReader(DataSourceReader):
    def __init__(self, root: str):
        self.root, self.only = root, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take what says which domains; give the rest back."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("domain",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = wanted if self.only is None else self.only & wanted
            elif not isinstance(f, IsNotNull):  # no column is ever null
                yield f

    def partitions(self) -> list[Folders]:
        names = [d for d in _domains(self.root) if self.only is None or d.strip() in self.only]
        n = max(1, min(PARTITIONS, len(names)))
        return [Folders(names[k::n]) for k in range(n)]

    def read(self, partition: Folders) -> Iterator[tuple[str, str, str]]:
        for domain in partition.names:
            for filename in _pages(self.root, domain):
                yield _row(self.root, domain, filename)


class PageStreamReader(DataSourceStreamReader):
    """Files in the order of their times of change; an offset is the last one's time and path."""

    #: Files of a batch at most, and of a partition.
    BATCH, PART = 100_000, 1000

    def __init__(self, root: str):
        self.root = root

    def _after(self, start: dict, most: int | None = None, end: dict | None = None) -> list[tuple[int, str]]:
        low, high = (start["time"], start["path"]), (end["time"], end["path"]) if end else None
        found = []
        for domain in _domains(self.root):
            for filename in _pages(self.root, domain):
                rel = f"{domain}/{filename}"
                place = (os.stat(os.path.join(self.root, rel)).st_mtime_ns, rel)
                if place > low and (high is None or place <= high):
                    found.append(place)
        return sorted(found)[:most]

    def initialOffset(self) -> dict:
        self.latest = {"time": 0, "path": ""}
        return self.latest

    def latestOffset(self) -> dict:
        new = self._after(getattr(self, "latest", {"time": 0, "path": ""}), self.BATCH)
        if new:
            self.latest = {"time": new[-1][0], "path": new[-1][1]}
        return getattr(self, "latest", {"time": 0, "path": ""})

    def partitions(self, start: dict, end: dict) -> list[Files]:
        self.latest = end
        rels = [rel for _, rel in self._after(start, None, end)]
        return [Files(rels[k : k + self.PART]) for k in range(0, len(rels), self.PART)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple[str, str, str]]:
        for rel in partition.rels:
            domain, _, filename = rel.partition("/")
            yield _row(self.root, domain, filename)


class PageWriter(DataSourceWriter):
    """Each task writes to a hidden folder of its own; the commit moves the files to their places, an abort deletes them."""

    def __init__(self, root: str):
        self.root = root

    def write(self, rows: Iterator) -> Written:
        folder = os.path.join(self.root, f".write-{uuid.uuid4().hex}")
        os.makedirs(folder)
        for row in rows:
            rel = os.path.join(row.domain or "", row.filename or "")
            if any(part in ("", ".", "..") for part in rel.split("/")):
                shutil.rmtree(folder)
                raise ValueError(f"bad path {rel!r}")
            os.makedirs(os.path.dirname(os.path.join(folder, rel)), exist_ok=True)
            with open(os.path.join(folder, rel), "w", encoding="utf-8", newline="") as out:
                out.write(row.html or "")
        return Written(folder)

    def commit(self, messages: list[Written | None]) -> None:
        for message in messages:
            for at, _, names in os.walk(message.folder):
                target = os.path.join(self.root, os.path.relpath(at, message.folder))
                os.makedirs(target, exist_ok=True)
                for name in names:
                    os.replace(os.path.join(at, name), os.path.join(target, name))
            shutil.rmtree(message.folder)

    def abort(self, messages: list[Written | None]) -> None:
        for message in messages:
            if message is not None:
                shutil.rmtree(message.folder, ignore_errors=True)


class ArchivePages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive_pages"

    def schema(self) -> str:
        return "domain string, filename string, html string"

    def _root(self) -> str:
        root = (self.options.get("path") or "").removeprefix("file://").rstrip("/")
        if not root.strip():
            raise ValueError("archive location is empty")
        return root

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(self._root())

    def streamReader(self, schema: StructType) -> PageStreamReader:
        return PageStreamReader(self._root())

    def writer(self, schema: StructType, overwrite: bool) -> PageWriter:
        return PageWriter(self._root())


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let it take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchivePages)
