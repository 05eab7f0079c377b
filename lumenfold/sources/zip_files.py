"""Zip files by tasks: entries are unpacked and packed in parallel, each as a stream.

Unpacking reads the list of entries once and then seeks to each entry. Packing
lets each task write the records of its files to a part of its own; one task
then joins the parts and writes the list of entries after them. No entry is ever
held whole in memory, and files of any size are fine.
"""

from __future__ import annotations

import os
import shutil
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.schemas import ArchiveError, InvalidPath
from lumenfold.session import keep
from lumenfold.sources.archive import list_files

ENTRIES = "name string, method int, crc long, packed long, size long, at long"
PIECE = 1 << 20
#: Bytes that a task unpacks or packs at least, as far as files allow.
TASK_BYTES = 64 << 20
_LOCAL, _CENTRAL, _END, _WIDE_END, _LOCATOR = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
_UTF8, _DEFLATE, _VERSION, _FULL, _FULL_SHORT = 0x800, 8, 45, 0xFFFFFFFF, 0xFFFF


def safe_entry(path: Column | str) -> Column:
    """Whether a name in a zip file stays below the folder it is unpacked to."""
    plain = F.replace(F.col(path) if isinstance(path, str) else path, F.lit("\\"), F.lit("/"))
    return ~(plain.startswith("/") | F.exists(F.split(plain, "/"), lambda x: x == "..") | plain.rlike(r"^[./]*$"))


def zip_entries(spark: SparkSession, source: str) -> DataFrame:
    """(name, method, crc, packed, size, at) of a zip file's entries, folders left out; read by one task, once."""

    def listed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in ENTRIES.split(", ")]
        for part in parts:
            for path in part["path"]:
                with zipfile.ZipFile(path) as held:
                    rows = [(i.filename, i.compress_type, i.CRC, i.compress_size, i.file_size, i.header_offset) for i in held.infolist() if not i.is_dir()]
                for k in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[k : k + 10_000], columns=names)

    return keep(spark.createDataFrame([(source,)], "path string").mapInPandas(listed, ENTRIES), "entries")


def _pieces(file, at: int, packed: int, method: int) -> Iterator[bytes]:
    file.seek(at)
    header = file.read(30)
    if len(header) < 30 or struct.unpack_from("<I", header)[0] != _LOCAL:
        raise ArchiveError(f"no entry at {at}")
    file.seek(at + 30 + sum(struct.unpack_from("<HH", header, 26)))
    unpack = zlib.decompressobj(-15) if method == _DEFLATE else None
    while packed:
        raw = file.read(min(PIECE, packed))
        if not raw:
            raise ArchiveError("the zip file ends within an entry")
        packed -= len(raw)
        while unpack and raw:
            yield unpack.decompress(raw, PIECE)
            raw = unpack.unconsumed_tail
        if not unpack:
            yield raw
    if unpack:
        yield unpack.flush()


def unzip_backup(spark: SparkSession, source: str, folder: str) -> DataFrame:
    """Unpack a zip file by tasks; the names that were written.

    Nothing is written if one of the names leaves the folder, or is packed in
    another way than deflate. An entry whose checksum is wrong is an error.
    """
    entries = zip_entries(spark, source)
    if wrong := entries.where(~safe_entry("name") | ~F.col("method").isin(0, _DEFLATE)).first():
        raise InvalidPath(wrong["name"])

    def put(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            with open(source, "rb") as file:
                for row in part.itertuples():
                    target = os.path.join(folder, row.name.replace("\\", "/"))
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    crc, temporary = 0, f"{target}.{uuid.uuid4().hex}.tmp"
                    with open(temporary, "wb") as out:
                        for piece in _pieces(file, row.at, row.packed, row.method):
                            crc = zlib.crc32(piece, crc)
                            out.write(piece)
                    if crc != row.crc:
                        os.remove(temporary)
                        raise ArchiveError(f"bad checksum of {row.name}")
                    os.replace(temporary, target)
            yield part[["name"]]

    os.makedirs(folder, exist_ok=True)
    total = entries.agg(F.coalesce(F.sum("packed"), F.lit(0))).first()[0]
    dealt = entries.repartition(min(1024, 1 + total // TASK_BYTES + (8 if total else 0)))
    return keep(dealt.mapInPandas(put, "name string"), "unpacked")


def _wide(*values: int) -> bytes:
    """The extra field for values that need more than 32 bits."""
    return struct.pack(f"<HH{len(values)}Q", 1, 8 * len(values), *values)


def zip_backup(spark: SparkSession, folder: str, target: str) -> None:
    """All files below a folder as one zip file, packed by tasks; links are left out, names are those below the folder."""
    parts_folder = f"{target}.{uuid.uuid4().hex}.parts"
    files = list_files(spark, folder).where("not is_link")
    entry = "part string, at long, name string, crc long, packed long, size long"

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(parts_folder, exist_ok=True)
        for part in parts:
            path, rows = f"{parts_folder}/{uuid.uuid4().hex}", []
            with open(path, "wb") as out:
                for rel, source in zip(part["rel"], part["abs_path"], strict=True):
                    at, name, crc, size = out.tell(), rel.encode(), 0, 0
                    out.write(b"\0" * (30 + len(name) + 20))  # known only afterwards
                    begun, press = out.tell(), zlib.compressobj(6, zlib.DEFLATED, -15)
                    with open(source, "rb") as file:
                        while piece := file.read(PIECE):
                            crc, size = zlib.crc32(piece, crc), size + len(piece)
                            out.write(press.compress(piece))
                    out.write(press.flush())
                    packed = out.tell() - begun
                    out.seek(at)
                    out.write(struct.pack("<IHHHHHIIIHH", _LOCAL, _VERSION, _UTF8, _DEFLATE, 0, 33, crc, _FULL, _FULL, len(name), 20) + name + _wide(size, packed))
                    out.seek(0, os.SEEK_END)
                    rows.append((path, at, rel, crc, packed, size))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in entry.split(", ")])

    packed = keep(files.mapInPandas(pack, entry), "packed")
    # A task that had to be repeated leaves a part that no row names; it is not joined.
    used = packed.select("part").distinct()

    def join(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        temporary, starts = f"{target}.{uuid.uuid4().hex}.tmp", []
        with open(temporary, "wb") as out:
            for part in parts:
                for path in part["part"]:
                    starts.append((path, out.tell()))
                    with open(path, "rb") as file:
                        shutil.copyfileobj(file, out, PIECE)
        yield pd.DataFrame([(temporary, p, s) for p, s in starts] or [(temporary, "", 0)], columns=["file", "part", "start"])

    joined = keep(used.coalesce(1).mapInPandas(join, "file string, part string, start long"), "joined")
    file = joined.first()
    if file is None:  # nothing to pack
        with zipfile.ZipFile(target, "w"):
            return
    placed = packed.join(joined.select("part", "start"), "part").select("name", "crc", "packed", "size", (F.col("start") + F.col("at")).alias("at"))

    def close(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with open(file["file"], "r+b") as out:
            out.seek(0, os.SEEK_END)
            begun, n = out.tell(), 0
            for part in parts:
                for row in part.itertuples():
                    name = row.name.encode()
                    out.write(struct.pack("<IHHHHHHIIIHHHHHII", _CENTRAL, _VERSION, _VERSION, _UTF8, _DEFLATE, 0, 33, row.crc, _FULL, _FULL, len(name), 28, 0, 0, 0, 0, _FULL) + name + _wide(row.size, row.packed, row.at))
                    n += 1
            end = out.tell()
            out.write(struct.pack("<IQHHIIQQQQ", _WIDE_END, 44, _VERSION, _VERSION, 0, 0, n, n, end - begun, begun) + struct.pack("<IIQI", _LOCATOR, 0, end, 1))
            out.write(struct.pack("<IHHHHIIH", _END, 0, 0, _FULL_SHORT, _FULL_SHORT, _FULL, _FULL, 0))
        os.replace(file["file"], target)
        yield pd.DataFrame({"n": [n]})

    keep(placed.coalesce(1).mapInPandas(close, "n long"), "closed")
    shutil.rmtree(parts_folder, ignore_errors=True)
