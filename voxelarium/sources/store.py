"""Access to stores: where the bytes of arrays come from.

A store reads whole objects and ranges of them by name, and may list and write; `None` is an absent object.  Readers
take any object of that shape, so other storage is added by another class.  On the driver, small files go through
Spark's own file systems (`put`, `get`), which reach whatever Spark reaches.
"""

from __future__ import annotations

import os
import uuid
from typing import Protocol
from urllib.parse import urlsplit

from pyspark.sql import SparkSession


class Store(Protocol):
    def read(self, name: str) -> bytes | None: ...

    def read_range(self, name: str, start: int, size: int) -> bytes | None:
        """Part of an object; a negative start counts from its end."""

    def write(self, name: str, data: bytes) -> None: ...


class Folder:
    """A local or mounted folder."""

    def __init__(self, path: str):
        self.path = path

    def read(self, name: str) -> bytes | None:
        try:
            with open(os.path.join(self.path, name), "rb") as f:
                return f.read()
        except (FileNotFoundError, IsADirectoryError, NotADirectoryError):
            return None

    def read_range(self, name: str, start: int, size: int) -> bytes | None:
        try:
            with open(os.path.join(self.path, name), "rb") as f:
                f.seek(start, os.SEEK_END if start < 0 else os.SEEK_SET)
                return f.read(size)
        except (FileNotFoundError, IsADirectoryError, NotADirectoryError):
            return None

    def write(self, name: str, data: bytes) -> None:
        path = os.path.join(self.path, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, path)  # a task that runs twice leaves the same file


class Remote:
    """A store that Arrow's file systems reach (hdfs, s3, gs, ...), by ranged reads."""

    def __init__(self, url: str):
        from pyarrow import fs

        self.fs, self.path = fs.FileSystem.from_uri(url)

    def _open(self, name: str):
        try:
            return self.fs.open_input_file(f"{self.path.rstrip('/')}/{name}")
        except FileNotFoundError:
            return None

    def read(self, name: str) -> bytes | None:
        f = self._open(name)
        if f is None:
            return None
        with f:
            return f.readall()

    def read_range(self, name: str, start: int, size: int) -> bytes | None:
        f = self._open(name)
        if f is None:
            return None
        with f:
            at = max(0, f.size() + start) if start < 0 else start
            return f.read_at(min(size, max(0, f.size() - at)), at)

    def write(self, name: str, data: bytes) -> None:
        path = f"{self.path.rstrip('/')}/{name}"
        self.fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with self.fs.open_output_stream(path) as f:
            f.write(data)


class Kept:
    """A store behind another, faster one that keeps what was read.  Objects and ranges found absent leave a marker, so
    that they are asked for once; tasks that fetch the same object write the same bytes."""

    def __init__(self, store: Store, keep: Store):
        self.store, self.keep = store, keep

    def _once(self, name: str, fetch) -> bytes | None:
        have = self.keep.read(name)
        if have is not None:
            return have
        if self.keep.read(f"{name}.missing") is not None:
            return None
        data = fetch()
        self.keep.write(name if data is not None else f"{name}.missing", data or b"")
        return data

    def read(self, name: str) -> bytes | None:
        return self._once(name, lambda: self.store.read(name))

    def read_range(self, name: str, start: int, size: int) -> bytes | None:
        return self._once(f"{name}#{start}+{size}", lambda: self.store.read_range(name, start, size))

    def write(self, name: str, data: bytes) -> None:
        self.store.write(name, data)


def store_of(location: str, keep: str | None = None) -> Store:
    """The store of a path or url; keep: a folder that what is read is kept in."""
    parts = urlsplit(location)
    store: Store = Folder(parts.path if parts.scheme == "file" else location) if parts.scheme in ("", "file") else Remote(location)
    return Kept(store, Folder(keep)) if keep else store


def plain(url: str) -> str:
    """A local path without its scheme; other urls as they are."""
    parts = urlsplit(url)
    return parts.path if parts.scheme == "file" else url


# ---- small files of the driver, by Spark's file systems ----
def _path(spark: SparkSession, url: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(url)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def put(spark: SparkSession, url: str, data: bytes) -> None:
    path, fs = _path(spark, url)
    out = fs.create(path, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def get(spark: SparkSession, url: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(url).select("content").first().content)
