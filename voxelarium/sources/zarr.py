"""Zarr arrays and OME-Zarr groups as a Spark data source of dense chunks.

    spark.dataSource.register(ZarrSource)
    spark.read.format("zarr3d").option("path", location).load()

gives (lod, cz, cy, cx, bytes), one row per stored chunk; absent chunks have no row.  Filters on lod, cz, cy and cx
prune the chunks that are opened (with spark.sql.python.filterPushdown.enabled).  Version 2 arrays of bytes with raw,
blosc, zstd or lz4 chunks are read, and version 3 sharded arrays with raw or zstd sub-chunks; a group's levels come
from its multiscales.  Scans with different filters need a load each.  A location is a folder or the url of a store (see store.py); the option `keep` names a folder
that what is read from a store is kept in.

Chunk names follow from the metadata, so nothing is listed: a task gets a run of places of the grid.  Of a shard its
index is read, then the wanted sub-chunks, each by its range.  Other stores are read with binaryFile and `decoded`.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from voxelarium.sources.codecs import decode
from voxelarium.sources.store import Store, plain, store_of

SCHEMA = "lod int, cz int, cy int, cx int, bytes binary"


@dataclass
class ArrayMeta:
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    compressor: dict | None
    fill: int
    separator: str
    version: int = 2
    shard: tuple[int, ...] | None = None
    index_at: str = "start"

    @classmethod
    def read(cls, path: str) -> ArrayMeta:
        new = _json(path, "zarr.json")
        if new is not None:
            return cls.v3(new)
        old = _json(path, ".zarray")
        if old is None:
            raise ValueError(f"{path} holds no array")
        return cls.v2(old)

    def per_file(self) -> list[int]:
        """Chunks of a file along each axis."""
        return [s // c for s, c in zip(self.shard, self.chunks, strict=True)] if self.shard else [1, 1, 1]

    def name(self, index) -> str:
        """The object of a chunk or shard."""
        return ("c" + self.separator if self.version == 3 else "") + self.separator.join(map(str, index))

    @classmethod
    def v2(cls, m: dict) -> ArrayMeta:
        if m["dtype"] != "|u1":
            raise ValueError(f"only bytes are supported, not {m['dtype']}")
        if m.get("filters"):
            raise ValueError("filters are not supported")
        return cls(tuple(m["shape"]), tuple(m["chunks"]), m.get("compressor"), int(m.get("fill_value") or 0), m.get("dimension_separator", "."))

    @classmethod
    def v3(cls, m: dict) -> ArrayMeta:
        if m["data_type"] != "uint8":
            raise ValueError(f"only bytes are supported, not {m['data_type']}")
        grid = tuple(m["chunk_grid"]["configuration"]["chunk_shape"])
        codecs = m["codecs"]
        sep = m.get("chunk_key_encoding", {}).get("configuration", {}).get("separator", "/")
        shard, inner, at = None, codecs, "start"
        if codecs and codecs[0]["name"] == "sharding_indexed":
            c = codecs[0]["configuration"]
            shard, grid, inner, at = grid, tuple(c["chunk_shape"]), c["codecs"], c.get("index_location", "end")
        named = [c["name"] for c in inner if c["name"] not in ("bytes", "transpose")]
        return cls(tuple(m["shape"]), grid, {"id": named[0]} if named else None, int(m.get("fill_value") or 0), sep, 3, shard, at)


def shard_index(raw: bytes, n: int) -> np.ndarray:
    """(n, 2) of offset and length; absent entries are (-1, -1)."""
    return np.frombuffer(raw[: n * 16], "<u8").reshape(n, 2).view(np.int64)


def _json(path: str, name: str):
    raw = store_of(path).read(name)
    return json.loads(raw) if raw is not None else None


def _below(path: str, name: str) -> str:
    return f"{path.rstrip('/')}/{name}"


def levels(path: str) -> list[tuple[int, str]]:
    """(lod, folder) of an array or of a group's published levels; unpublished ones are left out."""
    attrs = _json(path, ".zattrs")
    if attrs is None:
        m = _json(path, "zarr.json")
        attrs = m.get("attributes", {}).get("ome", m.get("attributes")) if m and m.get("node_type") == "group" else None
    if attrs and attrs.get("multiscales"):
        found = [(k, _below(path, d["path"])) for k, d in enumerate(attrs["multiscales"][0]["datasets"])]
        return [(k, p) for k, p in found if _json(p, ".zarray") is not None or _json(p, "zarr.json") is not None]
    return [(0, path)]


def sniff(path: str) -> str:
    """What a location holds: ome, zarr, cells, layers, or an error."""
    if "multiscales" in (_json(path, ".zattrs") or {}):
        return "ome"
    m = _json(path, "zarr.json")
    if m:
        return "zarr" if m.get("node_type") == "array" else "ome"
    if _json(path, ".zarray") is not None:
        return "zarr"
    names = os.listdir(plain(path))
    if any(re.fullmatch(r"cell_yxz_\d+_\d+_\d+\.tif", n) for n in names):
        return "cells"
    if any(re.fullmatch(r"\d{5}\.tif", n) for n in names):
        return "layers"
    raise ValueError(f"{path} holds no known volume")


#: Grid places of a task, and the most tasks of a level.
RUN, MOST_TASKS = 64, 1 << 17


class _Run(InputPartition):
    """Places first to last (in z, y, x order) of the box from low to high of a level's chunks or shards."""

    def __init__(self, lod: int, folder: str, low, high, first: int, last: int):
        self.lod, self.folder, self.low, self.high, self.first, self.last = lod, folder, low, high, first, last


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.keep = options["path"], options.get("keep")
        self.bounds: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        ops = {EqualTo: "=", In: "in", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            op = ops.get(type(f))
            if op and len(f.attribute) == 1 and f.attribute[0] in ("lod", "cz", "cy", "cx"):
                self.bounds.append((f.attribute[0], op, f.value))
            yield f  # Spark applies every filter again: pruning need not be exact

    def _wanted(self, **at) -> bool:
        test = {"=": lambda a, b: a == b, "in": lambda a, b: a in b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}
        return all(test[op](at[k], v) for k, op, v in self.bounds if k in at)

    def _ends(self, name: str, n: int) -> tuple[int, int]:
        """First and last wanted place of n on an axis."""
        low, high = 0, n - 1
        for k, op, v in self.bounds:
            if k == name:
                few = sorted(v) if op == "in" else [v]
                low = max(low, {"=": few[0], "in": few[0], ">": few[0] + 1, ">=": few[0]}.get(op, low))
                high = min(high, {"=": few[-1], "in": few[-1], "<": few[-1] - 1, "<=": few[-1]}.get(op, high))
        return low, high

    def partitions(self):
        out = []
        for lod, folder in levels(self.path):
            if not self._wanted(lod=lod):
                continue
            meta = ArrayMeta.read(folder)
            per = meta.per_file()
            ends = [self._ends(name, -(-n // c)) for name, n, c in zip(("cz", "cy", "cx"), meta.shape, meta.chunks, strict=True)]
            low, high = ([e[i] // k for e, k in zip(ends, per, strict=True)] for i in (0, 1))
            total = int(np.prod([max(0, h - l + 1) for l, h in zip(low, high, strict=True)]))
            run = max(1 if meta.shard else RUN, -(-total // MOST_TASKS))
            out += [_Run(lod, folder, low, high, i, min(i + run, total)) for i in range(0, total, run)]
        return out or [_Run(-1, "", (), (), 0, 0)]

    def read(self, p: _Run) -> Iterator[pa.RecordBatch]:
        if p.lod < 0:
            return
        meta, store = ArrayMeta.read(p.folder), store_of(p.folder, os.path.join(self.keep, str(p.lod)) if self.keep else None)
        sides = [h - l + 1 for l, h in zip(p.low, p.high, strict=True)]
        for i in range(p.first, p.last):
            index = tuple(int(k) + l for k, l in zip(np.unravel_index(i, sides), p.low, strict=True))
            for at, raw in stored(meta, store, index, lambda at: self._wanted(lod=p.lod, cz=at[0], cy=at[1], cx=at[2])):
                yield pa.RecordBatch.from_pydict({"lod": [p.lod], "cz": [at[0]], "cy": [at[1]], "cx": [at[2]], "bytes": [raw]}, pa.schema([("lod", pa.int32()), ("cz", pa.int32()), ("cy", pa.int32()), ("cx", pa.int32()), ("bytes", pa.binary())]))


def stored(meta: ArrayMeta, store: Store, index: tuple[int, int, int], wanted=lambda at: True) -> Iterator[tuple[tuple[int, int, int], bytes]]:
    """(chunk index, decoded bytes) of a chunk file, or of the wanted sub-chunks of a shard: the index first, then each
    by its range."""
    size, name = int(np.prod(meta.chunks)), meta.name(index)
    if not meta.shard:
        data = store.read(name) if wanted(index) else None
        if data is not None:
            yield index, decode(data, meta.compressor, size)
        return
    per = meta.per_file()
    places = [tuple(int(i * p + s) for i, p, s in zip(index, per, sub, strict=True)) for sub in np.ndindex(*per)]
    some = [k for k, at in enumerate(places) if wanted(at)]
    n = len(places)
    table = store.read_range(name, 0, n * 16) if some and meta.index_at == "start" else store.read_range(name, -(n * 16 + 4), n * 16) if some else None
    if table is None:
        return
    entries = shard_index(table, n)
    for k in some:
        off, length = entries[k].tolist()
        if off >= 0:
            yield places[k], decode(store.read_range(name, off, length), meta.compressor, size)


class ZarrSource(DataSource):
    @classmethod
    def name(cls):
        return "zarr3d"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def decoded(files: DataFrame, meta: ArrayMeta, lod: int = 0) -> DataFrame:
    """Chunks of binaryFile rows (path, content) of a version 2 array in any store Spark reads."""
    pattern = meta.separator.replace(".", r"\.").join([r"(\d+)"] * 3) + "$"
    keyed = files.where(F.col("path").rlike(pattern)).select(*[F.regexp_extract("path", pattern, i).cast("int").alias(c) for i, c in ((1, "cz"), (2, "cy"), (3, "cx"))], "content")
    size = int(np.prod(meta.chunks))

    def run(batches):
        for b in batches:
            raw = [decode(x, meta.compressor, size) for x in b.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([lod] * len(raw), pa.int32()), b.column("cz"), b.column("cy"), b.column("cx"), pa.array(raw, pa.binary())], ["lod", "cz", "cy", "cx", "bytes"])

    return keyed.mapInArrow(run, SCHEMA)


def voxels(chunks: DataFrame, shape: tuple[int, int, int], sides: tuple[int, int, int]) -> DataFrame:
    """(x, y, z, v) of stored chunks (z, y, x order), without the padding beyond the shape."""
    def run(batches):
        for b in batches:
            for cz, cy, cx, raw in zip(*[b.column(c).to_pylist() for c in ("cz", "cy", "cx", "bytes")], strict=True):
                v = np.frombuffer(raw, np.uint8).reshape(sides)
                z, y, x = np.indices(sides, np.int32).reshape(3, -1)
                z, y, x = z + cz * sides[0], y + cy * sides[1], x + cx * sides[2]
                ok = (z < shape[0]) & (y < shape[1]) & (x < shape[2])
                yield pa.RecordBatch.from_arrays([pa.array(i[ok].astype(np.int32)) for i in (x, y, z)] + [pa.array(v.ravel()[ok].astype(np.int32))], ["x", "y", "z", "v"])

    return chunks.mapInArrow(run, "x int, y int, z int, v int")


def write(chunks: DataFrame, folder: str, shape, sides, compressor: str | None = "zstd") -> None:
    """A version 2 array of dense chunks (cz, cy, cx, bytes), each task writing its own objects into the store."""
    from voxelarium.sources.codecs import blosc_frame

    meta = {"zarr_format": 2, "shape": list(shape), "chunks": list(sides), "dtype": "|u1", "fill_value": 0, "order": "C", "filters": None, "dimension_separator": ".", "compressor": {"id": "blosc", "cname": compressor, "clevel": 3, "shuffle": 0, "blocksize": 0} if compressor else None}
    store_of(folder).write(".zarray", json.dumps(meta).encode())

    def run(rows):
        store = store_of(folder)
        for r in rows:
            data = bytes(r["bytes"])
            store.write(f"{r['cz']}.{r['cy']}.{r['cx']}", blosc_frame(data, compressor) if compressor else data)

    chunks.select("cz", "cy", "cx", "bytes").foreachPartition(run)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ZarrSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
