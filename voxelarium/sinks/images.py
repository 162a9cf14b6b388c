"""Image writers: PNG and TIFF with a provenance text, layers assembled on executors, PCD-like point dumps."""

from __future__ import annotations

import hashlib
import json
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelarium.shared import cut
from voxelarium.sources import tiff
from voxelarium.sources.store import plain


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(image: np.ndarray, text: str = "") -> bytes:
    """A grey [row, column] or RGB [row, column, 3] byte image, with a text entry."""
    h, w = image.shape[:2]
    color = 2 if image.ndim == 3 else 0
    raw = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, -1)], 1).tobytes()
    parts = [_chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0))]
    if text:
        parts.append(_chunk(b"tEXt", b"metadata\0" + text.encode("latin-1", "replace")))
    return b"\x89PNG\r\n\x1a\n" + b"".join(parts) + _chunk(b"IDAT", zlib.compress(raw)) + _chunk(b"IEND", b"")


def read_png(data: bytes) -> tuple[np.ndarray, str]:
    """What png() wrote: the image and its text."""
    at, body, text = 8, b"", ""
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, _, color = struct.unpack(">IIBB", part[:10])
        elif kind == b"tEXt":
            text = part.split(b"\0", 1)[1].decode("latin-1")
        elif kind == b"IDAT":
            body += part
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, -1)[:, 1:]
    return (rows.reshape(h, w, 3) if color == 2 else rows), text


def tiles(pixels: DataFrame, tile: int) -> DataFrame:
    """(w, tv, tu, bytes): dense square tiles of (w, px, py, value), assembled one tile per group on the executors."""
    keyed = pixels.select("w", F.floor(F.col("py") / tile).cast("int").alias("tv"), F.floor(F.col("px") / tile).cast("int").alias("tu"), ((F.col("py") % tile) * tile + F.col("px") % tile).cast("int").alias("at"), F.col("value").cast("int").alias("value"))

    def run(t: pa.Table) -> pa.Table:
        block = np.zeros(tile * tile, np.uint8)
        block[np.asarray(t.column("at"))] = np.asarray(t.column("value")).astype(np.uint8)
        return pa.table({"w": pa.array([t.column("w")[0].as_py()], pa.int32()), "tv": pa.array([t.column("tv")[0].as_py()], pa.int32()), "tu": pa.array([t.column("tu")[0].as_py()], pa.int32()), "bytes": pa.array([block.tobytes()], pa.binary())})

    return keyed.groupBy("w", "tv", "tu").applyInArrow(run, "w int, tv int, tu int, bytes binary")


def layers(tiled: DataFrame, width: int, height: int, tile: int, form: str = "tif", text: str = "") -> DataFrame:
    """(w, name, content): one encoded image per layer; absent tiles are black.

    A layer's tiles meet in one task: its memory is one image of a layer.
    """
    across, down = -(-width // tile), -(-height // tile)

    def run(t: pa.Table) -> pa.Table:
        have = {(u, v): raw for u, v, raw in zip(t.column("tu").to_pylist(), t.column("tv").to_pylist(), t.column("bytes").to_pylist(), strict=True)}
        w = t.column("w")[0].as_py()
        blank = bytes(tile * tile)
        every = [(u, v, have.get((u, v), blank)) for v in range(down) for u in range(across)]
        if form == "tif":
            data = tiff.write_tiled(width, height, tile, every, text)
        else:
            image = np.zeros((down * tile, across * tile), np.uint8)
            for u, v, raw in every:
                image[v * tile : (v + 1) * tile, u * tile : (u + 1) * tile] = np.frombuffer(raw, np.uint8).reshape(tile, tile)
            data = png(image[:height, :width], text)
        return pa.table({"w": pa.array([w], pa.int32()), "name": [f"{w:05d}.{form}"], "content": pa.array([data], pa.binary())})

    return tiled.groupBy("w").applyInArrow(run, "w int, name string, content binary")


def write_layers(tiled: DataFrame, folder: str, width: int, height: int, tile: int, text: str = "") -> DataFrame:
    """Tiled TIFFs `WWWWW.tif` of every layer in a mounted folder, from many tasks: (w, name, tiles).

    Tiles are not compressed, so the place of each follows from its number: the driver writes the headers, tasks write
    their tiles in place, whatever their order, and a task that runs twice writes the same bytes.  No task holds more
    than a batch of tiles.  A layer with tiles missing raises.
    """
    folder = plain(folder)
    across, down = -(-width // tile), -(-height // tile)
    header, first = tiff.tiled_header(width, height, tile, text)
    found = tiled.groupBy("w").agg(F.countDistinct("tu", "tv").alias("tiles")).orderBy("w").collect()  # a row for each layer
    short = [r.w for r in found if r.tiles != across * down]
    if short:
        raise ValueError(f"tiles are missing in layers {short[:5]}")
    os.makedirs(folder, exist_ok=True)
    name = "{:05d}.tif".format
    for r in found:
        with open(os.path.join(folder, name(r.w)), "wb") as f:
            f.write(header)
            f.truncate(first + across * down * tile * tile)

    def run(rows):
        for r in rows:
            with open(os.path.join(folder, name(r["w"])), "r+b") as f:
                f.seek(first + (r["tv"] * across + r["tu"]) * tile * tile)
                f.write(bytes(r["bytes"]))

    tiled.select("w", "tv", "tu", "bytes").foreachPartition(run)
    return tiled.sparkSession.createDataFrame([(r.w, name(r.w), r.tiles) for r in found], "w int, name string, tiles long")


def every_tile(tiled: DataFrame, width: int, height: int, tile: int) -> DataFrame:
    """The tiles of each layer with blank ones where there is none."""
    across, down = -(-width // tile), -(-height // tile)
    grid = tiled.select("w").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(across * down - 1))))
    grid = grid.select("w", F.floor(F.col("k") / across).cast("int").alias("tv"), (F.col("k") % across).cast("int").alias("tu"))
    return grid.join(tiled, ["w", "tv", "tu"], "left").withColumn("bytes", F.coalesce("bytes", F.lit(bytes(tile * tile))))


def provenance(spark: SparkSession, arguments: dict, inputs: list[str]) -> str:
    """Arguments with size and sha256 of every input file, as JSON."""
    found = []
    for path in inputs:
        for r in spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256")).orderBy("path").collect():
            found.append({"path": r.path, "size": r.length, "sha256": r.sha256})
    return json.dumps({"arguments": arguments, "inputs": found}, sort_keys=True)


def digest(image: np.ndarray) -> str:
    return hashlib.sha256(image.tobytes()).hexdigest()


def points(voxels: DataFrame, path: str, by: str = "v") -> None:
    """A point cloud by label: Parquet partitioned by it."""
    voxels.select("x", "y", "z", by).repartition(by).write.mode("overwrite").partitionBy(by).parquet(path)


def store_chunks(chunks: DataFrame, path: str, key: tuple[str, ...] = ("volume_id", "lod", "cx", "cy", "cz")) -> DataFrame:
    """Append the chunks that the store does not hold yet; returns every key offered with its outcome.

    A key offered several times is written once: the chunk with bytes, of several the least.
    """
    spark = chunks.sparkSession
    chunks = chunks.groupBy(*key).agg(F.min("bytes").alias("bytes"))
    try:
        held = spark.read.parquet(path).select(*key, F.col("bytes").isNull().alias("_empty"))
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        held = chunks.select(*key, F.lit(True).alias("_empty")).limit(0)
    keys = chunks.select(*key).join(held, list(key), "left")
    outcome = keys.select(*key, F.when(F.col("_empty"), "AlreadyEmpty").when(~F.col("_empty"), "AlreadyResident").otherwise("Wrote").alias("outcome"))
    result = cut(outcome, "outcomes")  # before the store changes
    chunks.join(held.select(*key), list(key), "left_anti").write.mode("append").partitionBy("volume_id", "lod").parquet(path)
    return result
