"""Levels of detail: means downward, previews upward."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelarium.functions import kernels
from voxelarium.functions.voxel import idiv


def halve(voxels: DataFrame) -> DataFrame:
    """The next coarser level: the sum of eight children over 8, absent children 0; places without children stay out.

    A decomposable sum: Spark combines it before the shuffle.
    """
    return voxels.groupBy(*[F.shiftright(a, 1).alias(a) for a in "xyz"]).agg(idiv(F.sum("v"), 8).cast("int").alias("v"))


def pyramid(voxels: DataFrame, levels: int) -> DataFrame:
    """(lod, x, y, z, v) of the volume and so many coarser levels."""
    out, level = voxels.select(F.lit(0).alias("lod"), "x", "y", "z", "v"), voxels
    for k in range(1, levels + 1):
        level = halve(level)
        out = out.unionByName(level.select(F.lit(k).alias("lod"), "x", "y", "z", "v"))
    return out


def halve_chunks(chunks: DataFrame, bits: int = 6) -> DataFrame:
    """The next coarser level of dense chunks: up to eight children meet at their parent."""
    n = 1 << bits

    def run(table: pa.Table) -> pa.Table:
        parent = np.zeros((n, n, n), np.uint8)
        h = n // 2
        for cx, cy, cz, raw in zip(*[table.column(c).to_pylist() for c in ("cx", "cy", "cz", "bytes")], strict=True):
            ox, oy, oz = (cx & 1) * h, (cy & 1) * h, (cz & 1) * h
            parent[oz : oz + h, oy : oy + h, ox : ox + h] = kernels.halve(np.frombuffer(raw, np.uint8).reshape(n, n, n))
        at = [pa.array([table.column(f"p{a}")[0].as_py()], pa.int32()) for a in "xyz"]
        return pa.Table.from_arrays([*at, pa.array([parent.tobytes()], pa.binary())], ["cx", "cy", "cz", "bytes"])

    parents = chunks.select("*", *[F.shiftright(f"c{a}", 1).alias(f"p{a}") for a in "xyz"])
    return parents.groupBy("px", "py", "pz").applyInArrow(run, "cx int, cy int, cz int, bytes binary")


def preview(wanted: DataFrame, chunks: DataFrame, most: int = 6, bits: int = 6) -> DataFrame:
    """Chunks (lod, cx, cy, cz) that are missing, upsampled from their finest resident ancestor of chunks
    (lod, cx, cy, cz, bytes), at most so many levels up: adds shift and bytes."""
    n = 1 << bits
    up = wanted.withColumn("shift", F.explode(F.sequence(F.lit(1), F.lit(most))))
    up = up.select("*", (F.col("lod") + F.col("shift")).alias("_lod"), *[F.floor(F.col(f"c{a}") / F.pow(F.lit(2.0), F.col("shift"))).cast("int").alias(f"_c{a}") for a in "xyz"])
    p = chunks.select(F.col("lod").alias("_lod"), *[F.col(f"c{a}").alias(f"_c{a}") for a in "xyz"], "bytes")
    best = up.join(p, ["_lod", "_cx", "_cy", "_cz"]).groupBy("lod", "cx", "cy", "cz").agg(F.min_by(F.struct("shift", "bytes"), "shift").alias("b"))

    def run(batches):
        for b in batches:
            rows = b.to_pylist()
            for r in rows:
                block = np.frombuffer(r["bytes"], np.uint8).reshape(n, n, n)
                r["bytes"] = kernels.upsample(block, (r["cx"], r["cy"], r["cz"]), r["shift"]).tobytes()
            yield pa.RecordBatch.from_pylist(rows, b.schema)

    return best.select("lod", "cx", "cy", "cz", "b.shift", "b.bytes").mapInArrow(run, "lod int, cx int, cy int, cz int, shift int, bytes binary")


def preview_voxels(parents: DataFrame, shift: int, size: int) -> DataFrame:
    """Every child voxel of parent voxels (x, y, z, v) of one chunk of so many voxels a side, by the same rule in
    columns: two bracketing indices and a weight in 256ths per axis, each axis rounded down in turn (x, y, z)."""
    scale = 1 << shift
    t = parents.sparkSession.range(size * scale).select(F.col("id").cast("int").alias("t"))
    q = idiv((2 * F.col("t") + 1) * 128, scale) - 128
    axis = t.select("t", q.alias("q"), F.shiftright(q, 8).alias("raw"))
    low = F.least(F.greatest("raw", F.lit(0)), F.lit(size - 1))
    axis = axis.select("t", low.alias("lo"), F.least(low + 1, F.lit(size - 1)).alias("hi"), F.when((F.col("q") < 0) | (F.col("raw") >= size - 1), 0).otherwise(F.col("q") - F.shiftleft(low, 8)).cast("int").alias("w"))
    level = parents.select("x", "y", "z", "v")
    for a in "xyz":
        others = [c for c in "xyz" if c != a]
        lo = level.select(*others, F.col(a).alias("lo"), F.col("v").alias("v0"))
        hi = level.select(*others, F.col(a).alias("hi"), F.col("v").alias("v1"))
        # size * 2**shift rows: one chunk's axis
        level = lo.join(F.broadcast(axis), "lo").join(hi, [*others, "hi"]).select(*others, F.col("t").alias(a), F.shiftright(F.col("v0") * (256 - F.col("w")) + F.col("v1") * F.col("w"), 8).alias("v"))
    return level
