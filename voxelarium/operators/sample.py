"""Sampling: voxel lookup, trilinear stencils, level fallback, ray gathering - in voxel form and in chunk form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelarium.functions import kernels
from voxelarium.functions.kernels import trilinear_q8_partial
from voxelarium.functions.voxel import q8, trilinear_weight
from voxelarium.model import Compositing


def nearest(points: DataFrame, voxels: DataFrame, extent, out: str = "value") -> DataFrame:
    """Value at (sx, sy, sz): truncated toward zero, negatives clamp to 0, 0 beyond the extent or where absent."""
    p = points
    for a in "xyz":
        p = p.withColumn(f"_{a}", F.greatest(F.col(f"s{a}").cast("int"), F.lit(0)))
    far = (F.col("_x") >= extent[0]) | (F.col("_y") >= extent[1]) | (F.col("_z") >= extent[2])
    v = voxels.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("z").alias("_z"), F.col("v").alias("_v"))
    joined = p.join(v, ["_x", "_y", "_z"], "left")
    return joined.withColumn(out, F.when(far, 0).otherwise(F.coalesce("_v", F.lit(0)))).drop("_x", "_y", "_z", "_v")


_CORNERS = [(i & 1, i >> 1 & 1, i >> 2) for i in range(8)]


def _stencil(points: DataFrame, voxels: DataFrame, fraction, one, level: tuple[str, ...] = ()) -> DataFrame:
    """Every point with its eight corners' values and weights; absent corners are dropped (they count 0).

    level: a column of both sides that corners must share too.
    """
    p = points
    for a in "xyz":
        base = F.floor(F.greatest(F.col(f"s{a}"), F.lit(0.0))).cast("int")
        p = p.withColumn(f"_b{a}", base).withColumn(f"_f{a}", fraction(F.greatest(F.col(f"s{a}"), F.lit(0.0)) - base))
    corner = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z")) for x, y, z in _CORNERS]))
    p = p.withColumn("_c", corner)
    p = p.withColumn("_w", trilinear_weight(F.col("_c.x"), F.col("_c.y"), F.col("_c.z"), F.col("_fx"), F.col("_fy"), F.col("_fz"), one)).where("_w > 0")
    p = p.select("*", *[(F.col(f"_b{a}") + F.col(f"_c.{a}")).alias(f"_{a}") for a in "xyz"])
    v = voxels.select(*level, F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("z").alias("_z"), F.col("v").alias("_v"))
    return p.join(v, [*level, "_x", "_y", "_z"], "inner")


def trilinear_q8(points: DataFrame, key: list[str], voxels: DataFrame, extent, out: str = "value") -> DataFrame:
    """Trilinear value in 8-bit fixed point: weights are truncated 256ths, the sum is shifted right by 24."""
    hit = _stencil(points, voxels, q8, 256).withColumn("_p", F.col("_w").cast("long") * F.col("_v"))
    sums = hit.groupBy(*key).agg(F.sum("_p").alias("_sum"))
    far = (F.col("sx") >= extent[0]) | (F.col("sy") >= extent[1]) | (F.col("sz") >= extent[2])
    joined = points.join(sums, key, "left")
    return joined.withColumn(out, F.when(far, 0).otherwise(F.coalesce(F.shiftright("_sum", 24), F.lit(0))).cast("int")).drop("_sum")


def trilinear_f64(points: DataFrame, key: list[str], voxels: DataFrame, out: str = "value") -> DataFrame:
    """Trilinear value in double precision, axis after axis (x, then y, then z), truncated."""
    p = points
    for a in "xyz":
        p = p.withColumn(f"_b{a}", F.floor(F.greatest(F.col(f"s{a}"), F.lit(0.0))).cast("int"))
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z")) for i, (x, y, z) in enumerate(_CORNERS)]))
    p = p.withColumn("_c", corner)
    p = p.select(*key, F.col("_c.i").alias("_i"), *[(F.col(f"_b{a}") + F.col(f"_c.{a}")).alias(f"_{a}") for a in "xyz"])
    v = voxels.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("z").alias("_z"), F.col("v").alias("_v"))
    corners = p.join(v, ["_x", "_y", "_z"], "left").groupBy(*key).agg(*[F.coalesce(F.max(F.when(F.col("_i") == i, F.col("_v"))), F.lit(0)).cast("double").alias(f"_{i}") for i in range(8)])
    joined = points.join(corners, key)
    f = {a: F.greatest(F.col(f"s{a}"), F.lit(0.0)) - F.floor(F.greatest(F.col(f"s{a}"), F.lit(0.0))) for a in "xyz"}
    mix = lambda a, b, t: a * (1 - t) + b * t
    c = [F.col(f"_{i}") for i in range(8)]
    row = [mix(c[i], c[i + 1], f["x"]) for i in (0, 2, 4, 6)]
    plane = [mix(row[0], row[1], f["y"]), mix(row[2], row[3], f["y"])]
    return joined.withColumn(out, mix(plane[0], plane[1], f["z"]).cast("int")).drop(*[f"_{i}" for i in range(8)])


def fallback(points: DataFrame, key: list[str], levels: DataFrame, most: int, trilinear: bool = False, out: str = "value") -> DataFrame:
    """Value of the finest level that holds the point's place as resident, with that level.

    levels: (lod, x, y, z, v) of every place that is resident (or settled as empty, with v = 0).  One equi-join over the
    exploded levels and a minimum by level; with trilinear the lattice moves to the level found.
    """
    p = points.withColumn("_lod", F.explode(F.sequence(F.lit(0), F.lit(most))))
    p = p.select("*", *[F.floor(F.greatest(F.col(f"s{a}"), F.lit(0.0)) / F.pow(F.lit(2.0), F.col("_lod"))).cast("int").alias(f"_{a}") for a in "xyz"])
    v = levels.select(F.col("lod").alias("_lod"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("z").alias("_z"), F.col("v").alias("_v"))
    found = p.join(v, ["_lod", "_x", "_y", "_z"]).groupBy(*key).agg(F.min(F.struct("_lod", "_v")).alias("_hit"))
    out_rows = points.join(found, key, "left").withColumn("lod", F.col("_hit._lod")).withColumn(out, F.coalesce("_hit._v", F.lit(0))).drop("_hit")
    if not trilinear:
        return out_rows
    # the level is part of the key: one stencil for all of them
    scaled = out_rows.where("lod IS NOT NULL").select(*key, "lod", *[(F.col(f"s{a}") / F.pow(F.lit(2.0), F.col("lod"))).alias(f"s{a}") for a in "xyz"])
    hit = _stencil(scaled, levels, q8, 256, ("lod",)).withColumn("_p", F.col("_w").cast("long") * F.col("_v"))
    sums = hit.groupBy(*key).agg(F.sum("_p").alias("_sum"))
    return out_rows.drop(out).join(sums, key, "left").withColumn(out, F.coalesce(F.shiftright("_sum", 24), F.lit(0)).cast("int")).drop("_sum")


def rays_to_points(rays: DataFrame, layers: Column) -> DataFrame:
    """Rays (ray, ox, oy, oz, dx, dy, dz) at every layer w: points (ray, k, w, sx, sy, sz), k in walking order."""
    p = rays.select("*", F.posexplode(layers).alias("k", "w"))
    return p.select("ray", "k", "w", *[(F.col(f"o{a}") + F.col("w") * F.col(f"d{a}")).alias(f"s{a}") for a in "xyz"])


def gather(points: DataFrame, value: str = "value", out: str = "samples") -> DataFrame:
    """Samples of each ray as an array in walking order; a ray has at most a few hundred."""
    return points.groupBy("ray").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", value))), lambda s: s[value]).alias(out))


# ---- chunk form ----
def to_chunks(voxels: DataFrame, bits: int = 6) -> DataFrame:
    """(cx, cy, cz, bytes): dense chunks, x fastest, absent voxels 0."""
    n = 1 << bits
    keyed = voxels.select(*[F.shiftright(a, bits).alias(f"c{a}") for a in "xyz"], (F.shiftleft(F.col("z").bitwiseAND(F.lit(n - 1)), 2 * bits) + F.shiftleft(F.col("y").bitwiseAND(F.lit(n - 1)), bits) + F.col("x").bitwiseAND(F.lit(n - 1))).alias("at"), F.col("v").cast("int").alias("v"))

    def dense(table: pa.Table) -> pa.Table:
        block = np.zeros(n**3, np.uint8)
        block[np.asarray(table.column("at"))] = np.asarray(table.column("v")).astype(np.uint8)
        first = {c: [table.column(c)[0].as_py()] for c in ("cx", "cy", "cz")}
        return pa.table({**first, "bytes": pa.array([block.tobytes()], pa.binary())}, schema=pa.schema([("cx", pa.int32()), ("cy", pa.int32()), ("cz", pa.int32()), ("bytes", pa.binary())]))

    return keyed.groupBy("cx", "cy", "cz").applyInArrow(dense, "cx int, cy int, cz int, bytes binary")


def to_voxels(chunks: DataFrame, bits: int = 6, keep_zero: bool = True) -> DataFrame:
    """Voxels of dense chunks."""
    n = 1 << bits

    def run(batches):
        at = np.arange(n**3)
        for b in batches:
            for cx, cy, cz, raw in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                v = np.frombuffer(raw, np.uint8)
                i = at if keep_zero else at[v > 0]
                yield pa.RecordBatch.from_arrays([pa.array(((i & (n - 1)) + cx * n).astype(np.int32)), pa.array(((i >> bits & (n - 1)) + cy * n).astype(np.int32)), pa.array(((i >> 2 * bits) + cz * n).astype(np.int32)), pa.array(v[i].astype(np.int32))], ["x", "y", "z", "v"])

    return chunks.select("cx", "cy", "cz", "bytes").mapInArrow(run, "x int, y int, z int, v int")


def trilinear_q8_chunks(points: DataFrame, key: list[str], chunks: DataFrame, bits: int = 6, out: str = "value") -> DataFrame:
    """As trilinear_q8, over dense chunks: a point meets each of the one to eight chunks its corners fall in, a kernel
    adds up the corners there, and partial sums are combined.  Eight corners cost one row, not eight, away from edges.
    A chunk that more than HOT points touch is copied, and its points are dealt to the copies."""
    n = 1 << bits
    touched = points
    for a in "xyz":
        low = F.shiftright(F.floor(F.greatest(F.col(f"s{a}"), F.lit(0.0))).cast("int"), bits)
        high = F.shiftright(F.floor(F.greatest(F.col(f"s{a}"), F.lit(0.0))).cast("int") + 1, bits)
        touched = touched.withColumn(f"c{a}", F.explode(F.array_distinct(F.array(low, high))))
    kinds = ", ".join(f"{k} {dict(points.dtypes)[k]}" for k in key)

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        out_ = left.select(key)
        if not right.num_rows or not left.num_rows:
            return out_.slice(0, 0).append_column("part", pa.array([], pa.int64()))
        c = [right.column(f"c{a}")[0].as_py() for a in "xyz"]
        block = np.frombuffer(right.column("bytes")[0].as_py(), np.uint8).reshape(n, n, n)
        pos = np.maximum(np.stack([np.asarray(left.column(f"s{a}")) for a in "xyz"], 1), 0)
        return out_.append_column("part", pa.array(trilinear_q8_partial(block, [x * n for x in c], pos)))

    ck = ["cx", "cy", "cz"]
    touched = touched.select(*key, "sx", "sy", "sz", *ck)
    # few chunks are hot: the table of them is small, and the rest are on their first copy
    hot = touched.groupBy(*ck).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT).select(*ck, F.ceil(F.col("_n") / HOT).cast("int").alias("_copies"))
    dealt = touched.join(hot, ck, "left").withColumn("_copy", F.coalesce(F.pmod(F.xxhash64(*key), F.col("_copies")), F.lit(0)).cast("int")).drop("_copies")
    copied = chunks.select(*ck, "bytes").join(hot, ck, "left").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_copies") - 1, F.lit(0))))).drop("_copies")
    ck = [*ck, "_copy"]
    parts = dealt.groupBy(*ck).cogroup(copied.groupBy(*ck)).applyInArrow(kernel, f"{kinds}, part long")
    sums = parts.groupBy(*key).agg(F.sum("part").alias("_sum"))
    return points.join(sums, key, "left").withColumn(out, F.coalesce(F.shiftright("_sum", 24), F.lit(0)).cast("int")).drop("_sum")


#: Points of a chunk that one task samples.
HOT = 1 << 20
#: Chunk coordinates below 2**20 on each axis, packed in one number.
_AXIS = 20


def composite_rays(rays: DataFrame, chunks: DataFrame, c: Compositing, layers: tuple[int, ...], bits: int = 6) -> DataFrame:
    """(ray, value): trilinear samples of rays (ray long, ox..dz) at the layers, folded by alpha or maximum.

    What is shuffled is a ray per chunk it meets, not a sample per corner: a kernel in each chunk adds up the corners of
    all samples there, and the parts of a ray are added and folded where they meet.
    """
    n, steps = 1 << bits, np.asarray(layers, float)
    names = ("ox", "oy", "oz", "dx", "dy", "dz")

    def places(o: np.ndarray) -> np.ndarray:
        """(ray, layer, axis) of sample places, not below 0."""
        return np.maximum(o[:, None, :3] + steps[:, None] * o[:, None, 3:], 0)

    def meet(batches):
        for b in batches:
            o = np.stack([np.asarray(b.column(k)) for k in names], 1)
            base = np.floor(places(o)).astype(np.int64)
            code = []
            for corner in range(8):
                at = base + np.array([corner & 1, corner >> 1 & 1, corner >> 2]) >> bits
                code.append((at[..., 2] << _AXIS | at[..., 1]) << _AXIS | at[..., 0])
            code = np.sort(np.concatenate(code, 1), 1)
            new = np.ones(code.shape, bool)
            new[:, 1:] = code[:, 1:] != code[:, :-1]
            row, at = np.nonzero(new)
            yield pa.RecordBatch.from_arrays([pa.array(code[row, at]), b.column("ray").take(pa.array(row)), *[pa.array(o[row, i]) for i in range(6)]], ["chunk", "ray", *names])

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"ray": pa.array([], pa.int64()), "part": pa.array([], pa.list_(pa.int64()))})
        code = right.column("chunk")[0].as_py()
        origin = np.array([code & (1 << _AXIS) - 1, code >> _AXIS & (1 << _AXIS) - 1, code >> 2 * _AXIS]) * n
        block = np.frombuffer(right.column("bytes")[0].as_py(), np.uint8).reshape(n, n, n)
        o = np.stack([np.asarray(left.column(k)) for k in names], 1)
        part = trilinear_q8_partial(block, origin, places(o).reshape(-1, 3))
        offsets = np.arange(left.num_rows + 1, dtype=np.int32) * len(steps)
        return pa.table({"ray": left.column("ray").combine_chunks(), "part": pa.ListArray.from_arrays(pa.array(offsets), pa.array(part))})

    def finish(batches):
        held = []
        for b in [*batches, None]:
            # batches are sorted by ray: the last ray of a batch may go on in the next
            if b is not None:
                held.append(b)
                if len(held) < 64:
                    continue
            t = pa.Table.from_batches(held).combine_chunks() if held else None
            if t is None or not t.num_rows:
                continue
            ray = np.asarray(t.column("ray").combine_chunks())
            end = len(ray) if b is None else int(np.searchsorted(ray, ray[-1]))
            held = t.slice(end).to_batches()
            if not end:
                continue
            part = np.asarray(t.column("part").combine_chunks().flatten()).reshape(-1, len(steps))[:end]
            first = np.flatnonzero(np.concatenate(([True], ray[1:end] != ray[: end - 1])))
            samples = np.add.reduceat(part, first, axis=0) >> 24
            value = kernels.composite_max(samples) if c.mode == "max" else kernels.composite_alpha(samples, c)
            yield pa.RecordBatch.from_arrays([pa.array(ray[first]), pa.array(value)], ["ray", "value"])

    shifted = F.shiftleft(F.shiftleft(F.col("cz").cast("long"), _AXIS) + F.col("cy"), _AXIS) + F.col("cx")
    blocks = chunks.select(shifted.alias("chunk"), "bytes")
    met = rays.select("ray", *names).mapInArrow(meet, "chunk long, ray long, " + ", ".join(f"{k} double" for k in names))
    parts = met.groupBy("chunk").cogroup(blocks.groupBy("chunk")).applyInArrow(kernel, "ray long, part array<long>")
    return parts.repartition("ray").sortWithinPartitions("ray").mapInArrow(finish, "ray long, value int")
