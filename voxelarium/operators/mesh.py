"""Triangle meshes: spatial cells, rasterisation, barycentric maps.

A range join has no distributed plan of its own, so triangles are dealt to the cells of a grid and joined by cell; a
triangle that spans many cells goes to a coarser grid instead, which bounds the rows it makes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelarium.functions.voxel import affine, affine_normal
from voxelarium.functions.voxel import rgb
from voxelarium.model import Affine, Compositing
from voxelarium.operators import paint, sample

#: Most cells of a side of a triangle before the next coarser grid (eight times as wide) takes it; grids in use.
SPAN, GRIDS = 8, 4


def _low(axis: str):
    return F.least(*[F.col(f"{axis}{i}") for i in (1, 2, 3)])


def _high(axis: str):
    return F.greatest(*[F.col(f"{axis}{i}") for i in (1, 2, 3)])


def to_cells(tri: DataFrame, size: float, axes: str = "uv") -> DataFrame:
    """tri with (grid, cell_<axis>...): one row for each cell its box meets, on the finest grid where it spans few."""
    extent = F.greatest(*[_high(a) - _low(a) for a in axes])
    level = F.lit(GRIDS - 1)
    for k in range(GRIDS - 2, -1, -1):
        level = F.when(extent <= SPAN * size * 8**k, k).otherwise(level)
    out = tri.withColumn("grid", level.cast("int")).withColumn("_s", F.lit(float(size)) * F.pow(F.lit(8.0), F.col("grid")))
    for a in axes:
        out = out.withColumn(f"cell_{a}", F.explode(F.sequence(F.floor(_low(a) / F.col("_s")).cast("long"), F.floor(_high(a) / F.col("_s")).cast("long"))))
    return out.drop("_s")


def point_cells(points: DataFrame, size: float, axes: str = "uv") -> DataFrame:
    """points with (grid, cell_<axis>...): the cell of each grid."""
    out = points.withColumn("grid", F.explode(F.sequence(F.lit(0), F.lit(GRIDS - 1)))).withColumn("_s", F.lit(float(size)) * F.pow(F.lit(8.0), F.col("grid")))
    for a in axes:
        out = out.withColumn(f"cell_{a}", F.floor(F.col(a) / F.col("_s")).cast("long"))
    return out.drop("_s")


def barycentric():
    """(b1, b2, b3) of (u, v) in the triangle u1..v3; null for a flat one."""
    d = (F.col("v2") - F.col("v3")) * (F.col("u1") - F.col("u3")) + (F.col("u3") - F.col("u2")) * (F.col("v1") - F.col("v3"))
    b1 = F.try_divide((F.col("v2") - F.col("v3")) * (F.col("u") - F.col("u3")) + (F.col("u3") - F.col("u2")) * (F.col("v") - F.col("v3")), d)
    b2 = F.try_divide((F.col("v3") - F.col("v1")) * (F.col("u") - F.col("u3")) + (F.col("u1") - F.col("u3")) * (F.col("v") - F.col("v3")), d)
    return b1, b2, 1.0 - b1 - b2


def locate(points: DataFrame, key: list[str], tri: DataFrame, size: float = 4.0, also: tuple[str, ...] = ()) -> DataFrame:
    """points (key, u, v) with the triangle painted last there (the largest tri_id) and x, y, z; others drop out.

    also: further quantities of the corners (as x1, x2, x3 are of x) to interpolate.
    """
    b1, b2, b3 = barycentric()
    hit = point_cells(points, size).join(to_cells(tri, size), ["grid", "cell_u", "cell_v"])
    hit = hit.withColumn("_b", F.array(b1, b2, b3)).where(F.col("_b")[0].isNotNull() & (F.array_min("_b") >= 0.0))
    at = [sum((F.col("_b")[i - 1] * F.col(f"{a}{i}") for i in (2, 3)), F.col("_b")[0] * F.col(f"{a}1")).alias(a) for a in ("x", "y", "z", *also)]
    hit = hit.select(*key, "u", "v", "tri_id", *at)
    return hit.groupBy(*key, "u", "v").agg(F.max_by(F.struct("tri_id", "x", "y", "z", *also), "tri_id").alias("h")).select(*key, "u", "v", "h.*")


def transformed(tri: DataFrame, a: Affine) -> DataFrame:
    """Vertices under an affine map."""
    out = {}
    for i in (1, 2, 3):
        for axis, c in zip("xyz", affine(a, *[F.col(f"{b}{i}") for b in "xyz"]), strict=True):
            out[f"{axis}{i}"] = c
    return tri.withColumns(out)


def face_normals(tri: DataFrame) -> DataFrame:
    u = [F.col(f"{a}2") - F.col(f"{a}1") for a in "xyz"]
    v = [F.col(f"{a}3") - F.col(f"{a}1") for a in "xyz"]
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    same = Affine.uniform(1.0)
    return tri.withColumns(dict(zip(("nx", "ny", "nz"), affine_normal(same, *n), strict=True)))


def unit_uv(tri: DataFrame) -> DataFrame:
    """u and v rescaled to [0, 1] by their extremes (one row, joined to all)."""
    ends = tri.agg(F.min(_low("u")).alias("_u0"), F.max(_high("u")).alias("_u1"), F.min(_low("v")).alias("_v0"), F.max(_high("v")).alias("_v1"))
    out = tri.crossJoin(F.broadcast(ends))  # a single row
    for a in "uv":
        for i in (1, 2, 3):
            out = out.withColumn(f"{a}{i}", F.try_divide(F.col(f"{a}{i}") - F.col(f"_{a}0"), F.col(f"_{a}1") - F.col(f"_{a}0")))
    return out.drop("_u0", "_u1", "_v0", "_v1")


def orthographic(tri: DataFrame) -> DataFrame:
    """UV from x and z, less their minima; normals along y."""
    ends = tri.agg(F.min(_low("x")).alias("_x0"), F.min(_low("z")).alias("_z0"))
    out = tri.crossJoin(F.broadcast(ends))  # a single row
    for i in (1, 2, 3):
        out = out.withColumn(f"u{i}", F.col(f"x{i}") - F.col("_x0")).withColumn(f"v{i}", F.col(f"z{i}") - F.col("_z0"))
    return out.withColumns({"nx": F.lit(0.0), "ny": F.lit(1.0), "nz": F.lit(0.0)}).drop("_x0", "_z0")


NORMAL = ("nx", "ny", "nz")


def with_normals(pixels: DataFrame, tri: DataFrame) -> DataFrame:
    """pixels (px, py, u, v) on a mesh with x, y, z and a normal: that of the corners (nx1 .. nz3) interpolated as it is
    where the mesh has them, else the face's."""
    if "nx1" in tri.columns:
        return locate(pixels, ["px", "py"], tri, also=NORMAL)
    return locate(pixels, ["px", "py"], tri).join(face_normals(tri).select("tri_id", *NORMAL), "tri_id")


def paint_uv(pixels: DataFrame, tri: DataFrame, voxels: DataFrame, w: float = 0.0, extent=(1 << 30,) * 3, trilinear: bool = False) -> DataFrame:
    """(px, py, value) of pixels (px, py, u, v) under a mesh, w along the normal; pixels off the mesh drop out."""
    at = with_normals(pixels, tri)
    at = at.select("px", "py", *[(F.col(a) + w * F.col(f"n{a}")).alias(f"s{a}") for a in "xyz"])
    hit = sample.trilinear_q8(at, ["px", "py"], voxels, extent) if trilinear else sample.nearest(at, voxels, extent)
    return hit.select("px", "py", "value")


def composite_uv(pixels: DataFrame, tri: DataFrame, voxels: DataFrame, c: Compositing, overlay: DataFrame | None = None, w: int = 0) -> DataFrame:
    """(px, py, value): rays along the normals, folded."""
    at = with_normals(pixels, tri).withColumnsRenamed({f"n{a}": f"d{a}" for a in "xyz"})
    ray = F.shiftleft(F.col("py").cast("long"), 32) + F.col("px")
    rays = at.select(ray.alias("ray"), *[F.col(a).alias(f"o{a}") for a in "xyz"], "dx", "dy", "dz")
    out = paint.rays(rays, voxels, c, overlay, w=w)
    return out.select(F.col("ray").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("px"), F.shiftright("ray", 32).cast("int").alias("py"), "value")


def iso_color(x, y, z, place: tuple[float, float, float]):
    """Outline colour of a surface point within 2 of a place's x (blue), y (red) or z (green); null elsewhere."""
    near = lambda c, p: F.abs(c - F.lit(float(p))) < 2.0
    return F.when(near(x, place[0]), rgb(0, 0, 255)).when(near(y, place[1]), rgb(255, 0, 0)).when(near(z, place[2]), rgb(0, 255, 0))
