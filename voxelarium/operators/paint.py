"""Rasters: axis-aligned slices, surface images, composites, overlays, tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelarium.functions import composite as fold
from voxelarium.functions.voxel import filtered, idiv, tinted
from voxelarium.model import Coloring, Compositing, Crop, Filter, View
from voxelarium.operators import sample, surface


def pixels(spark: SparkSession, width: int, height: int) -> DataFrame:
    """(px, py) of an image."""
    i = spark.range(width * height)
    return i.select((F.col("id") % width).cast("int").alias("px"), idiv(F.col("id"), width).cast("int").alias("py"))


def view_points(spark: SparkSession, view: View) -> DataFrame:
    """Pixels of a view with their integer volume place (x, y, z), one step of paint_zoom apart."""
    u, v, w = view.axes
    names = "xyz"
    p = pixels(spark, view.width, view.height)
    at = {
        names[u]: (F.col("px") - view.width // 2) * view.paint_zoom + view.center[u],
        names[v]: (F.col("py") - view.height // 2) * view.paint_zoom + view.center[v],
        names[w]: F.lit(view.center[w]),
    }
    return p.select("px", "py", *[at[n].cast("int").alias(n) for n in names])


def box(view: View) -> dict[str, tuple[int, int]]:
    """Extent of a view on each axis, for pruning the voxels before the join."""
    u, v, w = view.axes
    out = {"xyz"[w]: (view.center[w], view.center[w])}
    for axis, size in ((u, view.width), (v, view.height)):
        low = view.center[axis] - size // 2 * view.paint_zoom
        out["xyz"[axis]] = (low, low + (size - 1) * view.paint_zoom)
    return out


def slice_plane(voxels: DataFrame, view: View, f: Filter | None = None, transparent_zero: bool = False) -> DataFrame:
    """(px, py, value) of a plane.  Pixels without a voxel are 0, or left out where zero is transparent.

    The view's box restricts the voxels by literals, which reach a Parquet scan or a generated column as a filter; the
    pixel side is as small as the image.
    """
    near = voxels
    for a, (low, high) in box(view).items():
        near = near.where((F.col(a) >= low) & (F.col(a) <= high))
    if transparent_zero:
        near = near.where("v <> 0")
    joined = view_points(voxels.sparkSession, view).join(near, ["x", "y", "z"], "inner" if transparent_zero else "left")
    value = F.coalesce("v", F.lit(0))
    return joined.select("px", "py", (filtered(value, f) if f else value).cast("int").alias("value"))


def overlaid(base: DataFrame, overlay: DataFrame, view: View, c: Coloring, f: Filter | None = None) -> DataFrame:
    """(px, py, r, g, b) of a slice under a label volume's colouring."""
    labels = slice_plane(overlay, view).withColumnRenamed("value", "label")
    joined = slice_plane(base, view, f).join(labels, ["px", "py"])
    return joined.withColumn("_c", tinted(F.col("value"), F.col("label"), c)).select("px", "py", "_c.r", "_c.g", "_c.b")


def rays(surface_points: DataFrame, voxels: DataFrame, c: Compositing, overlay: DataFrame | None = None, extent=(1 << 30,) * 3, w: int = 0) -> DataFrame:
    """Composite of rays (ray, ox..dz) of a surface: samples by nearest voxel along the normal, folded in order."""
    layers = F.array(*map(F.lit, c.layers(w)))
    points = sample.rays_to_points(surface_points, layers)
    base = sample.nearest(points, voxels, extent, "b")
    if overlay is not None:
        base = sample.nearest(base, overlay, extent, "o")
        both = base.groupBy("ray").agg(F.array_sort(F.collect_list(F.struct("k", "b", "o"))).alias("s"))
        return both.select("ray", fold.composite(c, F.transform("s", lambda x: x["b"]), F.transform("s", lambda x: x["o"]), len(c.layers(w))).alias("value"))
    if c.mode == "max":
        return base.groupBy("ray").agg(F.max("b").alias("value"))
    return sample.gather(base, "b").select("ray", fold.composite(c, F.col("samples"), None, len(c.layers(w))).alias("value"))


def tinted_rays(surface_points: DataFrame, voxels: DataFrame, overlay: DataFrame, c: Compositing, coloring: Coloring, extent=(1 << 30,) * 3, w: int = 0) -> DataFrame:
    """(ray, r, g, b): the base folded by its mode, tinted by the largest label along the ray."""
    most = Compositing("max", in_front=c.in_front, behind=c.behind, reverse=c.reverse)
    labels = rays(surface_points, overlay, most, extent=extent, w=w).withColumnRenamed("value", "label")
    both = rays(surface_points, voxels, c, extent=extent, w=w).join(labels, "ray")
    return both.withColumn("_c", tinted(F.col("value"), F.col("label"), coloring)).select("ray", "_c.r", "_c.g", "_c.b")


def slice_levels(levels: DataFrame, view: View, most: int, f: Filter | None = None) -> DataFrame:
    """(px, py, lod, value) of a plane: each pixel from the finest level that is resident there, filtered; pixels that no
    level holds drop out, and so does a plane below 0.  A coarse level is painted over by any finer one."""
    p = view_points(levels.sparkSession, view).where(" AND ".join(f"{a} >= 0" for a in "xyz"))
    points = p.select("px", "py", *[F.col(a).cast("double").alias(f"s{a}") for a in "xyz"])
    hit = sample.fallback(points, ["px", "py"], levels, most).where("lod IS NOT NULL")
    value = filtered(F.col("value"), f) if f else F.col("value")
    return hit.select("px", "py", "lod", value.cast("int").alias("value"))


def levels_overlaid(levels: DataFrame, overlay: DataFrame, view: View, most: int, c: Coloring, f: Filter | None = None) -> DataFrame:
    """(px, py, r, g, b) of slice_levels under a label volume's colouring."""
    labels = slice_plane(overlay, view).withColumnRenamed("value", "label")
    both = slice_levels(levels, view, most, f).join(labels, ["px", "py"], "left")
    return both.withColumn("_c", tinted(F.col("value"), F.coalesce("label", F.lit(0)), c)).select("px", "py", "_c.r", "_c.g", "_c.b")


def outline_raster(segments: DataFrame, key: list[str], radius: int = 1) -> DataFrame:
    """Distinct pixels (key, px, py, marker) of outline segments (x0, y0, x1, y1) and square markers at their starts."""
    drawn = lines(segments, key).withColumn("marker", F.lit(False))
    dots = points(segments.select(*key, F.col("x0").alias("px"), F.col("y0").alias("py")), key, radius).withColumn("marker", F.lit(True))
    return drawn.unionByName(dots).groupBy(*key, "px", "py").agg(F.max("marker").alias("marker"))


def surface_image(spark: SparkSession, grid: DataFrame, voxels: DataFrame, width: int, height: int, scale=(1.0, 1.0), origin=(0.0, 0.0), step: float = 1.0) -> DataFrame:
    """(px, py, value): the volume at the surface point under each pixel, null where there is no surface."""
    p = pixels(spark, width, height).withColumn("u", F.col("px") * step + origin[0]).withColumn("v", F.col("py") * step + origin[1])
    named = p.select(F.col("px").alias("_iu"), F.col("py").alias("_iv"), "u", "v")  # px, py, pz are the surface's point below
    at = surface.sample(surface.to_grid(named, scale), grid).select(F.col("_iu"), F.col("_iv"), *[F.col(f"p{a}").alias(f"s{a}") for a in "xyz"])
    hit = sample.nearest(at.where("sx IS NOT NULL"), voxels, (1 << 30,) * 3)
    return p.select("px", "py").join(hit.select(F.col("_iu").alias("px"), F.col("_iv").alias("py"), "value"), ["px", "py"], "left")


def tiles(spark: SparkSession, view: View, tile: int = 256, border: int = 1) -> DataFrame:
    """(tu, tv) of the tiles of a viewport and one more on each side."""
    u, v, _ = view.axes
    span = tile * view.paint_zoom

    def ends(axis: int, size: int):
        low, high = view.center[axis] - size * view.paint_zoom // 2, view.center[axis] + size * view.paint_zoom // 2
        return low // span - border, high // span + border

    (u0, u1), (v0, v1) = ends(u, view.width), ends(v, view.height)
    i = spark.range((u1 - u0 + 1) * (v1 - v0 + 1))
    return i.select((F.col("id") % (u1 - u0 + 1) + u0).cast("int").alias("tu"), (idiv(F.col("id"), u1 - u0 + 1) + v0).cast("int").alias("tv"))


def coarser_tile(wanted: DataFrame, have: DataFrame, most: int = 3) -> DataFrame:
    """Each wanted tile (level, tu, tv) with the nearest level that can stand in: a parent up to so many levels up,
    else the finest level with any child up to so many down."""
    up = wanted.withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(most))))
    up = up.select("level", "tu", "tv", "_d", (F.col("level") + F.col("_d")).alias("_l"), *[F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_d"))).cast("int").alias(f"_{c}") for c in ("tu", "tv")])
    h = have.select(F.col("level").alias("_l"), F.col("tu").alias("_tu"), F.col("tv").alias("_tv"))
    parent = up.join(h, ["_l", "_tu", "_tv"]).groupBy("level", "tu", "tv").agg(F.min("_l").alias("parent"))
    down = have.withColumn("_d", F.explode(F.sequence(F.lit(1), F.lit(most))))
    down = down.select((F.col("level") + F.col("_d")).alias("level"), F.col("level").alias("_l"), *[F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_d"))).cast("int").alias(c) for c in ("tu", "tv")])
    child = down.groupBy("level", "tu", "tv").agg(F.min("_l").alias("child"))
    return wanted.join(parent, ["level", "tu", "tv"], "left").join(child, ["level", "tu", "tv"], "left").select("level", "tu", "tv", F.coalesce("parent", "child").alias("source_level"))


def render_tiles(spark: SparkSession, width: int, height: int, layers: int, tile: int, crop: Crop | None = None) -> DataFrame:
    """(w, tv, tu) of an offline render in delivery order, with the crop's pixels of each tile (x0, y0, x1, y1)."""
    crop = crop or Crop(0, 0, width, height)
    nu, nv = -(-width // tile), -(-height // tile)
    i = spark.range(nu * nv * layers)
    t = i.select(idiv(F.col("id"), nu * nv).cast("int").alias("w"), (idiv(F.col("id"), nu) % nv).cast("int").alias("tv"), (F.col("id") % nu).cast("int").alias("tu"))
    x0, y0 = F.greatest(F.col("tu") * tile, F.lit(crop.left)), F.greatest(F.col("tv") * tile, F.lit(crop.top))
    x1, y1 = F.least((F.col("tu") + 1) * tile, F.lit(min(width, crop.left + crop.width))), F.least((F.col("tv") + 1) * tile, F.lit(min(height, crop.top + crop.height)))
    return t.select("*", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")).where("x0 < x1 AND y0 < y1").orderBy("w", "tv", "tu")


def lines(segments: DataFrame, key: list[str]) -> DataFrame:
    """Pixels (key, px, py) of segments (x0, y0, x1, y1), the end excluded: one step of the longer axis at a time, the
    other axis rounded to the nearest (halves away from the start)."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    n = F.greatest(F.abs(dx), F.abs(dy))
    s = segments.withColumn("_n", n).where("_n > 0").withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    step = lambda a, d: (F.col(a) + F.signum(d) * idiv(2 * F.col("_k") * F.abs(d) + F.col("_n"), 2 * F.col("_n"))).cast("int")
    return s.select(*key, step("x0", dx).alias("px"), step("y0", dy).alias("py"))


def points(places: DataFrame, key: list[str], radius: int = 1) -> DataFrame:
    """Square markers around places (px, py)."""
    d = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)]))
    return places.withColumn("_d", d).select(*key, (F.col("px") + F.col("_d.i")).alias("px"), (F.col("py") + F.col("_d.j")).alias("py"))
