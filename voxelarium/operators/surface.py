"""Grid surfaces: bilinear sampling, normals, bounding boxes, outlines with a plane."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelarium.functions.voxel import bilinear, crosses, crossing


def quads(grid: DataFrame) -> DataFrame:
    """(r, c) of every quad of the grid with its four corners as structs p00, p01, p10, p11; those absent are null.

    One window along the rows and one equi-join with the row below: no per-corner join.
    """
    cell = F.struct("px", "py", "pz", "valid")
    along = Window.partitionBy("r").orderBy("c")
    right = F.when(F.lead("c").over(along) == F.col("c") + 1, F.lead(cell).over(along))
    row = grid.select("r", "c", cell.alias("a"), right.alias("b"))
    below = row.select((F.col("r") - 1).alias("r"), "c", F.col("a").alias("p10"), F.col("b").alias("p11"))
    return row.select("r", "c", F.col("a").alias("p00"), F.col("b").alias("p01")).join(below, ["r", "c"], "left")


def whole(q: DataFrame) -> DataFrame:
    """Quads whose four corners are valid."""
    ok = F.lit(True)
    for k in ("p00", "p01", "p10", "p11"):
        ok = ok & F.coalesce(F.col(f"{k}.valid"), F.lit(False))
    return q.where(ok)


def sample(points: DataFrame, grid: DataFrame) -> DataFrame:
    """Points (gc, gr in grid cells) with px, py, pz, null where a corner is absent or invalid."""
    at = points.withColumn("c", F.floor("gc").cast("int")).withColumn("r", F.floor("gr").cast("int"))
    joined = at.join(whole(quads(grid)), ["r", "c"], "left")
    dx, dy = F.col("gc") - F.col("c"), F.col("gr") - F.col("r")
    out = joined.select("*", *[bilinear(F.col(f"p00.p{a}"), F.col(f"p01.p{a}"), F.col(f"p10.p{a}"), F.col(f"p11.p{a}"), dx, dy).alias(f"p{a}") for a in "xyz"])
    return out.drop("r", "c", "p00", "p01", "p10", "p11")


def normals(grid: DataFrame) -> DataFrame:
    """(r, c, nx, ny, nz): cross product of central differences; 0 on borders, beside invalid cells, and when short."""
    cell = F.when(F.col("valid"), F.struct("px", "py", "pz"))
    row, col = Window.partitionBy("r").orderBy("c"), Window.partitionBy("c").orderBy("r")
    g = grid.select("r", "c", "valid", cell.alias("p")).select(
        "r", "c", "valid",
        F.when(F.lag("c").over(row) == F.col("c") - 1, F.lag("p").over(row)).alias("w"),
        F.when(F.lead("c").over(row) == F.col("c") + 1, F.lead("p").over(row)).alias("e"),
        F.when(F.lag("r").over(col) == F.col("r") - 1, F.lag("p").over(col)).alias("n"),
        F.when(F.lead("r").over(col) == F.col("r") + 1, F.lead("p").over(col)).alias("s"),
    )
    d = lambda a, b: [F.col(f"{b}.p{x}") - F.col(f"{a}.p{x}") for x in "xyz"]
    u, v = d("w", "e"), d("n", "s")
    cross = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    size = F.sqrt(cross[0] * cross[0] + cross[1] * cross[1] + cross[2] * cross[2])
    good = F.col("valid") & F.col("w").isNotNull() & F.col("e").isNotNull() & F.col("n").isNotNull() & F.col("s").isNotNull() & (size > 1e-6)
    return g.select("r", "c", *[F.when(good, x / size).otherwise(0.0).alias(f"n{a}") for x, a in zip(cross, "xyz", strict=True)])


def boxes(grid: DataFrame) -> DataFrame:
    """(r, c, min and max of each axis) of whole quads."""
    q = whole(quads(grid))
    corners = lambda a: [F.col(f"{k}.p{a}") for k in ("p00", "p01", "p10", "p11")]
    return q.select("r", "c", *[f(*corners(a)).alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.least), ("max", F.greatest))])


def outlines(triangles: DataFrame, axis: str, w: float) -> DataFrame:
    """Segments in which triangles (tri_id, x1..z3) cut the plane axis = w: those with exactly two crossed edges.

    The plane is a literal, so triangles are filtered by their extent on the axis before anything else.
    """
    a = [F.col(f"{axis}{i}") for i in (1, 2, 3)]
    near = triangles.where((F.least(*a) <= w) & (F.greatest(*a) >= w))
    edges = []
    for i, j in ((1, 2), (2, 3), (3, 1)):
        p, q = F.col(f"{axis}{i}"), F.col(f"{axis}{j}")
        t = crossing(p, q, w)
        point = F.struct(*[(F.col(f"{b}{i}") + (F.col(f"{b}{j}") - F.col(f"{b}{i}")) * t).alias(b) for b in "xyz"])
        edges.append(F.when(crosses(p, q, w), point))
    cut = near.withColumn("_p", F.filter(F.array(*edges), lambda e: e.isNotNull())).where(F.size("_p") == 2)
    return cut.select("tri_id", *[F.get("_p", F.lit(k))[b].alias(f"{b}{k}") for k in (0, 1) for b in "xyz"])


def uv_size(rows: int, cols: int, scale: tuple[float, float]) -> tuple[int, int]:
    """Nominal (width, height) of a grid in segment coordinates."""
    return round(cols / scale[0]), round(rows / scale[1])


def to_grid(points: DataFrame, scale: tuple[float, float]) -> DataFrame:
    """Segment coordinates (u, v) to grid cells (gc, gr)."""
    return points.withColumn("gc", F.col("u") * scale[0]).withColumn("gr", F.col("v") * scale[1])
