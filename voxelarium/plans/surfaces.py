"""Queries over grid surfaces and triangle meshes."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelarium.functions.voxel import affine
from voxelarium.model import Affine, Compositing
from voxelarium.operators import mesh, paint, residency, sample, surface
from voxelarium.sources.derived import SG, TM, embedding_volume, grid_surface
from voxelarium.sources.derived import mesh as triangles

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return add


_QUAD = """q AS (SELECT a.r, a.c, a.px ax, a.py ay, a.pz az, b.px bx, b.py byy, b.pz bz, d.px dx, d.py dy, d.pz dz, e.px ex, e.py ey, e.pz ez
  FROM sg a JOIN sg b ON b.r = a.r AND b.c = a.c + 1 JOIN sg d ON d.r = a.r + 1 AND d.c = a.c JOIN sg e ON e.r = a.r + 1 AND e.c = a.c + 1 WHERE a.valid AND b.valid AND d.valid AND e.valid)"""
_AT = "p AS (SELECT p_partkey AS id, (p_partkey % 257) / 4.0::DOUBLE AS gc, (p_partkey * 13) % 1999 / 4.0::DOUBLE AS gr FROM part)"


def _at(spark, sf):
    k = F.col("p_partkey")
    return spark.read.parquet(f"{sf}/part.parquet").select(k.alias("id"), ((k % 257) / 4.0).alias("gc"), ((k * 13) % 1999 / 4.0).alias("gr"))


def _bilinear(a: str) -> str:
    s = {"x": ("ax", "bx", "dx", "ex"), "y": ("ay", "byy", "dy", "ey"), "z": ("az", "bz", "dz", "ez")}[a]
    return f"{s[0]} * ((1 - u) * (1 - v)) + {s[1]} * (u * (1 - v)) + {s[2]} * ((1 - u) * v) + {s[3]} * (u * v)"


@query(f"""WITH {SG}, {_QUAD}, {_AT}, t AS (SELECT id, CAST(floor(gc) AS INT) c, CAST(floor(gr) AS INT) r, gc - floor(gc) u, gr - floor(gr) v FROM p)
SELECT t.id, {', '.join(f"round({_bilinear(a)}, 6) AS p{a}" for a in "xyz")} FROM t LEFT JOIN q ON q.r = t.r AND q.c = t.c""")
def grid_bilinear(spark, sf):
    s = surface.sample(_at(spark, sf), grid_surface(spark, sf))
    return s.select("id", *[F.round(f"p{a}", 6).alias(f"p{a}") for a in "xyz"])


_NORMAL = """n AS (SELECT g.r, g.c, CASE WHEN g.valid AND w.valid AND e.valid AND n.valid AND s.valid THEN
    {'ux': e.px - w.px, 'uy': e.py - w.py, 'uz': e.pz - w.pz, 'vx': s.px - n.px, 'vy': s.py - n.py, 'vz': s.pz - n.pz} END AS d
  FROM sg g LEFT JOIN sg w ON w.r = g.r AND w.c = g.c - 1 LEFT JOIN sg e ON e.r = g.r AND e.c = g.c + 1 LEFT JOIN sg n ON n.c = g.c AND n.r = g.r - 1 LEFT JOIN sg s ON s.c = g.c AND s.r = g.r + 1),
m AS (SELECT r, c, d.uy * d.vz - d.uz * d.vy AS nx, d.uz * d.vx - d.ux * d.vz AS ny, d.ux * d.vy - d.uy * d.vx AS nz FROM n),
k AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS s FROM m)"""


@query(f"WITH {SG}, {_NORMAL} SELECT r, c, {', '.join(f'round(CASE WHEN s > 1e-6 THEN n{a} / s ELSE 0.0 END, 9) AS n{a}' for a in 'xyz')} FROM k")
def grid_normals(spark, sf):
    return surface.normals(grid_surface(spark, sf)).select("r", "c", *[F.round(f"n{a}", 9).alias(f"n{a}") for a in "xyz"])


@query(f"""WITH {SG}, {_QUAD} SELECT r, c, {', '.join(f"{f}({x}) AS {n}_{a}" for a, x in (("x", "ax, bx, dx, ex"), ("y", "ay, byy, dy, ey"), ("z", "az, bz, dz, ez")) for n, f in (("min", "least"), ("max", "greatest")))} FROM q""")
def grid_quad_aabb(spark, sf):
    return surface.boxes(grid_surface(spark, sf))


@query(f"""WITH {SG}, {_QUAD}, {_AT}, w AS (SELECT id, gc * 4 AS u, gr * 4 AS v FROM p), t AS (SELECT id, CAST(floor(u * 0.25) AS INT) c, CAST(floor(v * 0.25) AS INT) r, u * 0.25 - floor(u * 0.25) u, v * 0.25 - floor(v * 0.25) v FROM w)
SELECT t.id, {', '.join(f"CAST(trunc({_bilinear(a)}) AS INT) AS {a}" for a in "xyz")} FROM t JOIN q ON q.r = t.r AND q.c = t.c""")
def grid_to_world(spark, sf):
    p = _at(spark, sf).select("id", (F.col("gc") * 4).alias("u"), (F.col("gr") * 4).alias("v"))
    s = surface.sample(surface.to_grid(p, (0.25, 0.25)), grid_surface(spark, sf)).where("px IS NOT NULL")
    return s.select("id", *[F.col(f"p{a}").cast("int").alias(a) for a in "xyz"])


def _scaled(spark, sf):
    """The embedding volume spread over the surface's place, so that its points fall into voxels."""
    return embedding_volume(spark, sf).select((F.col("x") * 8).alias("x"), (F.col("z") * 10).alias("y"), (F.col("y") * 16 + 1080).alias("z"), "v")


def _flat(spark, sf):
    """Grid points brought onto the lattice of the scaled volume."""
    return grid_surface(spark, sf).select("r", "c", (8.0 * (F.col("c") % 8)).alias("px"), (10.0 * F.col("r")).alias("py"), (1080.0 + 16.0 * F.floor(F.col("c") / 8)).alias("pz"), "valid")


_FLAT = """vs AS (SELECT x * 8 AS x, z * 10 AS y, y * 16 + 1080 AS z, v FROM ve),
fl AS (SELECT r, c, 8.0::DOUBLE * (c % 8) AS px, 10.0::DOUBLE * r AS py, 1080.0::DOUBLE + 16.0 * (c // 8) AS pz, valid FROM sg)"""
_FQUAD = _QUAD.replace("sg ", "fl ").replace("q AS", "fq AS")


@query(f"""WITH {SG}, {_FLAT}, {_FQUAD}, px AS (SELECT CAST(i % 64 AS INT) px, CAST(i // 64 AS INT) py FROM range(4096) t(i)),
t AS (SELECT px, py, px * 1.0 c0, py * 1.0 r0, CAST(px AS INT) c, CAST(py AS INT) r, 0.0::DOUBLE u, 0.0::DOUBLE v FROM px),
s AS (SELECT px, py, CAST(trunc({_bilinear('x')}) AS INT) x, CAST(trunc({_bilinear('y')}) AS INT) y, CAST(trunc({_bilinear('z')}) AS INT) z FROM t JOIN fq ON fq.r = t.r AND fq.c = t.c)
SELECT px.px, px.py, CASE WHEN s.px IS NULL THEN NULL ELSE CAST(coalesce(vs.v, 0) AS INT) END AS value FROM px LEFT JOIN s ON s.px = px.px AND s.py = px.py LEFT JOIN vs ON vs.x = s.x AND vs.y = s.y AND vs.z = s.z""")
def grid_uv_paint(spark, sf):
    return paint.surface_image(spark, _flat(spark, sf), _scaled(spark, sf), 64, 64).select("px", "py", F.col("value").cast("int").alias("value"))


@query(f"""WITH {SG}, {_FLAT}, w AS (SELECT CAST(8 - k AS INT) w FROM range(17) t(k)),
s AS (SELECT c, w, px + 0 * w AS x, py AS y, pz + w AS z FROM fl, w WHERE r = 20 AND valid)
SELECT c, w, CAST(coalesce(vs.v, 0) AS INT) AS value FROM s LEFT JOIN vs ON vs.x = CAST(trunc(s.x) AS INT) AND vs.y = CAST(trunc(s.y) AS INT) AND vs.z = CAST(trunc(s.z) AS INT)""")
def grid_cross_section_uw(spark, sf):
    g = _flat(spark, sf).where("r = 20 AND valid").withColumn("w", F.explode(F.sequence(F.lit(8), F.lit(-8), F.lit(-1))))
    p = g.select("c", "w", F.col("px").alias("sx"), F.col("py").alias("sy"), (F.col("pz") + F.col("w")).alias("sz"))
    return sample.nearest(p, _scaled(spark, sf), (1 << 30,) * 3).select("c", "w", F.col("value").cast("int").alias("value"))


@query(f"""WITH {SG}, {_FLAT}, w AS (SELECT CAST(8 - k AS INT) w FROM range(17) t(k)),
s AS (SELECT r, w, px AS x, py AS y, pz + w AS z FROM fl, w WHERE c = 11 AND valid)
SELECT r, w, CAST(coalesce(vs.v, 0) AS INT) AS value FROM s LEFT JOIN vs ON vs.x = CAST(trunc(s.x) AS INT) AND vs.y = CAST(trunc(s.y) AS INT) AND vs.z = CAST(trunc(s.z) AS INT)""")
def grid_cross_section_vw(spark, sf):
    g = _flat(spark, sf).where("c = 11 AND valid").withColumn("w", F.explode(F.sequence(F.lit(8), F.lit(-8), F.lit(-1))))
    p = g.select("r", "w", F.col("px").alias("sx"), F.col("py").alias("sy"), (F.col("pz") + F.col("w")).alias("sz"))
    return sample.nearest(p, _scaled(spark, sf), (1 << 30,) * 3).select("r", "w", F.col("value").cast("int").alias("value"))


@query(f"""WITH {SG}, {_FLAT}, w AS (SELECT CAST(4 - k AS INT) w FROM range(9) t(k)),
s AS (SELECT CAST(r AS BIGINT) * 64 + c AS ray, px AS x, py AS y, pz + w AS z FROM fl, w WHERE valid)
SELECT ray, CAST(max(coalesce(vs.v, 0)) AS INT) AS value FROM s LEFT JOIN vs ON vs.x = CAST(trunc(s.x) AS INT) AND vs.y = CAST(trunc(s.y) AS INT) AND vs.z = CAST(trunc(s.z) AS INT) GROUP BY ray""")
def surface_composite_max(spark, sf):
    g = _flat(spark, sf).where("valid")
    rays = g.select((F.col("r").cast("long") * 64 + F.col("c")).alias("ray"), *[F.col(f"p{a}").alias(f"o{a}") for a in "xyz"], F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(1.0).alias("dz"))
    return paint.rays(rays, _scaled(spark, sf), Compositing("max", in_front=4, behind=4))


_SIGN = "CASE WHEN {} >= 0 THEN 1 ELSE -1 END"


def _outline(axis: str, w: float) -> str:
    parts = []
    for n, (i, j) in enumerate(((1, 2), (2, 3), (3, 1))):
        a, b = f"({axis}{i} - {w})", f"({axis}{j} - {w})"
        t = f"({a} / nullif({a} - {b}, 0))"
        parts.append(f"SELECT tri_id, {n} AS n, {', '.join(f'{c}{i} + ({c}{j} - {c}{i}) * {t} AS {c}' for c in 'xyz')} FROM tm WHERE ({_SIGN.format(a)}) <> ({_SIGN.format(b)})")
    return f"""WITH {TM}, pt AS ({' UNION ALL '.join(parts)}),
g AS (SELECT tri_id, list({{'x': x, 'y': y, 'z': z}} ORDER BY n) AS p FROM pt GROUP BY tri_id HAVING count(*) = 2)
SELECT tri_id, {', '.join(f'round(p[{k + 1}].{c}, 6) AS {c}{k}' for k in (0, 1) for c in 'xyz')} FROM g"""


@query(_outline("z", 1128.0))
def plane_outline_segments(spark, sf):
    s = surface.outlines(triangles(grid_surface(spark, sf)), "z", 1128.0)
    return s.select("tri_id", *[F.round(f"{c}{k}", 6).alias(f"{c}{k}") for k in (0, 1) for c in "xyz"])


@query(f"SELECT tri_id, (tri_id // 2) % 64 BETWEEN 16 AND 31 AND (tri_id // 128) BETWEEN 100 AND 199 AS highlighted FROM ({_outline('x', 313.0)})")
def plane_outline_highlight(spark, sf):
    s = surface.outlines(triangles(grid_surface(spark, sf)), "x", 313.0)
    c, r = F.floor(F.col("tri_id") / 2) % 64, F.floor(F.col("tri_id") / 128)
    return s.select("tri_id", (c.between(16, 31) & r.between(100, 199)).alias("highlighted"))


@query(f"""WITH {TM} SELECT CAST(cu AS BIGINT) AS cell_u, CAST(cv AS BIGINT) AS cell_v, count(*) AS n, min(tri_id) AS first FROM (
  SELECT tri_id, unnest(range(CAST(floor(least(u1, u2, u3) / 4) AS BIGINT), CAST(floor(greatest(u1, u2, u3) / 4) AS BIGINT) + 1)) AS cu, least(v1, v2, v3) AS lo, greatest(v1, v2, v3) AS hi FROM tm) a,
  LATERAL (SELECT unnest(range(CAST(floor(lo / 4) AS BIGINT), CAST(floor(hi / 4) AS BIGINT) + 1)) AS cv) GROUP BY cu, cv""")
def mesh_uv_cells(spark, sf):
    cells = mesh.to_cells(triangles(grid_surface(spark, sf)), 4.0)
    return cells.groupBy("cell_u", "cell_v").agg(F.count("*").alias("n"), F.min("tri_id").alias("first"))


_UV = "p AS (SELECT p_partkey AS id, (p_partkey % 509) / 8.0::DOUBLE + 0.03125 AS u, (p_partkey * 11) % 3989 / 8.0::DOUBLE + 0.015625 AS v FROM part)"


@query(f"""WITH {TM}, {_UV},
h AS (SELECT p.id, p.u, p.v, tm.*, (v2 - v3) * (u1 - u3) + (u3 - u2) * (v1 - v3) AS d FROM p JOIN tm ON p.u BETWEEN least(u1, u2, u3) AND greatest(u1, u2, u3) AND p.v BETWEEN least(v1, v2, v3) AND greatest(v1, v2, v3)),
b AS (SELECT *, ((v2 - v3) * (u - u3) + (u3 - u2) * (v - v3)) / d AS b1, ((v3 - v1) * (u - u3) + (u1 - u3) * (v - v3)) / d AS b2 FROM h),
k AS (SELECT *, 1.0 - b1 - b2 AS b3 FROM b), i AS (SELECT * FROM k WHERE b1 >= 0 AND b2 >= 0 AND b3 >= 0)
SELECT id, tri_id, {', '.join(f'round(b1 * {a}1 + b2 * {a}2 + b3 * {a}3, 6) AS {a}' for a in 'xyz')} FROM i QUALIFY row_number() OVER (PARTITION BY id ORDER BY tri_id DESC) = 1""")
def mesh_point_in_triangle(spark, sf):
    k = F.col("p_partkey")
    p = spark.read.parquet(f"{sf}/part.parquet").select(k.alias("id"), ((k % 509) / 8.0 + 0.03125).alias("u"), ((k * 11) % 3989 / 8.0 + 0.015625).alias("v"))
    hit = mesh.locate(p, ["id"], triangles(grid_surface(spark, sf)))
    return hit.select("id", "tri_id", *[F.round(a, 6).alias(a) for a in "xyz"])


MOVE = Affine(((0.5, 0.0, 0.25, 3.0), (0.0, 2.0, 0.0, -1.0), (0.0, 0.5, 1.0, 7.0)))


@query(f"WITH {TM} SELECT tri_id, {', '.join(f'x{i} * 0.5 + y{i} * 0.0 + z{i} * 0.25 + 3.0 AS x{i}, x{i} * 0.0 + y{i} * 2.0 + z{i} * 0.0 - 1.0 AS y{i}, x{i} * 0.0 + y{i} * 0.5 + z{i} * 1.0 + 7.0 AS z{i}' for i in (1, 2, 3))} FROM tm")
def mesh_affine(spark, sf):
    t = mesh.transformed(triangles(grid_surface(spark, sf)), MOVE)
    return t.select("tri_id", *[f"{a}{i}" for i in (1, 2, 3) for a in "xyz"])


@query(f"WITH {TM}, e AS (SELECT min(least(x1, x2, x3)) x0, min(least(z1, z2, z3)) z0 FROM tm) SELECT tri_id, {', '.join(f'x{i} - x0 AS u{i}, z{i} - z0 AS v{i}' for i in (1, 2, 3))} FROM tm, e")
def mesh_ortho_xz(spark, sf):
    return mesh.orthographic(triangles(grid_surface(spark, sf))).select("tri_id", *[f"{a}{i}" for i in (1, 2, 3) for a in "uv"])


@query(f"WITH {TM}, e AS (SELECT min(least(u1, u2, u3)) u0, max(greatest(u1, u2, u3)) ux, min(least(v1, v2, v3)) v0, max(greatest(v1, v2, v3)) vx FROM tm) SELECT tri_id, {', '.join(f'(u{i} - u0) / (ux - u0) AS u{i}, (v{i} - v0) / (vx - v0) AS v{i}' for i in (1, 2, 3))} FROM tm, e")
def mesh_unit_uv(spark, sf):
    return mesh.unit_uv(triangles(grid_surface(spark, sf))).select("tri_id", *[f"{a}{i}" for i in (1, 2, 3) for a in "uv"])


@query(f"""WITH {TM}, n AS (SELECT tri_id, (y2 - y1) * (z3 - z1) - (z2 - z1) * (y3 - y1) AS nx, (z2 - z1) * (x3 - x1) - (x2 - x1) * (z3 - z1) AS ny, (x2 - x1) * (y3 - y1) - (y2 - y1) * (x3 - x1) AS nz FROM tm), s AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS l FROM n)
SELECT tri_id, {', '.join(f'round(CASE WHEN l > 1e-6 THEN n{a} / l ELSE 0.0 END, 9) AS n{a}' for a in 'xyz')} FROM s""")
def mesh_face_normals(spark, sf):
    return mesh.face_normals(triangles(grid_surface(spark, sf))).select("tri_id", *[F.round(f"n{a}", 9).alias(f"n{a}") for a in "xyz"])


@query(f"""WITH {TM}, b AS (SELECT tri_id, least(x1, x2, x3) lx, greatest(x1, x2, x3) hx, least(y1, y2, y3) ly, greatest(y1, y2, y3) hy, least(z1, z2, z3) lz, greatest(z1, z2, z3) hz FROM tm),
g AS (SELECT CAST(a AS INT) cx, CAST(b AS INT) cy, CAST(c AS INT) cz FROM range((SELECT max(floor(hx / 64))::BIGINT + 1 FROM b)) t(a), range((SELECT max(floor(hy / 64))::BIGINT + 1 FROM b)) u(b), range((SELECT max(floor(hz / 64))::BIGINT + 1 FROM b)) w(c))
SELECT cx, cy, cz, count(*) AS n FROM b JOIN g ON floor(lx / 64) <= cx AND floor(hx / 64) >= cx AND floor(ly / 64) <= cy AND floor(hy / 64) >= cy AND floor(lz / 64) <= cz AND floor(hz / 64) >= cz GROUP BY ALL""")
def aabb_touch(spark, sf):
    t = triangles(grid_surface(spark, sf))
    box = t.select("tri_id", *[f(*[F.col(f"{a}{i}") for i in (1, 2, 3)]).alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.least), ("max", F.greatest))])
    extent = tuple((int(h // 64) + 1) * 64 for h in box.agg(*[F.max(f"max_{a}") for a in "xyz"]).first())
    return residency.touched(box, extent).groupBy("cx", "cy", "cz").agg(F.count("*").alias("n"))


_BOXES = "CAST(floor(least(x1, x2, x3) / {s}) AS BIGINT) lx, CAST(floor(greatest(x1, x2, x3) / {s}) AS BIGINT) hx, CAST(floor(least(y1, y2, y3) / {s}) AS BIGINT) ly, CAST(floor(greatest(y1, y2, y3) / {s}) AS BIGINT) hy, CAST(floor(least(z1, z2, z3) / {s}) AS BIGINT) lz, CAST(floor(greatest(z1, z2, z3) / {s}) AS BIGINT) hz"


@query(f"""WITH {TM}, b AS (SELECT 0 AS lod, {_BOXES.format(s=64)} FROM tm UNION ALL SELECT 3, {_BOXES.format(s=512)} FROM tm),
x AS (SELECT DISTINCT lod, unnest(range(lx, hx + 1)) AS cx, ly, hy, lz, hz FROM b), y AS (SELECT DISTINCT lod, cx, unnest(range(ly, hy + 1)) AS cy, lz, hz FROM x)
SELECT DISTINCT CAST(lod AS INT) AS lod, CAST(cx AS INT) AS cx, CAST(cy AS INT) AS cy, CAST(unnest(range(lz, hz + 1)) AS INT) AS cz FROM y""")
def aabb_pretouch(spark, sf):
    """What a mesh needs ahead, with the chunks of a coarse preview."""
    t = triangles(grid_surface(spark, sf))
    box = t.select(*[f(*[F.col(f"{a}{i}") for i in (1, 2, 3)]).alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.least), ("max", F.greatest))])
    extent = tuple((int(h // 512) + 1) * 512 for h in box.agg(*[F.max(f"max_{a}") for a in "xyz"]).first())
    return residency.pretouched(box, extent, 0, 3)


@query(f"""WITH {SG}, w AS (SELECT k - 8 AS w FROM range(17) t(k)) SELECT DISTINCT c // 16 AS tu, r // 16 AS tv, CAST(floor(px / 64) AS INT) AS cx, CAST(floor(py / 64) AS INT) AS cy, CAST(floor((pz + w) / 64) AS INT) AS cz FROM sg, w WHERE valid""")
def tile_chunk_distinct(spark, sf):
    """The chunks each 16x16 tile of a composited render needs: the sample plan without its data join."""
    g = grid_surface(spark, sf).where("valid").withColumn("w", F.explode(F.sequence(F.lit(-8), F.lit(8))))
    return g.select(F.floor(F.col("c") / 16).cast("int").alias("tu"), F.floor(F.col("r") / 16).cast("int").alias("tv"), F.floor(F.col("px") / 64).cast("int").alias("cx"), F.floor(F.col("py") / 64).cast("int").alias("cy"), F.floor((F.col("pz") + F.col("w")) / 64).cast("int").alias("cz")).distinct()


@query(f"""WITH {SG}, {_FLAT}, tl AS (SELECT CAST(i // 32 AS INT) w, CAST(i // 4 % 8 AS INT) tv, CAST(i % 4 AS INT) tu FROM range(96) t(i)),
k AS (SELECT *, greatest(tu * 16, 8) x0, greatest(tv * 16, 8) y0, least((tu + 1) * 16, 56) x1, least((tv + 1) * 16, 120) y1 FROM tl),
p AS (SELECT w, tv, tu, c, r, px, py, pz FROM k JOIN fl ON c >= x0 AND c < x1 AND r >= y0 AND r < y1 WHERE valid)
SELECT p.w, tv, tu, c AS px, r AS py, CAST(coalesce(vs.v, 0) AS INT) AS value FROM p LEFT JOIN vs ON vs.x = CAST(trunc(p.px) AS INT) AND vs.y = CAST(trunc(p.py) AS INT) AND vs.z = CAST(trunc(p.pz + p.w - 1) AS INT)""")
def render_tiles(spark, sf):
    """An offline render of three layers in tiles with a crop: one plan, no tile loop."""
    from voxelarium.model import Crop

    t = paint.render_tiles(spark, 64, 128, 3, 16, Crop(8, 8, 48, 112))
    g = _flat(spark, sf).where("valid AND c >= 8 AND c < 56 AND r >= 8 AND r < 120").withColumn("tu", F.floor(F.col("c") / 16).cast("int")).withColumn("tv", F.floor(F.col("r") / 16).cast("int"))
    p = t.join(g, ["tu", "tv"]).where("c >= x0 AND c < x1 AND r >= y0 AND r < y1")
    p = p.select("w", "tv", "tu", F.col("c").alias("px"), F.col("r").alias("py"), F.col("px").alias("sx"), F.col("py").alias("sy"), (F.col("pz") + F.col("w") - 1).alias("sz"))
    return sample.nearest(p, _scaled(spark, sf), (1 << 30,) * 3).select("w", "tv", "tu", "px", "py", F.col("value").cast("int").alias("value"))


def _uv_pixels(spark):
    return paint.pixels(spark, 126, 120).select("px", "py", (F.col("px") / 2.0 + 0.3125).alias("u"), (F.col("py") / 2.0 + 0.15625).alias("v"))


_ON = """pp AS (SELECT CAST(i % 126 AS INT) px, CAST(i // 126 AS INT) py FROM range(15120) t(i)), p AS (SELECT px, py, px / 2.0::DOUBLE + 0.3125 AS u, py / 2.0::DOUBLE + 0.15625 AS v FROM pp),
h AS (SELECT p.px, p.py, p.u, p.v, tm.*, (v2 - v3) * (u1 - u3) + (u3 - u2) * (v1 - v3) AS d FROM p JOIN (SELECT * FROM tm WHERE least(v1, v2, v3) <= 61) tm ON p.u BETWEEN least(u1, u2, u3) AND greatest(u1, u2, u3) AND p.v BETWEEN least(v1, v2, v3) AND greatest(v1, v2, v3)),
b AS (SELECT *, ((v2 - v3) * (u - u3) + (u3 - u2) * (v - v3)) / d AS b1, ((v3 - v1) * (u - u3) + (u1 - u3) * (v - v3)) / d AS b2 FROM h),
k AS (SELECT *, 1.0 - b1 - b2 AS b3 FROM b), i AS (SELECT * FROM k WHERE b1 >= 0 AND b2 >= 0 AND b3 >= 0 QUALIFY row_number() OVER (PARTITION BY px, py ORDER BY tri_id DESC) = 1),
o AS (SELECT px, py, b1 * x1 + b2 * x2 + b3 * x3 AS x, b1 * y1 + b2 * y2 + b3 * y3 AS y, b1 * z1 + b2 * z2 + b3 * z3 AS z,
  (y2 - y1) * (z3 - z1) - (z2 - z1) * (y3 - y1) AS nx, (z2 - z1) * (x3 - x1) - (x2 - x1) * (z3 - z1) AS ny, (x2 - x1) * (y3 - y1) - (y2 - y1) * (x3 - x1) AS nz FROM i),
e AS (SELECT px, py, x, y, z, CASE WHEN sqrt(nx * nx + ny * ny + nz * nz) > 1e-6 THEN nx / sqrt(nx * nx + ny * ny + nz * nz) ELSE 0 END AS nx, CASE WHEN sqrt(nx * nx + ny * ny + nz * nz) > 1e-6 THEN ny / sqrt(nx * nx + ny * ny + nz * nz) ELSE 0 END AS ny, CASE WHEN sqrt(nx * nx + ny * ny + nz * nz) > 1e-6 THEN nz / sqrt(nx * nx + ny * ny + nz * nz) ELSE 0 END AS nz FROM o)"""


def _dense(spark, t):
    """Voxels of a formula at the places wanted (a table of the dense volume would hold five million)."""
    return t.select("x", "y", "z").distinct().where("x >= 0 AND x < 700 AND y >= 0 AND y < 700 AND z >= 1080 AND z < 1260").withColumn("v", ((F.col("x") * 7 + F.col("y") * 13 + F.col("z") * 29) % 251).cast("int"))


def _formula(x: str, y: str, z: str) -> str:
    x, y, z = (f"greatest(CAST(trunc({c}) AS INT), 0)" for c in (x, y, z))
    return f"CASE WHEN {x} < 700 AND {y} < 700 AND {z} BETWEEN 1080 AND 1259 THEN ({x} * 7 + {y} * 13 + {z} * 29) % 251 ELSE 0 END"


def _around(spark, sf, offsets):
    """The dense volume restricted to the voxels around the mesh of the pixels."""
    t = triangles(grid_surface(spark, sf))
    n = mesh.face_normals(t).select("tri_id", "nx", "ny", "nz")
    at = mesh.locate(_uv_pixels(spark), ["px", "py"], t).join(n, "tri_id").withColumn("w", F.explode(F.array(*map(F.lit, offsets))))
    places = at.select(*[F.greatest((F.col(a) + F.col("w") * F.col(f"n{a}")).cast("int"), F.lit(0)).alias(a) for a in "xyz"])
    return t, _dense(spark, places)


@query(f"WITH {TM}, {_ON} SELECT px, py, CAST({_formula('x + 2.0 * nx', 'y + 2.0 * ny', 'z + 2.0 * nz')} AS INT) AS value FROM e")
def mesh_uv_paint(spark, sf):
    t, v = _around(spark, sf, [2.0])
    return mesh.paint_uv(_uv_pixels(spark), t, v, 2.0).select("px", "py", F.col("value").cast("int").alias("value"))


@query(f"WITH {TM}, {_ON}, w AS (SELECT CAST(k - 3 AS INT) AS w FROM range(7) t(k)) SELECT px, py, CAST(max({_formula('x + w * nx', 'y + w * ny', 'z + w * nz')}) AS INT) AS value FROM e, w GROUP BY px, py")
def mesh_uv_composite(spark, sf):
    t, v = _around(spark, sf, [float(w) for w in range(-3, 4)])
    return mesh.composite_uv(_uv_pixels(spark), t, v, Compositing("max", in_front=3, behind=3)).select("px", "py", F.col("value").cast("int").alias("value"))


@query(f"WITH {TM}, {_ON} SELECT px, py, CAST(CASE WHEN abs(x - 300.0) < 2.0 THEN 0 ELSE CASE WHEN abs(y - 200.0) < 2.0 THEN 255 ELSE 0 END END AS INT) AS r, CAST(CASE WHEN abs(x - 300.0) < 2.0 OR abs(y - 200.0) < 2.0 THEN 0 ELSE 255 END AS INT) AS g, CAST(CASE WHEN abs(x - 300.0) < 2.0 THEN 255 ELSE 0 END AS INT) AS b FROM o WHERE abs(x - 300.0) < 2.0 OR abs(y - 200.0) < 2.0 OR abs(z - 1128.0) < 2.0")
def uv_iso_outline(spark, sf):
    at = mesh.locate(_uv_pixels(spark), ["px", "py"], triangles(grid_surface(spark, sf)))
    out = at.withColumn("c", mesh.iso_color(F.col("x"), F.col("y"), F.col("z"), (300.0, 200.0, 1128.0))).where("c IS NOT NULL")
    return out.select("px", "py", "c.r", "c.g", "c.b")


@query("""WITH s AS (SELECT s_suppkey AS id, CAST(s_suppkey * 7 % 61 AS INT) x0, CAST(s_suppkey * 11 % 53 AS INT) y0, CAST(s_suppkey * 5 % 67 AS INT) x1, CAST(s_suppkey * 3 % 59 AS INT) y1 FROM supplier),
n AS (SELECT *, greatest(abs(x1 - x0), abs(y1 - y0)) AS n FROM s), k AS (SELECT *, unnest(range(n)) AS k FROM n WHERE n > 0)
SELECT id, CAST(x0 + sign(x1 - x0) * ((2 * k * abs(x1 - x0) + n) // (2 * n)) AS INT) AS px, CAST(y0 + sign(y1 - y0) * ((2 * k * abs(y1 - y0) + n) // (2 * n)) AS INT) AS py FROM k""")
def line_raster(spark, sf):
    k = F.col("s_suppkey")
    s = spark.read.parquet(f"{sf}/supplier.parquet").select(k.alias("id"), (k * 7 % 61).cast("int").alias("x0"), (k * 11 % 53).cast("int").alias("y0"), (k * 5 % 67).cast("int").alias("x1"), (k * 3 % 59).cast("int").alias("y1"))
    return paint.lines(s, ["id"])
