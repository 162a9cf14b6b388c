"""Renders that combine several operators in one plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelarium.functions.voxel import align_down, align_up, page_index, state_color
from voxelarium.model import Affine, Coloring, Compositing, Crop, Filter, View, natural_level, paint_zoom
from voxelarium.operators import mesh, paint, sample, surface
from voxelarium.plans import surfaces, volumes
from voxelarium.sinks import images
from voxelarium.sources import tiff
from voxelarium.sources.derived import TM, VE, VL, embedding_volume, grid_surface, label_volume, table
from voxelarium.sources.derived import mesh as triangles
from voxelarium.sources.formats import synthetic

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return add


# ---- slices over levels ----
SLICE = View((4, 2, 250), (0, 2, 1), 8, 256)
FILTER = Filter(threshold_min=60, threshold_max=20, quant=5)
_SHOWN = f"""{VE}, {volumes._LEVELS}, px AS (SELECT CAST(i % 8 AS INT) AS px, CAST(i // 8 AS INT) AS py FROM range(2048) t(i)),
s AS (SELECT px, py, min(lod) AS lod, arg_min(v, lod) AS v FROM px JOIN lv ON x = px >> lod AND y = 2 >> lod AND z = (py - 128 + 250) >> lod GROUP BY px, py),
k AS (SELECT px, py, lod, CAST(trunc(CAST((least((greatest(v - 60, 0) * 255) // 175, 255) & 248) AS DOUBLE) / 248.0::DOUBLE * 255.0::DOUBLE) AS INT) AS value FROM s)"""


@query(f"WITH {_SHOWN} SELECT px, py, lod, value FROM k")
def slice_levels_filtered(spark, sf):
    """A slice from the finest resident level of each pixel, filtered: one plan."""
    return paint.slice_levels(volumes._levels(spark, sf), SLICE, 2, FILTER)


@query(f"""WITH {_SHOWN}, {VL}, g AS (SELECT k.px, k.py, k.value AS g, coalesce(vl.v, 0) AS l FROM k LEFT JOIN vl ON vl.x = k.px AND vl.z = k.py - 128 + 250 AND vl.y = 2)
SELECT px, py, {', '.join(f"CAST(CASE WHEN l > 120 THEN floor(g * (1.0 - 0.3::DOUBLE) + {c} * 0.3::DOUBLE) ELSE g END AS INT) AS {n}" for n, c in zip('rgb', (10, 200, 90), strict=True))} FROM g""")
def slice_levels_overlaid(spark, sf):
    """Multi-resolution paint with a label overlay."""
    labels = label_volume(spark, sf).withColumn("v", F.when(F.col("v") > 120, 255).otherwise(0))
    return paint.levels_overlaid(volumes._levels(spark, sf), labels, SLICE, 2, Coloring("boolean", 0.3, (10, 200, 90)), FILTER)


# ---- tinted composite ----
@query(f"""WITH {volumes._RAY}, c AS (SELECT ray, CAST(max(b) AS INT) AS g, max(o) AS l FROM sm GROUP BY ray)
SELECT ray, {', '.join(f"CAST(CASE WHEN l <> 0 THEN floor(g * (1.0 - (l / 255.0::DOUBLE * 0.5::DOUBLE)) + {c} * (l / 255.0::DOUBLE * 0.5::DOUBLE)) ELSE g END AS INT) AS {n}" for n, c in zip('rgb', (127, 255, 0), strict=True))} FROM c""")
def composite_tinted(spark, sf):
    c = Compositing("max", in_front=12, behind=12)
    return paint.tinted_rays(volumes._rays(spark, sf), embedding_volume(spark, sf), label_volume(spark, sf), c, Coloring("hue", 0.5, hue=90.0))


# ---- meshes with normals at their corners ----
def _corner(axis: str, u, v):
    k = {"x": (3, 1, 5), "y": (1, 2, 7), "z": (2, 5, 3)}[axis]
    return (F.pmod(u * k[0] + v * k[1], F.lit(float(k[2]))) - k[2] // 2) / 4.0


def _bent(spark, sf):
    t = triangles(grid_surface(spark, sf))
    return t.withColumns({f"n{a}{i}": _corner(a, F.col(f"u{i}"), F.col(f"v{i}")) for i in (1, 2, 3) for a in "xyz"})


def _corner_sql(a: str, i: int) -> str:
    k = {"x": (3, 1, 5), "y": (1, 2, 7), "z": (2, 5, 3)}[a]
    return f"((u{i} * {k[0]} + v{i} * {k[1]}) % {k[2]} - {k[2] // 2}) / 4.0::DOUBLE"


_HIT = surfaces._ON[: surfaces._ON.index("o AS (SELECT px, py, b1 * x1")]
_BENT = _HIT + "e AS (SELECT px, py, b1 * x1 + b2 * x2 + b3 * x3 AS x, b1 * y1 + b2 * y2 + b3 * y3 AS y, b1 * z1 + b2 * z2 + b3 * z3 AS z, " + ", ".join("b1 * ({}) + b2 * ({}) + b3 * ({}) AS n{}".format(*[_corner_sql(a, i) for i in (1, 2, 3)], a) for a in "xyz") + " FROM i)"


def _bent_volume(spark, sf, offsets):
    at = mesh.with_normals(surfaces._uv_pixels(spark), _bent(spark, sf)).withColumn("w", F.explode(F.array(*map(F.lit, offsets))))
    return surfaces._dense(spark, at.select(*[F.greatest((F.col(a) + F.col("w") * F.col(f"n{a}")).cast("int"), F.lit(0)).alias(a) for a in "xyz"]))


@query(f"WITH {TM}, {_BENT} SELECT px, py, CAST({surfaces._formula('x + 3.0 * nx', 'y + 3.0 * ny', 'z + 3.0 * nz')} AS INT) AS value FROM e")
def mesh_vertex_normals_paint(spark, sf):
    return mesh.paint_uv(surfaces._uv_pixels(spark), _bent(spark, sf), _bent_volume(spark, sf, [3.0]), 3.0).select("px", "py", F.col("value").cast("int").alias("value"))


@query(f"WITH {TM}, {_BENT}, w AS (SELECT CAST(k - 2 AS INT) AS w FROM range(5) t(k)) SELECT px, py, CAST(max({surfaces._formula('x + w * nx', 'y + w * ny', 'z + w * nz')}) AS INT) AS value FROM e, w GROUP BY px, py")
def mesh_vertex_normals_composite(spark, sf):
    c = Compositing("max", in_front=2, behind=2)
    return mesh.composite_uv(surfaces._uv_pixels(spark), _bent(spark, sf), _bent_volume(spark, sf, [float(w) for w in range(-2, 3)]), c).select("px", "py", F.col("value").cast("int").alias("value"))


INVERSE = surfaces.MOVE.inverted()


@query(f"WITH {TM} SELECT tri_id, {', '.join(f'round({a}{i}, 6) AS {a}{i}' for i in (1, 2, 3) for a in 'xyz')} FROM tm")
def mesh_affine_inverse(spark, sf):
    """A transform, then its composition with another and both inverses: the mesh as it was."""
    other = Affine.uniform(2.0)
    back = other.inverted().then(INVERSE)
    t = mesh.transformed(mesh.transformed(triangles(grid_surface(spark, sf)), surfaces.MOVE.then(other)), back)
    return t.select("tri_id", *[(F.round(f"{a}{i}", 6) + 0.0).alias(f"{a}{i}") for i in (1, 2, 3) for a in "xyz"])


# ---- outlines as pixels ----
@query(f"""WITH s AS (SELECT tri_id, {', '.join(f"CAST(floor({c}{k} / 4) AS INT) AS {c}{k}" for k in (0, 1) for c in 'xy')} FROM ({surfaces.ORACLES['plane_outline_segments']})),
n AS (SELECT *, greatest(abs(x1 - x0), abs(y1 - y0)) AS n FROM s), k AS (SELECT *, unnest(range(n)) AS k FROM n WHERE n > 0),
d AS (SELECT CAST(x0 + sign(x1 - x0) * ((2 * k * abs(x1 - x0) + n) // (2 * n)) AS INT) AS px, CAST(y0 + sign(y1 - y0) * ((2 * k * abs(y1 - y0) + n) // (2 * n)) AS INT) AS py, false AS marker FROM k
  UNION ALL SELECT CAST(x0 + i AS INT), CAST(y0 + j AS INT), true FROM s, range(-1, 2) a(i), range(-1, 2) b(j))
SELECT px, py, bool_or(marker) AS marker FROM d GROUP BY px, py""")
def outline_raster(spark, sf):
    """The outline of a mesh in a plane, drawn with markers at the ends of its segments."""
    s = surfaces.QUERIES["plane_outline_segments"](spark, sf)
    s = s.select(F.lit(0).alias("pane"), *[F.floor(F.col(f"{c}{k}") / 4).cast("int").alias(f"{c}{k}") for k in (0, 1) for c in "xy"])
    return paint.outline_raster(s, ["pane"]).select("px", "py", "marker")


# ---- an offline render as one plan ----
@query(f"""WITH {surfaces.SG}, {surfaces._FLAT}, p AS (SELECT CAST(w.w AS INT) AS w, c AS px, r AS py, px AS sx, py AS sy, pz + w.w - 1 AS sz FROM fl, range(3) w(w) WHERE valid AND c >= 8 AND c < 56 AND r >= 8 AND r < 120),
a AS (SELECT p.w, p.px, p.py, coalesce(vs.v, 0) AS v FROM p LEFT JOIN vs ON vs.x = CAST(trunc(sx) AS INT) AND vs.y = CAST(trunc(sy) AS INT) AND vs.z = CAST(trunc(sz) AS INT)),
g AS (SELECT CAST(w AS INT) AS w, CAST(px AS INT) AS px, CAST(py AS INT) AS py FROM range(3) w(w), range(64) x(px), range(128) y(py))
SELECT g.w, g.px, g.py, CAST(coalesce(a.v, 0) AS INT) AS value FROM g LEFT JOIN a USING (w, px, py)""")
def offline_render(spark, sf):
    """Tiles of three layers under a crop: located, sampled, assembled to tiles and encoded to tiled images, in one plan
    up to the files' contents, then decoded for the result."""
    t = paint.render_tiles(spark, 64, 128, 3, 16, Crop(8, 8, 48, 112))
    g = surfaces._flat(spark, sf).where("valid").withColumn("tu", F.floor(F.col("c") / 16).cast("int")).withColumn("tv", F.floor(F.col("r") / 16).cast("int"))
    p = t.join(g, ["tu", "tv"]).where("c >= x0 AND c < x1 AND r >= y0 AND r < y1")
    p = p.select("w", F.col("c").alias("_c"), F.col("r").alias("_r"), F.col("px").alias("sx"), F.col("py").alias("sy"), (F.col("pz") + F.col("w") - 1).alias("sz"))
    hit = sample.nearest(p, surfaces._scaled(spark, sf), (1 << 30,) * 3).select("w", F.col("_c").alias("px"), F.col("_r").alias("py"), "value")
    return decoded(images.layers(images.tiles(hit, 16), 64, 128, 16))


def decoded(files):
    """(w, px, py, value) of tiled images (w, content)."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for w, raw in zip(b.column("w").to_pylist(), b.column("content").to_pylist(), strict=True):
                image = tiff.read(raw)[0]
                y, x = np.indices(image.shape, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(image.size, w, np.int32)), pa.array(x.ravel()), pa.array(y.ravel()), pa.array(image.ravel().astype(np.int32))], ["w", "px", "py", "value"])

    return files.select("w", "content").mapInArrow(run, "w int, px int, py int, value int")


# ---- addresses, zooms, colours ----
@query(f"""WITH {VE} SELECT x, y, z, CAST(((CAST(z >> 4 AS BIGINT) << 16) + ((y >> 4) << 8) + (x >> 4)) * 4096 + ((((z >> 2) & 3) << 4) + (((y >> 2) & 3) << 2) + ((x >> 2) & 3)) * 64 + ((z & 3) << 4) + ((y & 3) << 2) + (x & 3) AS BIGINT) AS place FROM ve""")
def paged_places(spark, sf):
    v = embedding_volume(spark, sf)
    return v.select("x", "y", "z", page_index(F.col("x"), F.col("y"), F.col("z")).cast("long").alias("place"))


@query("""WITH z AS (SELECT CAST(k AS INT) AS k, k / 16.0::DOUBLE AS zoom FROM range(1, 97) t(k)), n AS (SELECT *, CAST(ceil(1 / zoom) AS INT) AS n, CAST(trunc(1 / zoom) AS INT) AS l FROM z)
SELECT k, CAST(CASE WHEN zoom >= 1 THEN 1 ELSE least(CAST(pow(2, ceil(log2(least(n, 32)))) AS INT), 32) END AS INT) AS step, CAST(CASE WHEN l = 0 THEN 0 ELSE floor(log2(l)) + 1 END AS INT) AS level FROM n""")
def zoom_steps(spark, sf):
    """Paint steps and natural levels of zooms from 1/16 to 6."""
    return spark.createDataFrame([(k, paint_zoom(k / 16), natural_level(k / 16)) for k in range(1, 97)], "k int, step int, level int")


@query("SELECT p_partkey AS id, CAST((p_partkey - 700) // 32 * 32 AS BIGINT) AS low, CAST((p_partkey + 31) // 32 * 32 AS BIGINT) AS high FROM part WHERE p_partkey > 731")
def zoom_alignment(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").where(k > 731).select(k.alias("id"), align_down(k - 700, 32).cast("long").alias("low"), align_up(k, 32).cast("long").alias("high"))


_COLORS = {"empty": (60, 200, 110), "fine": (60, 130, 230), "fine_d": (40, 200, 220), "pending": (230, 200, 40), "pending_d": (230, 140, 40), "cooldown": (220, 60, 60), "missing": (220, 60, 220)}


@query("WITH c AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'empty' WHEN 1 THEN 'pending' WHEN 2 THEN 'cooldown' WHEN 3 THEN 'missing' END AS state, CASE WHEN o_orderkey % 3 < 2 THEN o_orderkey % 3 END AS chosen, o_custkey % 2 = 0 AS d FROM orders), n AS (SELECT id, CASE WHEN state = 'empty' THEN 'empty' WHEN chosen = 0 THEN NULL WHEN chosen IS NOT NULL THEN CASE WHEN d THEN 'fine_d' ELSE 'fine' END WHEN state = 'pending' THEN CASE WHEN d THEN 'pending_d' ELSE 'pending' END WHEN state = 'cooldown' THEN 'cooldown' ELSE 'missing' END AS name FROM c) SELECT id, " + ", ".join(f"CAST(CASE name {' '.join(f'WHEN {chr(39)}{n}{chr(39)} THEN {v[i]}' for n, v in _COLORS.items())} END AS INT) AS {c}" for i, c in enumerate("rgb")) + " FROM n")
def state_colors(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    state = F.when(k % 5 == 0, "empty").when(k % 5 == 1, "pending").when(k % 5 == 2, "cooldown").when(k % 5 == 3, "missing")
    c = state_color(F.lit(0).cast("long"), F.when(k % 3 < 2, k % 3), state, F.col("o_custkey") % 2 == 0)
    return o.select(k.alias("id"), c.alias("c")).select("id", "c.r", "c.g", "c.b")


@query("SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(z AS INT) AS z, CAST((x * 7 + y * 13 + z * 29) % 251 AS INT) AS v FROM range(20) a(x), range(15) b(y), range(40) c(z)")
def synthetic_volume(spark, sf):
    return synthetic(spark, (20, 15, 40), lambda x, y, z: (x * 7 + y * 13 + z * 29) % 251)


@query("""WITH g AS (SELECT x, y, z, 14695981039346656037::UBIGINT AS h FROM range(24) a(x), range(20) b(y), range(16) c(z)),
""" + ", ".join(f"m{c} AS (SELECT x, y, z, CAST((xor(h, CAST({c} AS UBIGINT))::HUGEINT * 1099511628211) % 18446744073709551616::HUGEINT AS UBIGINT) AS h FROM {'g' if c == 'x' else 's' + before}), s{c} AS (SELECT x, y, z, xor(h, h >> 15) AS h FROM m{c})" for c, before in (("x", ""), ("y", "x"), ("z", "y"))) + """
SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(z AS INT) AS z, CAST((h >> 24) & 255 AS INT) AS v FROM sz""")
def hashed_volume(spark, sf):
    """The deterministic hash volume, in dense blocks."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        from voxelarium.functions.kernels import voxel_hash

        for b in batches:
            for z in b.column(0).to_pylist():
                y, x = np.indices((20, 24), np.int32).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(np.full(len(x), z, np.int32)), pa.array(voxel_hash(x, y, np.full(len(x), z)).astype(np.int32))], ["x", "y", "z", "v"])

    return spark.range(16).mapInArrow(run, "x int, y int, z int, v int")


# ---- triangles by cells of space ----
@query(f"""WITH {TM}, c AS (SELECT tri_id, unnest(range(CAST(floor(least(x1, x2, x3) / 64) AS BIGINT), CAST(floor(greatest(x1, x2, x3) / 64) AS BIGINT) + 1)) AS cx, least(y1, y2, y3) AS y0, greatest(y1, y2, y3) AS yy, least(z1, z2, z3) AS z0, greatest(z1, z2, z3) AS zz FROM tm),
d AS (SELECT tri_id, cx, unnest(range(CAST(floor(y0 / 64) AS BIGINT), CAST(floor(yy / 64) AS BIGINT) + 1)) AS cy, z0, zz FROM c), e AS (SELECT tri_id, cx, cy, unnest(range(CAST(floor(z0 / 64) AS BIGINT), CAST(floor(zz / 64) AS BIGINT) + 1)) AS cz FROM d)
SELECT CAST(cx AS BIGINT) AS cell_x, CAST(cy AS BIGINT) AS cell_y, CAST(cz AS BIGINT) AS cell_z, count(*) AS n, min(tri_id) AS first FROM e GROUP BY cx, cy, cz""")
def mesh_xyz_cells(spark, sf):
    cells = mesh.to_cells(triangles(grid_surface(spark, sf)), 64.0, "xyz")
    return cells.groupBy("cell_x", "cell_y", "cell_z").agg(F.count("*").alias("n"), F.min("tri_id").alias("first"))
