"""Queries over volumes: slices, lookups, interpolation, levels, composites, overlays."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelarium.functions import composite as fold
from voxelarium.functions.voxel import chunk_of, idiv, inner_offset, linear_index, shard_of
from voxelarium.model import Coloring, Compositing, Filter, View
from voxelarium.operators import lod, paint, sample
from voxelarium.sources.derived import VE, VL, embedding_volume, label_volume

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return add


def _extent(spark, sf):
    return 8, 8, embedding_volume(spark, sf).agg(F.max("z")).first()[0] + 1


def _pixels(w: int, h: int) -> str:
    return f"px AS (SELECT CAST(i % {w} AS INT) AS px, CAST(i // {w} AS INT) AS py FROM range({w * h}) t(i))"


@query(f"WITH {VE}, {_pixels(16, 16)} SELECT px, py, CAST(coalesce(v, 0) AS INT) AS value FROM px LEFT JOIN ve ON x = px - 8 + 4 AND y = py - 8 + 4 AND z = 120")
def slice_xy(spark, sf):
    return paint.slice_plane(embedding_volume(spark, sf, (120, 120)), View((4, 4, 120), (0, 1, 2), 16, 16))


@query(f"WITH {VE}, {_pixels(16, 128)} SELECT px, py, CAST(coalesce(v, 0) AS INT) AS value FROM px LEFT JOIN ve ON x = px - 8 + 4 AND z = py - 64 + 200 AND y = 3")
def slice_xz(spark, sf):
    return paint.slice_plane(embedding_volume(spark, sf, (136, 263)), View((4, 3, 200), (0, 2, 1), 16, 128))


@query(f"WITH {VE}, {_pixels(128, 16)} SELECT px, py, CAST(coalesce(v, 0) AS INT) AS value FROM px LEFT JOIN ve ON z = (px - 64) * 2 + 250 AND y = (py - 8) * 2 + 4 AND x = 5")
def slice_yz(spark, sf):
    return paint.slice_plane(embedding_volume(spark, sf), View((5, 4, 250), (2, 1, 0), 128, 16, 2))


@query(f"""WITH {VE}, {_pixels(8, 8)},
t AS (SELECT px, py, coalesce(v, 0) AS v FROM px LEFT JOIN ve ON x = px AND y = py AND z = 40)
SELECT px, py, CAST(trunc(CAST((least((greatest(v - 90, 0) * 255) // 125, 255) & 240) AS DOUBLE) / 240.0::DOUBLE * 255.0::DOUBLE) AS INT) AS value FROM t""")
def slice_threshold_quant(spark, sf):
    return paint.slice_plane(embedding_volume(spark, sf, (40, 40)), View((4, 4, 40), (0, 1, 2), 8, 8), Filter(threshold_min=90, threshold_max=40, quant=4))


@query(f"WITH {VL}, {_pixels(8, 256)} SELECT px, py, v AS value FROM px JOIN vl ON x = px AND z = py - 128 + 250 AND y = 2 WHERE v <> 0")
def slice_transparent_zero(spark, sf):
    return paint.slice_plane(label_volume(spark, sf), View((4, 2, 250), (0, 2, 1), 8, 256), transparent_zero=True)


def _points(spark, sf):
    """Places in and around the volume, some beyond its ends and some negative."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    k = F.col("p_partkey")
    return p.select(k.alias("id"), ((k % 41) / 4.0 - 1.0).alias("sx"), ((k % 37) / 4.0 - 0.5).alias("sy"), ((k * 7) % 2011 / 4.0).alias("sz"))


_P = "p AS (SELECT p_partkey AS id, (p_partkey % 41) / 4.0::DOUBLE - 1.0 AS sx, (p_partkey % 37) / 4.0::DOUBLE - 0.5 AS sy, (p_partkey * 7) % 2011 / 4.0::DOUBLE AS sz FROM part)"


@query(f"""WITH {VE}, {_P}, t AS (SELECT id, greatest(CAST(trunc(sx) AS INT), 0) AS tx, greatest(CAST(trunc(sy) AS INT), 0) AS ty, greatest(CAST(trunc(sz) AS INT), 0) AS tz FROM p)
SELECT id, CAST(CASE WHEN tx >= 8 OR ty >= 8 OR tz >= (SELECT max(z) + 1 FROM ve) THEN 0 ELSE coalesce(v, 0) END AS INT) AS value FROM t LEFT JOIN ve ON x = tx AND y = ty AND z = tz""")
def voxel_lookup_oob(spark, sf):
    return sample.nearest(_points(spark, sf), embedding_volume(spark, sf), _extent(spark, sf)).select("id", F.col("value").cast("int").alias("value"))


@query(f"""WITH {VE} SELECT x >> 2 AS cx, y >> 2 AS cy, z >> 2 AS cz, CAST(((z >> 2) * 2 + (y >> 2)) * 2 + (x >> 2) AS BIGINT) AS idx, z >> 4 AS shard_z,
CAST(count(*) AS BIGINT) AS n, CAST(max(((z & 3) << 4) + ((y & 3) << 2) + (x & 3)) AS INT) AS last_offset FROM ve GROUP BY ALL""")
def chunk_key_histogram(spark, sf):
    v = embedding_volume(spark, sf)
    c = [chunk_of(F.col(a), 2).alias(f"c{a}") for a in "xyz"]
    v = v.select(*c, inner_offset(F.col("x"), F.col("y"), F.col("z"), 2).alias("o"))
    _, _, shard_z, _ = shard_of(F.col("cx"), F.col("cy"), F.col("cz"), 2)
    g = v.groupBy("cx", "cy", "cz").agg(F.count("*").alias("n"), F.max("o").cast("int").alias("last_offset"))
    return g.select("cx", "cy", "cz", linear_index(F.col("cx"), F.col("cy"), F.col("cz"), 2, 2).alias("idx"), shard_z.alias("shard_z"), "n", "last_offset")


_STENCIL = f"""b AS (SELECT id, greatest(sx, 0) AS sx, greatest(sy, 0) AS sy, greatest(sz, 0) AS sz FROM p),
k AS (SELECT id, sx, sy, sz, CAST(floor(sx) AS INT) AS bx, CAST(floor(sy) AS INT) AS byy, CAST(floor(sz) AS INT) AS bz FROM b),
o AS (SELECT * FROM (VALUES (0,0,0),(1,0,0),(0,1,0),(1,1,0),(0,0,1),(1,0,1),(0,1,1),(1,1,1)) t(dx, dy, dz))"""


@query(f"""WITH {VE}, {_P}, {_STENCIL},
w AS (SELECT id, CAST(trunc((sx - bx) * 256) AS BIGINT) AS fx, CAST(trunc((sy - byy) * 256) AS BIGINT) AS fy, CAST(trunc((sz - bz) * 256) AS BIGINT) AS fz, bx, byy, bz FROM k),
s AS (SELECT w.id, sum((CASE dx WHEN 1 THEN fx ELSE 256 - fx END) * (CASE dy WHEN 1 THEN fy ELSE 256 - fy END) * (CASE dz WHEN 1 THEN fz ELSE 256 - fz END) * coalesce(v, 0)) AS t
  FROM w, o LEFT JOIN ve ON x = bx + dx AND y = byy + dy AND z = bz + dz GROUP BY w.id)
SELECT p.id, CAST(CASE WHEN sx >= 8 OR sy >= 8 OR sz >= (SELECT max(z) + 1 FROM ve) THEN 0 ELSE CAST(t AS BIGINT) >> 24 END AS INT) AS value FROM p JOIN s ON p.id = s.id""")
def trilinear_q8(spark, sf):
    return sample.trilinear_q8(_points(spark, sf), ["id"], embedding_volume(spark, sf), _extent(spark, sf)).select("id", "value")


@query(ORACLES["trilinear_q8"].replace("CASE WHEN sx >= 8 OR sy >= 8 OR sz >= (SELECT max(z) + 1 FROM ve) THEN 0 ELSE CAST(t AS BIGINT) >> 24 END", "CAST(t AS BIGINT) >> 24"))
def trilinear_q8_chunk_form(spark, sf):
    """The same stencil over dense 4x4x4 chunks, a kernel per chunk."""
    chunks = sample.to_chunks(embedding_volume(spark, sf), 2)
    return sample.trilinear_q8_chunks(_points(spark, sf), ["id"], chunks, 2).select("id", "value")


@query(f"""WITH {VE}, {_P}, {_STENCIL},
c AS (SELECT k.id, any_value(sx - bx) AS fx, any_value(sy - byy) AS fy, any_value(sz - bz) AS fz, {', '.join(f"coalesce(max(CASE WHEN dx + 2 * dy + 4 * dz = {i} THEN v END), 0)::DOUBLE AS c{i}" for i in range(8))}
  FROM k, o LEFT JOIN ve ON x = bx + dx AND y = byy + dy AND z = bz + dz GROUP BY k.id),
r AS (SELECT id, fy, fz, {', '.join(f"c{i} * (1 - fx) + c{i + 1} * fx AS r{i}" for i in (0, 2, 4, 6))} FROM c),
q AS (SELECT id, fz, r0 * (1 - fy) + r2 * fy AS q0, r4 * (1 - fy) + r6 * fy AS q1 FROM r)
SELECT id, CAST(trunc(q0 * (1 - fz) + q1 * fz) AS INT) AS value FROM q""")
def trilinear_f64(spark, sf):
    return sample.trilinear_f64(_points(spark, sf), ["id"], embedding_volume(spark, sf)).select("id", "value")


_LOD = "SELECT x >> 1 AS x, y >> 1 AS y, z >> 1 AS z, CAST(sum(v) // 8 AS INT) AS v FROM {} GROUP BY ALL"


@query(f"WITH {VE} {_LOD.format('ve')}")
def lod_mean_1(spark, sf):
    return lod.halve(embedding_volume(spark, sf))


@query(f"WITH {VE}, l1 AS ({_LOD.format('ve')}) {_LOD.format('l1')}")
def lod_mean_2(spark, sf):
    return lod.halve(lod.halve(embedding_volume(spark, sf)))


@query(f"WITH {VE}, l1 AS ({_LOD.format('ve')}) SELECT x, y, z, v FROM l1 WHERE z < (SELECT (max(z) + 1) // 8 * 4 FROM ve)")
def lod_mean_chunk_form(spark, sf):
    """Means of dense 4x4x4 chunks, back in voxels, over the planes that fill their chunks."""
    v = embedding_volume(spark, sf)
    whole = (v.agg(F.max("z")).first()[0] + 1) // 8 * 4
    halves = lod.halve_chunks(sample.to_chunks(v, 2), 2)
    return sample.to_voxels(halves, 2).where(f"x < 4 AND y < 4 AND z < {whole}")


def _levels(spark, sf):
    """Levels 0 to 2 with only some of the fine places resident."""
    p = lod.pyramid(embedding_volume(spark, sf), 2)
    chunk = F.shiftright("z", 2) + F.shiftright("x", 1)
    return p.where((F.col("lod") == 2) | ((F.col("lod") == 0) & (chunk % 3 == 0)) | ((F.col("lod") == 1) & (chunk % 2 == 0)))


_LEVELS = f"""l1 AS ({_LOD.format('ve')}), l2 AS ({_LOD.format('l1')}),
lv AS (SELECT 0 AS lod, * FROM ve WHERE ((z >> 2) + (x >> 1)) % 3 = 0 UNION ALL SELECT 1, * FROM l1 WHERE ((z >> 2) + (x >> 1)) % 2 = 0 UNION ALL SELECT 2, * FROM l2)"""
_FOUND = """t AS (SELECT id, greatest(sx, 0) AS sx, greatest(sy, 0) AS sy, greatest(sz, 0) AS sz FROM p),
f AS (SELECT t.id, min(lod) AS lod, arg_min(v, lod) AS v FROM t JOIN lv ON x = CAST(floor(sx / (1 << lod)) AS INT) AND y = CAST(floor(sy / (1 << lod)) AS INT) AND z = CAST(floor(sz / (1 << lod)) AS INT) GROUP BY t.id)"""


@query(f"WITH {VE}, {_LEVELS}, {_P}, {_FOUND} SELECT p.id, f.lod, CAST(coalesce(f.v, 0) AS INT) AS value FROM p LEFT JOIN f ON p.id = f.id")
def lod_fallback_nearest(spark, sf):
    return sample.fallback(_points(spark, sf), ["id"], _levels(spark, sf), 2).select("id", "lod", F.col("value").cast("int").alias("value"))


@query(f"""WITH {VE}, {_LEVELS}, {_P}, {_FOUND},
m AS (SELECT t.id, f.lod, sx / (1 << f.lod) AS sx, sy / (1 << f.lod) AS sy, sz / (1 << f.lod) AS sz FROM t JOIN f ON t.id = f.id),
k AS (SELECT *, CAST(floor(sx) AS INT) AS bx, CAST(floor(sy) AS INT) AS byy, CAST(floor(sz) AS INT) AS bz FROM m),
w AS (SELECT id, lod, CAST(trunc((sx - bx) * 256) AS BIGINT) AS fx, CAST(trunc((sy - byy) * 256) AS BIGINT) AS fy, CAST(trunc((sz - bz) * 256) AS BIGINT) AS fz, bx, byy, bz FROM k),
o AS (SELECT * FROM (VALUES (0,0,0),(1,0,0),(0,1,0),(1,1,0),(0,0,1),(1,0,1),(0,1,1),(1,1,1)) t(dx, dy, dz)),
s AS (SELECT w.id, w.lod, sum((CASE dx WHEN 1 THEN fx ELSE 256 - fx END) * (CASE dy WHEN 1 THEN fy ELSE 256 - fy END) * (CASE dz WHEN 1 THEN fz ELSE 256 - fz END) * coalesce(v, 0)) AS t
  FROM w, o LEFT JOIN lv ON lv.lod = w.lod AND x = bx + dx AND y = byy + dy AND z = bz + dz GROUP BY w.id, w.lod)
SELECT p.id, s.lod, CAST(coalesce(CAST(t AS BIGINT) >> 24, 0) AS INT) AS value FROM p LEFT JOIN s ON p.id = s.id""")
def lod_fallback_trilinear(spark, sf):
    return sample.fallback(_points(spark, sf), ["id"], _levels(spark, sf), 2, trilinear=True).select("id", "lod", F.col("value").cast("int").alias("value"))


_AXIS = """ax AS (SELECT t, greatest(least(q >> 8, 7), 0) AS lo, least(greatest(least(q >> 8, 7), 0) + 1, 7) AS hi, CASE WHEN q < 0 OR (q >> 8) >= 7 THEN 0 ELSE q - (greatest(least(q >> 8, 7), 0) << 8) END AS w
  FROM (SELECT CAST(t AS INT) AS t, CAST((2 * t + 1) * 128 // 4 - 128 AS INT) AS q FROM range(32) r(t)))"""


@query(f"""WITH {VE}, {_AXIS}, p AS (SELECT x, y, z - 96 AS z, v FROM ve WHERE z BETWEEN 96 AND 103),
a AS (SELECT ax.t AS x, l.y, l.z, (l.v * (256 - w) + h.v * w) >> 8 AS v FROM ax JOIN p l ON l.x = lo JOIN p h ON h.x = hi AND h.y = l.y AND h.z = l.z),
b AS (SELECT l.x, ax.t AS y, l.z, (l.v * (256 - w) + h.v * w) >> 8 AS v FROM ax JOIN a l ON l.y = lo JOIN a h ON h.y = hi AND h.x = l.x AND h.z = l.z)
SELECT l.x, l.y, ax.t AS z, CAST((l.v * (256 - w) + h.v * w) >> 8 AS INT) AS v FROM ax JOIN b l ON l.z = lo JOIN b h ON h.z = hi AND h.x = l.x AND h.y = l.y""")
def upsample_preview(spark, sf):
    block = embedding_volume(spark, sf, (96, 103)).select("x", "y", (F.col("z") - 96).alias("z"), "v")
    return lod.preview_voxels(block, 2, 8).select("x", "y", "z", F.col("v").cast("int").alias("v"))


# ---- rays: one for each column and block of planes ----
LAYERS = Compositing(in_front=12, behind=12)


def _rays(spark, sf):
    v = embedding_volume(spark, sf).where("z % 25 = 12")
    ray = (idiv(F.col("z"), 25) * 8 + F.col("y")) * 8 + F.col("x")
    return v.select(ray.cast("long").alias("ray"), *[F.col(a).cast("double").alias(f"o{a}") for a in "xyz"], F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(1.0).alias("dz"))


_RAY = f"""{VE}, {VL}, w AS (SELECT CAST(12 - k AS INT) AS w, CAST(k AS INT) AS k FROM range(25) t(k)),
pt AS (SELECT CAST(((z // 25) * 8 + y) * 8 + x AS BIGINT) AS ray, k, x, y, greatest(z + w, 0) AS z FROM ve, w WHERE z % 25 = 12),
sm AS (SELECT pt.ray, pt.k, coalesce(ve.v, 0) AS b, coalesce(vl.v, 0) AS o FROM pt LEFT JOIN ve ON ve.x = pt.x AND ve.y = pt.y AND ve.z = pt.z LEFT JOIN vl ON vl.x = pt.x AND vl.y = pt.y AND vl.z = pt.z)"""


@query(f"WITH {_RAY} SELECT ray, list(b ORDER BY k) AS samples FROM sm GROUP BY ray")
def ray_gather(spark, sf):
    points = sample.rays_to_points(_rays(spark, sf), F.array(*map(F.lit, LAYERS.layers())))
    return sample.gather(sample.nearest(points, embedding_volume(spark, sf), (1 << 30,) * 3))


def _composite(mode: str, **more):
    c = Compositing(mode, in_front=12, behind=12, **more)
    over = label_volume if mode.startswith("overlay") else None
    return lambda spark, sf: paint.rays(_rays(spark, sf), embedding_volume(spark, sf), c, over(spark, sf) if over else None)


PARAMS = {"alpha_min": 100, "alpha_max": 200, "cutoff": 9500, "opacity": 60}
_Q = "least(greatest(({} / 255.0::DOUBLE - 100 / 255.0::DOUBLE) / (200 / 255.0::DOUBLE - 100 / 255.0::DOUBLE), 0), 1)"
_L = "l AS (SELECT ray, list({{'b': CAST(b AS DOUBLE), 'o': CAST(o AS DOUBLE), 'q': {q}, 'r': {r}, 'v': 0.0::DOUBLE, 'a': 0.0::DOUBLE, 'd': 0.0::DOUBLE, 'm': 0.0::DOUBLE}} ORDER BY k) AS items FROM sm{where} GROUP BY ray)"
_ZERO = "{'b': 0.0::DOUBLE, 'o': 0.0::DOUBLE, 'q': 0.0::DOUBLE, 'r': 0.0::DOUBLE, 'v': 0.0::DOUBLE, 'a': 0.0::DOUBLE, 'd': 0.0::DOUBLE, 'm': 0.0::DOUBLE}"


def _fold(v: str, a: str, d: str = "s.d", m: str = "s.m", q: str = _Q.format("b"), r: str = _Q.format("o"), out: str = "greatest(least(f.v * 255.0, 255.0), 0)", where: str = "") -> str:
    """An ordered fold in SQL: the state rides in the fields v, a, d, m of the list's own element type."""
    step = f"{{'b': x.b, 'o': x.o, 'q': x.q, 'r': x.r, 'v': {v}, 'a': {a}, 'd': {d}, 'm': {m}}}"
    return f"""WITH {_RAY}, {_L.format(q=q, r=r, where=where)},
r AS (SELECT ray, list_reduce(list_prepend({_ZERO}, items), lambda s, x: {step}) AS f FROM l)
SELECT ray, CAST(floor({out}) AS INT) AS value FROM r"""


_W = "(1.0 - s.a) * least(x.{} * 0.6::DOUBLE, 1.0)"
_LIVE = "x.{} > 0 AND s.a < 0.95::DOUBLE"
_BLEND = {"v": f"CASE WHEN {_LIVE.format('q')} THEN s.v + {_W.format('q')} * x.q ELSE s.v END", "a": f"CASE WHEN {_LIVE.format('q')} THEN s.a + {_W.format('q')} ELSE s.a END"}

QUERIES["composite_max"] = _composite("max")
ORACLES["composite_max"] = f"WITH {_RAY} SELECT ray, CAST(max(b) AS INT) AS value FROM sm GROUP BY ray"
QUERIES["composite_none"] = _composite("none")
ORACLES["composite_none"] = f"WITH {_RAY} SELECT ray, CAST(0 AS INT) AS value FROM sm GROUP BY ray"
# a mode added from outside: the mean of the samples that are not 0
fold.register("mean_present", lambda base, overlay, c, n: F.coalesce(F.floor(F.try_divide(F.aggregate(base, F.lit(0).cast("long"), lambda s, x: s + x), F.size(F.filter(base, lambda x: x != 0)))), F.lit(0)).cast("int"))
QUERIES["composite_registered"] = _composite("mean_present")
ORACLES["composite_registered"] = f"WITH {_RAY} SELECT ray, CAST(coalesce(floor(sum(b) / nullif(count(*) FILTER (b <> 0), 0)), 0) AS INT) AS value FROM sm GROUP BY ray"
QUERIES["composite_alpha"] = _composite("alpha", **PARAMS)
ORACLES["composite_alpha"] = _fold(**_BLEND)
QUERIES["composite_heightmap"] = _composite("heightmap", **PARAMS)
ORACLES["composite_heightmap"] = _fold(
    v=f"CASE WHEN {_LIVE.format('q')} THEN s.v + {_W.format('q')} * s.d ELSE s.v END", a=_BLEND["a"], d="CASE WHEN s.a >= 0.95::DOUBLE THEN s.d ELSE s.d + 1.0 END",
    out="CASE WHEN f.a = 0 THEN 0 ELSE greatest(least(255.0 - f.v / f.a * 255.0 / 25, 255.0), 0) END")
QUERIES["composite_overlay_opacity"] = _composite("overlay_opacity", **PARAMS)
ORACLES["composite_overlay_opacity"] = _fold(v=f"CASE WHEN {_LIVE.format('r')} THEN s.v + {_W.format('r')} * (x.b / 255.0) ELSE s.v END", a=f"CASE WHEN {_LIVE.format('r')} THEN s.a + {_W.format('r')} ELSE s.a END")
QUERIES["composite_overlay_start"] = _composite("overlay_start", **PARAMS)
ORACLES["composite_overlay_start"] = _fold(**_BLEND, where=" WHERE k >= coalesce((SELECT min(k) FROM sm z WHERE z.ray = sm.ray AND z.o / 255.0::DOUBLE > 100 / 255.0::DOUBLE), 0)")
QUERIES["composite_overlay_combined"] = _composite("overlay_combined", background=0.25, value_norm=0.5, **PARAMS)
# v, a: the masked walk; d, m: the plain one
ORACLES["composite_overlay_combined"] = _fold(
    v="CASE WHEN x.q > 0 AND x.r > 0 AND s.a < 0.95::DOUBLE THEN s.v + (1.0 - s.a) * least(x.r * 0.6::DOUBLE, 1.0) * x.q ELSE s.v END",
    a="CASE WHEN x.q > 0 AND x.r > 0 AND s.a < 0.95::DOUBLE THEN s.a + (1.0 - s.a) * least(x.r * 0.6::DOUBLE, 1.0) ELSE s.a END",
    d="CASE WHEN x.q > 0 AND s.m < 0.95::DOUBLE THEN s.d + (1.0 - s.m) * least(x.q * 0.6::DOUBLE, 1.0) * x.q ELSE s.d END",
    m="CASE WHEN x.q > 0 AND s.m < 0.95::DOUBLE THEN s.m + (1.0 - s.m) * least(x.q * 0.6::DOUBLE, 1.0) ELSE s.m END",
    r=f"{_Q.format('b')} * (o / 255.0::DOUBLE)",
    out="greatest(least((0.75::DOUBLE * (CASE WHEN f.a > 0 THEN f.v / f.a * pow(f.a, 0.5::DOUBLE) ELSE 0.0 END) + 0.25::DOUBLE * f.d) * 255.0, 255.0), 0)")


# ---- overlays ----
VIEW = View((4, 2, 250), (0, 2, 1), 8, 256)
_OV = f"""{VE}, {VL}, {_pixels(8, 256)},
g AS (SELECT px, py, coalesce(ve.v, 0) AS g, coalesce(vl.v, 0) AS l FROM px LEFT JOIN ve ON ve.x = px AND ve.z = py - 128 + 250 AND ve.y = 2 LEFT JOIN vl ON vl.x = px AND vl.z = py - 128 + 250 AND vl.y = 2)"""


def _overlay(c: Coloring, labels=None):
    def run(spark, sf):
        l = label_volume(spark, sf)
        return paint.overlaid(embedding_volume(spark, sf), labels(l) if labels else l, VIEW, c)
    return run


def _mixed(cond: str, rgb: tuple[str, str, str], alpha: str) -> str:
    return f"WITH {_OV} SELECT px, py, " + ", ".join(f"CAST(CASE WHEN {cond} THEN floor(g * (1.0 - {alpha}) + ({c}) * {alpha}) ELSE g END AS INT) AS {n}" for n, c in zip("rgb", rgb, strict=True)) + " FROM g"


_FOUR = lambda v: v.withColumn("v", F.col("v") % 5)
QUERIES["overlay_tint_four"] = _overlay(Coloring("four", 0.4), _FOUR)
ORACLES["overlay_tint_four"] = _mixed("l % 5 <> 0", ("CASE WHEN l % 5 IN (1, 3) THEN 255 ELSE 0 END", "CASE WHEN l % 5 IN (2, 3) THEN 255 ELSE 0 END", "CASE WHEN l % 5 IN (1, 2, 3) THEN 0 ELSE 255 END"), "0.4::DOUBLE")
QUERIES["overlay_tint_boolean"] = _overlay(Coloring("boolean", 0.3, (10, 200, 90)), lambda v: v.withColumn("v", F.when(F.col("v") > 120, 255).otherwise(0)))
ORACLES["overlay_tint_boolean"] = _mixed("l > 120", ("10", "200", "90"), "0.3::DOUBLE")
QUERIES["overlay_tint_hue"] = _overlay(Coloring("hue", 0.5, hue=90.0))
ORACLES["overlay_tint_hue"] = _mixed("l <> 0", ("127", "255", "0"), "(l / 255.0::DOUBLE * 0.5::DOUBLE)")
# a pure hue of 90 degrees at the base's lightness: chroma c, half of it red
QUERIES["overlay_blend_multiply"] = _overlay(Coloring("hue", 0.5, hue=120.0, mode="multiply"))
ORACLES["overlay_blend_multiply"] = f"""WITH {_OV}, c AS (SELECT px, py, g, l, g / 255.0::DOUBLE AS li, (1.0 - abs(2.0 * (g / 255.0::DOUBLE) - 1.0)) * least(l / 255.0::DOUBLE * 0.5::DOUBLE, 1.0) AS c FROM g)
SELECT px, py, CAST(CASE WHEN l <> 0 THEN floor(greatest(least((0.0 + (li - c * 0.5)) * 255.0, 255.0), 0)) ELSE g END AS INT) AS r,
  CAST(CASE WHEN l <> 0 THEN floor(greatest(least((c + (li - c * 0.5)) * 255.0, 255.0), 0)) ELSE g END AS INT) AS g,
  CAST(CASE WHEN l <> 0 THEN floor(greatest(least((0.0 + (li - c * 0.5)) * 255.0, 255.0), 0)) ELSE g END AS INT) AS b FROM c"""
