"""Readers and writers of every file form, each on files that the query writes into the shared folder first."""

from __future__ import annotations

import json
import struct

import numpy as np
import zstandard
from pyspark.sql import functions as F

from voxelarium.operators import lod, sample
from voxelarium.plans.rasters import decoded
from voxelarium.shared import folder as _folder
from voxelarium.sinks import images
from voxelarium.sources import formats, tiff, zarr
from voxelarium.sources.derived import EV, VE, VL, chunk_state, embedding_volume, label_volume, table
from voxelarium.sources.derived import telemetry as events
from voxelarium.sources.store import plain, put

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return add


#: A small solid that file forms are tried on, as a formula of x, y, z.
SOLID = "(x * 7 + y * 13 + z * 29) % 251"


def _solid(nx: int, ny: int, nz: int) -> np.ndarray:
    z, y, x = np.indices((nz, ny, nx))
    return ((x * 7 + y * 13 + z * 29) % 251).astype(np.uint8)


def _range(nx: int, ny: int, nz: int, value: str = SOLID) -> str:
    return f"SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(z AS INT) AS z, CAST({value} AS INT) AS v FROM range({nx}) a(x), range({ny}) b(y), range({nz}) c(z)"


# ---- arrays ----
@query(f"WITH {VE}, l1 AS (SELECT x >> 1 AS x, y >> 1 AS y, z >> 1 AS z, CAST(sum(v) // 8 AS INT) AS v FROM ve GROUP BY ALL) SELECT 0 AS lod, x, y, z, v FROM ve UNION ALL SELECT 1, x, y, z, v FROM l1")
def ome_levels(spark, sf):
    """A group of two published levels of three, read with its levels' numbers."""
    folder = _folder(spark, "ome")
    v = embedding_volume(spark, sf)
    n = v.agg(F.max("z")).first()[0] + 1
    shapes = [(n, 8, 8), (-(-n // 2), 4, 4)]
    for k, level in enumerate((v, lod.halve(v))):
        zarr.write(sample.to_chunks(level, 4), f"{folder}/s{k}", shapes[k], (16, 16, 16), "lz4")
    put(spark, f"{folder}/.zattrs", json.dumps({"multiscales": [{"datasets": [{"path": f"s{k}"} for k in range(3)]}]}).encode())
    zarr.register(spark)
    assert zarr.sniff(folder) == "ome"
    # a load for each level: Spark keeps the filters pushed last of one load for all its scans
    level = lambda k: spark.read.format("zarr3d").option("path", folder).load().where(F.col("lod") == k)
    parts = [zarr.voxels(level(k), s, (16, 16, 16)).withColumn("lod", F.lit(k)) for k, s in enumerate(shapes)]
    return parts[0].unionByName(parts[1])


def _shards(spark, folder: str, at: str) -> None:
    """Version 3 shards of 16 voxels a side with sub-chunks of 8, some of them absent, around the solid."""
    m = {"zarr_format": 3, "node_type": "array", "shape": [40, 16, 24], "data_type": "uint8", "fill_value": 0, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [16, 16, 16]}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "codecs": [{"name": "sharding_indexed", "configuration": {"chunk_shape": [8, 8, 8], "codecs": [{"name": "bytes"}, {"name": "zstd"}], "index_codecs": [{"name": "bytes"}, {"name": "crc32c"}], "index_location": at}}]}
    put(spark, f"{folder}/zarr.json", json.dumps(m).encode())
    solid = np.pad(_solid(24, 16, 40), ((0, 8), (0, 0), (0, 8)))
    for sz, sx in np.ndindex(3, 2):
        entries, body, first = [], b"", 8 * 16 + 4 if at == "start" else 0
        for z, y, x in np.ndindex(2, 2, 2):
            c = (sz * 2 + z, y, sx * 2 + x)
            if sum(c) % 3 == 0:
                entries.append((2**64 - 1, 2**64 - 1))
                continue
            raw = zstandard.compress(solid[c[0] * 8 : c[0] * 8 + 8, c[1] * 8 : c[1] * 8 + 8, c[2] * 8 : c[2] * 8 + 8].tobytes())
            entries.append((first + len(body), len(raw)))
            body += raw
        index = b"".join(struct.pack("<QQ", *e) for e in entries) + bytes(4)
        put(spark, f"{folder}/c/{sz}/0/{sx}", index + body if at == "start" else body + index)


@query(_range(24, 16, 40) + " WHERE (z // 8 + y // 8 + x // 8) % 3 <> 0 AND z >= 8")
def sharded_ranges(spark, sf):
    """Shards read by their index and the ranges of the sub-chunks wanted, through a store that keeps what it read."""
    zarr.register(spark)
    out = None
    for at, low, high in (("start", 1, 2), ("end", 3, 9)):
        folder = _folder(spark, "shards")
        _shards(spark, folder, at)
        r = spark.read.format("zarr3d").option("path", folder).option("keep", plain(_folder(spark, "kept")))
        part = zarr.voxels(r.load().where(F.col("cz").between(low, high)), (40, 16, 24), (8, 8, 8))
        out = part if out is None else out.unionByName(part)
    return out


# ---- images, cells, tiles ----
@query(f"{_range(12, 9, 6, SOLID)}")
def layer_stack(spark, sf):
    folder = _folder(spark, "layers")
    for z, page in enumerate(_solid(12, 9, 6)):
        put(spark, f"{folder}/{z:05d}.tif", tiff.write(page.astype(np.uint16) * 256 + 17))
    return formats.layers(spark, folder)


@query("SELECT CAST(x + 10 AS INT) AS x, CAST(y AS INT) AS y, CAST(z + 20 AS INT) AS z, CAST((x * 7 + y * 13) % 251 AS INT) AS v FROM range(10) a(x), range(10) b(y), range(1) c(z)")
def tiff_cells(spark, sf):
    folder = _folder(spark, "cells")
    put(spark, f"{folder}/cell_yxz_001_002_003.tif", tiff.write(_solid(10, 10, 1)[0].astype(np.uint16) * 256))
    return formats.cells(spark, folder, 10)


@query("SELECT CAST(x + 64 * c AS INT) AS x, CAST(y AS INT) AS y, CAST(z AS INT) AS z, CAST((x * 7 + y * 13 + z * 29 + c) % 251 AS INT) AS v FROM range(64) a(x), range(64) b(y), range(64) d(z), range(2) e(c)")
def tile_files(spark, sf):
    folder = _folder(spark, "tiles")
    z, y, x = np.indices((64, 64, 64))
    for c in range(2):
        raster = ((x * 7 + y * 13 + z * 29 + c) % 251).astype(np.uint8)
        put(spark, f"{folder}/64-4/d00/z000/xyz-{c}-0-0-b255-d00.bin", raster.reshape(16, 4, 16, 4, 16, 4).transpose(0, 2, 4, 1, 3, 5).tobytes())
    return sample.to_voxels(formats.tile_files(spark, folder).select("cx", "cy", "cz", "bytes"))


def _planes(spark, sf):
    """(w, px, py, value): five images of the embedding volume's planes, side by side."""
    z = F.col("z")
    return embedding_volume(spark, sf).select((z % 5).alias("w"), (F.floor(z / 5) % 10 * 8 + F.col("x")).cast("int").alias("px"), (F.floor(z / 50) * 8 + F.col("y")).cast("int").alias("py"), F.col("v").alias("value"))


_PLANES = f"{VE}, g AS (SELECT CAST(w AS INT) AS w, CAST(px AS INT) AS px, CAST(py AS INT) AS py FROM range(5) a(w), range(80) b(px), range((SELECT max(z) // 50 * 8 + 8 FROM ve)) c(py)), p AS (SELECT z % 5 AS w, z // 5 % 10 * 8 + x AS px, z // 50 * 8 + y AS py, v FROM ve)"


@query(f"WITH {_PLANES} SELECT w, px, py, CAST(coalesce(v, 0) AS INT) AS value FROM g LEFT JOIN p USING (w, px, py)")
def tiled_images_from_tasks(spark, sf):
    """Tiled images written tile by tile from many tasks, read back through Spark."""
    folder = _folder(spark, "images")
    height = embedding_volume(spark, sf).agg(F.max("z")).first()[0] // 50 * 8 + 8
    images.write_layers(images.every_tile(images.tiles(_planes(spark, sf), 16), 80, height, 16), folder, 80, height, 16, "provenance")
    f = formats.binary(spark, folder, "*.tif").select(F.regexp_extract("path", r"(\d{5})\.tif$", 1).cast("int").alias("w"), "content")
    return decoded(f)


@query(f"WITH {_PLANES} SELECT w, sum(CAST(coalesce(v, 0) AS BIGINT) * (px + 1) * (py + 3))::BIGINT AS checksum, 'made by a test' AS text FROM g LEFT JOIN p USING (w, px, py) GROUP BY w")
def png_images(spark, sf):
    """The same images as PNGs with a text entry."""
    height = embedding_volume(spark, sf).agg(F.max("z")).first()[0] // 50 * 8 + 8
    files = images.layers(images.tiles(_planes(spark, sf), 32), 80, height, 32, "png", "made by a test")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for w, raw in zip(b.column("w").to_pylist(), b.column("content").to_pylist(), strict=True):
                image, text = images.read_png(raw)
                y, x = np.indices(image.shape)
                out.append((w, int((image.astype(np.int64) * (x + 1) * (y + 3)).sum()), text))
            yield pa.RecordBatch.from_pylist([dict(zip(("w", "checksum", "text"), r, strict=True)) for r in out], pa.schema([("w", pa.int32()), ("checksum", pa.int64()), ("text", pa.string())]))

    return files.mapInArrow(run, "w int, checksum long, text string")


@query("SELECT sha256(string_agg(chr(CAST(65 + k % 26 AS INT)), '' ORDER BY k)) AS sha256, CAST(count(*) AS BIGINT) AS size, 16 AS tile FROM range(1000) t(k)")
def provenance_record(spark, sf):
    path = _folder(spark, "inputs") + "/in.bin"
    put(spark, path, bytes(65 + k % 26 for k in range(1000)))
    p = json.loads(images.provenance(spark, {"tile": 16}, [path]))
    return spark.createDataFrame([(p["inputs"][0]["sha256"], p["inputs"][0]["size"], p["arguments"]["tile"])], "sha256 string, size long, tile int")


# ---- surfaces and meshes ----
@query("SELECT CAST(u AS INT) AS u, CAST(v AS INT) AS v, u * 1.5::DOUBLE AS x, v * 2.0::DOUBLE AS y, u * 8.0::DOUBLE + v AS z, u / 4.0::DOUBLE AS nx, v / 4.0::DOUBLE AS ny, 1.0::DOUBLE AS nz FROM range(30) a(u), range(20) b(v)")
def surface_map_file(spark, sf):
    return formats.surface_map(spark, _ppm(spark))


def _ppm(spark) -> str:
    folder = _folder(spark, "ppm")
    v, u = np.indices((20, 30)).astype("<f8")
    body = np.stack((u * 1.5, v * 2, u * 8 + v, u / 4, v / 4, np.ones_like(u)), -1)
    put(spark, f"{folder}/map.ppm", b"width: 30\nheight: 20\ndim: 6\nordered: true\ntype: double\nversion: 1\n<>\n" + body.tobytes())
    return folder


@query("""WITH p AS (SELECT p_partkey AS id, p_partkey % 113 / 4.0::DOUBLE AS u, p_partkey % 73 / 4.0::DOUBLE AS v, p_partkey % 101 - 50.0::DOUBLE AS w FROM part)
SELECT id, CASE WHEN ok THEN u * 1.5 + w * u / 4 END AS sx, CASE WHEN ok THEN v * 2 + w * v / 4 END AS sy, CASE WHEN ok THEN u * 8 + v + w END AS sz FROM (SELECT *, u > 0 AND v > 0 AND abs(w) <= 45 AND NOT (floor(u) = 0 AND floor(v) = 0) AS ok FROM p)""")
def surface_map_places(spark, sf):
    """Places on a surface map; the map is linear, so bilinear places have a closed form."""
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select(k.alias("id"), (k % 113 / 4.0).alias("u"), (k % 73 / 4.0).alias("v"), (k % 101 - 50.0).cast("double").alias("w"))
    s = formats.surface_map_sample(p, formats.surface_map(spark, _ppm(spark)).withColumn("z", F.col("z")).withColumns({c: F.when((F.col("u") == 0) & (F.col("v") == 0), 0.0).otherwise(F.col(c)) for c in ("x", "y", "z")}))
    return s.select("id", "sx", "sy", "sz")


@query("""WITH q AS (SELECT r, c FROM range(9) a(r), range(7) b(c)), t AS (SELECT 2 * (r * 7 + c) + 1 AS tri_id, r r1, c c1, r + 1 r2, c c2, r r3, c + 1 c3 FROM q UNION ALL SELECT 2 * (r * 7 + c) + 2, r + 1, c, r + 1, c + 1, r, c + 1 FROM q)
SELECT CAST(tri_id AS BIGINT) AS tri_id, """ + ", ".join(f"c{i} * 2.0::DOUBLE AS x{i}, r{i} * 3.0::DOUBLE AS y{i}, r{i} * c{i} * 1.0::DOUBLE AS z{i}, c{i} / 7.0::DOUBLE AS u{i}, r{i} / 9.0::DOUBLE AS v{i}" for i in (1, 2, 3)) + " FROM t")
def obj_file(spark, sf):
    """A mesh file with groups and materials, as triangles."""
    n = lambda r, c: r * 8 + c + 1
    lines = ["mtllib none.mtl", "o sheet"]
    lines += [f"v {c * 2.0!r} {r * 3.0!r} {float(r * c)!r}" for r in range(10) for c in range(8)]
    lines += [f"vt {c / 7.0!r} {r / 9.0!r}" for r in range(10) for c in range(8)]
    lines += ["usemtl none", "s off"]
    for r in range(9):
        for c in range(7):
            for tri in ((n(r, c), n(r + 1, c), n(r, c + 1)), (n(r + 1, c), n(r + 1, c + 1), n(r, c + 1))):
                lines.append("f " + " ".join(f"{k}/{k}" for k in tri))
    lines += ["o other", "v 9 9 9", "vt 0 0", "f 1/1 2/2 81/81"]
    path = _folder(spark, "obj") + "/sheet.obj"
    put(spark, path, "\n".join(lines).encode())
    return formats.obj_triangles(*formats.obj(spark, path))


@query("SELECT CAST(r AS INT) AS r, CAST(c AS INT) AS c, c * 2.5::DOUBLE AS px, r * 4.0::DOUBLE AS py, CASE WHEN (r + c) % 11 = 0 THEN -1.0::DOUBLE ELSE r * 30.0 + c END AS pz, (r + c) % 11 <> 0 AND r * 30 + c > 0 AS valid FROM range(25) a(r), range(30) b(c)")
def grid_surface_folder(spark, sf):
    folder = _folder(spark, "grid")
    r, c = np.indices((25, 30)).astype(np.float32)
    for name, image in (("x", c * 2.5), ("y", r * 4), ("z", np.where((r + c) % 11 == 0, -1, r * 30 + c))):
        put(spark, f"{folder}/{name}.tif", tiff.write(image.astype(np.float32)))
    put(spark, f"{folder}/meta.json", b'{"format": "tifxyz", "scale": [0.05, 0.05]}')
    return formats.grid_surface(spark, folder)[0]


# ---- records ----
@query("SELECT 's' || s_suppkey AS id, s_nationkey AS num, s_suppkey % 2 = 0 AS fragment, s_suppkey * 3 AS width, CAST(s_nationkey AS VARCHAR) AS volume FROM supplier")
def segment_records(spark, sf):
    """A compressed catalogue of segments."""
    s = table(spark, sf, "supplier").orderBy("s_suppkey").collect()
    lines = [json.dumps({"id": f"s{r.s_suppkey}", "scroll": {"id": "x", "num": r.s_nationkey, "oldId": "o", "isFragment": r.s_suppkey % 2 == 0}, "width": r.s_suppkey * 3, "volume": {"volume": str(r.s_nationkey)}, "other": 1}) for r in s]
    path = _folder(spark, "catalogue") + "/segments.json.zst"
    put(spark, path, zstandard.compress("\n".join(lines).encode()))
    g = formats.segments(spark, path)
    return g.select("id", F.col("scroll.num").alias("num"), F.col("scroll.isFragment").alias("fragment"), F.col("width").cast("long").alias("width"), F.col("volume.volume").alias("volume"))


@query("SELECT 'r' || n_nationkey AS id, n_name AS name, n_nationkey * 1.5::DOUBLE AS size FROM nation WHERE n_nationkey % 6 <> 0")
def record_tree(spark, sf):
    """A tree of files of one record each; those that can't be parsed are left out."""
    folder = _folder(spark, "tree")
    for r in table(spark, sf, "nation").collect():
        k = r.n_nationkey
        put(spark, f"{folder}/{k % 3}/{k}.json", b'{"id": ' if k % 6 == 0 else json.dumps({"id": f"r{k}", "name": r.n_name, "size": k * 1.5}, indent=1).encode())
    return formats.records(spark, folder, schema="id string, name string, size double")


@query(f"WITH {EV} SELECT event, host, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM ev GROUP BY event, host")
def telemetry_lines(spark, sf):
    """Telemetry written as lines, among lines that are none, and read back."""
    folder = _folder(spark, "lines")
    e = events(spark, sf)
    good = e.select(F.to_json(F.struct("event", "host", "t", "bytes")).alias("value"))
    good.unionByName(e.where("event_id % 10 = 0").select(F.lit("torn {").alias("value"))).write.text(folder)
    return formats.telemetry(spark, folder).where("event IS NOT NULL").groupBy("event", "host").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query("SELECT id, location, x, max_lod FROM (VALUES ('scan-a', 's3://volumes/a.zarr', 4096, 5), ('b', '/data/b', 512, 0), ('c.zarr', 'https://host/v/c.zarr', 0, 0)) t(id, location, x, max_lod)")
def volume_registry(spark, sf):
    """Known volumes by id, and one found by its location."""
    from voxelarium.model import VolumeSpec

    r = formats.Registry([VolumeSpec("scan-a", "s3://volumes/a.zarr", (4096, 4096, 8192), 5), VolumeSpec("b", "/data/b", (512, 512, 512))])
    r.add(r.find("https://host/v/c.zarr"))
    return r.table(spark).select("id", "location", F.col("extent")[0].alias("x"), "max_lod")


@query("SELECT l_orderkey % 40 AS idx, 'Wrote' AS outcome, 1 AS round FROM lineitem GROUP BY 1 UNION ALL SELECT l_orderkey % 60 AS idx, CASE WHEN l_orderkey % 60 >= 40 THEN 'Wrote' WHEN l_orderkey % 60 % 7 = 0 THEN 'AlreadyEmpty' ELSE 'AlreadyResident' END, 2 FROM lineitem GROUP BY 1")
def chunk_store(spark, sf):
    """Chunks offered several times and in two rounds."""
    folder = _folder(spark, "store")
    out = None
    for k, n in ((1, 40), (2, 60)):
        i = (F.col("l_orderkey") % n).cast("int")
        c = table(spark, sf, "lineitem").select(F.lit("v").alias("volume_id"), F.lit(0).alias("lod"), i.alias("cx"), F.lit(0).alias("cy"), F.lit(0).alias("cz"), F.when(i % 7 != 0, F.encode(i.cast("string"), "utf-8")).alias("bytes"))
        part = images.store_chunks(c, folder).select(F.col("cx").cast("long").alias("idx"), "outcome", F.lit(k).alias("round"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {VL} SELECT v, count(*) AS n, CAST(sum(x + 10 * y + 100 * z) AS BIGINT) AS places FROM vl GROUP BY v")
def points_by_label(spark, sf):
    """A point cloud written by label and read back."""
    folder = _folder(spark, "points")
    images.points(label_volume(spark, sf), folder)
    p = spark.read.parquet(folder)
    return p.groupBy("v").agg(F.count("*").alias("n"), F.sum(F.col("x") + 10 * F.col("y") + 100 * F.col("z")).alias("places"))
