"""Readers of the other file forms: surface maps, meshes, grid surfaces, tile files, cells and layers, catalogues,
telemetry, remap rules, transforms.  Binary files come through binaryFile and are parsed in Arrow batches."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelarium.model import VolumeSpec
from voxelarium.sources import tiff


def binary(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (r.option("pathGlobFilter", pattern) if pattern else r).load(path).select("path", "content")


def surface_map(spark: SparkSession, path: str) -> DataFrame:
    """(u, v, x, y, z, nx, ny, nz) of a per-pixel surface map: a text header up to `<>`, then six doubles a pixel."""
    def run(batches):
        for b in batches:
            for raw in b.column("content").to_pylist():
                at = raw.index(b"<>") + 2
                at += raw[at : at + 1] == b"\n"
                head = dict(x.split(":", 1) for x in raw[:at].decode("latin-1").splitlines() if ":" in x)
                w, h = int(head["width"]), int(head["height"])
                p = np.frombuffer(raw, "<f8", w * h * 6, at).reshape(-1, 6)
                for i in range(0, len(p), 65536):
                    q = p[i : i + 65536]
                    k = np.arange(i, i + len(q))
                    yield pa.RecordBatch.from_arrays([pa.array((k % w).astype(np.int32)), pa.array((k // w).astype(np.int32)), *[pa.array(np.ascontiguousarray(q[:, j])) for j in range(6)]], ["u", "v", "x", "y", "z", "nx", "ny", "nz"])

    return binary(spark, path).mapInArrow(run, "u int, v int, x double, y double, z double, nx double, ny double, nz double")


def surface_map_sample(points: DataFrame, ppm: DataFrame) -> DataFrame:
    """Points (id, u, v, w) on a surface map: bilinear place plus w along the normal.  Places at u, v <= 0, |w| > 45 or
    with an all-zero corner give null."""
    p = points.withColumn("_u", F.floor("u").cast("int")).withColumn("_v", F.floor("v").cast("int"))
    p = p.withColumn("_c", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])))
    du, dv = F.col("u") - F.col("_u"), F.col("v") - F.col("_v")
    weight = F.when(F.col("_c.i") == 1, du).otherwise(1 - du) * F.when(F.col("_c.j") == 1, dv).otherwise(1 - dv)
    p = p.select("id", "u", "v", "w", (F.col("_u") + F.col("_c.i")).alias("_pu"), (F.col("_v") + F.col("_c.j")).alias("_pv"), weight.alias("_w"))
    m = ppm.select(F.col("u").alias("_pu"), F.col("v").alias("_pv"), "x", "y", "z", "nx", "ny", "nz").where("x <> 0 OR y <> 0 OR z <> 0")
    s = p.join(m, ["_pu", "_pv"]).groupBy("id", "u", "v", "w").agg(F.count("*").alias("_n"), *[F.sum(F.col("_w") * F.col(c)).alias(c) for c in ("x", "y", "z", "nx", "ny", "nz")])
    ok = (F.col("_n") == 4) & (F.col("u") > 0) & (F.col("v") > 0) & (F.abs("w") <= 45)
    return points.join(s.where(ok).select("id", *[(F.col(a) + F.col("w") * F.col(f"n{a}")).alias(f"s{a}") for a in "xyz"]), "id", "left")


def obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vertices, texture points, triangles) of a Wavefront file: v, vt and three-cornered f lines of its first object.

    Lines are numbered by their place in the file, which is one partition (the format has no other index).
    """
    def run(batches):
        n, named = {"v": 0, "vt": 0, "f": 0}, False
        for b in batches:
            out = []
            for line in b.column(0).to_pylist():
                kind, *rest = line.split() or [""]
                if kind == "o":
                    named, over = True, named and n["f"] > 0
                    if over:
                        n = {}  # of a second object nothing is read
                if kind not in n:
                    continue
                n[kind] += 1
                if kind == "f":
                    if len(rest) != 3:
                        raise ValueError("only triangles are supported")
                    refs = [[int(x) if x else 0 for x in (c.split("/") + ["", ""])[:3]] for c in rest]
                    out.append((kind, n[kind], [float(r[0]) for r in refs], [float(r[1]) for r in refs]))
                else:
                    out.append((kind, n[kind], [float(x) for x in rest[:3]], None))
            if out:
                k, i, a, t = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(i, pa.int64()), pa.array(a, pa.list_(pa.float64())), pa.array(t, pa.list_(pa.float64()))], ["kind", "id", "a", "t"])

    lines = spark.read.option("wholetext", "false").text(path).coalesce(1).mapInArrow(run, "kind string, id long, a array<double>, t array<double>")
    v = lines.where("kind = 'v'").select("id", *[F.col("a")[i].alias(c) for i, c in enumerate("xyz")])
    vt = lines.where("kind = 'vt'").select("id", *[F.col("a")[i].alias(c) for i, c in enumerate("uv")])
    f = lines.where("kind = 'f'").select(F.col("id").alias("tri_id"), *[F.col("a")[i].cast("long").alias(f"a{i + 1}") for i in range(3)], *[F.col("t")[i].cast("long").alias(f"t{i + 1}") for i in range(3)])
    return v, vt, f


def obj_triangles(v: DataFrame, vt: DataFrame, f: DataFrame) -> DataFrame:
    """Denormalised triangles: six equi-joins on indices."""
    out = f
    for i in (1, 2, 3):
        out = out.join(v.select(F.col("id").alias(f"a{i}"), *[F.col(c).alias(f"{c}{i}") for c in "xyz"]), f"a{i}")
        out = out.join(vt.select(F.col("id").alias(f"t{i}"), *[F.col(c).alias(f"{c}{i}") for c in "uv"]), f"t{i}")
    return out.select("tri_id", *[f"{c}{i}" for i in (1, 2, 3) for c in "xyzuv"])


def grid_surface(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """((r, c, px, py, pz, valid), meta) of a folder with meta.json and x.tif, y.tif, z.tif."""
    meta = json.loads(spark.read.option("wholetext", "true").text(f"{path}/meta.json").first()[0])
    if meta.get("format", "tifxyz") != "tifxyz":
        raise ValueError(f"the surface's format is {meta['format']}")

    def run(batches):
        for b in batches:
            for name, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                axis = name.rsplit("/", 1)[1][0]
                image = tiff.read(raw)[0].astype(np.float32)
                for r, row in enumerate(image):
                    yield pa.RecordBatch.from_arrays([pa.array([axis] * len(row)), pa.array(np.full(len(row), r, np.int32)), pa.array(np.arange(len(row), dtype=np.int32)), pa.array(row)], ["axis", "r", "c", "p"])

    cells = binary(spark, path, "{x,y,z}.tif").mapInArrow(run, "axis string, r int, c int, p float")
    g = cells.groupBy("r", "c").agg(*[F.max(F.when(F.col("axis") == a, F.col("p"))).alias(f"p{a}") for a in "xyz"])
    finite = F.lit(True)
    for a in "xyz":
        finite = finite & F.col(f"p{a}").isNotNull() & ~F.isnan(f"p{a}") & (F.abs(f"p{a}") < float("inf"))
    return g.select("r", "c", *[F.col(f"p{a}").cast("double").alias(f"p{a}") for a in "xyz"], (finite & (F.col("pz") > 0)).alias("valid")), meta


def tile_files(spark: SparkSession, path: str) -> DataFrame:
    """(lod, cx, cy, cz, bytes): 64-voxel tile files `xyz-X-Y-Z-bMMM-dNN.bin` of 4-voxel blocks, made raster order."""
    pattern = r"xyz-(\d+)-(\d+)-(\d+)-b\d+-d(\d+)\.bin$"
    f = binary(spark, path, "*.bin").where(F.col("path").rlike(pattern))
    f = f.select(F.regexp_extract("path", pattern, 4).cast("int").alias("lod"), *[F.regexp_extract("path", pattern, i).cast("int").alias(c) for i, c in ((1, "cx"), (2, "cy"), (3, "cz"))], "content")

    def run(batches):
        for b in batches:
            out = []
            for raw in b.column("content").to_pylist():
                if len(raw) != 64**3:
                    raise ValueError("a tile has 64 * 64 * 64 bytes")
                x = np.frombuffer(raw, np.uint8).reshape(16, 16, 16, 4, 4, 4)  # block z, y, x, then voxel z, y, x
                out.append(x.transpose(0, 3, 1, 4, 2, 5).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(4)] + [pa.array(out, pa.binary())], ["lod", "cx", "cy", "cz", "bytes"])

    return f.mapInArrow(run, "lod int, cx int, cy int, cz int, bytes binary")


def _pages_to_voxels(files: DataFrame, keys: list[str], place) -> DataFrame:
    """Voxels of 16-bit (high byte) or 8-bit pages; place gives origin and axis of the pages from the keys."""
    def run(batches):
        for b in batches:
            keyed = [b.column(k).to_pylist() for k in keys]
            for r, raw in enumerate(b.column("content").to_pylist()):
                ox, oy, oz = place(*[k[r] for k in keyed])
                for z, page in enumerate(tiff.read(raw)):
                    v = (page >> 8 if page.dtype.itemsize == 2 else page).astype(np.int32)
                    y, x = np.indices(v.shape, np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array((x + ox).ravel().astype(np.int32)), pa.array((y + oy).ravel().astype(np.int32)), pa.array(np.full(v.size, z + oz, np.int32)), pa.array(v.ravel())], ["x", "y", "z", "v"])

    return files.mapInArrow(run, "x int, y int, z int, v int")


def cells(spark: SparkSession, path: str, side: int = 500) -> DataFrame:
    """Voxels of multi-page cells `cell_yxz_YYY_XXX_ZZZ.tif`, numbered from 1."""
    pattern = r"cell_yxz_(\d+)_(\d+)_(\d+)\.tif$"
    f = binary(spark, path, "cell_yxz_*.tif").select(*[F.regexp_extract("path", pattern, i).cast("int").alias(c) for i, c in ((1, "j"), (2, "i"), (3, "k"))], "content")
    return _pages_to_voxels(f, ["i", "j", "k"], lambda i, j, k: ((i - 1) * side, (j - 1) * side, (k - 1) * side))


def layers(spark: SparkSession, path: str, compat: bool = False) -> DataFrame:
    """Voxels of a stack of pages `ZZZZZ.tif`; with compat the last layer is out of reach."""
    pattern = r"(\d{5})\.tif$"
    f = binary(spark, path, "*.tif").where(F.col("path").rlike(r"/\d{5}\.tif$")).select(F.regexp_extract("path", pattern, 1).cast("int").alias("k"), "content")
    if compat:
        f = f.where(F.col("k") < f.agg(F.max("k")).first()[0])
    return _pages_to_voxels(f, ["k"], lambda k: (0, 0, k))


SEGMENTS = "id string, scroll struct<id: string, num: int, oldId: string, isFragment: boolean>, width int, height int, minZ int, maxZ int, volume struct<volume: string, baseUrl: string, maxX: int, maxY: int, maxZ: int, voxelSizenM: int, energykeV: int>, areaCm2 double, author string, layers array<int>, labels array<string>"
DOWNLOADS = "t long, event string, host string, url string, chunk string, range_off long, range_len long, status int, ok boolean, x_cache string, wait_ms long, wait_total_ms long, touches int, ttfb_ms long, body_ms long, bytes long, in_flight int, q_depth int, outcome string, reason string, ms long, fills int, kind string, queued_ms long, ran boolean, pending_ms long"


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The segment catalogue; zstd files are read as they are."""
    return spark.read.schema(SEGMENTS).json(path)


def records(spark: SparkSession, path: str, strict: bool = False, schema: str | None = None) -> DataFrame:
    """One JSON object per file: samples fail on a bad one, their scans, volumes and segments skip it."""
    r = spark.read.option("multiLine", "true").option("mode", "FAILFAST" if strict else "DROPMALFORMED").option("recursiveFileLookup", "true")
    return (r.schema(schema) if schema else r).json(path)


def telemetry(spark: SparkSession, path: str) -> DataFrame:
    """Telemetry lines; those that are no JSON are skipped."""
    return spark.read.schema(DOWNLOADS).option("mode", "DROPMALFORMED").json(path)


def remap_rules(spark: SparkSession, text: str) -> DataFrame:
    """Rewrite rules of a configuration {"atlas": [{"usage"?, "prefix", "replacement"}, ...]}, in order."""
    rules = json.loads(text).get("atlas", [])
    return spark.createDataFrame([(i, r.get("usage"), r["prefix"], r["replacement"]) for i, r in enumerate(rules)], "seq int, usage string, prefix string, replacement string")


class Registry:
    """Known volumes by id; unknown ids with a scheme or a slash are taken as locations."""

    def __init__(self, specs: list[VolumeSpec] = ()):
        self.specs = {s.id: s for s in specs}

    def add(self, spec: VolumeSpec) -> None:
        self.specs[spec.id] = spec

    def find(self, ref: str) -> VolumeSpec:
        if ref in self.specs:
            return self.specs[ref]
        if "/" in ref:
            return VolumeSpec(ref.rstrip("/").rsplit("/", 1)[1], ref)
        raise KeyError(f"no volume is called {ref}")

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(s.id, s.location, list(s.extent), s.max_lod) for s in self.specs.values()], "id string, location string, extent array<int>, max_lod int")


def synthetic(spark: SparkSession, extent: tuple[int, int, int], value) -> DataFrame:
    """Voxels of a function of columns (x, y, z)."""
    nx, ny, nz = extent
    i = spark.range(nx * ny * nz)
    g = i.select((F.col("id") % nx).cast("int").alias("x"), (F.floor(F.col("id") / nx) % ny).cast("int").alias("y"), F.floor(F.col("id") / (nx * ny)).cast("int").alias("z"))
    return g.withColumn("v", value(F.col("x"), F.col("y"), F.col("z")).cast("int"))


def empty(spark: SparkSession) -> DataFrame:
    return spark.range(0).select(*[F.lit(0).alias(c) for c in ("x", "y", "z", "v")])
