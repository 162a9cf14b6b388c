"""Formats: exact round trips and rejections."""

import json
import struct

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from voxelarium.operators import catalog, graph, mesh, residency
from voxelarium.sinks import images
from voxelarium.sources import codecs, formats, store, tiff, zarr
from voxelarium.sources.formats import synthetic


@pytest.mark.parametrize(("w", "h", "t"), [(40, 24, 16), (48, 32, 16)])
@pytest.mark.parametrize("big", [False, True])
def test_tiled_tiff(w, h, t, big):
    image = np.fromfunction(lambda y, x: (7 * x + 13 * y) % 251, (h, w)).astype(np.uint8)
    padded = np.pad(image, ((0, -h % t), (0, -w % t)))
    parts = [(x, y, padded[y * t : y * t + t, x * t : x * t + t].tobytes()) for y in range(-(-h // t)) for x in range(-(-w // t))]
    assert (tiff.read(tiff.write_tiled(w, h, t, parts[::-1], "meta", big))[0] == image).all()
    with pytest.raises(ValueError):
        tiff.write_tiled(w, h, t, parts[:1])
    with pytest.raises(ValueError):
        tiff.write_tiled(w, h, 20, parts)


def test_plain_tiff_and_png():
    for kind in ("u1", "u2", "f4"):
        image = (np.arange(35).reshape(5, 7) * 3).astype(kind)
        assert (tiff.read(tiff.write(image))[0] == image).all()
    image = np.arange(60, dtype=np.uint8).reshape(5, 4, 3)
    back, text = images.read_png(images.png(image, "provenance"))
    assert (back == image).all() and text == "provenance"
    with pytest.raises(ValueError):
        tiff.read(b"not a tiff file")


def test_codecs():
    raw = bytes(range(256)) * 700
    for codec in ("zstd", "lz4"):
        assert codecs.decode(codecs.blosc_frame(raw, codec), {"id": "blosc"}, len(raw)) == raw
    assert codecs.decode(zstandard.compress(raw), {"id": "zstd"}, len(raw)) == raw
    assert codecs.decode(struct.pack("<i", len(raw)) + pa.Codec("lz4_raw").compress(raw).to_pybytes(), {"id": "lz4"}, len(raw)) == raw
    assert codecs.decode(raw, None, len(raw)) == raw
    assert codecs.is_lossy(b"C3DC") and not codecs.is_lossy(b"C3D") and not codecs.is_lossy(b"not a chunk at all")
    with pytest.raises(NotImplementedError):
        codecs.decode(b"C3DC", {"id": "c3d"}, 1)
    with pytest.raises(ValueError):
        codecs.blosc(b"short")


def test_ome_group_with_pruning(spark, tmp_path):
    from voxelarium.operators import lod, sample

    v = synthetic(spark, (8, 8, 8), lambda x, y, z: (x + 8 * y + z) % 256)
    for k, level in ((0, v), (1, lod.halve(v))):
        n = 8 >> k
        zarr.write(sample.to_chunks(level, 2), str(tmp_path / f"s{k}"), (n, n, n), (4, 4, 4), "lz4")
    (tmp_path / ".zattrs").write_text(json.dumps({"multiscales": [{"datasets": [{"path": "s0"}, {"path": "s1"}, {"path": "s9"}]}]}))
    zarr.register(spark)
    df = spark.read.format("zarr3d").option("path", str(tmp_path)).load()
    assert zarr.sniff(str(tmp_path)) == "ome" and zarr.sniff(str(tmp_path / "s0")) == "zarr"
    assert {r.lod: r["count"] for r in df.groupBy("lod").count().collect()} == {0: 8, 1: 1}
    assert df.where("lod = 0 AND cz = 1 AND cx < 1").count() == 2
    back = zarr.voxels(df.where("lod = 0"), (8, 8, 8), (4, 4, 4))
    assert v.select("x", "y", "z", "v").exceptAll(back).isEmpty()
    meta = zarr.ArrayMeta.read(str(tmp_path / "s0"))
    again = zarr.decoded(formats.binary(spark, str(tmp_path / "s0")), meta)
    assert again.count() == 8


def test_sharded_version_3(spark, tmp_path):
    meta = {"zarr_format": 3, "node_type": "array", "shape": [4, 4, 4], "data_type": "uint8", "fill_value": 0, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [4, 4, 4]}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "codecs": [{"name": "sharding_indexed", "configuration": {"chunk_shape": [2, 2, 2], "codecs": [{"name": "bytes"}, {"name": "zstd"}], "index_codecs": [{"name": "bytes"}], "index_location": "start"}}]}
    (tmp_path / "zarr.json").write_text(json.dumps(meta))
    a, b = zstandard.compress(bytes(range(8))), zstandard.compress(bytes(range(8, 16)))
    entries = [(2**64 - 1, 2**64 - 1)] * 8
    entries[1], entries[6] = (128, len(a)), (128 + len(a), len(b))
    (tmp_path / "c/0/0").mkdir(parents=True)
    (tmp_path / "c/0/0/0").write_bytes(b"".join(struct.pack("<QQ", *e) for e in entries) + a + b)
    zarr.register(spark)
    got = {(r.cz, r.cy, r.cx): bytes(r.bytes) for r in spark.read.format("zarr3d").option("path", str(tmp_path)).load().collect()}
    assert got == {(0, 0, 1): bytes(range(8)), (1, 1, 0): bytes(range(8, 16))}


def test_metadata_rejections():
    with pytest.raises(ValueError):
        zarr.ArrayMeta.v2({"dtype": "<u2", "shape": [1], "chunks": [1]})
    with pytest.raises(ValueError):
        zarr.ArrayMeta.v3({"data_type": "uint16"})


def test_surface_map(spark, tmp_path):
    grid = np.arange(4 * 3 * 6, dtype="<f8").reshape(3, 4, 6) + 1
    (tmp_path / "a.ppm").write_bytes(b"width: 4\nheight: 3\ndim: 6\nordered: true\ntype: double\nversion: 1\n<>\n" + grid.tobytes())
    ppm = formats.surface_map(spark, str(tmp_path))
    assert {(r.u, r.v): r.nz for r in ppm.collect()}[(2, 1)] == grid[1, 2, 5]
    p = spark.createDataFrame([(0, 1.5, 0.5, 2.0), (1, 0.0, 1.0, 0.0), (2, 1.0, 1.0, 46.0), (3, 1.0, 1.0, -45.0)], "id int, u double, v double, w double")
    got = {r.id: r.sx for r in formats.surface_map_sample(p, ppm).collect()}
    place = grid[:2, 1:3].mean((0, 1))
    assert got[0] == pytest.approx(place[0] + 2 * place[3]) and got[1] is None and got[2] is None and got[3] is not None


def test_obj(spark, tmp_path):
    (tmp_path / "m.obj").write_text("mtllib a\nv 0 0 0\nv 4 0 0\nv 0 4 0\nvt 0 0\nvt 1 0\nvt 0 1\nusemtl b\nf 1/1 2/2 3/3\n")
    t = formats.obj_triangles(*formats.obj(spark, str(tmp_path / "m.obj"))).collect()
    assert len(t) == 1 and (t[0].x2, t[0].u2, t[0].v3) == (4.0, 1.0, 1.0)


def test_grid_surface_folder(spark, tmp_path):
    for k, a in enumerate("xyz"):
        image = np.full((3, 4), k + 1.0, np.float32)
        if a == "z":
            image[1, 2], image[0, 0] = -1, np.nan
        (tmp_path / f"{a}.tif").write_bytes(tiff.write(image))
    (tmp_path / "meta.json").write_text('{"uuid": "s", "type": "seg", "format": "tifxyz", "scale": [0.05, 0.05]}')
    g, meta = formats.grid_surface(spark, str(tmp_path))
    assert meta["scale"] == [0.05, 0.05] and g.count() == 12 and g.where("valid").count() == 10


def test_cells_layers_and_tile_files(spark, tmp_path):
    (tmp_path / "cells").mkdir()
    (tmp_path / "layers").mkdir()
    (tmp_path / "tiles").mkdir()
    page = (np.arange(12).reshape(3, 4) * 256).astype(np.uint16)
    (tmp_path / "cells/cell_yxz_002_001_003.tif").write_bytes(tiff.write(page))
    r = formats.cells(spark, str(tmp_path / "cells")).where("v = 7").first()
    assert (r.x, r.y, r.z) == (3, 501, 1000)
    for k in (3, 4):
        (tmp_path / f"layers/{k:05d}.tif").write_bytes(tiff.write(page))
    assert formats.layers(spark, str(tmp_path / "layers")).select("z").distinct().count() == 2
    assert formats.layers(spark, str(tmp_path / "layers"), compat=True).select("z").distinct().count() == 1
    raster = np.random.default_rng(0).integers(0, 256, (64, 64, 64), dtype=np.uint8)
    blocks = raster.reshape(16, 4, 16, 4, 16, 4).transpose(0, 2, 4, 1, 3, 5)
    (tmp_path / "tiles/xyz-1-2-3-b255-d02.bin").write_bytes(blocks.tobytes())
    r = formats.tile_files(spark, str(tmp_path / "tiles")).first()
    assert (r.lod, r.cx, r.cy, r.cz) == (2, 1, 2, 3) and bytes(r.bytes) == raster.tobytes()


def test_json_sources(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"event": "download", "host": "a", "bytes": 5, "t": 1}\nnot json\n{"event": "extract", "outcome": "ok"}\n')
    assert formats.telemetry(spark, str(tmp_path / "log.jsonl")).where("event = 'download'").first().bytes == 5
    line = '{"id": "s1", "scroll": {"id": "1", "num": 1, "oldId": "x", "isFragment": false}, "width": 3, "height": 4}\n'
    (tmp_path / "seg.json.zst").write_bytes(zstandard.compress(line.encode()))
    assert formats.segments(spark, str(tmp_path / "seg.json.zst")).first().scroll.num == 1
    rules = formats.remap_rules(spark, '{"atlas": [{"prefix": "a/", "replacement": "b/"}]}')
    urls = spark.createDataFrame([("standard", "a/x"), ("standard", "c/x")], "usage string, url string")
    assert {r.url: r.rewritten for r in catalog.rewrite(urls, rules).collect()} == {"a/x": "b/x", "c/x": "c/x"}


def test_first_url(spark):
    e = spark.createDataFrame([("s", "obj", [("p1", [("other", "u0")]), ("p2", [("standard", "u1/")])])], "owner string, type string, origins array<struct<path: string, roots: array<struct<usage: string, url: string>>>>")
    assert catalog.first_url(e, "obj").first().url == "u1/p2"


def test_last_run_only(spark):
    s = spark.createDataFrame([("s1", 1, False, 1, 0), ("s2", 2, False, 2, 1), ("s3", 1, False, 1, 2)], "segment_id string, scroll_id int, is_fragment boolean, num int, seq int")
    assert [r.segments for r in catalog.by_scroll(s).collect()] == [["s1", "s3"], ["s2"]]
    assert [r.segments for r in catalog.by_scroll(s, last_run_only=True).collect()] == [["s3"], ["s2"]]


def test_purge_thresholds(spark):
    state = spark.createDataFrame([(0, i, 1, e) for i, e in enumerate([10] * 5 + [20] * 3 + [40] * 9)], "volume_id int, idx int, state int, access_epoch int")
    assert residency.threshold(state, 40, 5).first().age_threshold == 30
    assert residency.threshold(state, 40, 8).first().freed == 8
    assert residency.threshold(state, 40, 9).isEmpty()  # only the current epoch is left


def test_store_is_idempotent(spark, tmp_path):
    c = spark.createDataFrame([("v", 0, 0, 0, 0, bytearray(b"a")), ("v", 0, 1, 0, 0, bytearray(b"b"))], "volume_id string, lod int, cx int, cy int, cz int, bytes binary")
    first = images.store_chunks(c, str(tmp_path / "store")).collect()
    again = images.store_chunks(c, str(tmp_path / "store")).collect()
    assert {r.outcome for r in first} == {"Wrote"} and {r.outcome for r in again} == {"AlreadyResident"}
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2


def test_a_chunk_offered_twice_is_written_once(spark, tmp_path):
    c = spark.createDataFrame([("v", 0, 1, 0, 0, bytearray(b"a")), ("v", 0, 1, 0, 0, bytearray(b"a")), ("v", 0, 2, 0, 0, None)], "volume_id string, lod int, cx int, cy int, cz int, bytes binary")
    assert sorted((r.cx, r.outcome) for r in images.store_chunks(c, str(tmp_path / "store")).collect()) == [(1, "Wrote"), (2, "Wrote")]
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2
    assert sorted((r.cx, r.outcome) for r in images.store_chunks(c, str(tmp_path / "store")).collect()) == [(1, "AlreadyResident"), (2, "AlreadyEmpty")]


def test_tiles_written_in_place(spark, tmp_path):
    image = np.fromfunction(lambda y, x: (7 * x + 13 * y) % 251, (40, 56)).astype(np.uint8)
    rows = [(w, x, y, int(image[y, x]) if w else 255 - int(image[y, x])) for w in (0, 3) for y in range(40) for x in range(56)]
    tiled = images.tiles(spark.createDataFrame(rows, "w int, px int, py int, value int"), 16)
    out = images.write_layers(tiled, f"file://{tmp_path}/out", 56, 40, 16, "text")
    assert [(r.w, r.name, r.tiles) for r in out.orderBy("w").collect()] == [(0, "00000.tif", 12), (3, "00003.tif", 12)]
    assert (tiff.read((tmp_path / "out/00003.tif").read_bytes())[0] == image).all() and (tiff.read((tmp_path / "out/00000.tif").read_bytes())[0] == 255 - image).all()
    with pytest.raises(ValueError):
        images.write_layers(tiled.where("tu > 0"), str(tmp_path / "short"), 56, 40, 16)
    for big in (False, True):
        header, first = tiff.tiled_header(40, 24, 16, "d", big)
        padded = np.pad(image, ((0, 8), (0, 8)))
        data = header + b"".join(padded[y : y + 16, x : x + 16].tobytes() for y in (0, 16) for x in (0, 16, 32))
        assert first == len(header) and (tiff.read(data)[0] == image[:24, :40]).all()


class Counting:
    """A store that counts what is asked of it."""

    def __init__(self, have):
        self.have, self.asked = have, []

    def read(self, name):
        self.asked.append(name)
        return self.have.get(name)

    def read_range(self, name, start, size):
        self.asked.append((name, start, size))
        data = self.have.get(name)
        return data and (data[start:][:size] if start >= 0 else data[max(0, len(data) + start) :][:size])

    def write(self, name, data):
        self.have[name] = data


def test_stores(tmp_path):
    inner = Counting({"a/b": b"0123456789"})
    kept = store.Kept(inner, store.Folder(str(tmp_path)))
    for _ in range(3):
        assert kept.read("a/b") == b"0123456789" and kept.read("none") is None and kept.read_range("a/b", -3, 2) == b"78" and kept.read_range("no", 0, 1) is None
    assert inner.asked == ["a/b", "none", ("a/b", -3, 2), ("no", 0, 1)]
    for s in (store.store_of(str(tmp_path)), store.store_of(f"file://{tmp_path}"), store.Remote(f"file://{tmp_path}")):
        assert s.read("a/b") == b"0123456789" and s.read("x/y") is None and s.read_range("a/b", 2, 3) == b"234" and s.read_range("a/b", -4, 2) == b"67"
        s.write("n/m", b"new")
        assert s.read("n/m") == b"new"


def test_a_shard_is_read_by_ranges():
    meta = zarr.ArrayMeta((4, 2, 2), (2, 2, 2), {"id": "zstd"}, 0, "/", 3, (4, 2, 2), "end")
    a, b = (zstandard.compress(bytes([k] * 8)) for k in (1, 2))
    inner = Counting({"c/0/0/0": a + b + struct.pack("<QQQQ", 0, len(a), len(a), len(b)) + bytes(4)})
    assert list(zarr.stored(meta, inner, (0, 0, 0), lambda at: at == (1, 0, 0))) == [((1, 0, 0), bytes([2] * 8))]
    assert inner.asked == [("c/0/0/0", -36, 32), ("c/0/0/0", len(a), len(b))]
    assert list(zarr.stored(meta, inner, (9, 0, 0))) == [] and list(zarr.stored(meta, inner, (0, 0, 0), lambda at: False)) == []


def test_purge_as_a_job(spark):
    class Log:
        def evict(self, victims):
            self.seen = sorted((r.volume_id, r.idx, r.batch) for r in victims.collect())

    log = Log()
    state = spark.createDataFrame([(0, i, 1, e) for i, e in enumerate([10] * 5 + [20] * 3 + [40] * 9)] + [(1, 0, 2, 10)], "volume_id int, idx int, state int, access_epoch int")
    after = residency.purge(state, 40, 16, 1, targets=(log,))
    assert log.seen == [(0, i, 0) for i in range(5)]
    assert sorted((r.volume_id, r.idx, r.state) for r in after.collect()) == [(0, i, 0 if i < 5 else 1) for i in range(17)] + [(1, 0, 2)]
    assert residency.purge(state, 40, 100, 1) is state
    assert residency.victims(state, 40, 100).isEmpty()


def test_a_loading_plan_composes_its_transforms(spark):
    from voxelarium.model import Affine

    r = Affine(((2.0, 0.0, 0.5, 1.0), (0.0, 2.0, 0.0, 2.0), (0.0, 0.25, 2.0, 3.0)))
    edges = spark.createDataFrame([("a", "b", 1, [float(x) for row in r.rows for x in row]), ("a", "b", 2, [0.0] * 12), ("a", "a", 0, [9.0] * 12)], "source string, target string, seq int, matrix array<double>")
    segments = spark.createDataFrame([("s", "a", 4.0, None), ("t", "a", None, None)], "segment_id string, original_volume_id string, downscale double, current_volume_id string")
    wanted = spark.createDataFrame([("s", "b"), ("s", None), ("t", "b"), ("t", "a"), ("t", "c")], "segment_id string, volume_id string")
    got = {(x.segment_id, x.volume_id): (x.matrix, x.uv_scale) for x in catalog.load_plan(wanted, segments, edges).collect()}
    both = [float(x) for row in Affine.uniform(4.0).then(r).rows for x in row]
    assert got["s", "b"][0] == both and got["s", "b"][1] == pytest.approx(r.scale())
    assert got["s", "a"] == ([4.0, 0, 0, 0, 0, 4.0, 0, 0, 0, 0, 4.0, 0], 1.0)
    assert got["t", "b"][0] == [float(x) for row in r.rows for x in row] and got["t", "a"] == got["t", "c"] == (None, 1.0)


def test_components_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 4)
    rng = np.random.default_rng(5)
    grid = rng.integers(0, 3, (11, 9, 10))
    want = np.arange(grid.size).reshape(grid.shape)
    while True:
        before = want.copy()
        for axis in range(3):
            a, b = [slice(None)] * 3, [slice(None)] * 3
            a[axis], b[axis] = slice(None, -1), slice(1, None)
            a, b = tuple(a), tuple(b)
            low = np.where(grid[a] == grid[b], np.minimum(want[a], want[b]), want[a])
            want[a] = np.minimum(want[a], low)
            want[b] = np.where(grid[a] == grid[b], np.minimum(want[a], want[b]), want[b])
        if (want == before).all():
            break
    v = spark.createDataFrame([(x, y, z, int(grid[z, y, x])) for z, y, x in np.ndindex(*grid.shape)] + [(0, 0, 0, int(grid[0, 0, 0]))], "x int, y int, z int, v int")
    got = {(r.z, r.y, r.x): r.component for r in graph.components(v).collect()}
    groups = {}
    for at in np.ndindex(*grid.shape):
        groups.setdefault(want[at], set()).add(got[at])
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_by_hand(spark):
    v = spark.createDataFrame([(0, 0, 0, 1), (1, 0, 0, 1), (2, 0, 0, 2), (3, 0, 0, 1), (3, 1, 0, 1), (0, 5, 5, 9)], "x int, y int, z int, v int")
    assert sorted(r.n for r in graph.sizes(graph.components(v)).collect()) == [1, 1, 2, 2]


def test_large_triangles_share_grids(spark):
    t = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0.0, 0.0, 900.0, 0.0, 0.0, 900.0, 0.0, 0.0, 900.0, 0.0, 0.0, 900.0)], "tri_id int, x1 double, y1 double, z1 double, u1 double, v1 double, x2 double, y2 double, z2 double, u2 double, v2 double, x3 double, y3 double, z3 double, u3 double, v3 double")
    assert mesh.to_cells(t, 4.0).count() <= 81
    p = spark.createDataFrame([(0, 100.0, 200.0), (1, 800.0, 800.0)], "id int, u double, v double")
    assert [r.id for r in mesh.locate(p, ["id"], t).collect()] == [0]


def test_request_states(spark, tmp_path):
    from voxelarium.streaming.telemetry import request_states

    rows = [("c1", "request", 0), ("c1", "request", 1), ("c1", "failed", 5), ("c1", "request", 6), ("c1", "request", 20_000), ("c1", "done", 20_001), ("c1", "request", 20_002)]
    spark.createDataFrame(rows, "chunk string, kind string, at long").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("chunk string, kind string, at long").parquet(str(tmp_path / "in"))
    q = request_states(s).writeStream.outputMode("append").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.action, r["at"]) for r in spark.table("states").orderBy("at").collect()] == [("dispatch", 0), ("cooldown", 5), ("dispatch", 20_000), ("resident", 20_001)]


def test_provenance(spark, tmp_path):
    (tmp_path / "in.bin").write_bytes(b"abc")
    p = json.loads(images.provenance(spark, {"tile": 16}, [str(tmp_path / "in.bin")]))
    assert p["inputs"][0]["size"] == 3 and p["arguments"] == {"tile": 16}


def test_synthetic_hash_kernel():
    from voxelarium.functions.kernels import voxel_hash

    g = np.arange(16)
    a = voxel_hash(g[:, None, None], g[None, :, None], g[None, None, :])
    assert a.shape == (16, 16, 16) and len(np.unique(a)) > 200


def test_points_by_label(spark, tmp_path):
    v = synthetic(spark, (3, 3, 3), lambda x, y, z: x)
    images.points(v, str(tmp_path / "pts"))
    assert {r.v: r["count"] for r in spark.read.parquet(str(tmp_path / "pts")).groupBy("v").count().collect()} == {0: 9, 1: 9, 2: 9}


def test_covered_closed_form(spark):
    b = spark.createDataFrame([(0, 0, 0, 0, 0, 0)], "lo_x int, lo_y int, lo_z int, hi_x int, hi_y int, hi_z int")
    assert residency.covered(b, (128, 64, 100), (300, 300, 300)).select(F.max("cx"), F.max("cy"), F.max("cz")).first() == (1, 0, 0)


def test_catalogue_urls_and_labels(spark):
    roots = lambda u, x: [(u, x)]
    e = spark.createDataFrame([("s", "obj-normalized", [("m.obj", roots("standard", "http://a/"))]), ("s", "tifxyz", [("/g", roots("standard", "http://b"))]), ("s", "tifxyz-normalized", [("gn", roots("private", "http://c"))]), ("t", "obj", [("x", roots("private", "http://d"))])], "owner string, type string, origins array<struct<path: string, roots: array<struct<usage: string, url: string>>>>")
    got = {r.owner: (r.grid_url, r.mesh_url, r.downloadable) for r in catalog.geometry(e).collect()}
    assert got == {"s": ("http://b/g", "http://a/m.obj", True), "t": (None, None, False)}
    assert {r.url for r in catalog.urls(e, "private").collect()} == {"http://c/gn", "http://d/x"}
    row = spark.range(1).select(catalog.scroll_label(F.lit(True), F.lit(3), F.lit("x")).alias("a"), catalog.volume_label(F.lit("v"), F.lit(7.91), F.lit(53), F.lit(220.0)).alias("b"), catalog.volume_label(F.lit("v"), F.lit(None).cast("double"), F.lit(53), F.lit(1.0)).alias("c"), catalog.volume_label(F.lit("v"), F.lit(2.4), F.lit(53), F.lit(1.0), F.lit(2)).alias("d")).first()
    assert tuple(row) == ("Fragment 3 - x", "7.91µm, 53keV, 0.22m", "v", "2.40µm (^2)")
    edges = spark.createDataFrame([("a", "b", 1, 0), ("a", "b", 2, 1)], "source string, target string, matrix int, seq int")
    assert catalog.direct_transform(edges, "a", "b").first().matrix == 1 and catalog.direct_transform(edges, "a", "a").isEmpty()
