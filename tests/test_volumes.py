"""Closed forms on synthetic volumes, overlay identities, kernels against their column twins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelarium.functions import composite as fold
from voxelarium.functions import kernels
from voxelarium.functions.voxel import affine, filtered, from_linear, linear_index, page_index, state_color
from voxelarium.model import Affine, Coloring, Compositing, Crop, Filter, View, natural_level, paint_zoom, parse_alpha, parse_color, purge_target, synthesised_levels
from voxelarium.operators import lod, paint, sample
from voxelarium.sources.formats import synthetic


def points(spark, *at):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], "id int, sx double, sy double, sz double")


def values(df):
    return [r.value for r in df.orderBy("id").collect()]


def test_xor_volume(spark):
    v = synthetic(spark, (16, 16, 16), lambda x, y, z: x.bitwiseXOR(y).bitwiseXOR(z))
    assert values(sample.nearest(points(spark, (1, 2, 3), (-1, 2, 0), (16, 0, 0), (15.9, 0, 0)), v, (16, 16, 16))) == [0, 2, 0, 15]


def test_gradient_interpolation(spark):
    v = synthetic(spark, (128, 2, 2), lambda x, y, z: x)
    p = points(spark, (10.25, 0, 0), (10.5, 0, 0), (63.5, 0, 0), (63.0, 0, 0))
    assert values(sample.trilinear_q8(p, ["id"], v, (128, 2, 2))) == [10, 10, 63, 63]
    assert values(sample.trilinear_f64(p, ["id"], v)) == [10, 10, 63, 63]
    assert values(sample.trilinear_q8_chunks(p, ["id"], sample.to_chunks(v, 6), 6)) == [10, 10, 63, 63]


def test_coarse_lattice(spark):
    """With level 0 absent the lattice moves to level 1."""
    v = synthetic(spark, (32, 2, 2), lambda x, y, z: (x * 16) % 256).withColumn("lod", F.lit(1))
    p = points(spark, (10.5, 0, 0), (11.5, 0, 0), (12.0, 0, 0))
    assert values(sample.fallback(p, ["id"], v, 1, trilinear=True)) == [84, 92, 96]


def test_constant_volume_paints_every_pixel(spark):
    v = synthetic(spark, (64, 64, 4), lambda x, y, z: F.lit(0xAB))
    rows = paint.slice_plane(v, View((32, 32, 2), width=24, height=24, paint_zoom=2)).collect()
    assert len(rows) == 576 and {r.value for r in rows} == {0xAB}


def test_level_means(spark):
    v = synthetic(spark, (4, 4, 4), lambda x, y, z: F.shiftright(z, 1) * 4 + F.shiftright(y, 1) * 2 + F.shiftright(x, 1))
    assert {(r.x, r.y, r.z): r.v for r in lod.halve(v).collect()} == {(x, y, z): z * 4 + y * 2 + x for x in (0, 1) for y in (0, 1) for z in (0, 1)}


def test_chunk_round_trip(spark):
    v = synthetic(spark, (8, 8, 8), lambda x, y, z: (x * 31 + y * 7 + z) % 256)
    back = sample.to_voxels(sample.to_chunks(v, 2), 2)
    assert v.exceptAll(back.select("x", "y", "z", "v")).isEmpty() and back.count() == 512


def test_preview_twins(spark):
    rng = np.random.default_rng(0)
    block = rng.integers(0, 256, (8, 8, 8), dtype=np.uint8)
    v = spark.createDataFrame([(int(x), int(y), int(z), int(block[z, y, x])) for z in range(8) for y in range(8) for x in range(8)], "x int, y int, z int, v int")
    got = {(r.x, r.y, r.z): r.v for r in lod.preview_voxels(v, 1, 8).collect()}
    child = kernels.upsample(block, (1, 0, 1), 1)
    assert all(got[(x + 8, y, z + 8)] == child[z, y, x] for x in range(8) for y in range(8) for z in range(8))
    chunks = spark.createDataFrame([(2, 0, 0, 0, bytearray(block.tobytes()))], "lod int, cx int, cy int, cz int, bytes binary")
    wanted = spark.createDataFrame([(1, 1, 0, 1)], "lod int, cx int, cy int, cz int")
    row = lod.preview(wanted, chunks, bits=3).first()
    assert row["shift"] == 1 and bytes(row["bytes"]) == child.tobytes()


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def arr(xs):
    return F.array(*map(F.lit, xs))


C = Compositing(alpha_min=0, alpha_max=255, cutoff=9500, opacity=100)


def test_overlay_identities(spark):
    ramp = [0, 20, 40, 90, 150, 200, 255, 255]
    plain = one(spark, fold.alpha(arr(ramp), C))
    full, zero = [255] * 8, [0] * 8
    with_ = lambda mode, o, **k: one(spark, fold.composite(Compositing(mode, **k), arr(ramp), arr(o)))
    assert with_("overlay_combined", full) == plain
    assert with_("overlay_combined", zero) == 0
    assert with_("overlay_combined", zero, background=1.0) == plain
    assert with_("overlay_start", zero) == plain
    assert with_("overlay_start", [0, 0, 0, 9, 0, 0, 0, 0]) == one(spark, fold.alpha(arr(ramp[3:]), C))
    assert with_("overlay_opacity", zero) == 0
    assert abs(one(spark, fold.composite(Compositing("overlay_combined", value_norm=0.0), arr([200] * 8), arr([60] * 8))) - 200) <= 1


def test_height_map(spark):
    assert one(spark, fold.height_map(arr([0, 0, 0]), C, 3)) == 0
    assert one(spark, fold.height_map(arr([255, 0, 0]), C, 3)) == 255
    assert one(spark, fold.height_map(arr([0, 255, 0]), C, 2)) == 127


def test_alpha_kernel_is_the_fold(spark):
    rng = np.random.default_rng(1)
    rays = rng.integers(0, 256, (50, 12))
    c = Compositing(alpha_min=60, alpha_max=220, cutoff=9000, opacity=40)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rays)], "id int, s array<int>")
    got = [r.v for r in df.orderBy("id").select(fold.alpha(F.col("s"), c).alias("v")).collect()]
    assert got == kernels.composite_alpha(rays, c).tolist()


def test_addresses(spark):
    df = spark.range(60).select(F.col("id").alias("i"))
    x, y, z = from_linear(F.col("i"), 3, 4)
    assert df.where(linear_index(x, y, z, 3, 4) != F.col("i")).isEmpty()
    assert spark.range(4096).select(page_index((F.col("id") % 16).cast("int"), (F.floor(F.col("id") / 16) % 16).cast("int"), F.floor(F.col("id") / 256).cast("int")).alias("p")).distinct().count() == 4096


def test_filter_edges(spark):
    assert one(spark, filtered(F.lit(77), Filter())) == 77
    assert one(spark, filtered(F.lit(255), Filter(threshold_min=100))) == 255
    assert one(spark, filtered(F.lit(99), Filter(threshold_min=100))) == 0
    assert one(spark, filtered(F.lit(9), Filter(threshold_min=128, threshold_max=127))) == 0
    assert Filter(quant=4, mask_shift=1).mask == 0x78


def test_transforms(spark):
    a = Affine(((1.0, 2.0, 0.0, 3.0), (0.0, 1.0, 0.0, -1.0), (0.0, 0.0, 2.0, 0.5)))
    p = np.array([1.0, 2.0, 3.0])
    x, y, z = (one(spark, c) for c in affine(a.then(a.inverted()), *map(F.lit, p.tolist())))
    assert np.allclose((x, y, z), p)
    assert Affine.uniform(2.0).scale() == 2.0
    assert Affine.parse('{"transformation_matrix": [[1,0,0,0],[0,1,0,0],[0,0,1,5]]}').rows[2][3] == 5
    with pytest.raises(ValueError):
        Affine(((0.0,) * 4,) * 3).inverted()


def test_parsers():
    assert Crop.parse("3+4-50x60") == Crop(3, 4, 50, 60)
    assert Coloring.parse("boolean:#0aC85a:0.5:multiply") == Coloring("boolean", 0.5, (10, 200, 90), mode="multiply")
    assert Coloring.parse("hue:90").hue == 90
    assert parse_color("ff0001") == (255, 0, 1)
    for bad in ("four:2", "none", "boolean", "hue:1:0.5:add"):
        with pytest.raises(ValueError):
            Coloring.parse(bad)
    with pytest.raises(ValueError):
        parse_alpha("1.5")
    with pytest.raises(ValueError):
        Crop.parse("1+2-3")


def test_zoom_and_purge_numbers():
    assert [paint_zoom(z) for z in (2, 1, 0.9, 0.5, 0.3, 0.001)] == [1, 1, 2, 2, 4, 32]
    assert [natural_level(z) for z in (2, 1, 0.5, 0.25)] == [0, 1, 2, 3]
    assert purge_target(96, 100 * 64**3) == 16 and purge_target(95, 100 * 64**3) == 0
    assert synthesised_levels((512, 512, 512), 0, 1000) == 3 and synthesised_levels((512, 512, 512), 0, 100) == 0


def test_state_colors(spark):
    c = state_color(F.lit(0), F.lit(None).cast("int"), F.lit("empty"), F.lit(False))
    assert tuple(one(spark, c)) == (60, 200, 110)
    assert one(spark, state_color(F.lit(0), F.lit(0), F.lit("resident"), F.lit(False))) is None


@pytest.mark.parametrize("mode", ["alpha", "max"])
def test_ray_kernel_is_the_column_form(spark, mode):
    """Rays over dense chunks against the trilinear join and the fold, across chunk seams and past the edge."""
    v = synthetic(spark, (24, 24, 24), lambda x, y, z: (x * 31 + y * 17 + z * 7) % 256)
    rng = np.random.default_rng(2)
    rows = [(i, *rng.uniform(2, 22, 3).tolist(), *rng.uniform(-0.7, 0.7, 3).tolist()) for i in range(40)]
    rays = spark.createDataFrame(rows, "ray long, ox double, oy double, oz double, dx double, dy double, dz double")
    c = Compositing(mode, alpha_min=40, alpha_max=230, cutoff=9300, opacity=30)
    layers = tuple(range(-4, 5))
    p = sample.rays_to_points(rays, F.array(*map(F.lit, layers)))
    joined = sample.gather(sample.trilinear_q8(p, ["ray", "k"], v, (1 << 30,) * 3))
    want = {r.ray: r.value for r in joined.select("ray", fold.composite(c, F.col("samples")).alias("value")).collect()}
    got = {r.ray: r.value for r in sample.composite_rays(rays, sample.to_chunks(v, 3), c, layers, 3).collect()}
    assert got == want


def test_points_of_a_hot_chunk_are_dealt_to_copies(spark, monkeypatch):
    monkeypatch.setattr(sample, "HOT", 7)
    v = synthetic(spark, (12, 8, 8), lambda x, y, z: (x * 7 + y * 13 + z * 29) % 251)
    p = spark.range(60).select("id", ((F.col("id") * 37 % 100) / 10.0).alias("sx"), ((F.col("id") * 11 % 60) / 10.0).alias("sy"), ((F.col("id") % 7) / 1.5).alias("sz"))
    assert values(sample.trilinear_q8_chunks(p, ["id"], sample.to_chunks(v, 2), 2)) == values(sample.trilinear_q8(p, ["id"], v, (12, 8, 8)))
