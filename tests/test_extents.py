"""Queries reach the whole of a table larger than 500 vectors."""

import pytest

from voxelarium import registry

LARGE = "/root/testdata/sf0.1"


def test_lod_mean_chunk_form(spark):
    assert registry.QUERIES["lod_mean_chunk_form"](spark, LARGE).agg({"z": "max"}).first()[0] == 999


def test_tiled_tiff_roundtrip(spark):
    assert registry.QUERIES["tiled_tiff_roundtrip"](spark, LARGE).count() == 2000 * 64


@pytest.mark.parametrize("ids", [range(106), [*range(0, 40), *range(47, 203), 409], []])
def test_tiled_tiff_roundtrip_ends_within_a_row(spark, duck, tmp_path, ids):
    """Pixels of an image where the volume has no plane are not the volume's: the last row is short, planes are missing."""
    rows = [(i, [(i * 31 + k * 7) % 200 / 100.0 - 1 for k in range(64)], i % 3) for i in ids]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.QUERIES["tiled_tiff_roundtrip"](spark, str(tmp_path))
    sql = registry.ORACLES["tiled_tiff_roundtrip"].replace("FROM embeddings)", f"FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet'))")
    assert sorted(map(tuple, got.collect())) == sorted(duck.execute(sql).fetchall())
    assert got.columns == [c[0] for c in duck.description]


def test_aabb_touch(spark):
    assert registry.QUERIES["aabb_touch"](spark, LARGE).where("cy >= 79").count()


def test_lookups_beyond_plane_500(spark):
    ids = [r.p_partkey for r in spark.read.parquet(f"{LARGE}/part.parquet").where("(p_partkey * 7) % 2011 >= 2000 AND p_partkey % 41 < 32 AND p_partkey % 37 < 30").select("p_partkey").collect()]
    for name in ("voxel_lookup_oob", "trilinear_q8"):
        df = registry.QUERIES[name](spark, LARGE)
        assert df.where(df.id.isin(ids) & (df.value > 0)).count()
