"""Connected components of voxels of equal value, six neighbours each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelarium.shared import cut, delete, folder

#: Voxels along each side of a block that is labelled in one task.
BLOCK = 64


def _local(t: pa.Table) -> pa.Table:
    """The least id reachable within a block of each of its voxels."""
    x, y, z, id_ = (np.asarray(t.column(c).combine_chunks()).astype(np.int64) for c in ("x", "y", "z", "id"))
    values, value = np.unique(np.asarray(t.column("v").combine_chunks()), return_inverse=True)
    place = (((z - z.min()) * (BLOCK + 1) + (y - y.min())) * (BLOCK + 1) + (x - x.min())) * len(values) + value
    order = np.argsort(place, kind="stable")
    place = place[order]
    twin = np.flatnonzero(place[1:] == place[:-1])  # a voxel given twice
    ends = [(twin, twin + 1)]
    for step in (1, BLOCK + 1, (BLOCK + 1) ** 2):
        to = place + step * len(values)
        at = np.minimum(np.searchsorted(place, to), len(place) - 1)
        i = np.flatnonzero(place[at] == to)
        ends.append((i, at[i]))
    a, b = (np.concatenate(e) for e in zip(*ends, strict=True))
    mark = np.arange(len(id_))
    while True:
        low = np.minimum(mark[a], mark[b])
        new = mark.copy()
        # the roots of both ends are tied too, so that chains halve
        for e in (a, b, mark[a], mark[b]):
            np.minimum.at(new, e, low)
        new = new[new]
        if (new == mark).all():
            break
        mark = new
    root = np.empty(len(id_), np.int64)
    root[order] = id_[order][mark]
    return t.select(["x", "y", "z", "v", "id"]).append_column("root", pa.array(root))


def components(voxels: DataFrame, rounds: int = 100) -> DataFrame:
    """(x, y, z, v, component): component is the least id, (z * 2**20 + y) * 2**20 + x, of the component.

    Blocks of BLOCK voxels a side are labelled first, each in one task of bounded size; only pairs of blocks' labels
    that touch across a face are edges.  These are contracted by alternating stars; each round is a minimum per node and
    an equi-join, written out, and the round before it is deleted.
    """
    kinds = {f.name: f.dataType.simpleString() for f in voxels.schema.fields}
    v = voxels.select("x", "y", "z", "v").withColumn("id", F.shiftleft(F.shiftleft(F.col("z").cast("long"), 20) + F.col("y"), 20) + F.col("x"))
    block = [F.floor(F.col(c) / BLOCK).alias(f"_{c}") for c in "xyz"]
    spark = voxels.sparkSession
    home = folder(spark, "components")
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("x", "y", "z", "v")) + ", id long, root long"
    v = cut(v.select("*", *block).groupBy("_x", "_y", "_z").applyInArrow(_local, schema), "", f"{home}/blocks")
    edges = None
    for axis in "xyz":
        # the voxels on both sides of the faces between blocks
        face = F.pmod(F.col(axis), F.lit(BLOCK))
        other = v.where(face == 0).select(*[(F.col(c) - 1 if c == axis else F.col(c)).alias(c) for c in "xyz"], "v", F.col("root").alias("b"))
        e = v.where(face == BLOCK - 1).select("x", "y", "z", "v", F.col("root").alias("a")).join(other, ["x", "y", "z", "v"]).select("a", "b")
        edges = e if edges is None else edges.unionByName(e)
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "", f"{home}/0")
    if e.isEmpty():
        return v.select("x", "y", "z", "v", F.col("root").alias("component"))
    before = None
    for k in range(1, rounds + 1):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = cut(e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "", f"{home}/{k}")
        delete(spark, f"{home}/{k - 1}")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    top = e.groupBy(F.col("u").alias("root")).agg(F.min("v").alias("top"))
    return v.join(top, "root", "left").select("x", "y", "z", "v", F.coalesce("top", "root").alias("component"))


def sizes(labelled: DataFrame, least: int = 1) -> DataFrame:
    return labelled.groupBy("component", "v").agg(F.count("*").alias("n")).where(F.col("n") >= least)
