"""Shared plumbing: row keys, tables in the shared folder, connected components, shipping code to executors."""

from __future__ import annotations

import gc
import math
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelarium.ship import ship as send

#: Tables written by this process, for clean().
_WRITTEN: list[str] = []


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, and bound the rows of an Arrow batch.

    Long texts make large batches; 512 rows hold a batch of very long documents within a worker's memory.
    """
    send(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")


def clean(spark: SparkSession) -> None:
    """Delete the intermediate tables written so far.  DataFrames that still read them are of no use afterwards."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "file://" + os.path.join(tempfile.gettempdir(), "voxelarium-shared")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame, name: str = "step", free: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: the lineage ends there and survives lost executors.

    free: let go of the shuffle files that led to it now (Spark removes them once their plan is collected as garbage),
    where a large shuffle would otherwise stay on disk beside the next one.
    """
    spark = df.sparkSession
    schema = df.schema
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    if free:
        del df
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def keyed(docs: DataFrame, *keep: str) -> DataFrame:
    """k1, k2 and the named columns.  (k1, k2) names a row up to rows equal in doc_id and text.

    A null doc_id takes part as the least long with another k2, so that joins need no null-safe comparison.
    """
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("k1"),
        F.xxhash64(F.col("text"), F.col("doc_id").isNull()).alias("k2"),
        *keep,
    )


def no_key(name: str = "k1"):
    """doc_id as it was: the key of a null id is null again."""
    return F.when(F.col(name) != F.lit(-(2**63)), F.col(name)).alias("doc_id")


def ends(edges: DataFrame) -> DataFrame:
    """(id) of both ends of the links (a, b)."""
    return edges.select(F.col("a").alias("id")).distinct().unionByName(edges.select(F.col("b").alias("id")).distinct()).distinct()


#: Links that one task contracts.
LINKS = 1 << 20


def _contract(batches):
    """(u, v): each node of a partition's links (a, b) with the least node it reaches there, itself included."""
    parts = [(np.asarray(x.column(0)), np.asarray(x.column(1))) for x in batches]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    node, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    mark = np.arange(len(node))
    while len(i):
        low = np.minimum(mark[i], mark[j])
        new = mark.copy()
        # the marks of both ends are tied too, so that chains halve
        for end in (i, j, mark[i], mark[j]):
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == mark).all():
            break
        mark = new
    for k in range(0, len(node), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(node[k : k + 50_000]), pa.array(node[mark[k : k + 50_000]])], ["u", "v"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of every end of the links (a, b): component is the smallest id reachable.

    The links are contracted within partitions of about LINKS rows, which leaves one link a node; where that is one
    partition it is all.  Else alternating large-star and small-star steps follow.  Each is a minimum per node (combined
    before the shuffle) and one equi-join, which adaptive execution can split where a hub is hot; no step gathers a
    node's neighbours in one row.  Every round and the result are written to the shared folder.  Self links name
    isolated nodes.
    """
    links = cut(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")), "links")
    parts = max(1, math.ceil(links.count() / LINKS))
    e = cut(links.coalesce(parts).mapInArrow(_contract, "u long, v long"), "contracted")
    if parts == 1:
        return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    nodes = e.select(F.col("u").alias("id")).distinct()
    e = cut(e.where("u <> v").distinct(), "star")
    before = None
    for _ in range(rounds):
        # large star: every node ties its larger neighbours to its smallest one
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = cut(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        # small star: every node ties its smaller neighbours and itself to the smallest of them
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        e = cut(e.distinct(), "small")
        n, h = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, h) == before:
            break
        before = (n, h)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.groupBy("u").agg(F.min("v").alias("m"))
    return cut(nodes.join(roots, nodes["id"] == roots["u"], "left").select("id", F.coalesce("m", "id").alias("component")), "components")
