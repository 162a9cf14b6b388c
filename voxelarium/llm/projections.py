"""Operator 8: embedding near-duplicates by sorted projection passes.

Vectors equal in label and every component form one class and are compared once.  In each pass the classes of a label
are ordered by the lexicographic string of BITS random hyperplane signs, taken about the label's mean, and every vector
is compared in double precision with its WINDOW neighbours before it; verified links of all passes are united.

How many passes a label takes follows from its number of classes n and from how concentrated it is.  With the mean's
squared length s, a pair at the threshold T keeps the cosine (T - s) / (1 - s) about the mean and falls on one side of
a hyperplane with probability p = 1 - acos(.) / pi; log2(n / WINDOW) signs narrow a label down to a window.  The passes
are as many as leave a pair unmet with probability MISS.  Where they would cost more than comparing the label whole
(small or very concentrated labels), the label is compared whole.

Windows can still be too narrow where vectors crowd within a label.  A vector is *crowded* if in some pass the far end
of its window is still within cosine CROWD.  Crowded vectors are united over such neighbours, and each of these groups
is compared whole, block against block: only counts and one edge per vector leave a task, so no partner is capped and
no list of a group's pairs is written.  That work grows with the square of a group, not of a label.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows with null label or
null vec_id, link with nothing (n_links 0, component their own id, kept); vectors of different length are never
compared; rows that share a vec_id are one node in the components but counted one by one; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelarium.llm.base import components, cut, ship
from voxelarium.llm.suffix import _batch

THRESHOLD = 0.98
BITS, WINDOW, BLOCK = 62, 64, 512
CROWD, MISS = 0.9, 1e-4


def _matrix(column) -> tuple[np.ndarray, np.ndarray]:
    """(unit rows, zero-padded to the longest; lengths) of a list column without nulls."""
    size = np.asarray(pc.list_value_length(column)).astype(np.int64)
    x = np.zeros((len(size), int(size.max(initial=1))))
    x[np.arange(x.shape[1]) < size[:, None]] = np.asarray(column.flatten()).astype(np.float64)
    # scaled by a power of two first: squares of very large or small components stay finite and above zero
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
    return x / np.linalg.norm(x, axis=1)[:, None], size


def hyperplanes(which: int, dim: int) -> np.ndarray:
    return np.random.default_rng((which, dim)).standard_normal((dim, BITS))


def _sums(batches):
    """Sums of the unit vectors of each label in a batch."""
    for b in batches:
        if not b.num_rows:
            continue
        x, size = _matrix(b.column("e"))
        label = np.asarray(b.column("label"))
        groups, which = np.unique(np.stack((label, size)), axis=1, return_inverse=True)
        which = which.ravel()
        total = np.zeros((groups.shape[1], x.shape[1]))
        np.add.at(total, which, x)
        rows = [total[g, : groups[1, g]].tolist() for g in range(groups.shape[1])]
        yield pa.RecordBatch.from_arrays([pa.array(groups[0]), pa.array(groups[1].astype(np.int32)), pa.array(np.bincount(which)), pa.array(rows, pa.list_(pa.float64()))], ["label", "dim", "n", "s"])


def plan(classes: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW) -> DataFrame:
    """(label, dim, mean, passes) of every label; passes is 0 where the label is compared whole."""
    sums = cut(classes.select("label", "e").mapInArrow(_sums, "label long, dim int, n long, s array<double>"), "sums")
    mean = sums.select("label", "dim", F.posexplode("s").alias("at", "v")).groupBy("label", "dim", "at").agg(F.sum("v").alias("v"))
    mean = mean.groupBy("label", "dim").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("m"))
    per = sums.groupBy("label", "dim").agg(F.sum("n").alias("n")).join(mean, ["label", "dim"])
    # rounded: the order in which parts are summed doesn't matter
    per = per.withColumn("mean", F.transform("m", lambda x: F.round(x["v"] / F.col("n"), 6)))
    s = F.aggregate("mean", F.lit(0.0), lambda a, x: a + x * x)
    cos = F.greatest((F.lit(threshold) - s) / F.greatest(1 - s, F.lit(1e-9)), F.lit(-1.0))
    meet = F.pow(1 - F.acos(F.least(cos, F.lit(1.0))) / F.lit(np.pi), F.greatest(F.log2(F.col("n") / window), F.lit(0.0)))
    passes = F.ceil(F.log(F.lit(MISS)) / F.log(1 - F.least(meet, F.lit(1 - MISS))))
    cheap = F.coalesce((meet > 0) & (2 * window * passes < F.col("n")), F.lit(False))
    return per.select("label", "dim", "mean", F.when(cheap, passes).otherwise(0).cast("int").alias("passes"))


def _project(batches):
    """Each vector once for each pass of its label, with its sign string as a number."""
    for b in batches:
        if not b.num_rows:
            continue
        x, size = _matrix(b.column("e"))
        mean = np.zeros_like(x)
        mean[np.arange(x.shape[1]) < size[:, None]] = np.asarray(b.column("mean").flatten())
        passes = np.asarray(b.column("passes"))
        label, h1, h2 = (np.asarray(b.column(c)) for c in ("label", "h1", "h2"))
        for t in range(int(passes.max())):
            rows = np.flatnonzero(passes > t)
            key = np.zeros(len(rows), np.int64)
            for n in np.unique(size[rows]):
                own = size[rows] == n
                signs = ((x[rows[own], :n] - mean[rows[own], :n]) @ hyperplanes(t, int(n))) > 0
                key[own] = (signs.astype(np.int64) << np.arange(BITS - 1, -1, -1)).sum(1)
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), t, np.int32)), pa.array(label[rows]), pa.array(size[rows].astype(np.int32)), pa.array(key), pa.array(h1[rows]), pa.array(h2[rows]), b.column("id").take(at), b.column("e").take(at)], ["pass", "label", "dim", "key", "h1", "h2", "id", "e"])


FOUND = "kind int, h1 long, h2 long, a long, g1 long, g2 long, b long"


def _united(near: np.ndarray) -> np.ndarray:
    """The least index reachable of each, over a symmetric matrix of links with a full diagonal."""
    mark = np.arange(len(near))
    while len(near):
        low = np.where(near, mark[None, :], len(near)).min(1)
        low = low[low]
        if (low == mark).all():
            break
        mark = low
    return mark


def _sweep(threshold: float, window: int):
    """Links within the window (kind 0), and of crowded vectors an edge to one of their neighbours (kind 1).

    Two vectors that are both found crowded here are left to the comparison of their group.
    """
    def run(batches):
        tail = None
        for b in batches:
            t = pa.Table.from_batches([b])
            if tail is not None:
                t = pa.concat_tables([tail, t])
            n = t.num_rows
            if not n:
                continue
            start = 0 if tail is None else tail.num_rows
            tail = t.slice(max(0, n - window))
            t = t.combine_chunks()
            x, size = _matrix(t.column("e").combine_chunks())
            p, label, h1, h2, ids = (np.asarray(t.column(c)) for c in ("pass", "label", "h1", "h2", "id"))
            # blocks of rows against those up to a window before: the matrix stays small
            for at in range(start, n, BLOCK):
                low, end = max(0, at - window), min(n, at + BLOCK)
                r = np.arange(low, end)
                cos = x[r] @ x[r].T
                same = (p[r][:, None] == p[r]) & (label[r][:, None] == label[r]) & (size[r][:, None] == size[r])
                gap = r[:, None] - r[None, :]
                pair = same & (gap > 0) & (gap <= window) & (r[:, None] >= at)
                crowd = pair & (gap == window) & (cos >= CROWD)
                dense = crowd.any(1)  # the later end; its window reaches down to the earlier one
                whole = np.zeros(len(r) + 1, np.int32)
                k = np.flatnonzero(dense)
                np.add.at(whole, np.maximum(k - window, 0), 1)
                np.add.at(whole, k + 1, -1)
                inside = np.cumsum(whole[:-1]) > 0
                if len(k):
                    near = same & (cos >= CROWD) & (np.abs(gap) <= window)
                    some = np.flatnonzero(inside)
                    near = near[np.ix_(some, some)]
                    np.fill_diagonal(near, True)
                    to = some[_united(near)]
                    crowded = np.zeros(len(r), bool)
                    crowded[k] = True
                    crowded[np.maximum(k - window, 0)] = True
                    some, to = some[crowded[some] | crowded[to]], to[crowded[some] | crowded[to]]
                    yield _batch(("kind", "h1", "h2", "a", "g1", "g2", "b"), (np.ones(len(some), np.int32), h1[r[some]], h2[r[some]], ids[r[some]], h1[r[to]], h2[r[to]], ids[r[to]]))
                    # neighbours of a crowded vector may not be crowded themselves
                    both = np.zeros(len(r), bool)
                    both[some] = True
                    pair &= ~(both[:, None] & both)
                i, j = np.nonzero(pair & (cos >= threshold))
                if len(i):
                    i, j = r[i], r[j]
                    less = (h1[i] < h1[j]) | ((h1[i] == h1[j]) & (h2[i] < h2[j]))
                    i, j = np.where(less, i, j), np.where(less, j, i)
                    yield _batch(("kind", "h1", "h2", "a", "g1", "g2", "b"), (np.zeros(len(i), np.int32), h1[i], h2[i], ids[i], h1[j], h2[j], ids[j]))
    return run


def _compare(threshold: float):
    """Links between two blocks of one group (or within one): counts, and an edge of each linked vector."""
    def run(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        block, first, second, many, ids = (np.asarray(t.column(c)) for c in ("block", "i", "j", "many", "id"))
        x, size = _matrix(t.column("e").combine_chunks())
        near = (x @ x.T >= threshold) & (size[:, None] == size)
        np.fill_diagonal(near, False)
        if first[0] != second[0]:
            near &= block[:, None] != block
        some = np.flatnonzero(near.any(1))
        near = near[np.ix_(some, some)]
        links = (near * many[some]).sum(1, dtype=np.int64)
        np.fill_diagonal(near, True)
        mark = _united(near)
        return pa.table({"h1": t.column("h1").take(pa.array(some)), "h2": t.column("h2").take(pa.array(some)), "links": pa.array(links), "a": pa.array(ids[some]), "b": pa.array(ids[some[mark]])})
    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    ship(spark)
    e = F.col("embedding").cast("array<double>")
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), e.alias("e"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    valid = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull() & F.coalesce(F.forall("e", finite) & F.exists("e", lambda x: x != 0), F.lit(False))
    h = [F.xxhash64("label", "e"), F.xxhash64("e", "label", F.lit(7))]
    base = base.withColumn("ok", valid).withColumn("h1", F.when(F.col("ok"), h[0])).withColumn("h2", F.when(F.col("ok"), h[1]))
    classes = cut(base.where("ok").groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("many"), F.first("label").alias("label"), F.first("e").alias("e")), "classes")
    labels = cut(plan(classes, threshold, window), "labels")
    # one row per label, broadcast by Spark where that table is small
    planned = classes.withColumn("dim", F.size("e")).join(labels, ["label", "dim"])
    # all passes at once; range partitions split labels of any size
    spread = planned.where("passes > 0").select("label", "mean", "passes", "h1", "h2", "id", "e").mapInArrow(_project, "pass int, label long, dim int, key long, h1 long, h2 long, id long, e array<double>")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ("pass", "label", "dim", "key", "h1", "h2")
    swept = cut(spread.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_sweep(threshold, window), FOUND).distinct(), "swept")
    # groups to be compared whole: labels of no passes, and crowds
    crowd = swept.where("kind = 1")
    node = lambda p, q: F.xxhash64(p, q)
    comp = components(crowd.select(node("h1", "h2").alias("a"), node("g1", "g2").alias("b")))
    grouped = planned.withColumn("node", node("h1", "h2")).join(comp.withColumnRenamed("id", "node"), "node", "left")
    whole = F.when(F.col("passes") == 0, F.xxhash64("label", "dim"))
    grouped = cut(grouped.withColumn("group", F.coalesce(whole, "component")).where("group IS NOT NULL").select("group", "h1", "h2", "id", "many", "e"), "groups")
    size = grouped.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    member = grouped.join(size, "group").withColumn("block", F.pmod(F.xxhash64("h2", "h1"), F.col("blocks")).cast("int"))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    member = member.select("group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "h1", "h2", "many", "e")
    compared = cut(member.groupBy("group", "i", "j").applyInArrow(_compare(threshold), "h1 long, h2 long, links long, a long, b long"), "compared")
    # links found in the passes, but for those between members of one group, which are counted there
    of = lambda p, q, name: grouped.select(F.col("h1").alias(p), F.col("h2").alias(q), F.col("group").alias(name))
    found = swept.where("kind = 0").join(of("h1", "h2", "left"), ["h1", "h2"], "left").join(of("g1", "g2", "right"), ["g1", "g2"], "left")
    found = cut(found.where(~F.coalesce(F.col("left") == F.col("right"), F.lit(False))).drop("left", "right"), "found")
    both = found.select("h1", "h2", "g1", "g2").unionByName(found.select(F.col("g1").alias("h1"), F.col("g2").alias("h2"), F.col("h1").alias("g1"), F.col("h2").alias("g2")))
    partner = classes.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "many")
    counted = compared.select("h1", "h2", "links").unionByName(both.join(partner, ["g1", "g2"]).select("h1", "h2", F.col("many").alias("links")))
    counted = counted.groupBy("h1", "h2").agg(F.sum("links").alias("links"))
    comp = components(compared.select("a", "b").unionByName(found.select("a", "b")))
    per = classes.select("h1", "h2", "id", "many").join(counted, ["h1", "h2"], "left").join(comp, "id", "left")
    per = per.select("h1", "h2", (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("_links"), F.coalesce("component", "id").alias("_component"))
    out = base.select("vec_id", "h1", "h2").join(per, ["h1", "h2"], "left")
    component = F.coalesce("_component", "vec_id")
    return out.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op8_sorted_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, label, e FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
cc(id, m) USING KEY (id) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, min(cc.m) FROM cc JOIN l ON l.a = cc.id JOIN recurring.cc r ON r.id = l.b WHERE cc.m < r.m GROUP BY l.b)
SELECT v.vec_id, CAST((SELECT count(*) FROM l WHERE l.a = v.vec_id) AS BIGINT) AS n_links, cc.m AS component_id, v.vec_id = cc.m AS kept FROM v JOIN cc ON cc.id = v.vec_id
"""
