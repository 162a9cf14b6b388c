"""Operator 1: mixing sources to target weights by Pareto order sampling.

Targets: sources by code point, null last, weigh 5, 2, 1 in turn and share 150 % of all words; no target exceeds twice
its source, the excess is shared again by weight.  That is the level at which sum(min(2 size, weight * level)) meets the
budget, found by one ordered pass over the sources.

A source with target T and size S takes every document floor(T/S) times for certain.  The rest is a sample of fixed
size in words: documents are ranked by their random odds over their inclusion odds, (u/(1-u)) / (f/(1-f)) with f the
fractional part of T/S, and taken in that order while each brings the sum nearer to what is missing.  u comes from the
md5 of doc_id (of the text where the id is null), so reruns agree.  Running sums are two-level (buckets of the ranking variable, then documents of the one
bucket where the target falls), so that no task ranks a whole source.

Defined results: null or wordless text has size 0 and takes 0; null is a source of its own; rows repeated in the table
are taken each on its own; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelarium.llm.base import cut

WEIGHTS = (5, 2, 1)
BUDGET, MOST = 1.5, 2
BUCKETS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def name_of(doc_id: Column, text: Column) -> Column:
    """What a document's random number is made of: its id, or its text where it has none."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("n"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))


def uniform(name: Column) -> Column:
    """An integer below 2**48 from the md5 of the name."""
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 12), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size); one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("s"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    w = F.element_at(F.array(*map(F.lit, weights)), turn + 1)
    per = per.withColumn("w", w.cast("long"))
    all_ = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("s").cast("double") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("total", F.sum("s").over(all_)).withColumn("w_left", F.sum("w").over(all_) - F.coalesce(F.sum("w").over(order), F.lit(0)))
    per = per.withColumn("before", F.coalesce(F.sum(most * F.col("s")).over(order), F.lit(0)))
    capped = (most * F.col("s") * F.col("w_left")).cast("double") <= F.col("w") * (F.lit(budget) * F.col("total") - F.col("before"))
    per = per.withColumn("capped", capped)
    per = per.withColumn("c", F.sum(F.when(F.col("capped"), most * F.col("s")).otherwise(0)).over(all_)).withColumn("wu", F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w"))).over(all_))
    target = F.when(F.col("capped"), (most * F.col("s")).cast("double")).otherwise(F.col("w") * (F.lit(budget) * F.col("total") - F.col("c")) / F.nullif(F.col("wu"), F.lit(0)))
    return per.select("source", F.col("s").alias("source_size"), target.alias("target"))


def _ranked(rows: DataFrame) -> DataFrame:
    """Adds the ranking variable _q and the rest of the order, _u and _id; f is the inclusion probability."""
    share = uniform(F.col("name")) / F.lit(float(2**48))
    q = F.when(F.col("f") > 0, (share / (1 - share)) * ((1 - F.col("f")) / F.col("f")))
    return rows.withColumn("_u", uniform(F.col("name"))).withColumn("_q", q).withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))))


def decide(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """One row per source of (doc_id, source, size): its target, certain copies, inclusion probability f, and the last
    place (_cq, _cu, _cid) of the order that is sampled."""
    plan = targets(sizes, weights, budget, most)
    r = F.col("target") / F.nullif(F.col("source_size"), F.lit(0))
    plan = plan.withColumn("whole", F.coalesce(F.floor(r), F.lit(0))).withColumn("f", F.coalesce(r - F.floor(r), F.lit(0.0)))
    plan = plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = cut(plan.withColumn("_k", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))), "targets")
    rows = sizes.withColumn("_k", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))).drop("source").join(plan.where("f > 0").select("_k", "f", "rest"), "_k")
    rows = _ranked(rows).withColumn("_b", F.floor(F.col("_q") / (1 + F.col("_q")) * BUCKETS))
    # running sums over the buckets of a source; the target falls into one of them
    sums = rows.groupBy("_k", "_b").agg(F.sum("size").alias("_sum"), F.first("rest").alias("_rest"))
    w = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    edge = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(w), F.lit(0))).where("_before < _rest AND _before + _sum > _rest").select("_k", "_b", "_before")
    # and over the documents of that bucket; documents of one place in the order are taken together
    inside = rows.join(edge, ["_k", "_b"]).groupBy("_k", "_q", "_u", "_id").agg(F.sum("size").alias("size"), F.first("rest").alias("rest"), F.first("_before").alias("_before"))
    w = Window.partitionBy("_k").orderBy("_q", "_u", "_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_before") + F.coalesce(F.sum("size").over(w), F.lit(0))
    last = inside.withColumn("_in", 2 * before + F.col("size") <= 2 * F.col("rest")).groupBy("_k").agg(F.max(F.when(F.col("_in"), F.struct("_q", "_u", "_id"))).alias("_last"))
    # where no document of the bucket is taken, the order ends with the bucket before
    out = plan.join(edge.select("_k", (F.col("_b") / BUCKETS).alias("_v")), "_k", "left").join(last, "_k", "left")
    return out.select("_k", "source_size", "target", "whole", "f", "_v", F.col("_last._q").alias("_cq"), F.col("_last._u").alias("_cu"), F.col("_last._id").alias("_cid"))


def mix(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The columns of docs (doc_id, name and source among them) with source_size, target and copies.

    decisions is one row per source; documents are neither shuffled nor sorted where that table is small.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    rows = _ranked(docs.withColumn("_k", key).join(decisions, "_k"))
    bucket = F.floor(F.col("_q") / (1 + F.col("_q")) * BUCKETS)
    # no edge bucket: the whole order is within the target
    place, last = F.struct("_q", "_u", "_id"), F.struct("_cq", "_cu", "_cid")
    edge = F.col("_v") * BUCKETS
    # before the edge bucket everything is taken, in it what comes no later than the last place
    taken = F.col("_v").isNull() | (bucket < edge) | ((bucket == edge) & F.col("_cq").isNotNull() & (place <= last))
    extra = F.when((F.col("f") > 0) & taken, 1).otherwise(0)
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], "source_size", "target", (F.col("whole") + extra).cast("long").alias("copies"))


def sizes_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"), name_of(F.col("doc_id"), F.col("text")).alias("name"))


def repeat(docs: DataFrame) -> DataFrame:
    """The mix itself: every row of docs, all columns unchanged, as often as it is taken."""
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), name_of(F.col("doc_id"), F.col("text")).alias("name"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    mixed = mix(rows, cut(decide(cut(sizes_of(docs), "sizes")), "decisions"))
    return mixed.where("copies > 0").select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = cut(sizes_of(spark.read.parquet(f"{sf_dir}/documents.parquet")), "sizes")
    mixed = mix(sizes, cut(decide(sizes), "decisions"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'n' || md5(coalesce(text, '')))), 1, 12) AS BIGINT) AS u
  FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS s, list_extract([5, 2, 1], 1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)) AS w FROM d GROUP BY source),
a AS (
  SELECT *, CAST(sum(s) OVER () AS BIGINT) AS total,
    CAST(sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS BIGINT) AS w_left, CAST(coalesce(sum(2 * s) OVER o, 0) AS BIGINT) AS before
  FROM p WINDOW o AS (ORDER BY CAST(s AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, CAST(2 * s * w_left AS DOUBLE) <= w * (CAST(1.5 AS DOUBLE) * total - before) AS capped FROM a),
e AS (SELECT *, CAST(sum(CASE WHEN capped THEN 2 * s ELSE 0 END) OVER () AS BIGINT) AS c, CAST(sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS BIGINT) AS wu FROM c),
t AS (SELECT source, s, CASE WHEN capped THEN CAST(2 * s AS DOUBLE) ELSE w * (CAST(1.5 AS DOUBLE) * total - c) / nullif(wu, 0) END AS target FROM e),
r AS (SELECT *, coalesce(floor(target / nullif(s, 0)), 0) AS whole, coalesce(target / nullif(s, 0) - floor(target / nullif(s, 0)), 0) AS f FROM t),
q AS (
  SELECT d.doc_id, d.source, d.size, d.u, r.s, r.target, CAST(r.whole AS BIGINT) AS whole, r.f, r.target - r.whole * r.s AS rest,
    CASE WHEN r.f > 0 THEN (d.u / 281474976710656.0::DOUBLE / (1 - d.u / 281474976710656.0::DOUBLE)) * ((1 - r.f) / r.f) END AS q
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
k AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY q, u, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q)
SELECT doc_id, size, s AS source_size, target,
  CAST(size * (whole + CASE WHEN f > 0 AND 2 * before + size <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM k
"""
