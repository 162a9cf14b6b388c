"""Summaries of download telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelarium.functions.voxel import idiv


def nearest_rank(values: Column, p: int) -> Column:
    """sorted[min(n - 1, n * p // 100)] of an array; 0 for none."""
    n = F.size(values)
    return F.coalesce(F.try_element_at(F.array_sort(values), F.least(n - 1, idiv(n * p, 100)).cast("int") + 1), F.lit(0))


def counted(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Values of each group with their cumulative numbers: the exact percentile input, bounded by distinct values."""
    from pyspark.sql import Window

    c = df.groupBy(*key, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*key).orderBy(value)
    return c.withColumn("_to", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(Window.partitionBy(*key)))


def percentiles(df: DataFrame, key: list[str], value: str, ps=(50, 90, 99)) -> DataFrame:
    """Nearest-rank percentiles and maximum per group, from value counts: no group is gathered in one row."""
    c = counted(df, key, value)
    rank = lambda p: F.least(F.col("_all") - 1, idiv(F.col("_all") * p, 100))
    return c.groupBy(*key).agg(*[F.min(F.when(F.col("_to") > rank(p), F.col(value))).alias(f"{value}_p{p}") for p in ps], F.max(value).alias(f"{value}_max"))


def hosts(ev: DataFrame) -> DataFrame:
    """Successful downloads per host: number, bytes, rate over the span, percentiles of each phase."""
    ok = ev.where(F.col("ok") & F.col("status").isin(200, 206))
    span = F.greatest((F.max("t") - F.min("t")) / 1000.0, F.lit(0.0))
    out = ok.groupBy("host").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.when(span == 0, 1.0).otherwise(span).alias("span_s"))
    out = out.withColumn("rate", F.col("bytes") / F.col("span_s"))
    for value in ("wait_ms", "ttfb_ms", "body_ms"):
        rows = ok.where("ttfb_ms <> 0") if value == "ttfb_ms" else ok
        out = out.join(percentiles(rows, ["host"], value), "host", "left")
    return out


def statuses(ev: DataFrame) -> DataFrame:
    return ev.groupBy("host", "status").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"))


def breakdown(records: DataFrame, by: dict[str, Column]) -> DataFrame:
    """(dimension, value, n, n_ok) of each named column, null values aside: one pass over the records, with a row a
    dimension that is summed before the shuffle.  Reasons are cut at their first colon, to 60 characters."""
    cut = lambda name, c: F.substring(F.substring_index(c, ":", 1), 1, 60) if name == "reason" else c
    rows = F.array(*[F.struct(F.lit(k).alias("dimension"), cut(k, c.cast("string")).alias("value")) for k, c in by.items()])
    each = records.select("ok", F.explode(rows).alias("r")).select("ok", "r.*").where("value IS NOT NULL")
    return each.groupBy("dimension", "value").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"))


def slowest(ev: DataFrame, n: int = 10) -> DataFrame:
    total = F.col("wait_ms") + F.col("ttfb_ms") + F.col("body_ms")
    return ev.withColumn("total_ms", total).orderBy(F.desc("total_ms"), "event_id").limit(n)


def utilisation(ev: DataFrame) -> DataFrame:
    """(sec, bytes, n): bytes of each second, each download spread evenly over its body's time."""
    d = ev.where("bytes <> 0").withColumn("_ms", F.greatest("body_ms", F.lit(1)))
    start = F.col("t") - F.col("_ms")
    d = d.withColumn("_a", start).withColumn("sec", F.explode(F.sequence(F.floor(start / 1000).cast("long"), F.floor((F.col("t") - 1) / 1000).cast("long"))))
    part = F.least(F.col("t"), (F.col("sec") + 1) * 1000) - F.greatest(F.col("_a"), F.col("sec") * 1000)
    return d.groupBy("sec").agg(F.sum(F.col("bytes") * part / F.col("_ms")).alias("bytes"), F.count("*").alias("n"))


def io_metrics(ev: DataFrame) -> DataFrame:
    """One row: requests, mean wait, mean body, share of time reading, mean concurrency."""
    busy, wall = F.sum(F.col("ttfb_ms") + F.col("body_ms")), F.max("t") - F.min("t")
    return ev.agg(F.count("*").alias("n"), F.avg("wait_ms").alias("mean_wait"), F.avg("body_ms").alias("mean_body"), F.try_divide(F.sum("body_ms"), busy).alias("read_fraction"), F.try_divide(busy, wall).alias("concurrency"))
