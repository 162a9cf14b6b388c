"""Queries over chunk residency, catalogues, telemetry, urls, tiles and components."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelarium.functions.voxel import cache_key, http_outcome, url_host, volume_key
from voxelarium.model import View
from voxelarium.operators import catalog, graph, paint, residency, telemetry
from voxelarium.sources.derived import CE, EV, VE, VL, chunk_state, embedding_volume, label_volume, table
from voxelarium.sources.derived import telemetry as events

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return add


# ---- native chunks and coverage: chunk addresses from part ----
NATIVE, SHAPE = (100, 48, 130), (900, 700, 600)


def _chunks(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select((k % 15).cast("int").alias("cx"), ((k / 15).cast("int") % 11).alias("cy"), ((k / 165).cast("int") % 10).alias("cz")).distinct()


_C = "c AS (SELECT DISTINCT CAST(p_partkey % 15 AS INT) cx, CAST(p_partkey // 15 % 11 AS INT) cy, CAST(p_partkey // 165 % 10 AS INT) cz FROM part)"
_N = "nx AS (SELECT CAST(i AS INT) nx, i * 100 lo, least((i + 1) * 100, 900) hi FROM range(9) t(i)), ny AS (SELECT CAST(i AS INT) ny, i * 48 lo, least((i + 1) * 48, 700) hi FROM range(15) t(i)), nz AS (SELECT CAST(i AS INT) nz, i * 130 lo, least((i + 1) * 130, 600) hi FROM range(5) t(i))"


@query(f"""WITH {_C}, {_N} SELECT cx, cy, cz, nx, ny, nz FROM c JOIN nx ON nx.lo < least((cx + 1) * 64, 900) AND nx.hi > cx * 64
  JOIN ny ON ny.lo < least((cy + 1) * 64, 700) AND ny.hi > cy * 64 JOIN nz ON nz.lo < least((cz + 1) * 64, 600) AND nz.hi > cz * 64 WHERE cx * 64 < 900 AND cy * 64 < 700 AND cz * 64 < 600""")
def native_chunk_overlap(spark, sf):
    return residency.native_overlap(_chunks(spark, sf), NATIVE, SHAPE)


def _boxes(spark, sf):
    k = F.col("s_suppkey").cast("int")
    x, y, z = k % 6, k % 10, k % 3
    return table(spark, sf, "supplier").select("s_suppkey", x.alias("lo_x"), (x + k % 4).alias("hi_x"), y.alias("lo_y"), (y + k % 6).alias("hi_y"), z.alias("lo_z"), (z + k % 2 + 1).alias("hi_z"))


@query("""WITH b AS (SELECT s_suppkey, CAST(s_suppkey AS INT) k FROM supplier), r AS (SELECT s_suppkey, (k % 6) * 100 x0, least((k % 6 + k % 4 + 1) * 100, 900) x1, (k % 10) * 48 y0, least((k % 10 + k % 6 + 1) * 48, 700) y1, (k % 3) * 130 z0, least((k % 3 + k % 2 + 2) * 130, 600) z1 FROM b),
g AS (SELECT CAST(a AS INT) cx, CAST(b AS INT) cy, CAST(c AS INT) cz FROM range(15) t(a), range(11) u(b), range(10) w(c))
SELECT s_suppkey, cx, cy, cz FROM r JOIN g ON cx * 64 >= x0 AND least((cx + 1) * 64, 900) <= x1 AND cy * 64 >= y0 AND least((cy + 1) * 64, 700) <= y1 AND cz * 64 >= z0 AND least((cz + 1) * 64, 600) <= z1""")
def covered_chunks(spark, sf):
    return residency.covered(_boxes(spark, sf), NATIVE, SHAPE).select("s_suppkey", "cx", "cy", "cz")


@query("""SELECT CAST(p_partkey % 40 AS INT) >> 2 AS shard, CAST((p_partkey % 40) & 3 AS INT) AS place, count(*) AS n, CAST(sum(s_suppkey * 100) AS BIGINT) AS bytes FROM part JOIN supplier ON s_suppkey % 40 = p_partkey % 40 WHERE s_suppkey % 7 <> 0 GROUP BY ALL""")
def shard_locate(spark, sf):
    key = lambda c: [F.shiftright((F.col(c) % 40).cast("int"), 2).alias("shard"), (F.col(c) % 4).cast("int").alias("place")]
    absent = F.col("s_suppkey") % 7 == 0
    index = table(spark, sf, "supplier").select(*key("s_suppkey"), F.when(absent, -1).otherwise(F.col("s_suppkey")).alias("off"), F.when(absent, -1).otherwise(F.col("s_suppkey") * 100).alias("len"))
    hit = residency.shard_lookup(table(spark, sf, "part").select(*key("p_partkey")), index)
    return hit.groupBy("shard", "place").agg(F.count("*").alias("n"), F.sum("len").alias("bytes"))


# ---- eviction ----
CURRENT, TARGET, LIMIT = 40, 1000, 205


@query(f"WITH {CE} SELECT access_epoch, count(*) AS n FROM ce WHERE state = 1 GROUP BY access_epoch")
def epoch_histogram(spark, sf):
    return residency.histogram(chunk_state(spark, sf))


CAPACITY, FREE, FLOOR = 6000, 100, 900


@query(f"""WITH {CE}, t AS (SELECT count(*) AS resident FROM ce WHERE state = 1)
SELECT resident, CASE WHEN resident > {CAPACITY} * 95 // 100 THEN resident - {CAPACITY} * 80 // 100 ELSE 0 END AS by_capacity, greatest(CASE WHEN resident > {CAPACITY} * 95 // 100 THEN resident - {CAPACITY} * 80 // 100 ELSE 0 END, {FLOOR - FREE}) AS target FROM t""")
def purge_target(spark, sf):
    state = chunk_state(spark, sf)
    plenty = residency.purge_target(state, CAPACITY, 1).withColumnRenamed("target", "by_capacity")
    return plenty.join(residency.purge_target(state, CAPACITY, 1, FREE, FLOOR), "resident")


@query(f"""WITH {CE}, h AS (SELECT (({CURRENT} - access_epoch) % 256 + 256) % 256 AS age, count(*) AS n FROM ce WHERE state = 1 GROUP BY 1),
r AS (SELECT age, sum(n) OVER (ORDER BY age DESC) AS freed FROM h WHERE age >= 1) SELECT CAST(max(age) AS INT) AS age_threshold, CAST(min(freed) AS BIGINT) AS freed FROM r WHERE freed >= {TARGET} HAVING max(age) IS NOT NULL""")
def purge_threshold(spark, sf):
    return residency.threshold(chunk_state(spark, sf), CURRENT, TARGET)


@query(f"""WITH {CE}, a AS (SELECT volume_id, (({CURRENT} - access_epoch) % 256 + 256) % 256 AS age FROM ce WHERE state = 1)
SELECT volume_id, count(*) AS resident, count(*) FILTER (age >= {LIMIT}) AS victims, CAST(max(age) AS INT) AS oldest_age, (count(*) FILTER (age >= {LIMIT})) * 100.0::DOUBLE / count(*) AS percent FROM a GROUP BY volume_id""")
def purge_breakdown(spark, sf):
    return residency.purge_report(chunk_state(spark, sf), CURRENT, LIMIT)


@query("""WITH o AS (SELECT o_orderkey AS id, epoch_ms(o_orderdate) AS mtime, CAST(floor(o_totalprice) AS BIGINT) AS bytes FROM orders), r AS (SELECT *, coalesce(sum(bytes) OVER (ORDER BY mtime, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum, sum(bytes) OVER () AS al FROM o)
SELECT id, mtime, bytes FROM r WHERE cum < al - 1000000000""")
def lru_evict_bytes(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("mtime"), F.floor("o_totalprice").alias("bytes"))
    return residency.evict_oldest(o, 1_000_000_000)


@query("""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS bytes FROM orders GROUP BY 1)
SELECT day, bytes, CAST((1 + (sum(bytes) OVER (ORDER BY day)) // 7000000) % 256 AS INT) AS epoch FROM d""")
def epoch_advance(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("day"), F.floor("o_totalprice").alias("bytes"))
    return residency.epochs(o, 7_000_000)


@query(f"WITH {CE} SELECT DISTINCT w.volume_id, w.idx FROM (SELECT CAST(l_suppkey % 16 AS INT) AS volume_id, l_orderkey AS idx FROM lineitem) w ANTI JOIN (SELECT * FROM ce WHERE state <> 0) f ON w.volume_id = f.volume_id AND w.idx = f.idx")
def covered_minus_filled(spark, sf):
    wanted = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 16).cast("int").alias("volume_id"), F.col("l_orderkey").alias("idx"))
    return residency.missing(wanted, chunk_state(spark, sf).where("state <> 0"), ["volume_id", "idx"])


@query(f"WITH {CE} SELECT volume_id, count(*) AS resident FROM ce WHERE state = 1 AND volume_id NOT IN (SELECT s_suppkey % 5 FROM supplier) GROUP BY volume_id")
def live_antijoin(spark, sf):
    live = table(spark, sf, "supplier").select((F.col("s_suppkey") % 5).cast("int").alias("volume_id"))
    return residency.offline(chunk_state(spark, sf).where("state = 1"), live).groupBy("volume_id").agg(F.count("*").alias("resident"))


@query("""WITH r AS (SELECT event_id % 701 AS chunk, max(event_id) AS seq, max(epoch_ms(ts)) AS t, bool_or(event_id % 97 = 0) AS durable FROM events GROUP BY 1)
SELECT chunk, seq FROM r WHERE durable OR (SELECT max(epoch_ms(ts)) FROM events) - t <= 86400000""")
def queue_pop_order(spark, sf):
    e = table(spark, sf, "events")
    r = e.select((F.col("event_id") % 701).alias("chunk"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), (F.col("event_id") % 97 == 0).alias("durable"))
    now = r.agg(F.max("t")).first()[0]
    return residency.pop_order(r, now, 86_400_000).select("chunk", "seq")


@query("""SELECT o_custkey % 50 AS source_key, min(o_orderkey) AS first, count(DISTINCT o_orderkey) AS waiters FROM orders GROUP BY 1""")
def source_fetch_plan(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("chunk"), (F.col("o_custkey") % 50).alias("source_key"), F.lit("download").alias("kind"), F.col("o_orderpriority").alias("url"), F.col("o_orderkey").alias("off"), F.lit(1).alias("len"))
    return residency.fetch_plan(o).select("source_key", F.col("off").alias("first"), "waiters")


# ---- catalogue ----
def _segments(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("segment_id"), F.col("c_nationkey").alias("scroll_id"), (F.col("c_nationkey") % 2 == 1).alias("is_fragment"), F.col("c_nationkey").alias("num"), (F.col("c_custkey") % 100 + 1).alias("original_volume_id"), F.col("c_custkey").alias("seq"))


@query("""SELECT c_nationkey AS scroll_id, c_nationkey % 2 = 1 AS is_fragment, count(*) AS n, min(c_custkey) AS first, max(c_custkey) AS last FROM customer GROUP BY c_nationkey""")
def catalog_by_scroll(spark, sf):
    g = catalog.by_scroll(_segments(spark, sf))
    return g.select("scroll_id", "is_fragment", "n", F.element_at("segments", 1).alias("first"), F.element_at("segments", -1).alias("last"))


@query("SELECT c_custkey AS segment_id FROM customer WHERE c_custkey % 100 + 1 = 17")
def segments_for_volume(spark, sf):
    return _segments(spark, sf).where("original_volume_id = 17").select("segment_id")


@query("""WITH s AS (SELECT c_custkey AS segment_id, c_custkey % 100 + 1 AS ov FROM customer), v AS (SELECT s_suppkey AS volume_id FROM supplier),
c AS (SELECT DISTINCT o_custkey AS segment_id, o_orderkey % 150 AS volume_id FROM orders), t AS (SELECT DISTINCT l_suppkey AS source, l_partkey % 120 AS target FROM lineitem WHERE l_linenumber = 1 AND l_quantity > 45),
a AS (SELECT segment_id, volume_id FROM s JOIN v ON volume_id = ov UNION SELECT c.segment_id, c.volume_id FROM c JOIN v USING (volume_id) JOIN s USING (segment_id) UNION SELECT s.segment_id, t.target FROM s JOIN t ON t.source = s.ov JOIN v ON v.volume_id = t.target)
SELECT a.segment_id, a.volume_id, a.volume_id = s.ov AS original FROM a JOIN s USING (segment_id)""")
def renderable_volumes(spark, sf):
    volumes = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("volume_id"))
    coverage = table(spark, sf, "orders").select(F.col("o_custkey").alias("segment_id"), (F.col("o_orderkey") % 150).alias("volume_id")).distinct()
    transforms = table(spark, sf, "lineitem").where("l_linenumber = 1 AND l_quantity > 45").select(F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 120).alias("target")).distinct()
    return catalog.renderable(_segments(spark, sf), volumes, coverage, transforms)


@query("""SELECT s_suppkey AS volume_id, CAST(row_number() OVER (ORDER BY s_nationkey % 3 NULLS LAST, CASE WHEN s_nationkey % 4 = 0 THEN NULL ELSE s_nationkey % 4 END NULLS LAST, floor(s_acctbal / 1000) NULLS LAST, s_suppkey) AS INT) AS place FROM supplier""")
def volume_order(spark, sf):
    from pyspark.sql import Window

    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("volume_id"), (F.col("s_nationkey") % 3).alias("pixel_size"), F.when(F.col("s_nationkey") % 4 != 0, F.col("s_nationkey") % 4).alias("energy"), F.floor(F.col("s_acctbal") / 1000).alias("distance"), F.col("s_suppkey").alias("seq"))
    w = Window.orderBy(F.col("pixel_size").asc_nulls_last(), F.col("energy").asc_nulls_last(), F.col("distance").asc_nulls_last(), "seq")  # a catalogue's few volumes
    return catalog.volume_order(s).select("volume_id", F.row_number().over(w).alias("place"))


RULES = [(1, "standard", "https://m.", "s3://mirror/m."), (2, None, "https://", "s3://all/"), (3, "standard", "http://", "file:///data/"), (4, None, "http://www.", "never://")]


@query("""WITH u AS (SELECT DISTINCT CASE WHEN page_id % 2 = 0 THEN 'standard' ELSE 'other' END AS usage, url FROM pages)
SELECT usage, url, CASE WHEN usage = 'standard' AND starts_with(url, 'https://m.') THEN 's3://mirror/m.' || substr(url, 11) WHEN starts_with(url, 'https://') THEN 's3://all/' || substr(url, 9)
  WHEN usage = 'standard' AND starts_with(url, 'http://') THEN 'file:///data/' || substr(url, 8) WHEN starts_with(url, 'http://www.') THEN 'never://' || substr(url, 12) ELSE url END AS rewritten FROM u""")
def url_rewrite_first_rule(spark, sf):
    urls = table(spark, sf, "pages").select(F.when(F.col("page_id") % 2 == 0, "standard").otherwise("other").alias("usage"), "url").distinct()
    rules = spark.createDataFrame(RULES, "seq int, usage string, prefix string, replacement string")
    return catalog.rewrite(urls, rules)


@query("""SELECT page_id, sha256(regexp_replace(url, '/$', '')) AS cache_key, substr(sha256(regexp_replace(url, '/$', '')), 1, 16) || '__v' || page_id AS volume_key, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/]*)', 1) AS host FROM pages""")
def url_cache_key(spark, sf):
    return table(spark, sf, "pages").select("page_id", cache_key(F.col("url")).alias("cache_key"), volume_key(F.col("url"), F.concat(F.lit("v"), F.col("page_id").cast("string"))).alias("volume_key"), url_host(F.col("url")).alias("host"))


# ---- telemetry ----
def _rank(v: str, p: int, cond: str = "true") -> str:
    return f"list_sort(list({v}) FILTER ({cond}))[least(len(list({v}) FILTER ({cond})) - 1, len(list({v}) FILTER ({cond})) * {p} // 100) + 1]"


@query(f"""WITH {EV} SELECT host, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, {', '.join(f"{_rank(v, p, c)} AS {v}_p{p}" for v, c in (("wait_ms", "true"), ("ttfb_ms", "ttfb_ms <> 0"), ("body_ms", "true")) for p in (50, 90, 99))}, max(wait_ms) AS wait_ms_max, max(body_ms) AS body_ms_max
FROM ev WHERE ok AND status IN (200, 206) GROUP BY host""")
def netlog_host_percentiles(spark, sf):
    h = telemetry.hosts(events(spark, sf))
    return h.select("host", "n", "bytes", *[f"{v}_p{p}" for v in ("wait_ms", "ttfb_ms", "body_ms") for p in (50, 90, 99)], "wait_ms_max", "body_ms_max")


@query(f"""WITH {EV} SELECT host, status, CASE WHEN status IN (200, 206) THEN 'data' WHEN status IN (403, 404) THEN 'absent' ELSE 'transient' END AS outcome, count(*) AS n, count(*) FILTER (ok) AS n_ok FROM ev GROUP BY ALL""")
def netlog_status_counts(spark, sf):
    return telemetry.statuses(events(spark, sf)).withColumn("outcome", http_outcome(F.col("status")))


@query(f"WITH {EV} SELECT event_id, host, wait_ms + ttfb_ms + body_ms AS total_ms FROM ev ORDER BY total_ms DESC, event_id LIMIT 10")
def netlog_slowest10(spark, sf):
    return telemetry.slowest(events(spark, sf)).select("event_id", "host", "total_ms")


@query(f"""WITH {EV}, d AS (SELECT *, greatest(body_ms, 1) AS ms FROM ev WHERE bytes <> 0), b AS (SELECT *, t - ms AS a, unnest(range((t - ms) // 1000, (t - 1) // 1000 + 1)) AS sec FROM d)
SELECT sec, round(sum(bytes * (least(t, (sec + 1) * 1000) - greatest(a, sec * 1000)) / ms), 6) AS bytes, count(*) AS n FROM b GROUP BY sec""")
def netlog_utilisation(spark, sf):
    return telemetry.utilisation(events(spark, sf)).select("sec", F.round("bytes", 6).alias("bytes"), "n")


@query(f"WITH {EV} SELECT count(*) AS n, round(avg(wait_ms), 6) AS mean_wait, round(avg(body_ms), 6) AS mean_body, round(sum(body_ms) / sum(ttfb_ms + body_ms), 9) AS read_fraction, round(sum(ttfb_ms + body_ms) / (max(t) - min(t)), 9) AS concurrency FROM ev")
def io_metrics(spark, sf):
    m = telemetry.io_metrics(events(spark, sf))
    return m.select("n", *[F.round(c, 6).alias(c) for c in ("mean_wait", "mean_body")], *[F.round(c, 9).alias(c) for c in ("read_fraction", "concurrency")])


# ---- tiles ----
@query("""SELECT CAST(a AS INT) AS tu, CAST(b AS INT) AS tv FROM range(-1, 7) t(a), range(2, 8) u(b)""")
def viewport_tiles(spark, sf):
    return paint.tiles(spark, View((1500, 2500, 0), (0, 1, 2), 1200, 900, 2))


@query("""WITH w AS (SELECT DISTINCT 2 AS level, CAST(p_partkey % 64 AS INT) tu, CAST(p_partkey // 64 AS INT) tv FROM part), h AS (SELECT DISTINCT CAST(s_suppkey % 6 AS INT) AS level, CAST(s_suppkey * 7 % 64 AS INT) tu, CAST(s_suppkey * 3 % 32 AS INT) tv FROM supplier),
p AS (SELECT w.level, w.tu, w.tv, min(h.level) AS parent FROM w JOIN h ON h.level BETWEEN w.level AND w.level + 3 AND h.tu = w.tu >> (h.level - w.level) AND h.tv = w.tv >> (h.level - w.level) GROUP BY ALL),
c AS (SELECT w.level, w.tu, w.tv, min(h.level) AS child FROM w JOIN h ON h.level BETWEEN w.level - 3 AND w.level - 1 AND h.tu >> (w.level - h.level) = w.tu AND h.tv >> (w.level - h.level) = w.tv GROUP BY ALL)
SELECT w.level, w.tu, w.tv, coalesce(parent, child) AS source_level FROM w LEFT JOIN p USING (level, tu, tv) LEFT JOIN c USING (level, tu, tv)""")
def cross_mip_fallback(spark, sf):
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    wanted = table(spark, sf, "part").select(F.lit(2).alias("level"), (k % 64).cast("int").alias("tu"), (k / 64).cast("int").alias("tv")).distinct()
    have = table(spark, sf, "supplier").select((s % 6).cast("int").alias("level"), (s * 7 % 64).cast("int").alias("tu"), (s * 3 % 32).cast("int").alias("tv")).distinct()
    return paint.coarser_tile(wanted, have)


# ---- components ----
@query(f"""WITH RECURSIVE {VL}, b AS (SELECT (CAST(z AS BIGINT) * 1048576 + y) * 1048576 + x AS id, v // 50 AS v, x, y, z FROM vl),
e AS (SELECT a.id AS a, c.id AS b FROM b a JOIN b c ON a.v = c.v AND ((c.x = a.x + 1 AND c.y = a.y AND c.z = a.z) OR (c.x = a.x - 1 AND c.y = a.y AND c.z = a.z) OR (c.x = a.x AND c.y = a.y + 1 AND c.z = a.z) OR (c.x = a.x AND c.y = a.y - 1 AND c.z = a.z) OR (c.x = a.x AND c.y = a.y AND c.z = a.z + 1) OR (c.x = a.x AND c.y = a.y AND c.z = a.z - 1))),
cc(id, m) USING KEY (id) AS (SELECT id, id FROM b UNION SELECT e.b, min(cc.m) FROM cc JOIN e ON e.a = cc.id JOIN recurring.cc r ON r.id = e.b WHERE cc.m < r.m GROUP BY e.b)
SELECT m AS component, count(*) AS n FROM cc GROUP BY m""")
def components_6n(spark, sf):
    v = label_volume(spark, sf).withColumn("v", F.floor(F.col("v") / 50).cast("int"))
    return graph.sizes(graph.components(v)).select("component", "n")


@query(f"WITH {VL} SELECT v, count(*) AS n FROM vl GROUP BY v")
def label_counts(spark, sf):
    return label_volume(spark, sf).groupBy("v").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS idx, CAST(arg_max(l_partkey % 256, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey) AS INT) AS access_epoch, CAST(arg_max(l_suppkey % 3, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey) AS INT) AS state FROM lineitem GROUP BY l_orderkey")
def latest_access_epoch(spark, sf):
    a = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("idx"), (F.col("l_partkey") % 256).cast("int").alias("access_epoch"), (F.col("l_suppkey") % 3).cast("int").alias("state"), (F.col("l_linenumber") * 10_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).alias("seq"))
    return residency.latest(a, ["idx"])


@query(f"WITH {VE} SELECT x, y, z, v FROM ve")
def native_assembly(spark, sf):
    """Cache chunks of 16 voxels assembled from native chunks of 5 x 3 x 7 and read back as voxels."""
    import numpy as np
    import pyarrow as pa

    from voxelarium.operators import sample

    planes = embedding_volume(spark, sf).agg(F.max("z")).first()[0] + 1
    sides, shape = (5, 3, 7), (8, 8, planes)
    v = embedding_volume(spark, sf).select(*[F.floor(F.col(a) / s).cast("int").alias(f"n{a}") for a, s in zip("xyz", sides, strict=True)], (((F.col("z") % 7) * 3 + F.col("y") % 3) * 5 + F.col("x") % 5).alias("at"), "v")

    def dense(t: pa.Table) -> pa.Table:
        block = np.zeros(105, np.uint8)
        block[np.asarray(t.column("at"))] = np.asarray(t.column("v"))
        return pa.table({**{c: pa.array([t.column(c)[0].as_py()], pa.int32()) for c in ("nx", "ny", "nz")}, "bytes": pa.array([block.tobytes()], pa.binary())})

    native = v.groupBy("nx", "ny", "nz").applyInArrow(dense, "nx int, ny int, nz int, bytes binary")
    wanted = spark.range(-(-planes // 16)).select(F.lit(0).alias("cx"), F.lit(0).alias("cy"), F.col("id").cast("int").alias("cz"))
    return sample.to_voxels(residency.assemble(wanted, native, sides, shape, 16), 4).where((F.col("x") < 8) & (F.col("y") < 8) & (F.col("z") < planes))
