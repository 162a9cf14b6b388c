"""Catalogue lookups, loading plans, purges and telemetry counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelarium.functions.voxel import url_host
from voxelarium.operators import catalog, residency, telemetry
from voxelarium.plans.operations import CURRENT, _segments
from voxelarium.sources.derived import CE, EV, chunk_state, table
from voxelarium.sources.derived import telemetry as events

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return add


# ---- catalogue ----
@query("""WITH s AS (SELECT c_custkey AS segment_id, c_custkey % 100 + 1 AS ov FROM customer), v AS (SELECT s_suppkey AS volume_id, s_nationkey AS scan_id FROM supplier)
SELECT segment_id, volume_id, n_nationkey AS scan_id, n_name AS scan FROM s LEFT JOIN v ON v.volume_id = s.ov LEFT JOIN nation n ON n.n_nationkey = v.scan_id AND n.n_nationkey % 2 = 0 ORDER BY segment_id""")
def catalog_lookup(spark, sf):
    """Segments, by id, with their volume and its scan."""
    v = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("volume_id"), F.col("s_nationkey").alias("scan_id"))
    scans = table(spark, sf, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("scan_id"), F.col("n_name").alias("scan"))
    found = catalog.lookup(_segments(spark, sf).select("segment_id", "original_volume_id"), v, scans)
    return found.select("segment_id", "volume_id", F.when(F.col("scan").isNotNull(), F.col("scan_id")).alias("scan_id"), "scan").orderBy("segment_id")


_EDGES = """e AS (SELECT source, target, arg_min(k, seq) AS k FROM (SELECT l_suppkey AS source, l_partkey % 100 + 1 AS target, l_orderkey * 10 + l_linenumber AS seq, l_orderkey % 7 + 1 AS k FROM lineitem WHERE l_quantity > 40) WHERE source <> target GROUP BY source, target)"""


def _edges(spark, sf):
    """Direct transforms between volumes: a scaling by k with a shift by k, 2 k and 3 k, and a shear."""
    l = table(spark, sf, "lineitem").where("l_quantity > 40")
    k = (F.col("l_orderkey") % 7 + 1).cast("double")
    m = F.array(*[F.lit(float(x)) * k if isinstance(x, int) else F.lit(x) for x in (1, 0.0, 0.5, 1, 0.0, 1, 0.0, 2, 0.0, 0.0, 1, 3)])
    return l.select(F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 100 + 1).alias("target"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), m.alias("matrix"))


@query(f"""WITH {_EDGES}, s AS (SELECT c_custkey AS segment_id, c_custkey % 100 + 1 AS ov, CASE WHEN c_custkey % 3 = 0 THEN 4.0::DOUBLE END AS d, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 100 + 1 ELSE c_custkey % 90 + 1 END AS cv FROM customer),
w AS (SELECT o_custkey AS segment_id, max(CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 100 + 1 END) AS volume_id FROM orders GROUP BY o_custkey),
j AS (SELECT s.*, coalesce(w.volume_id, s.ov) AS volume_id FROM w JOIN s USING (segment_id)),
m AS (SELECT j.segment_id, j.volume_id, j.d, CAST(r.k AS DOUBLE) AS k, CAST(c.k AS DOUBLE) AS c FROM j LEFT JOIN e r ON r.source = j.ov AND r.target = j.volume_id LEFT JOIN e c ON c.source = j.cv AND c.target = j.volume_id)
SELECT segment_id, volume_id, CASE WHEN k IS NULL AND d IS NULL THEN NULL ELSE array_to_string(list_transform(CASE WHEN k IS NULL THEN [d, 0, 0, 0, 0, d, 0, 0, 0, 0, d, 0] ELSE [k * coalesce(d, 1), 0, 0.5 * coalesce(d, 1), k, 0, k * coalesce(d, 1), 0, 2 * k, 0, 0, k * coalesce(d, 1), 3 * k] END, lambda x: CAST(CAST(round(x * 10) AS BIGINT) AS VARCHAR)), ',') END AS matrix,
  round(CASE WHEN c IS NULL THEN 1.0 ELSE (c + c + sqrt(0.25 + c * c)) / 3 END, 9) AS uv_scale FROM m""")
def segment_load(spark, sf):
    """For each segment wanted in a volume: the composed transform (in tenths) and the scale of its surface."""
    k = F.col("c_custkey")
    s = table(spark, sf, "customer").select(k.alias("segment_id"), (k % 100 + 1).alias("original_volume_id"), F.when(k % 3 == 0, 4.0).alias("downscale"), F.when(k % 2 == 0, k % 100 + 1).otherwise(k % 90 + 1).alias("current_volume_id"))
    o = F.col("o_orderkey")
    wanted = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("segment_id")).agg(F.max(F.when(o % 4 != 0, o % 100 + 1)).alias("volume_id"))
    p = catalog.load_plan(wanted, s, _edges(spark, sf))
    tenths = F.array_join(F.transform("matrix", lambda x: F.round(x * 10).cast("long").cast("string")), ",")
    return p.select("segment_id", "volume_id", tenths.alias("matrix"), F.round("uv_scale", 9).alias("uv_scale"))


@query("SELECT source, target, CAST(k AS DOUBLE) AS k FROM (WITH " + _EDGES + " SELECT * FROM e)")
def direct_transforms(spark, sf):
    return catalog.first_edges(_edges(spark, sf)).select("source", "target", F.col("matrix")[0].alias("k"))


@query("SELECT l_orderkey AS segment_id FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_linenumber) >= 4")
def complete_segments(spark, sf):
    files = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("segment_id"), F.col("l_linenumber").alias("name"))
    return catalog.all_present(files, 4)


_TYPES = ("obj", "tifxyz", "obj-normalized", "tifxyz-normalized")


def _entries(spark, sf):
    """Data entries of an owner, one of each of four types, with two origins of two roots each."""
    p, k = table(spark, sf, "pages"), F.col("page_id")
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (k % 4 + 1).cast("int"))
    root = lambda i, j: F.struct(F.when((k + i + 2 * j) % 3 == 0, "standard").otherwise("private").alias("usage"), F.concat(F.lit(f"http://r{i}{j}.org/" + "/" * j), (k % 10).cast("string")).alias("url"))
    origin = lambda i: F.struct(F.concat(F.lit("/" * i + "p"), k.cast("string")).alias("path"), F.array(root(i, 0), root(i, 1)).alias("roots"))
    return p.select(F.floor(k / 4).alias("owner"), kind.alias("type"), F.array(origin(0), origin(1)).alias("origins"))


_ROOTS = """r AS (SELECT page_id // 4 AS owner, ['obj', 'tifxyz', 'obj-normalized', 'tifxyz-normalized'][CAST(page_id % 4 + 1 AS INT)] AS type, CASE WHEN (page_id + i + 2 * j) % 3 = 0 THEN 'standard' ELSE 'private' END AS usage,
  i * 2 + j AS place, 'http://r' || i || j || '.org/' || repeat('/', CAST(j AS INT)) || (page_id % 10) || '/p' || page_id AS url FROM pages, range(2) a(i), range(2) b(j))"""


@query(f"WITH {_ROOTS} SELECT owner, type, url FROM r WHERE usage = 'private'")
def catalog_urls(spark, sf):
    return catalog.urls(_entries(spark, sf), "private").select(F.col("owner").cast("long").alias("owner"), "type", "url")


@query(f"WITH {_ROOTS} SELECT owner, arg_min(url, place) AS url FROM r WHERE usage = 'standard' AND type = 'tifxyz' GROUP BY owner")
def catalog_first_url(spark, sf):
    return catalog.first_url(_entries(spark, sf), "tifxyz").select(F.col("owner").cast("long").alias("owner"), "url")


@query(f"""WITH {_ROOTS}, f AS (SELECT owner, type, arg_min(url, place) AS url FROM r WHERE usage = 'standard' GROUP BY owner, type),
g AS (SELECT owner, {', '.join(f"max(CASE WHEN type = '{t}' THEN url END) AS u{i}" for i, t in enumerate(_TYPES))} FROM f GROUP BY owner)
SELECT o.owner, coalesce(u3, u1) AS grid_url, coalesce(u0, u2) AS mesh_url, coalesce(u3, u1, u0, u2) IS NOT NULL AS downloadable FROM (SELECT DISTINCT owner FROM r) o LEFT JOIN g USING (owner)""")
def catalog_geometry(spark, sf):
    return catalog.geometry(_entries(spark, sf)).withColumn("owner", F.col("owner").cast("long"))


@query("""SELECT s_suppkey AS id, (CASE WHEN s_suppkey % 2 = 0 THEN 'Fragment' ELSE 'Scroll' END) || ' ' || s_nationkey || ' - ' || s_name AS scroll,
CASE WHEN s_suppkey % 5 = 0 THEN s_name ELSE printf('%.2f', s_suppkey * 0.37) || 'µm, ' || s_nationkey || 'keV, ' || printf('%.2f', s_suppkey / 4.0) || 'm' END AS volume FROM supplier""")
def catalog_labels(spark, sf):
    k = F.col("s_suppkey")
    label = catalog.volume_label(F.col("s_name"), k * 0.37, F.when(k % 5 != 0, F.col("s_nationkey")), k * 250.0)
    return table(spark, sf, "supplier").select(k.alias("id"), catalog.scroll_label(k % 2 == 0, F.col("s_nationkey"), F.col("s_name")).alias("scroll"), label.alias("volume"))


@query("""WITH u AS (SELECT DISTINCT CASE page_id % 3 WHEN 0 THEN 'standard' WHEN 1 THEN 'other' END AS usage, url FROM pages)
SELECT usage, url, CASE WHEN usage = 'standard' AND starts_with(url, 'https://m.') THEN 's3://mirror/m.' || substr(url, 11) WHEN starts_with(url, 'https://') THEN 's3://all/' || substr(url, 9)
  WHEN usage = 'standard' AND starts_with(url, 'http://') THEN 'file:///data/' || substr(url, 8) WHEN starts_with(url, 'http://www.') THEN 'never://' || substr(url, 12) ELSE url END AS rewritten FROM u""")
def url_rewrite_null_usage(spark, sf):
    """Urls of no usage meet the rules that hold for every usage."""
    from voxelarium.plans.operations import RULES

    k = F.col("page_id")
    urls = table(spark, sf, "pages").select(F.when(k % 3 == 0, "standard").when(k % 3 == 1, "other").alias("usage"), "url").distinct()
    return catalog.rewrite(urls, spark.createDataFrame(RULES, "seq int, usage string, prefix string, replacement string"))


@query("SELECT page_id, regexp_extract(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/]*)', 1), '([^.]+)$', 1) AS top FROM pages")
def url_top_domain(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract(url_host(F.col("url")), r"([^.]+)$", 1).alias("top"))


# ---- purges ----
_VICTIMS = f"""{CE}, g AS (SELECT volume_id, idx, (({CURRENT} - access_epoch) % 256 + 256) % 256 AS age FROM ce WHERE state = 1), h AS (SELECT age, count(*) AS n FROM g WHERE age >= 1 GROUP BY age),
t AS (SELECT max(age) AS t FROM (SELECT age, sum(n) OVER (ORDER BY age DESC) AS freed FROM h) WHERE freed >= (SELECT greatest(CASE WHEN count(*) > 5700 THEN count(*) - 4800 ELSE 0 END, 800) FROM g)),
v AS (SELECT volume_id, idx, CAST((row_number() OVER (PARTITION BY volume_id ORDER BY idx) - 1) // 64 AS INT) AS batch FROM g, t WHERE age >= t)"""


@query(f"WITH {_VICTIMS} SELECT volume_id, idx, batch FROM v")
def purge_victims(spark, sf):
    state = chunk_state(spark, sf)
    target = residency.purge_target(state, 6000, 1, 100, 900).first().target
    return residency.victims(state, CURRENT, target, 64)


@query(f"WITH {_VICTIMS} SELECT ce.volume_id, CAST(CASE WHEN v.idx IS NOT NULL THEN 0 ELSE ce.state END AS INT) AS state, count(*) AS n FROM ce LEFT JOIN v ON v.volume_id = ce.volume_id AND v.idx = ce.idx GROUP BY ALL")
def purge_job(spark, sf):
    """Target, threshold, victims and the state afterwards, as one job."""
    after = residency.purge(chunk_state(spark, sf), CURRENT, 6000, 1, 100, 900)
    return after.groupBy("volume_id", "state").agg(F.count("*").alias("n"))


@query(f"WITH {CE} SELECT w.volume_id, w.idx FROM (SELECT DISTINCT CAST(l_suppkey % 16 AS INT) AS volume_id, l_orderkey AS idx FROM lineitem WHERE l_linenumber = 2) w ANTI JOIN (SELECT * FROM ce WHERE state <> 0) f ON w.volume_id = f.volume_id AND w.idx = f.idx")
def pending_keys(spark, sf):
    keys = table(spark, sf, "lineitem").where("l_linenumber = 2").select((F.col("l_suppkey") % 16).cast("int").alias("volume_id"), F.col("l_orderkey").alias("idx")).distinct()
    return residency.pending(keys, chunk_state(spark, sf), ["volume_id", "idx"])


@query("SELECT 'base' AS volume, l_orderkey % 100 AS chunk, count(*) AS n FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL UNION ALL SELECT 'overlay', o_orderkey % 80, count(*) FROM orders GROUP BY ALL")
def chunk_groups(spark, sf):
    base = table(spark, sf, "lineitem").where("l_linenumber = 1").select((F.col("l_orderkey") % 100).alias("chunk"))
    both = residency.both_groups(base, table(spark, sf, "orders").select((F.col("o_orderkey") % 80).alias("chunk")))
    return both.groupBy("volume", "chunk").agg(F.count("*").alias("n"))


@query(f"WITH {CE} SELECT access_epoch, count(*) AS n FROM ce WHERE state = 1 GROUP BY access_epoch")
def epochs_accumulated(spark, sf):
    """Histograms of the volumes, each reported twice, counted once."""
    per = chunk_state(spark, sf).where("state = 1").groupBy("volume_id", "access_epoch").agg(F.count("*").alias("n"))
    per = per.groupBy("volume_id").agg(F.map_from_entries(F.collect_list(F.struct("access_epoch", "n"))).alias("epochs"))
    return residency.accumulated(per.unionByName(per))


@query("SELECT DISTINCT event_id % 300 AS chunk, epoch_ms(ts) // 3600000 AS frame FROM events")
def touches_debounced(spark, sf):
    t = table(spark, sf, "events").select((F.col("event_id") % 300).alias("chunk"), F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 3600000).alias("frame"))
    return residency.touched_once(t)


# ---- telemetry ----
@query(f"""WITH {EV}, d AS (SELECT ok, CAST(status AS VARCHAR) AS status, CASE WHEN ok THEN 'ok' ELSE 'failed' END AS outcome, CASE WHEN NOT ok THEN CASE WHEN touches % 2 = 0 THEN 'timeout' ELSE 'decode error' END END AS reason, event AS kind, CASE WHEN touches >= 2 THEN 'hit' ELSE 'miss' END AS cache FROM ev)
{' UNION ALL '.join(f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS n, count(*) FILTER (ok) AS n_ok FROM d WHERE {c} IS NOT NULL GROUP BY {c}" for c in ('status', 'outcome', 'reason', 'kind', 'cache'))}""")
def netlog_breakdown(spark, sf):
    """Counts by status, outcome, reason of failure, kind, and cache hit or miss."""
    reason = F.when(~F.col("ok"), F.when(F.col("touches") % 2 == 0, F.concat(F.lit("timeout: "), "host")).otherwise(F.concat(F.lit("decode error:"), F.col("event_id").cast("string"))))
    by = {"status": F.col("status"), "outcome": F.when(F.col("ok"), "ok").otherwise("failed"), "reason": reason, "kind": F.col("event"), "cache": F.when(F.col("touches") >= 2, "hit").otherwise("miss")}
    return telemetry.breakdown(events(spark, sf), by)


@query(f"WITH {EV} SELECT host, count(*) AS n, round(CAST(sum(bytes) AS DOUBLE) / CASE WHEN max(t) = min(t) THEN 1.0 ELSE (max(t) - min(t)) / 1000.0 END, 9) AS rate FROM ev WHERE ok AND status IN (200, 206) GROUP BY host")
def netlog_host_rate(spark, sf):
    return telemetry.hosts(events(spark, sf)).select("host", "n", F.round("rate", 9).alias("rate"))


@query("WITH d AS (SELECT CAST(floor(l_quantity * 5) AS INT) % 9 AS component, count(*) AS n FROM lineitem GROUP BY 1) SELECT component, n FROM d WHERE n >= 6000")
def large_components(spark, sf):
    """Component sizes from a threshold on."""
    from voxelarium.operators import graph

    v = table(spark, sf, "lineitem").select((F.floor(F.col("l_quantity") * 5).cast("int") % 9).alias("component"), F.lit(1).alias("v"))
    return graph.sizes(v, 6000).select("component", "n")
