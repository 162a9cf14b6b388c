"""Volumes, surfaces, meshes, telemetry and catalogues derived from relational tables, in Spark and as SQL.

The SQL texts are independent definitions of the same data for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelarium.functions.voxel import idiv
from voxelarium.operators import surface

#: Extent of the embedding volume: eight by eight by one plane per vector; 500 planes at the small scales.
SIDE = 8


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def embedding_volume(spark: SparkSession, sf: str, planes: tuple[int, int] | None = None) -> DataFrame:
    """(x, y, z, v): one plane of 8x8 voxels per vector.

    planes: first and last plane wanted; on the stored column, so that the scan skips row groups.
    """
    e = table(spark, sf, "embeddings")
    if planes:
        e = e.where(F.col("vec_id").between(*planes))
    e = e.select(F.col("vec_id").cast("int").alias("z"), F.posexplode("embedding").alias("k", "e"))
    v = F.floor((F.col("e").cast("double") + 1) * 127.5)
    return e.select((F.col("k") % SIDE).alias("x"), idiv(F.col("k"), SIDE).cast("int").alias("y"), "z", F.least(F.greatest(v, F.lit(0)), F.lit(255)).cast("int").alias("v"))


VE = """ve AS (SELECT CAST(k % 8 AS INT) AS x, CAST(k // 8 AS INT) AS y, z, CAST(least(greatest(floor((CAST(e AS DOUBLE) + 1) * 127.5), 0), 255) AS INT) AS v
  FROM (SELECT CAST(vec_id AS INT) AS z, unnest(embedding) AS e, unnest(range(len(embedding))) AS k FROM embeddings))"""


def label_volume(spark: SparkSession, sf: str) -> DataFrame:
    """(x, y, z, v): sparse labels on the grid of the embedding volume."""
    l = table(spark, sf, "lineitem")
    return l.groupBy((F.col("l_suppkey") % SIDE).cast("int").alias("x"), (F.col("l_partkey") % SIDE).cast("int").alias("y"), (F.col("l_orderkey") % 500).cast("int").alias("z")).agg(F.max(F.floor(F.col("l_quantity") * 5).cast("int")).alias("v"))


VL = """vl AS (SELECT CAST(l_suppkey % 8 AS INT) AS x, CAST(l_partkey % 8 AS INT) AS y, CAST(l_orderkey % 500 AS INT) AS z, max(CAST(floor(l_quantity * 5) AS INT)) AS v FROM lineitem GROUP BY ALL)"""


def grid_surface(spark: SparkSession, sf: str) -> DataFrame:
    """(r, c, px, py, pz, valid): one row of 64 cells per vector."""
    v = embedding_volume(spark, sf)
    c = 8 * F.col("y") + F.col("x")
    return v.select(F.col("z").alias("r"), c.alias("c"), (10.0 * c + F.col("v") / 4.0).alias("px"), (10.0 * F.col("z")).alias("py"), (1000.0 + F.col("v")).alias("pz"), (F.col("v") > 100).alias("valid"))


SG = VE + """,
sg AS (SELECT z AS r, 8 * y + x AS c, 10.0::DOUBLE * (8 * y + x) + v / 4.0::DOUBLE AS px, 10.0::DOUBLE * z AS py, 1000.0::DOUBLE + v AS pz, v > 100 AS valid FROM ve)"""


def telemetry(spark: SparkSession, sf: str) -> DataFrame:
    """Download events: host, event, t in ms, wait_ms, ttfb_ms, body_ms, bytes, touches, status, ok."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    t = F.unix_millis(F.col("ts").cast("timestamp"))
    body = F.floor(F.col("value") * 10).cast("long") + 1
    status = F.when(F.col("event_id") % 50 == 0, 404).when(F.col("event_id") % 7 == 0, 206).otherwise(200)
    return e.select("event_id", F.concat(F.lit("host"), (F.col("user_id") % 20).cast("string")).alias("host"), F.col("event_type").alias("event"), t.alias("t"), F.floor("value").cast("long").alias("wait_ms"), (F.floor(F.col("value") * 3).cast("long") % 97).alias("ttfb_ms"), body.alias("body_ms"), k.alias("bytes"), (k % 4).alias("touches"), status.alias("status"), (F.col("event_id") % 11 != 0).alias("ok"))


EV = """ev AS (SELECT event_id, 'host' || CAST(user_id % 20 AS VARCHAR) AS host, event_type AS event, epoch_us(ts) // 1000 AS t, CAST(floor(value) AS BIGINT) AS wait_ms,
  CAST(floor(value * 3) AS BIGINT) % 97 AS ttfb_ms, CAST(floor(value * 10) AS BIGINT) + 1 AS body_ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS bytes, CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 AS touches,
  CASE WHEN event_id % 50 = 0 THEN 404 WHEN event_id % 7 = 0 THEN 206 ELSE 200 END AS status, event_id % 11 <> 0 AS ok FROM events)"""


def chunk_state(spark: SparkSession, sf: str) -> DataFrame:
    """(volume_id, idx, state, access_epoch): 1 resident, 2 empty, 0 missing."""
    o = table(spark, sf, "orders")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))
    return o.select((F.col("o_custkey") % 16).cast("int").alias("volume_id"), F.col("o_orderkey").alias("idx"), F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(0).alias("state"), F.pmod(day, F.lit(256)).alias("access_epoch"))


CE = """ce AS (SELECT CAST(o_custkey % 16 AS INT) AS volume_id, o_orderkey AS idx, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS state,
  CAST(((date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) % 256) + 256) % 256 AS INT) AS access_epoch FROM orders)"""


def mesh(grid: DataFrame, width: int = 64) -> DataFrame:
    """Two triangles for each quad of valid cells: (tri_id, x1..z3, u1..v3); u is the column, v the row."""
    q = surface.whole(surface.quads(grid)).select("r", "c", *[F.col(f"p{k}.p{a}").alias(f"{a}{k}") for k in ("00", "01", "10", "11") for a in "xyz"])
    quad = (F.col("r").cast("long") * width + F.col("c")) * 2
    corner = {"00": (0, 0), "01": (0, 1), "10": (1, 0), "11": (1, 1)}

    def tri(n: int, *keys: str):
        parts = [(quad + n).alias("tri_id")]
        for i, k in enumerate(keys, 1):
            parts += [F.col(f"{a}{k}").alias(f"{a}{i}") for a in "xyz"]
            parts += [(F.col("c") + corner[k][1]).cast("double").alias(f"u{i}"), (F.col("r") + corner[k][0]).cast("double").alias(f"v{i}")]
        return F.struct(*parts)

    return q.select(F.explode(F.array(tri(0, "00", "10", "01"), tri(1, "10", "11", "01"))).alias("t")).select("t.*")


TM = SG + """,
q AS (SELECT a.r, a.c, a.px x00, a.py y00, a.pz z00, b.px x01, b.py y01, b.pz z01, d.px x10, d.py y10, d.pz z10, e.px x11, e.py y11, e.pz z11
  FROM sg a JOIN sg b ON b.r = a.r AND b.c = a.c + 1 JOIN sg d ON d.r = a.r + 1 AND d.c = a.c JOIN sg e ON e.r = a.r + 1 AND e.c = a.c + 1 WHERE a.valid AND b.valid AND d.valid AND e.valid),
tm AS (
  SELECT (CAST(r AS BIGINT) * 64 + c) * 2 AS tri_id, x00 x1, y00 y1, z00 z1, CAST(c AS DOUBLE) u1, CAST(r AS DOUBLE) v1, x10 x2, y10 y2, z10 z2, CAST(c AS DOUBLE) u2, CAST(r + 1 AS DOUBLE) v2, x01 x3, y01 y3, z01 z3, CAST(c + 1 AS DOUBLE) u3, CAST(r AS DOUBLE) v3 FROM q
  UNION ALL
  SELECT (CAST(r AS BIGINT) * 64 + c) * 2 + 1, x10, y10, z10, CAST(c AS DOUBLE), CAST(r + 1 AS DOUBLE), x11, y11, z11, CAST(c + 1 AS DOUBLE), CAST(r + 1 AS DOUBLE), x01, y01, z01, CAST(c + 1 AS DOUBLE), CAST(r AS DOUBLE) FROM q)"""
