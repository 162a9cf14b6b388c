"""Operator 3: URL filters by a temporal list join.

A list is a log of dated entries: (kind, pattern, action, at) with kind `domain` (a host and its subdomains) or `url`
(scheme, query and fragment aside), and action `add` or `remove`.  The log becomes validity intervals [from, until),
and an as-of join evaluates every capture against the entries active when it was fetched.

Domain entries are matched per distinct host: a host's parent domains are looked up in the intervals once, whatever the
number of its captures, and the captures join their host's intervals (one row per host), so a hot host is one row on
the small side of a join that adaptive execution can split.

Defined results: a null or unparsable url, or a null fetch time, is never blocked; repeated captures are each
evaluated; a repeated add extends nothing and a remove without an add is void; an entry active at both instants of an
equal add and remove time counts as removed; extra columns are ignored; an empty list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)"
PLACE = r"^[A-Za-z][A-Za-z0-9+.-]*://([^?#]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def place_of(url: Column) -> Column:
    """Host and path of a url, without its last slash."""
    return F.lower(F.regexp_replace(F.regexp_extract(url, PLACE, 1), "/$", ""))


def intervals(log: DataFrame) -> DataFrame:
    """(kind, pattern, start, until) of the times an entry is active; until is null while it still is."""
    w = Window.partitionBy("kind", "pattern").orderBy("at", F.col("action"))
    log = log.select("kind", F.lower("pattern").alias("pattern"), "at", "action").distinct()
    changes = log.withColumn("_was", F.coalesce(F.lag("action").over(w), F.lit("remove"))).where("action <> _was")
    spans = changes.withColumn("until", F.lead("at").over(w)).where("action = 'add'")
    return spans.where("until IS NULL OR until > at").select("kind", "pattern", F.col("at").alias("start"), "until")


def active(fetched: Column, spans: Column) -> Column:
    return F.filter(spans, lambda s: (s["start"] <= fetched) & (s["until"].isNull() | (s["until"] > fetched)))


def evaluate(captures: DataFrame, log: DataFrame) -> DataFrame:
    """captures (url, fetched_at, ...) with host, n_active (entries active at fetch) and blocked."""
    spans = intervals(log)
    span = F.struct("start", "until")
    rows = captures.withColumn("host", host_of(F.col("url"))).withColumn("_place", place_of(F.col("url")))
    parts = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    hosts = rows.where(F.length("host") > 0).select("host").distinct().select("host", F.explode(parents).alias("pattern"))
    by_host = hosts.join(spans.where("kind = 'domain'"), "pattern").groupBy("host").agg(F.collect_list(span).alias("_domain"))
    by_place = spans.where("kind = 'url'").groupBy(F.col("pattern").alias("_place")).agg(F.collect_list(span).alias("_url"))
    out = rows.join(by_host, "host", "left").join(by_place, "_place", "left")
    count = sum(F.coalesce(F.size(active(F.col("fetched_at"), F.col(c))), F.lit(0)) for c in ("_domain", "_url"))
    n = F.when(F.col("_domain").isNull() & F.col("_url").isNull(), 0).otherwise(count)
    return out.withColumn("n_active", F.greatest(n, F.lit(0)).cast("long")).withColumn("blocked", F.col("n_active") > 0).drop("_domain", "_url", "_place")


def _number(x: Column) -> Column:
    return F.conv(F.substring(F.md5(x.cast("binary")), 1, 8), 16, 10).cast("long")


def example_log(pages: DataFrame) -> DataFrame:
    """A list log for tables that come without one, by rule: a quarter of the hosts and a fiftieth of the urls are
    added on a day of 2024 that their md5 gives, every second of them is removed 20 to 119 days later, and every
    fourth added again 30 days after that."""
    hosts = pages.select(host_of(F.col("url")).alias("pattern")).where("pattern <> ''").distinct().withColumn("n", _number(F.col("pattern"))).where("n % 4 = 0").withColumn("kind", F.lit("domain"))
    urls = pages.select(place_of(F.col("url")).alias("pattern")).where("pattern <> ''").distinct().withColumn("n", _number(F.col("pattern"))).where("n % 50 = 7").withColumn("kind", F.lit("url"))
    both = hosts.unionByName(urls)
    add = F.date_add(F.lit("2024-01-01").cast("date"), ((F.col("n") / 4).cast("long") % 200).cast("int"))
    gone = F.date_add(add, (20 + (F.col("n") / 1000).cast("long") % 100).cast("int"))
    event = lambda action, at: F.struct(F.lit(action).alias("action"), at.alias("at"))
    events = F.array(event("add", add), F.when((F.col("n") / 16).cast("long") % 2 == 0, event("remove", gone)), F.when((F.col("n") / 16).cast("long") % 4 == 0, event("add", F.date_add(gone, 30))))
    return both.select("kind", "pattern", F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e")).select("kind", "pattern", "e.action", "e.at")


def op3_temporal_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the example list; pages carry no fetch time, so it is a day of 2024 given by page_id."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int"))
    return evaluate(pages.withColumn("fetched_at", fetched), example_log(pages)).select("page_id", "host", "fetched_at", "n_active", "blocked")


SQL = r"""
WITH p AS (
  SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)) AS host,
    lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^?#]*)', 1), '/$', '')) AS place,
    DATE '2024-01-01' + CAST((page_id * 37) % 366 AS INT) AS fetched_at
  FROM pages),
l AS (
  SELECT DISTINCT 'domain' AS kind, host AS pattern, CAST('0x' || substr(md5(host), 1, 8) AS BIGINT) AS n FROM p WHERE host <> '' AND CAST('0x' || substr(md5(host), 1, 8) AS BIGINT) % 4 = 0
  UNION ALL SELECT DISTINCT 'url', place, CAST('0x' || substr(md5(place), 1, 8) AS BIGINT) FROM p WHERE place <> '' AND CAST('0x' || substr(md5(place), 1, 8) AS BIGINT) % 50 = 7),
d AS (SELECT *, DATE '2024-01-01' + CAST((n // 4) % 200 AS INT) AS a, DATE '2024-01-01' + CAST((n // 4) % 200 + 20 + (n // 1000) % 100 AS INT) AS g FROM l),
s AS (
  SELECT kind, pattern, a AS f, CASE WHEN (n // 16) % 2 = 0 THEN g END AS t FROM d
  UNION ALL SELECT kind, pattern, g + 30, NULL FROM d WHERE (n // 16) % 4 = 0),
m AS (
  SELECT p.page_id, p.fetched_at, s.f, s.t FROM p JOIN s ON s.kind = 'domain' AND (p.host = s.pattern OR ends_with(p.host, '.' || s.pattern))
  UNION ALL SELECT p.page_id, p.fetched_at, s.f, s.t FROM p JOIN s ON s.kind = 'url' AND p.place = s.pattern),
c AS (SELECT page_id, count(*) AS n FROM m WHERE f <= fetched_at AND (t IS NULL OR t > fetched_at) GROUP BY page_id)
SELECT p.page_id, p.host, CAST(p.fetched_at AS DATE) AS fetched_at, CAST(coalesce(c.n, 0) AS BIGINT) AS n_active, coalesce(c.n, 0) > 0 AS blocked
FROM p LEFT JOIN c ON p.page_id = c.page_id
"""
