"""Catalogue lookups: groupings, urls, transforms, renderable volumes, orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelarium.functions.voxel import affine_scale, affine_then, url_join


def by_scroll(segments: DataFrame, last_run_only: bool = False) -> DataFrame:
    """Scrolls with their segments in order; with last_run_only a scroll split over several runs of the input order
    (column seq) keeps its last run."""
    s = segments
    if last_run_only:
        w = Window.orderBy("seq")
        s = s.withColumn("_new", (F.lag("scroll_id").over(w).isNull() | (F.lag("scroll_id").over(w) != F.col("scroll_id"))).cast("int")).withColumn("_run", F.sum("_new").over(w))
        s = s.withColumn("_last", F.max("_run").over(Window.partitionBy("scroll_id"))).where("_run = _last")
    g = s.groupBy("scroll_id", "is_fragment", "num").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("segment_id")).alias("segments"))
    return g.orderBy("is_fragment", "num")


def renderable(segments: DataFrame, volumes: DataFrame, coverage: DataFrame, transforms: DataFrame) -> DataFrame:
    """(segment_id, volume_id, original): the segment's own volume, volumes that cover it, and those a transform
    reaches.  A union of three equi-joins instead of one join under OR."""
    own = segments.join(volumes, segments["original_volume_id"] == volumes["volume_id"]).select("segment_id", "volume_id")
    cover = coverage.join(volumes, "volume_id", "left_semi").join(segments, "segment_id", "left_semi").select("segment_id", "volume_id")
    reach = segments.join(transforms, segments["original_volume_id"] == transforms["source"]).select("segment_id", F.col("target").alias("volume_id")).join(volumes, "volume_id", "left_semi").select("segment_id", "volume_id")
    every = own.unionByName(cover).unionByName(reach).distinct()
    return every.join(segments.select("segment_id", "original_volume_id"), "segment_id").select("segment_id", "volume_id", (F.col("volume_id") == F.col("original_volume_id")).alias("original"))


def volume_order(volumes: DataFrame) -> DataFrame:
    return volumes.orderBy(F.col("pixel_size").asc_nulls_last(), F.col("energy").asc_nulls_last(), F.col("distance").asc_nulls_last(), "seq")


def rewrite(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (usage, url) with the first matching rule (seq, usage or null, prefix, replacement) applied once.

    Rules match by prefix, so each url is compared with the prefixes of its own lengths: an equi-join, not a range join.
    """
    lengths = [r.n for r in rules.select(F.length("prefix").alias("n")).distinct().orderBy("n").collect()]  # a configuration's few rules
    if not lengths:
        return urls.withColumn("rewritten", F.col("url"))
    r = rules.select(F.col("prefix").alias("_p"), F.col("usage").alias("_u"), F.col("seq").alias("_seq"), "replacement")
    base = urls.withColumn("_id", F.xxhash64("usage", "url"))
    keys = base.select("_id", "usage", "url").distinct().withColumn("_n", F.explode(F.array(*map(F.lit, lengths)))).where(F.length("url") >= F.col("_n")).withColumn("_p", F.expr("substring(url, 1, _n)"))
    hit = keys.join(r, "_p").where(F.col("_u").isNull() | (F.col("_u") == F.col("usage")))
    first = hit.groupBy("usage", "url").agg(F.min_by(F.concat("replacement", F.expr("substring(url, length(_p) + 1)")), "_seq").alias("rewritten"))
    first = first.select(F.col("usage").alias("_usage"), F.col("url").alias("_url"), "rewritten")
    # a null usage meets the rules for every usage
    out = urls.join(first, F.col("usage").eqNullSafe(F.col("_usage")) & (F.col("url") == F.col("_url")), "left")
    return out.select(*[F.col(f"`{c}`") for c in urls.columns], F.coalesce("rewritten", "url").alias("rewritten"))


def first_url(entries: DataFrame, kind: str, usage: str = "standard") -> DataFrame:
    """(owner, url): of entries (owner, type, origins: [path, roots: [usage, url]]) the first of a type whose origin has
    a root of the usage."""
    e = entries.where(F.col("type") == kind).select("owner", F.posexplode("entries").alias("i", "e")) if "entries" in entries.columns else entries.where(F.col("type") == kind).withColumn("i", F.lit(0)).select("owner", "i", F.struct("origins").alias("e"))
    o = e.select("owner", "i", F.posexplode("e.origins").alias("j", "o")).select("owner", "i", "j", F.col("o.path").alias("path"), F.posexplode("o.roots").alias("k", "root"))
    hit = o.where(F.col("root.usage") == usage)
    return hit.groupBy("owner").agg(F.min_by(url_join(F.col("root.url"), F.col("path")), F.struct("i", "j", "k")).alias("url"))


def prefer(*urls: Column) -> Column:
    return F.coalesce(*urls)


def all_present(files: DataFrame, need: int) -> DataFrame:
    """Segments whose file set is complete."""
    return files.groupBy("segment_id").agg(F.countDistinct("name").alias("n")).where(F.col("n") >= need).select("segment_id")


def urls(entries: DataFrame, usage: str) -> DataFrame:
    """(owner, type, url) of every root of a usage."""
    o = entries.select("owner", "type", F.explode("origins").alias("o")).select("owner", "type", F.col("o.path").alias("path"), F.explode("o.roots").alias("root"))
    return o.where(F.col("root.usage") == usage).select("owner", "type", url_join(F.col("root.url"), F.col("path")).alias("url"))


def geometry(entries: DataFrame, usage: str = "standard") -> DataFrame:
    """Per owner: the first grid url (normalised before plain), the first mesh url (plain before normalised), and
    whether there is either.  The types are looked at in one pass."""
    o = entries.withColumn("_i", F.monotonically_increasing_id()).select("owner", "type", "_i", F.posexplode("origins").alias("_j", "o"))
    r = o.select("owner", "type", "_i", "_j", F.col("o.path").alias("path"), F.posexplode("o.roots").alias("_k", "root")).where(F.col("root.usage") == usage)
    first = lambda kind: F.min_by(F.when(F.col("type") == kind, url_join(F.col("root.url"), F.col("path"))), F.when(F.col("type") == kind, F.struct("_i", "_j", "_k")))
    per = r.groupBy("owner").agg(F.coalesce(first("tifxyz-normalized"), first("tifxyz")).alias("grid_url"), F.coalesce(first("obj"), first("obj-normalized")).alias("mesh_url"))
    out = entries.select("owner").distinct().join(per, "owner", "left")
    return out.withColumn("downloadable", F.col("grid_url").isNotNull() | F.col("mesh_url").isNotNull())


def lookup(segments: DataFrame, volumes: DataFrame, scans: DataFrame) -> DataFrame:
    """Segments with their original volume and its scan; null where a record is missing."""
    return segments.join(volumes, segments["original_volume_id"] == volumes["volume_id"], "left").join(scans, "scan_id", "left")


def first_edges(edges: DataFrame) -> DataFrame:
    """The first direct transform (source, target, matrix) of each pair of different volumes, by seq."""
    return edges.where("source <> target").groupBy("source", "target").agg(F.min_by("matrix", "seq").alias("matrix"))


def load_plan(wanted: DataFrame, segments: DataFrame, edges: DataFrame) -> DataFrame:
    """(segment_id, volume_id, matrix, uv_scale) of segments to be shown in a volume (null: their original one).

    matrix maps stored coordinates to the volume: the segment's downscaling first (segments: segment_id,
    original_volume_id, downscale or null, current_volume_id or null), then the registration into the volume where it
    is another one; null where neither applies.  uv_scale is the mean scale of the transform from the volume now shown
    (current_volume_id) to the wanted one, 1 where there is none.
    """
    s = wanted.join(segments, "segment_id").withColumn("volume_id", F.coalesce("volume_id", "original_volume_id"))
    s = s.withColumn("_from", F.coalesce("current_volume_id", "original_volume_id"))
    e = first_edges(edges)
    edge = lambda a, out: e.select(F.col("source").alias(a), F.col("target").alias("volume_id"), F.col("matrix").alias(out))
    s = s.join(edge("original_volume_id", "_r"), ["original_volume_id", "volume_id"], "left").join(edge("_from", "_s"), ["_from", "volume_id"], "left")
    zero, d = F.lit(0.0), F.col("downscale")
    down = F.when(d.isNotNull(), F.array(*[d if i == j else zero for i in range(3) for j in range(4)]))
    return s.select("segment_id", "volume_id", affine_then(down, F.col("_r")).alias("matrix"), affine_scale(F.col("_s")).alias("uv_scale"))


def direct_transform(edges: DataFrame, source: str, target: str) -> DataFrame:
    """The matrix of the first direct edge (source, target, matrix, seq) between two different volumes."""
    if source == target:
        return edges.where(F.lit(False)).select("matrix")
    return edges.where((F.col("source") == source) & (F.col("target") == target)).orderBy("seq").limit(1).select("matrix")


def scroll_label(is_fragment: Column, num: Column, scroll_id: Column) -> Column:
    return F.format_string("%s %s - %s", F.when(is_fragment, "Fragment").otherwise("Scroll"), num.cast("string"), scroll_id)


def volume_label(volume_id: Column, pixel_um: Column, energy_kev: Column, distance_mm: Column, shortcut: Column | None = None) -> Column:
    """Pixel size, energy and distance; with a shortcut number pixel size and number; the id where anything is unknown."""
    known = pixel_um.isNotNull() & energy_kev.isNotNull() & distance_mm.isNotNull()
    full = F.format_string("%.2fµm, %skeV, %.2fm", pixel_um.cast("double"), energy_kev.cast("string"), distance_mm.cast("double") / 1000.0)
    short = full if shortcut is None else F.when(shortcut.isNotNull(), F.format_string("%.2fµm (^%s)", pixel_um.cast("double"), shortcut.cast("string"))).otherwise(full)
    return F.when(known, short).otherwise(volume_id)
