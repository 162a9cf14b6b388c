"""Which chunks a plan needs, what covers them, and what to evict."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelarium.functions.voxel import idiv

EPOCHS = 256


def _cells(df: DataFrame, names: dict[str, tuple[Column, Column]]) -> DataFrame:
    for name, (low, high) in names.items():
        df = df.withColumn(name, F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    return df


def native_overlap(chunks: DataFrame, native: tuple[int, int, int], shape: tuple[int, int, int], size: int = 64) -> DataFrame:
    """Cache chunks (cx, cy, cz) with the native chunks (nx, ny, nz) they overlap: a closed form, no interval join."""
    names, live = {}, F.lit(True)
    for a, n, s in zip("xyz", native, shape, strict=True):
        low = F.col(f"c{a}") * size
        live = live & (low < s)
        names[f"n{a}"] = (idiv(low, n), idiv(F.least(low + size, F.lit(s)) - 1, n))
    return _cells(chunks.where(live), names)


def covered(boxes: DataFrame, native: tuple[int, int, int], shape: tuple[int, int, int], size: int = 64) -> DataFrame:
    """Cache chunks wholly within a box of native chunks (lo_x..hi_z, ends included), the volume's edge counting as
    the end of the last chunk."""
    names = {}
    for a, n, s in zip("xyz", native, shape, strict=True):
        start, end = F.col(f"lo_{a}") * n, F.least((F.col(f"hi_{a}") + 1) * n, F.lit(s))
        last = F.when(end >= s, idiv(F.lit(s - 1), size)).otherwise(idiv(end, size) - 1)
        names[f"c{a}"] = (idiv(start + size - 1, size), last)
    ok = F.lit(True)
    for low, high in names.values():
        ok = ok & (low <= high)
    return _cells(boxes.where(ok), names)


def touched(boxes: DataFrame, extent: tuple[int, int, int], lod: int = 0, size: int = 64) -> DataFrame:
    """Chunks of a level that boxes (min_x..max_z) meet, clamped to the grid."""
    names, ok = {}, F.lit(True)
    for a, e in zip("xyz", extent, strict=True):
        step = size << lod
        last = -(-e // step) - 1
        ok = ok & (F.col(f"max_{a}") >= 0) & (F.floor(F.col(f"min_{a}") / step) <= last)
        names[f"c{a}"] = (F.greatest(F.floor(F.col(f"min_{a}") / step), F.lit(0)), F.least(F.floor(F.col(f"max_{a}") / step), F.lit(last)))
    return _cells(boxes.where(ok), names)


def pretouched(boxes: DataFrame, extent: tuple[int, int, int], lod: int, preview: int, size: int = 64) -> DataFrame:
    """Distinct (lod, cx, cy, cz) to ask for ahead: the chunks that boxes meet at a level and at the coarse one of the
    preview."""
    each = [touched(boxes, extent, k, size).select(F.lit(k).alias("lod"), "cx", "cy", "cz") for k in sorted({lod, preview})]
    out = each[0]
    for x in each[1:]:
        out = out.unionByName(x)
    return out.distinct()


def missing(wanted: DataFrame, filled: DataFrame, key: list[str]) -> DataFrame:
    """Wanted keys that are not filled."""
    return wanted.select(*key).distinct().join(filled.select(*key), key, "left_anti")


def shard_lookup(subchunks: DataFrame, index: DataFrame) -> DataFrame:
    """Sub-chunks (shard, place) with their byte range from index (shard, place, off, len); absent entries (all ones,
    read as -1) drop out."""
    return subchunks.join(index.where("NOT (off = -1 AND len = -1)"), ["shard", "place"])


def fetch_plan(needs: DataFrame) -> DataFrame:
    """One row per source of (chunk, source_key, kind, url, off, len): the first registration and all its waiters' number."""
    return needs.groupBy("source_key").agg(F.min_by(F.struct("kind", "url", "off", "len"), "chunk").alias("s"), F.countDistinct("chunk").alias("waiters")).select("source_key", "s.*", "waiters")


def purge_target(state: DataFrame, cap_bytes: int, chunk_bytes: int, free_bytes: int | None = None, floor_bytes: int = 5 << 30) -> DataFrame:
    """(resident, target): how many chunks must go.  Down to 80 % of the capacity once above 95 %, and enough to leave
    the floor free on disk where free_bytes is known."""
    capacity = cap_bytes // chunk_bytes
    n = F.col("resident")
    target = F.when(n > capacity * 95 // 100, n - capacity * 80 // 100).otherwise(0)
    short = -(-(floor_bytes - free_bytes) // chunk_bytes) if free_bytes is not None and free_bytes < floor_bytes else 0
    return state.where("state = 1").agg(F.count("*").alias("resident")).withColumn("target", F.greatest(target, F.lit(short)).cast("long"))


def age(current: int, epoch: str = "access_epoch") -> Column:
    return F.pmod(F.lit(current) - F.col(epoch), F.lit(EPOCHS))


def histogram(state: DataFrame) -> DataFrame:
    """Resident chunks per access epoch: at most 256 rows."""
    return state.where("state = 1").groupBy("access_epoch").agg(F.count("*").alias("n"))


def threshold(state: DataFrame, current: int, target: int) -> DataFrame:
    """(age_threshold, freed): the largest age from which evicting reaches the target without touching the current
    epoch; no row where that is out of reach.  The window runs over the histogram's 256 rows."""
    h = histogram(state).withColumn("age", age(current)).where("age >= 1")
    run = h.withColumn("freed", F.sum("n").over(Window.orderBy(F.desc("age")).rowsBetween(Window.unboundedPreceding, 0)))
    return run.where(F.col("freed") >= target).agg(F.max("age").alias("age_threshold"), F.min("freed").alias("freed")).where("age_threshold IS NOT NULL")


def breakdown(state: DataFrame, current: int, limit: int) -> DataFrame:
    """Per volume: resident chunks, victims under an age limit, oldest age."""
    r = state.where("state = 1").withColumn("age", age(current))
    return r.groupBy("volume_id").agg(F.count("*").alias("resident"), F.count_if(F.col("age") >= limit).alias("victims"), F.max("age").alias("oldest_age"))


def purge_report(state: DataFrame, current: int, limit: int) -> DataFrame:
    """The breakdown by victims, then residents, with the victims' percentage."""
    return breakdown(state, current, limit).withColumn("percent", F.col("victims") * 100.0 / F.col("resident")).orderBy(F.desc("victims"), F.desc("resident"), "volume_id")


class PurgeTarget(Protocol):
    """What holds chunks: told which of them (volume_id, idx, batch) go."""

    def evict(self, victims: DataFrame) -> None: ...


def victims(state: DataFrame, current: int, target: int, batch: int = 1024) -> DataFrame:
    """(volume_id, idx, batch) of the chunks that go so that the target is met: those of the threshold's age or older,
    in batches of a volume.  None where the target is out of reach."""
    limit = threshold(state, current, target).select("age_threshold")
    old = state.where("state = 1").withColumn("_age", age(current)).join(F.broadcast(limit), F.col("_age") >= F.col("age_threshold"))  # one row at most
    order = Window.partitionBy("volume_id").orderBy("idx")
    return old.select("volume_id", "idx", idiv(F.row_number().over(order) - 1, batch).cast("int").alias("batch"))


def purge(state: DataFrame, current: int, cap_bytes: int, chunk_bytes: int, free_bytes: int | None = None, floor_bytes: int = 5 << 30, targets: tuple[PurgeTarget, ...] = ()) -> DataFrame:
    """The state after a purge as a whole: how many must go, which, and each of them missing afterwards.  The targets
    are told before the new state is returned."""
    n = purge_target(state, cap_bytes, chunk_bytes, free_bytes, floor_bytes).first().target  # one number
    if not n:
        return state
    gone = victims(state, current, n)
    for t in targets:
        t.evict(gone)
    out = state.join(gone.select("volume_id", "idx", F.lit(True).alias("_gone")), ["volume_id", "idx"], "left")
    return out.select(*[F.when(F.col("_gone"), 0).otherwise(F.col(c)).alias(c) if c == "state" else F.col(c) for c in state.columns])


def pending(keys: DataFrame, state: DataFrame, key: list[str]) -> DataFrame:
    """The keys that are neither resident nor settled as empty yet."""
    return keys.join(state.where("state <> 0").select(*key), key, "left_anti")


def both_groups(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """Chunks of a base and an overlay volume as one table, tagged by volume."""
    return base.withColumn("volume", F.lit("base")).unionByName(overlay.withColumn("volume", F.lit("overlay")))


def accumulated(histograms: DataFrame) -> DataFrame:
    """Resident chunks by epoch over volumes; a volume reported several times (volume_id, epochs: map) counts once."""
    one = histograms.dropDuplicates(["volume_id"]).select(F.explode("epochs").alias("access_epoch", "n"))
    return one.groupBy("access_epoch").agg(F.sum("n").alias("n"))


def touched_once(touches: DataFrame) -> DataFrame:
    """One touch of a chunk a frame."""
    return touches.dropDuplicates(["chunk", "frame"])


def evict_oldest(items: DataFrame, keep_bytes: int, by: str = "mtime", size: str = "bytes", key: str = "id", buckets: int = 1024) -> DataFrame:
    """The oldest items that must go so that at most keep_bytes stay.

    The running sum is two-level: per time bucket (a bounded window), then within the buckets.
    """
    ends = items.agg(F.min(by).alias("_a"), F.max(by).alias("_z"), F.sum(size).alias("_all"))
    b = items.crossJoin(F.broadcast(ends))  # a single row
    b = b.withColumn("_b", F.floor((F.col(by) - F.col("_a")) / F.greatest(F.col("_z") - F.col("_a"), F.lit(1)) * (buckets - 1)))
    per = b.groupBy("_b").agg(F.sum(size).alias("_s"))
    per = per.withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    w = Window.partitionBy("_b").orderBy(by, key).rowsBetween(Window.unboundedPreceding, -1)
    run = b.join(F.broadcast(per), "_b").withColumn("_cum", F.col("_before") + F.coalesce(F.sum(size).over(w), F.lit(0)))  # at most `buckets` rows
    return run.where(F.col("_cum") < F.col("_all") - keep_bytes).drop("_a", "_z", "_all", "_b", "_before", "_cum")


def epochs(fills: DataFrame, bytes_per_epoch: int, by: str = "seq", size: str = "bytes", group: str = "day") -> DataFrame:
    """Epoch after each group of fills: 1 + bytes so far // bytes per epoch, modulo 256 (per group, then over groups)."""
    per = fills.groupBy(group).agg(F.sum(size).alias("bytes"))
    run = F.sum("bytes").over(Window.orderBy(group).rowsBetween(Window.unboundedPreceding, 0))
    return per.withColumn("epoch", F.pmod(1 + idiv(run, bytes_per_epoch), F.lit(EPOCHS)).cast("int"))


def bytes_per_epoch(cap_bytes: int) -> int:
    return max(cap_bytes * 13 // 10 // EPOCHS, 1)


def offline(volumes: DataFrame, live: DataFrame) -> DataFrame:
    """Volumes without a live owner."""
    return volumes.join(live.select("volume_id"), "volume_id", "left_anti")


def pop_order(requests: DataFrame, now: int, max_age: int) -> DataFrame:
    """Requests (chunk, seq, t, durable) in the order of a last-in-first-out queue: a touch renews a chunk, and aged
    ones go unless durable."""
    latest = requests.groupBy("chunk").agg(F.max("seq").alias("seq"), F.max("t").alias("t"), F.max("durable").alias("durable"))
    return latest.where(F.col("durable") | (now - F.col("t") <= max_age)).orderBy(F.desc("seq"))


def assemble(wanted: DataFrame, native: DataFrame, sides: tuple[int, int, int], shape: tuple[int, int, int], size: int = 64) -> DataFrame:
    """Dense cache chunks (cx, cy, cz, bytes) filled from decoded native chunks (nx, ny, nz, bytes; z, y, x order).

    Each native chunk is decoded once, before it meets the cache chunks it overlaps; each cache chunk is one group.
    """
    parts = native_overlap(wanted.select("cx", "cy", "cz").distinct(), sides, shape, size).join(native, ["nx", "ny", "nz"])

    def run(table: pa.Table) -> pa.Table:
        c = [table.column(f"c{a}")[0].as_py() for a in "xyz"]
        out = np.zeros((size, size, size), np.uint8)
        for *n, raw in zip(*[table.column(k).to_pylist() for k in ("nx", "ny", "nz", "bytes")], strict=True):
            block = np.frombuffer(raw, np.uint8).reshape(sides[::-1])
            to, source = [], []
            for ci, ni, si, ei in zip(c, n, sides, shape, strict=True):
                low, high = max(ci * size, ni * si), min((ci + 1) * size, (ni + 1) * si, ei)
                to.append(slice(low - ci * size, high - ci * size))
                source.append(slice(low - ni * si, high - ni * si))
            out[tuple(to[::-1])] = block[tuple(source[::-1])]
        return pa.table({**{f"c{a}": pa.array([v], pa.int32()) for a, v in zip("xyz", c, strict=True)}, "bytes": pa.array([out.tobytes()], pa.binary())})

    return parts.groupBy("cx", "cy", "cz").applyInArrow(run, "cx int, cy int, cz int, bytes binary")


def latest(accesses: DataFrame, key: list[str], by: str = "seq") -> DataFrame:
    """The state of each chunk after its last access: (key, access_epoch, state)."""
    return accesses.groupBy(*key).agg(F.max_by(F.struct("access_epoch", "state"), by).alias("s")).select(*key, "s.*")
