"""Operator 4: sharding with fixed virtual slots.

Records hash into SLOTS virtual slots; bytes and rows are summed per slot; a versioned map sends slots to shards.
Version 0 deals slots out in equal ranges; rebalancing edits the map (moves and swaps of slots between the fullest and
the emptiest shard) and stores the next version, so only the edited slots' records move.  Only per-slot sums, SLOTS
rows whatever the input, reach the driver.

Law: bytes.  A record's place within its shard (gapless from 0) is its rank in its virtual slot plus the records of
the shard's slots before it.

Defined results: null text has no bytes (size 16) and the checksum 0 of the empty text; rows with null doc_id are
placed by their checksum; rows equal in every column share a virtual slot and get places of their own; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelarium.llm.base import shared_dir

SHARDS, SLOTS, OVERHEAD = 40, 8192, 16


class SlotMap:
    """shard_of[slot], a version number, and the edits (slot, from, to) that led from the version before."""

    def __init__(self, shard_of: list[int], shards: int, version: int = 0, edits=()):
        self.shard_of, self.shards, self.version, self.edits = shard_of, shards, version, list(edits)

    @classmethod
    def initial(cls, shards: int = SHARDS, slots: int = SLOTS) -> SlotMap:
        return cls([s * shards // slots for s in range(slots)], shards)

    def rebalanced(self, weight: list[int], shards: int | None = None) -> SlotMap:
        """The next version: slots move from the fullest to the emptiest shard while that brings the two nearer.

        shards: may be more than now; new shards start empty.
        """
        shards = shards or self.shards
        held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
        for slot, shard in enumerate(self.shard_of):
            if weight[slot]:
                held[shard].append((weight[slot], slot))
        for x in held:
            x.sort()
        load = [sum(w for w, _ in x) for x in held]
        now = list(self.shard_of)

        def move(item, a, b):
            held[a].pop(bisect.bisect_left(held[a], item))
            bisect.insort(held[b], item)
            load[a] -= item[0]
            load[b] += item[0]
            now[item[1]] = b

        for _ in range(8 * len(self.shard_of)):
            a, b = max(range(shards), key=lambda i: (load[i], -i)), min(range(shards), key=lambda i: (load[i], i))
            gap = load[a] - load[b]
            if gap <= 1:
                break
            at = bisect.bisect_left(held[a], (gap / 2, 0))
            near = [held[a][i] for i in (at - 1, at) if 0 <= i < len(held[a]) and held[a][i][0] < gap]
            best = min(near, key=lambda x: abs(x[0] - gap / 2), default=None)
            swap = None
            for x in held[a]:  # or trade a slot for a smaller one
                i = bisect.bisect_left(held[b], (x[0] - gap / 2, 0))
                for y in held[b][max(0, i - 1) : i + 1]:
                    d = x[0] - y[0]
                    if 0 < d < gap and (swap is None or abs(d - gap / 2) < abs(swap[0][0] - swap[1][0] - gap / 2)):
                        swap = (x, y)
                if swap and abs(swap[0][0] - swap[1][0] - gap / 2) < 1:
                    break
            if best and (not swap or abs(best[0] - gap / 2) <= abs(swap[0][0] - swap[1][0] - gap / 2)):
                move(best, a, b)
            elif swap:
                move(swap[0], a, b)
                move(swap[1], b, a)
            else:
                break
        return SlotMap(now, shards, self.version + 1, [(s, x, y) for s, (x, y) in enumerate(zip(self.shard_of, now, strict=True)) if x != y])

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.version, s, x) for s, x in enumerate(self.shard_of)], "map_version int, virtual_slot int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Append this version to the map's folder."""
        self.table(spark).write.mode("overwrite").parquet(f"{path}/version={self.version}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int, shards: int) -> SlotMap:
        rows = spark.read.parquet(f"{path}/version={version}").orderBy("virtual_slot").collect()
        return cls([r.shard for r in rows], shards, version)


def slot_of(slots: int = SLOTS):
    """A record's virtual slot: by doc_id and checksum."""
    return F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int")


def records(docs: DataFrame, slots: int = SLOTS, *keep) -> DataFrame:
    data = F.encode(F.col("text"), "UTF-8")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"), F.crc32(F.coalesce(data, F.lit(b""))).alias("text_crc32"), *keep)
    return out.withColumn("virtual_slot", slot_of(slots))


PLACED = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "virtual_slot", "map_version")


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, whole_rows: bool = False) -> DataFrame:
    """The columns PLACED and, with whole_rows, those of docs that have other names."""
    spark = docs.sparkSession
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if whole_rows else []
    sums = {r.virtual_slot: (r.b, r.n) for r in records(docs, slots).groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}
    first = SlotMap.initial(shards, slots)
    current = first.rebalanced([sums.get(s, (0, 0))[0] for s in range(slots)])
    path = f"{shared_dir(spark)}/slot-maps/{uuid.uuid4().hex}"
    first.save(spark, path)
    current.save(spark, path)
    before, seen = [], [0] * shards
    for s, x in enumerate(current.shard_of):
        before.append((s, x, seen[x], current.version))
        seen[x] += sums.get(s, (0, 0))[1]
    places = spark.createDataFrame(before, "virtual_slot int, shard int, _before long, map_version int")
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")) - 1
    # one row per virtual slot: the map is as large for any input
    out = records(docs, slots, *row).withColumn("_rank", rank).join(F.broadcast(places), "virtual_slot")
    out = out.withColumn("law", F.lit("bytes")).withColumn("slot", (F.col("_before") + F.col("_rank")).cast("long")).withColumn("grown_shard", F.lit(None).cast("int"))
    others = [c for c in docs.columns if c.lower() not in PLACED] if whole_rows else []
    return out.select(*PLACED, *[F.col(f"_row.`{c}`") for c in others])


def op4_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
