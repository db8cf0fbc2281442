"""Sharding over fixed virtual slots.

A record's slot is a hash of its key modulo a fixed number of slots.  Bytes are
summed per slot, and a small versioned map says which shard holds a slot.  The
map is a table in the shared folder, one folder per version, and a version is
never changed once written.  Rebalancing loads the last version and writes the
next: version 1 is filled largest slot first, each later version moves only the
slots that it must.  A slot that would be more than a fraction of a shard (one
key with a third of the rows) is split into slots of its own, numbered by the
slot and a salt.  The salt is drawn once and returned with the records, and a
slot that was split stays split in later versions, so that an old map means the
same records later.

Defined results: a null text has no bytes; a null key is a key of its own;
repeated rows are placed each for itself; a text of any length is one record;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickweave.workspace import materialise, shared_root

SLOTS = 8192
#: Each record costs this many bytes besides its text.
OVERHEAD = 8
#: Parts into which an overfull slot is split.
SPLIT = 512


@dataclass(frozen=True)
class SlotMap:
    """Which shard holds a slot, by version, and which slots are split; a version is never changed once written."""

    shards: int
    owner: dict[int, int]
    version: int = 1
    moved: tuple[int, ...] = field(default=())
    split: frozenset[int] = field(default=frozenset())

    @classmethod
    def balanced(cls, weight: dict[int, int], shards: int, split: frozenset[int] = frozenset()) -> SlotMap:
        """Longest slot first onto the lightest shard."""
        heap = [(0, s) for s in range(shards)]
        owner = {}
        for slot in sorted(weight, key=lambda s: (-weight[s], s)):
            load, shard = heapq.heappop(heap)
            owner[slot] = shard
            heapq.heappush(heap, (load + weight[slot], shard))
        return cls(shards, owner, split=split)

    def rebalanced(self, weight: dict[int, int], shards: int, split: frozenset[int] = frozenset()) -> SlotMap:
        """The next version: slots leave shards only to fill those that lack bytes."""
        fair = sum(weight.values()) / shards
        owner = {s: k for s, k in self.owner.items() if k < shards}
        load = dict.fromkeys(range(shards), 0)
        held: dict[int, list[int]] = {k: [] for k in range(shards)}
        for s, k in owner.items():
            load[k] += weight.get(s, 0)
            held[k].append(s)
        loose = [s for s in weight if s not in owner]
        for k, slots in held.items():
            for s in sorted(slots, key=lambda s: (-weight.get(s, 0), s)):
                if load[k] > fair and load[k] - weight.get(s, 0) >= fair:
                    load[k] -= weight.get(s, 0)
                    loose.append(s)
        heap = [(v, k) for k, v in load.items()]
        heapq.heapify(heap)
        for s in sorted(loose, key=lambda s: (-weight.get(s, 0), s)):
            v, k = heapq.heappop(heap)
            owner[s] = k
            heapq.heappush(heap, (v + weight.get(s, 0), k))
        moved = tuple(sorted(s for s in owner if self.owner.get(s) != owner[s]))
        return SlotMap(shards, owner, self.version + 1, moved, self.split | split)

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes this version below ``path``; an existing version is an error."""
        rows = [(s, k, s in self.split, self.shards) for s, k in self.owner.items()] + [(s, None, True, self.shards) for s in self.split if s not in self.owner]
        table = spark.createDataFrame(rows, "virtual_slot long, shard int, split boolean, shards int").coalesce(1)
        table.write.mode("errorifexists").parquet(f"{path}/version={self.version}")

    @staticmethod
    def versions(spark: SparkSession, path: str) -> list[int]:
        """The versions stored below ``path``, in order."""
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in system.listStatus(folder)] if system.exists(folder) else []
        return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap | None:
        """A stored version, the last if none is named; None if there is none."""
        known = cls.versions(spark, path)
        if not known:
            return None
        chosen = known[-1] if version is None else version
        rows = spark.read.parquet(f"{path}/version={chosen}").collect()  # a row per slot
        owner = {r.virtual_slot: r["shard"] for r in rows if r["shard"] is not None}
        return cls(rows[0]["shards"] if rows else 1, owner, chosen, split=frozenset(r.virtual_slot for r in rows if r["split"]))


def records(docs: DataFrame, key: str = "doc_id", slots: int = SLOTS, salt: str | None = None) -> DataFrame:
    """key, size, text_crc32, virtual_slot and salt of every row, written once; ``salt``: the column with earlier salts."""
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    drawn = F.floor(F.rand(7) * SPLIT).cast("long")
    rows = docs.select(
        F.col(key).cast("long").alias(key),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(slots)).cast("long").alias("virtual_slot"),
        (F.coalesce(F.col(salt).cast("long"), drawn) if salt else drawn).alias("salt"),
    )
    return materialise(rows, "records")


def split_slots(rows: DataFrame, split: frozenset[int], slots: int = SLOTS) -> DataFrame:
    """Gives the rows of split slots the slots of their salts."""
    if not split:
        return rows
    fresh = F.lit(slots) + F.col("virtual_slot") * SPLIT + F.col("salt")
    return rows.withColumn("virtual_slot", F.when(F.col("virtual_slot").isin(sorted(split)), fresh).otherwise(F.col("virtual_slot")).cast("long"))


def slot_bytes(rows: DataFrame) -> dict[int, int]:
    """Bytes per slot: a row per slot, a fixed number of slots."""
    return {r.virtual_slot: r["bytes"] for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes")).collect()}


def shard(docs: DataFrame, shards: int = 24, key: str = "doc_id", slots: int = SLOTS, *, map_path: str | None = None, salt: str | None = None) -> DataFrame:
    """key, size, text_crc32, law 'bytes', shard, slot (place in the shard), grown_shard, virtual_slot, salt, map_version.

    ``map_path``: the folder of the versioned map.  Its last version is
    rebalanced and the next one written; where there is none (and by default, in
    a new folder of the shared one) version 1 is.
    """
    spark = docs.sparkSession
    path = map_path or f"{shared_root(spark)}/slot-map-{uuid.uuid4().hex}"
    before = SlotMap.load(spark, path)
    rows = records(docs, key, slots, salt)
    weight = slot_bytes(rows)
    limit = sum(weight.values()) / shards / 4
    split = frozenset(s for s, w in weight.items() if w > limit) | (before.split if before else frozenset())  # over a quarter of a shard: 4 * shards a version at most
    rows = split_slots(rows, split, slots)
    if split:
        weight = slot_bytes(rows)
    chosen = before.rebalanced(weight, shards, split) if before else SlotMap.balanced(weight, shards, split)
    chosen.save(spark, path)
    owners = spark.read.parquet(f"{path}/version={chosen.version}").where("shard is not null").select("virtual_slot", "shard")
    # A slot is ranked for itself; what stands before it in its shard is a sum over slots.
    counts = rows.groupBy("virtual_slot").agg(F.count("*").alias("n")).join(F.broadcast(owners), "virtual_slot")
    ahead = F.sum("n").over(Window.partitionBy("shard").orderBy("virtual_slot")) - F.col("n")
    starts = counts.select("virtual_slot", "shard", ahead.alias("before"))
    order = Window.partitionBy("virtual_slot").orderBy(key, "text_crc32", "size", "salt")
    ranked = rows.withColumn("rank", F.row_number().over(order) - 1).join(F.broadcast(starts), "virtual_slot")  # a row per slot
    return ranked.select(
        key,
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("before") + F.col("rank")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        "salt",
        F.lit(chosen.version).alias("map_version"),
    )
