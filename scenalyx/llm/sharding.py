"""Sharding by fixed virtual slots, with DataFrame functions only.

A record's doc_id hashes into one of ``SLOTS`` virtual slots, for good. A
versioned map names each slot's shard; rebalancing edits the map and moves whole
slots, never single records. The maps are a table in the shared folder
(``MapStore``): a version is written once, rows are placed by the version that is
read back, and an edit writes the next one. ``grow`` opens a shard by taking an
equal number of slots from the others, so one more shard takes rows only into
itself; ``rebalance`` moves slots from heavy to light shards by the bytes that were
aggregated per slot.

Law ``key``, that of the query: version 1 is the first map and version 2 the grown
one; both depend on the shard count alone, so doc_id and shard count decide where a
row goes. Law ``bytes``: version 2 is version 1 rebalanced, and places the rows. A
row's place in its shard is its rank within its virtual slot after the counts of
the shard's earlier slots, so no task holds a shard; slots are split further, and
evenly whatever the rows are, by the rows' numbers in their input.

Defined cases: null text has size 1 and the CRC of no bytes; a null doc_id has a
slot of its own, too; equal doc_ids share a slot, equal rows take places of their
own; other columns are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .spark import checkpoint_dir, cut, session_of

SLOTS = 4096
SPLITS = 64


@dataclass(frozen=True)
class SlotMap:
    """Version and the shard of every slot."""

    version: int
    shards: tuple[int, ...]

    @property
    def count(self) -> int:
        return max(self.shards) + 1


def initial(shards: int, slots: int = SLOTS) -> SlotMap:
    return SlotMap(1, tuple(s % shards for s in range(slots)))


def grow(old: SlotMap) -> SlotMap:
    """One more shard: each of the others gives it the last of its slots, as equal in number as they come."""
    n, new = old.count, list(old.shards)
    want = len(new) // (n + 1)
    mine = {k: [s for s, x in enumerate(old.shards) if x == k] for k in range(n)}
    for _ in range(want):
        most = max(mine, key=lambda k: (len(mine[k]), -k))
        new[mine[most].pop()] = n
    return SlotMap(old.version + 1, tuple(new))


def rebalance(old: SlotMap, slot_bytes: dict[int, int], tolerance: float = 0.01) -> SlotMap:
    """The next version: slots move from the fullest to the emptiest shard while that evens out their bytes."""
    new, n = list(old.shards), old.count
    load = [0] * n
    for s, k in enumerate(new):
        load[k] += slot_bytes.get(s, 0)
    goal = sum(load) / n
    for _ in range(len(new)):
        high, low = max(range(n), key=load.__getitem__), min(range(n), key=load.__getitem__)
        room = (load[high] - load[low]) / 2
        fits = [s for s, k in enumerate(new) if k == high and 0 < slot_bytes.get(s, 0) <= room]
        if load[high] <= goal * (1 + tolerance) or not fits:
            break
        move = max(fits, key=lambda s: slot_bytes[s])
        new[move] = low
        load[high] -= slot_bytes[move]
        load[low] += slot_bytes[move]
    return SlotMap(old.version + 1, tuple(new))


def virtual_slot(doc_id: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(slots)).cast("int")


class MapStore:
    """Slot-to-shard maps by version: folders ``version=n`` of (virtual_slot, shard), each written once."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{checkpoint_dir(spark)}/slot-maps-{uuid.uuid4().hex}"

    def put(self, new: SlotMap) -> SlotMap:
        """Store a version; one that is there already is an error, so two edits of one map cannot both win."""
        rows = self.spark.createDataFrame(list(enumerate(new.shards)), "virtual_slot int, shard int")
        rows.coalesce(1).write.mode("error").parquet(f"{self.path}/version={new.version}")
        return new

    def table(self, version: int) -> DataFrame:
        return self.spark.read.schema("virtual_slot int, shard int").parquet(f"{self.path}/version={version}")

    def get(self, version: int) -> SlotMap:
        rows = self.table(version).orderBy("virtual_slot").collect()  # one row a slot
        return SlotMap(version, tuple(r["shard"] for r in rows))

    def grow(self, version: int) -> SlotMap:
        return self.put(grow(self.get(version)))

    def rebalance(self, version: int, loads: DataFrame) -> SlotMap:
        """Edit a version by the bytes per slot (virtual_slot, slot_bytes), at most one row a slot."""
        return self.put(rebalance(self.get(version), {r["virtual_slot"]: r["slot_bytes"] for r in loads.select("virtual_slot", "slot_bytes").collect()}))


def slot_bytes(sized: DataFrame) -> DataFrame:
    return sized.groupBy("virtual_slot").agg(F.sum("size").alias("slot_bytes"), F.count(F.lit(1)).alias("slot_rows"))


def shard(docs: DataFrame, shards: int = 16, law: str = "key", store: MapStore | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, slot_bytes, map_version of every row."""
    spark = session_of(docs)
    store = store or MapStore(spark)
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    # the split is no rule for rows: it only deals them out, and the checkpoint keeps it
    sized = cut(sized.withColumn("virtual_slot", virtual_slot(F.col("doc_id"))).withColumn("split", F.pmod(F.monotonically_increasing_id(), F.lit(SPLITS)).cast("int")))
    loads = slot_bytes(sized)
    first = store.put(initial(shards))
    other = store.grow(first.version) if law == "key" else store.rebalance(first.version, loads)
    now = first.version if law == "key" else other.version
    grown = store.table(other.version).select("virtual_slot", F.col("shard").alias("grown_shard"))
    table = store.table(now).join(grown, "virtual_slot")
    if law != "key":
        table = table.withColumn("grown_shard", F.lit(None).cast("int"))
    # SLOTS rows may be broadcast; counts of splits meet the rows on the keys of their window, which are dealt alike
    loads = loads.join(F.broadcast(table), "virtual_slot")
    counts = sized.groupBy("virtual_slot", "split").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(table.select("virtual_slot", "shard")), "virtual_slot")
    before = counts.withColumn("skip", F.sum("n").over(Window.partitionBy("shard").orderBy("virtual_slot", "split")) - F.col("n")).select("virtual_slot", "split", "skip")
    nth = F.row_number().over(Window.partitionBy("virtual_slot", "split").orderBy("doc_id", "text_crc32", "size")) - 1
    out = sized.withColumn("nth", nth).join(before, ["virtual_slot", "split"]).join(F.broadcast(loads), "virtual_slot")
    return out.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("skip") + F.col("nth")).cast("long").alias("slot"), "grown_shard", "virtual_slot", "slot_bytes", F.lit(now).alias("map_version"))
