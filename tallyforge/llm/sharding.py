"""Shards by fixed virtual slots and a versioned slot-to-shard map.

A record belongs to one of thousands of slots by a hash of its id, for ever. Bytes are summed per slot, and a map gives
every slot a shard, the heaviest first to the lightest shard. Only the map changes when shards are added or drift apart.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyforge.session import cut

SLOTS = 8192
SHARDS = 16
#: A rebalanced map leaves no shard this share above the mean, where slots are small enough.
TOLERANCE = 0.005


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(id, size, text_crc32, virtual_slot); size is the text's UTF-8 bytes (null: none) plus 1."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    out = docs.select(F.col(f"`{id_col}`").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                      F.crc32(text.cast("binary")).alias("text_crc32"))
    key = F.when(F.col("id").isNull(), F.xxhash64("text_crc32", "size")).otherwise(F.xxhash64("id"))
    return out.withColumn("virtual_slot", F.pmod(key, F.lit(slots)).cast("int"))


def first_map(slot_bytes: dict[int, int], shards: int = SHARDS, slots: int = SLOTS) -> list[int]:
    """A shard for every slot: heaviest slot first, each to the lightest shard."""
    load = [(0, s) for s in range(shards)]
    out = [0] * slots
    for slot in sorted(range(slots), key=lambda v: (-slot_bytes.get(v, 0), v)):
        total, shard = heapq.heappop(load)
        out[slot] = shard
        heapq.heappush(load, (total + slot_bytes.get(slot, 0), shard))
    return out


def rebalanced(old: list[int], slot_bytes: dict[int, int], shards: int, tolerance: float = TOLERANCE) -> list[int]:
    """``old`` edited for ``shards`` shards: slots move one by one from the heaviest shard to the lightest.

    A move takes the largest slot that does not make the lightest shard the heavier of the two; what need not move stays.
    """
    new, load, held = list(old), [0] * shards, [set() for _ in range(shards)]
    homeless = []
    for slot, shard in enumerate(old):
        if shard < shards:
            load[shard] += slot_bytes.get(slot, 0)
            held[shard].add(slot)
        else:
            homeless.append(slot)
    for slot in sorted(homeless, key=lambda v: (-slot_bytes.get(v, 0), v)):
        to = min(range(shards), key=lambda s: (load[s], s))
        new[slot], load[to] = to, load[to] + slot_bytes.get(slot, 0)
        held[to].add(slot)
    mean = sum(load) / shards
    while True:
        top, low = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
        if load[top] <= mean * (1 + tolerance):
            return new
        fits = [v for v in held[top] if 0 < slot_bytes.get(v, 0) < load[top] - load[low]
                and load[low] + slot_bytes[v] <= max(mean * (1 + tolerance), (load[top] + load[low]) / 2)]
        if not fits:
            return new
        slot = max(fits, key=lambda v: (slot_bytes[v], -v))
        new[slot] = low
        held[top].remove(slot)
        held[low].add(slot)
        load[top] -= slot_bytes[slot]
        load[low] += slot_bytes[slot]


def save_map(spark: SparkSession, path: str, version: int, shard_of: list[int]) -> None:
    """Stores a version; earlier versions stay, and a version that exists is an error."""
    rows = spark.createDataFrame(list(enumerate(shard_of)), "virtual_slot int, shard int")
    rows.coalesce(1).write.mode("error").parquet(f"{path.rstrip('/')}/version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> list[int]:
    rows = spark.read.parquet(f"{path.rstrip('/')}/version={version}").orderBy("virtual_slot").collect()
    return [r["shard"] for r in rows]


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, slots: int = SLOTS,
           shard_of: list[int] | None = None) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot) for every row.

    The law is ``bytes``: sizes per shard are near equal. ``slot`` is the row's place in its shard, gapless from 0; equal
    rows take any order. ``shard_of`` gives the map, else a first one is made from the bytes per slot, of which the driver
    sees ``slots`` numbers. Rows without an id go by their text. An empty table gives no rows.
    """
    rows = cut(records(docs, id_col, text_col, slots), "records")
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    shard_of = shard_of or first_map({r["virtual_slot"]: r["bytes"] for r in sums}, shards, slots)
    filled, table = {}, []
    for r in sorted(sums):
        shard = shard_of[r["virtual_slot"]]
        table.append((r["virtual_slot"], shard, filled.get(shard, 0)))
        filled[shard] = filled.get(shard, 0) + r["n"]
    known = docs.sparkSession.createDataFrame(table, "virtual_slot int, shard int, before long")
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("id", "text_crc32", "size")) - 1
    return rows.withColumn("place", place).join(F.broadcast(known), "virtual_slot").select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
