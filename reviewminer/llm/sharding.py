"""Shards by fixed virtual slots and a versioned slot-to-shard map.

Records are hashed into ``SLOTS`` slots, bytes are summed per slot, and a map
of slots to shards is stored. Version 1 deals slots round; a rebalancing adds
a version in which slots moved from full shards to empty ones until the bytes
are near equal. Records never move between slots.

Null texts have one byte, as empty ones. Null and repeated doc_ids are hashed
with their text. Empty tables give empty tables.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SLOTS = 8192
SHARDS = 8
MAP_SCHEMA = "version int, slot int, shard int, bytes bigint"


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, vslot, at) without the text; ``at`` numbers the rows as they were written."""
    text = F.coalesce(F.col("text"), F.lit(""))
    hashed = F.pmod(F.xxhash64(F.col("doc_id"), text), F.lit(slots)).cast("int")
    return written(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            hashed.alias("vslot"),
            F.monotonically_increasing_id().alias("at"),
        ),
        "slots",
    )


def rebalanced(sizes: dict[int, int], owner: dict[int, int], shards: int) -> dict[int, int]:
    """The map edited so that bytes are near equal: only slots that have to move do.

    Shards above the mean give up slots, largest first, as long as they stay at
    or above it; the slots given up, and then single slots from the fullest to
    the emptiest shard, go wherever least lies. Work is bounded by the slots.
    """
    load = [0] * shards
    for slot, shard in owner.items():
        load[shard] += sizes.get(slot, 0)
    mean = sum(load) / shards
    owner, free = dict(owner), []
    for slot in sorted(owner, key=lambda s: (-sizes.get(s, 0), s)):
        size = sizes.get(slot, 0)
        if size and load[owner[slot]] > mean and (load[owner[slot]] - size >= mean or size > mean):
            load[owner[slot]] -= size
            free.append(slot)
    heap = [(v, k) for k, v in enumerate(load)]
    heapq.heapify(heap)
    for slot in free:
        value, shard = heapq.heappop(heap)
        owner[slot] = shard
        load[shard] = value + sizes[slot]
        heapq.heappush(heap, (load[shard], shard))
    for _ in range(len(owner)):
        high, low = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[high] - load[low]
        fits = [s for s in owner if owner[s] == high and 0 < sizes.get(s, 0) < gap]
        if not fits:
            break
        slot = min(fits, key=lambda s: (abs(gap / 2 - sizes[s]), s))
        owner[slot] = low
        load[high] -= sizes[slot]
        load[low] += sizes[slot]
    return owner


def slot_map(records: DataFrame, slots: int = SLOTS, shards: int = SHARDS, tolerance: float = 0.0) -> DataFrame:
    """Stored map(version, slot, shard, bytes), all versions. At most ``slots`` sums reach the driver."""
    found = records.groupBy("vslot").agg(F.sum("size").alias("bytes")).collect()
    sizes = {r["vslot"]: r["bytes"] for r in found}
    first = {s: s % shards for s in range(slots)}
    versions = [first]
    load = [sum(sizes.get(s, 0) for s in range(k, slots, shards)) for k in range(shards)]
    if sum(load) and max(load) > (1 + tolerance) * sum(load) / shards:
        versions.append(rebalanced(sizes, first, shards))
    rows = [(v + 1, s, k, sizes.get(s, 0)) for v, m in enumerate(versions) for s, k in m.items()]
    return written(records.sparkSession.createDataFrame(rows, MAP_SCHEMA).coalesce(1), "slot-map")


def sharded(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, vslot, version): rows numbered from 0 in every shard.

    Numbers are offsets of written pieces plus places within a piece, so that
    no shard passes through one task.
    """
    records = slotted(docs, slots)
    stored = slot_map(records, slots, shards)
    newest = stored.agg(F.max("version")).first()[0]
    current = stored.where(F.col("version") == newest).select(F.col("slot").alias("vslot"), "shard", "version")
    rows = records.join(F.broadcast(current), "vslot").withColumn("piece", F.shiftright("at", 33))
    counts = rows.groupBy("piece", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("piece", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("piece", "shard").orderBy("at")) - 1
    return rows.withColumn("place", place).join(offsets, ["piece", "shard"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("place")).alias("slot"), "vslot", "version"
    )
