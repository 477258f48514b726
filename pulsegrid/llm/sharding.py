"""Sharding by bytes: indivisible groups by best-fit decreasing into a fixed number of near-equal shards.

Two levels, both best-fit decreasing over a balanced tree of remaining capacities. First each block of
groups (a hash range, one sorted pass, memory bounded by its open bins) fills parcels of a fixed
capacity; groups above that capacity are parcels of their own. Then the parcels, at most
``PARCELS`` per shard and two per block, enter the shards at the smallest capacity that holds them all.
The driver sees parcels only, so what it holds does not grow with the corpus.

Equal texts are one group; null counts as the empty text. A group larger than a shard's share makes
that shard larger, since groups are indivisible. Repeated rows each take a place. An empty table gives
an empty result; further columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.llm.common import written

SHARDS = 24
#: Parcels that the mean shard is made of, and groups in a block.
PARCELS, BLOCK_GROUPS = 1000, 100_000
MOST_BLOCKS = 4096


class OpenBins:
    """Remaining capacities in order: B+-tree of two levels whose leaves split at ``LEAF`` entries."""

    LEAF = 512

    def __init__(self):
        self.leaves: list[list[tuple[int, int]]] = [[]]
        self.highest: list[tuple[int, int]] = []

    def add(self, remaining: int, number: int) -> None:
        entry = (remaining, number)
        k = min(bisect_left(self.highest, entry), len(self.leaves) - 1)
        leaf = self.leaves[k]
        insort(leaf, entry)
        if len(leaf) > self.LEAF:
            half = len(leaf) // 2
            self.leaves[k : k + 1] = [leaf[:half], leaf[half:]]
        if len(self.highest) == len(self.leaves):
            self._mark_one(k)
        else:
            self._mark()

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the tightest bin with room for ``size``."""
        k = bisect_left(self.highest, (size, -1))
        if k == len(self.highest):
            return None
        leaf = self.leaves[k]
        entry = leaf.pop(bisect_left(leaf, (size, -1)))
        if not leaf and len(self.leaves) > 1:
            del self.leaves[k]
            self._mark()
        else:
            self._mark_one(k) if leaf else self._mark()
        return entry

    def _mark(self) -> None:
        self.highest = [leaf[-1] for leaf in self.leaves if leaf]

    def _mark_one(self, k: int) -> None:
        self.highest[k] = self.leaves[k][-1]


def best_fit(sizes: Iterator[int], capacity: int) -> Iterator[int]:
    """Bin of each size in turn (decreasing): the tightest open bin, else a new one. Larger sizes get their own."""
    bins, opened = OpenBins(), 0
    for size in sizes:
        found = bins.take(size)
        if found is None:
            found = (max(capacity, size), opened)
            opened += 1
        bins.add(found[0] - size, found[1])
        yield found[1]


def shard_parcels(sizes: list[int], shards: int) -> list[int]:
    """Shard of each parcel: best-fit decreasing at the least capacity, to one part in a million, that needs no more shards."""
    order = sorted(range(len(sizes)), key=lambda k: (-sizes[k], k))
    in_order = [sizes[k] for k in order]
    total = sum(sizes)

    def fill(capacity: int) -> list[int] | None:
        out = []
        for b in best_fit(iter(in_order), capacity):
            if b >= shards:
                return None
            out.append(b)
        return out

    low, high = -(-total // shards), max(total, 1)
    least = max(in_order, default=0)
    low, best = max(low, least), fill(high)
    while high - low > max(1, total // 1_000_000 // shards):
        middle = (low + high) // 2
        found = fill(middle)
        if found is None:
            low = middle + 1
        else:
            high, best = middle, found
    out = [0] * len(sizes)
    for k, b in zip(order, best or []):
        out[k] = b
    return out


def parcels_of(groups: DataFrame, capacity: int, blocks: int) -> DataFrame:
    """(block, parcel) of every group: best-fit decreasing within the block its key hashes to."""
    sorted_groups = (
        groups.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
        .repartition("block")
        .sortWithinPartitions("block", F.col("bytes").desc(), "key")
        .select("block", "key", "bytes")
    )

    def run(batches):
        at, bins, opened = None, OpenBins(), 0
        for batch in batches:
            parcels = []
            for block, size in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if block != at:
                    at, bins, opened = block, OpenBins(), 0
                found = bins.take(size)
                if found is None:
                    found, opened = (max(capacity, size), opened), opened + 1
                bins.add(found[0] - size, found[1])
                parcels.append(found[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parcels, pa.int32())], names=["block", "key", "bytes", "parcel"])

    return sorted_groups.mapInArrow(run, "block int, key binary, bytes long, parcel int")


def shard_by_bytes(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``rows`` (key binary, size long, any others) with shard and slot; rows of one key stay together."""
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "sized")
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    groups = written(groups, "groups")
    total, n = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    capacity = max(1, total // (shards * PARCELS))
    blocks = max(1, min(MOST_BLOCKS, n // BLOCK_GROUPS))
    parcels = written(parcels_of(groups, capacity, blocks), "parcels")
    filled = parcels.groupBy("block", "parcel").agg(F.sum("bytes").alias("bytes")).orderBy("block", "parcel").collect()
    chosen = shard_parcels([p.bytes for p in filled], shards)
    by_parcel = rows.sparkSession.createDataFrame([(p.block, p.parcel, s) for p, s in zip(filled, chosen)], "block int, parcel int, shard int")
    # at most 2 * PARCELS * shards + MOST_BLOCKS parcels, whatever the corpus
    placed = parcels.join(F.broadcast(by_parcel), ["block", "parcel"])
    # the few keys that hold more than a parcel would make hot join keys; fewer than PARCELS * shards of them
    large = F.broadcast(placed.where(F.col("bytes") > capacity).select("key", F.col("shard").alias("large_shard")))
    rest = rows.join(large, "key", "left")
    hot = rest.where("large_shard IS NOT NULL").withColumnRenamed("large_shard", "shard")
    small = placed.where(F.col("bytes") <= capacity).select("key", "shard")
    cold = rest.where("large_shard IS NULL").drop("large_shard").join(small, "key")
    return with_slots(written(hot.unionByName(cold), "sharded"))


def with_slots(sharded: DataFrame) -> DataFrame:
    """Gapless numbers within each shard: rows counted per (shard, input part), then numbered within it."""
    part = F.shiftright("row", 33).alias("part")
    per_part = sharded.groupBy("shard", part).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = per_part.select("shard", "part", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row")) - 1
    numbered = sharded.withColumn("part", part).withColumn("inside", inside)
    return numbered.join(before, ["shard", "part"]).withColumn("slot", F.col("before") + F.col("inside")).drop("before", "inside", "part", "row")


def shard_documents(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null: this law has none)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = documents.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"),
    )
    placed = shard_by_bytes(sized, shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
