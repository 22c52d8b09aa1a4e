"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Rows of equal text are one group. Groups of at least ``1 / (shards * FINE)`` of all bytes are packed as
they are: there are at most ``shards * FINE``. The others, however many, are bundled by a hash of their
text into ``shards * FINE`` bundles; a group lies whole in one bundle. So the list that is packed has a
bound whatever the corpus holds, and a bundle is small beside a shard.

Items sorted by size, largest first, enter the bin with the tightest sufficient room, found in a balanced
search tree of the bins' rooms. The capacity is the smallest at which all items fit into the wanted number
of shards, by bisection, so that the shards come out nearly equal in bytes (law ``bytes``). A group larger than an even
share has a shard to itself.

Defined results: a null text has no bytes and checksum 0, and forms a group with empty texts; repeated rows are
rows of their group; an empty table gives no rows; other columns pass by and one called like an output is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from periodica.llm.common import cut, text_of

#: Packed items for each shard, of large groups and of bundles each.
FINE = 200
#: Bytes a row takes beside its text.
ROW_BYTES = 16
#: Rows that one task numbers.
SLOT_ROWS = 200_000


class Rooms:
    """AA tree of (room, bin): a balanced binary search tree that finds the least room of at least a size."""

    def __init__(self):
        self.root = None  # a node is [key, level, left, right]

    def add(self, key: tuple[int, int]) -> None:
        self.root = self._add(self.root, key)

    def remove(self, key: tuple[int, int]) -> None:
        self.root = self._remove(self.root, key)

    def tightest(self, size: int) -> tuple[int, int] | None:
        node, best = self.root, None
        while node:
            if node[0] >= (size, -1):
                best, node = node[0], node[2]
            else:
                node = node[3]
        return best

    @staticmethod
    def _skew(n):
        if n and n[2] and n[2][1] == n[1]:
            left = n[2]
            n[2], left[3] = left[3], n
            return left
        return n

    @staticmethod
    def _split(n):
        if n and n[3] and n[3][3] and n[3][3][1] == n[1]:
            right = n[3]
            n[3], right[2] = right[2], n
            right[1] += 1
            return right
        return n

    def _add(self, n, key):
        if n is None:
            return [key, 1, None, None]
        side = 2 if key < n[0] else 3
        n[side] = self._add(n[side], key)
        return self._split(self._skew(n))

    def _remove(self, n, key):
        if n is None:
            return None
        if key == n[0]:
            if n[2] is None:
                return n[3]
            if n[3] is None:
                return n[2]
            heir = n[3]
            while heir[2]:
                heir = heir[2]
            n[0] = heir[0]
            n[3] = self._remove(n[3], heir[0])
        else:
            side = 2 if key < n[0] else 3
            n[side] = self._remove(n[side], key)
        level = min(n[2][1] if n[2] else 0, n[3][1] if n[3] else 0) + 1
        if level < n[1]:
            n[1] = level
            if n[3] and n[3][1] > level:
                n[3][1] = level
        n = self._skew(n)
        n[3] = self._skew(n[3])
        if n[3]:
            n[3][3] = self._skew(n[3][3])
        n = self._split(n)
        n[3] = self._split(n[3])
        return n


def best_fit(sizes: list[int], capacity: int, bins: int | None = None) -> list[int] | None:
    """The bin of each of ``sizes`` (sorted, largest first); None if over ``bins`` bins would be needed."""
    rooms, opened, placed = Rooms(), 0, []
    for size in sizes:
        found = rooms.tightest(size)
        if found is None:
            if size > capacity or opened == bins:
                return None
            room, where = capacity, opened
            opened += 1
        else:
            room, where = found
            rooms.remove(found)
        placed.append(where)
        rooms.add((room - size, where))
    return placed


def pack(sizes: list[int], bins: int) -> list[int]:
    """The bin of each of ``sizes`` (largest first) at the smallest capacity that ``bins`` bins allow, found by bisection.

    What is larger than an even share of the rest has a bin to itself and does not widen the others.
    """
    alone, rest = 0, sum(sizes)
    while alone < min(bins - 1, len(sizes)) and sizes[alone] * (bins - alone) > rest:
        rest -= sizes[alone]
        alone += 1
    return list(range(alone)) + [alone + where for where in _pack_evenly(sizes[alone:], bins - alone)]


def _pack_evenly(sizes: list[int], bins: int) -> list[int]:
    if not sizes:
        return []
    low = max(-(-sum(sizes) // bins), sizes[0])
    high, best = low, best_fit(sizes, low, bins)
    while best is None:
        high += max(1, high // 64)
        best = best_fit(sizes, high, bins)
    while low < high:
        middle = (low + high) // 2
        placed = best_fit(sizes, middle, bins)
        if placed is None:
            low = middle + 1
        else:
            best, high = placed, middle
    return best


def with_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """``docs`` with size, text_crc32, law, shard, slot (gapless from 0 in its shard) and grown_shard (null)."""
    spark = docs.sparkSession
    outputs = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    # Columns go by position, so that their names may hold dots; one that is called like an output, in any case, is replaced.
    passed = {f"_in_{i}": c for i, c in enumerate(docs.columns) if c.lower() not in outputs}
    named = docs.toDF(*(f"_in_{i}" for i in range(len(docs.columns))))
    doc, text = (f"_in_{docs.columns.index(c)}" for c in ("doc_id", "text"))
    rows = named.select(
        *passed,
        F.col(doc).alias("_id"),
        (F.octet_length(text_of(text)).cast("bigint") + ROW_BYTES).alias("size"),
        F.crc32(text_of(text).cast("binary")).alias("text_crc32"),
        F.xxhash64(text_of(text)).alias("_group"),
    )
    groups = cut(rows.groupBy("_group").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "groups")
    total, count = groups.agg(F.sum("bytes"), F.sum("n")).first()
    total = total or 0
    least = -(-total // (shards * FINE)) if total else 1
    bundle = F.pmod("_group", F.lit(shards * FINE))
    # A whole group or a bundle of small ones; at most shards * FINE of each.
    items = groups.select(
        F.when(F.col("bytes") >= least, F.col("_group")).alias("_large"),
        F.when(F.col("bytes") < least, bundle).alias("_bundle"),
        "bytes",
    )
    summed = items.groupBy("_large", "_bundle").agg(F.sum("bytes").alias("bytes"))
    listed = sorted(summed.collect(), key=lambda r: (-r.bytes, r._large is None, r._large or 0, r._bundle or 0))
    placed = pack([r.bytes for r in listed], shards)
    packed = [(r._large, r._bundle, p) for r, p in zip(listed, placed, strict=True)]
    places = spark.createDataFrame(packed, "_large bigint, _bundle bigint, _shard int")
    large = F.broadcast(places.where("_large is not null").select(F.col("_large").alias("_group"), F.col("_shard").alias("_s1")))
    small = F.broadcast(places.where("_bundle is not null").select("_bundle", F.col("_shard").alias("_s2")))
    sharded = (
        rows.withColumn("_bundle", bundle)
        .join(large, "_group", "left")
        .join(small, "_bundle", "left")
        .withColumn("shard", F.coalesce("_s1", "_s2"))
    )
    # Slots: each shard is dealt into parts that one task can number, and parts follow one another.
    parts = max(1, -(-(count or 0) // (shards * SLOT_ROWS)))
    part = F.pmod(F.xxhash64("_id", "text_crc32"), F.lit(parts)).cast("int")
    narrow = sharded.withColumn("_part", part)
    sizes = narrow.groupBy("shard", "_part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_part").orderBy("_id", "text_crc32", "size")
    numbered = narrow.withColumn("_row", F.row_number().over(within)).join(starts, ["shard", "_part"])
    return numbered.withColumns(
        {
            "slot": F.col("_start") + F.col("_row") - 1,
            "law": F.lit("bytes"),
            "grown_shard": F.lit(None).cast("int"),
        }
    ).select(*(F.col(at).alias(c) for at, c in passed.items()), *outputs)
