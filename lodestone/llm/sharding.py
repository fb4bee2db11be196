"""Sharding by best-fit-decreasing bin packing of indivisible groups (documents of equal text).

Groups of at least 1/fineness of all bytes are items of their own: there are at most ``fineness`` of them whatever the
input. All smaller groups are counted by size class: sizes below 4096 are classes of their own, above a class spans
less than 1/2048 of its size. The driver packs the classes' groups one by one, in decreasing size, each into the bin
with the tightest remaining capacity; equal sizes go there in runs, as the tightest bin stays so until it is full. So
it holds at most ``fineness`` items and some ten thousand classes, and every group is placed by its own size. The
executors group, rank the groups of a class, join and number rows with DataFrame operations only.

Null text counts as empty (size 1). Repeated rows are one group and each get a slot. A null id is sharded like any
other. An empty table gives an empty result. A group larger than a shard's even part makes that shard as large.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Groups of at least this part of all bytes are packed singly.
FINENESS = 50_000
#: Bits of a size that tell its class.
_BITS = 12
#: Values in a leaf of the tree of remaining capacities.
_LEAF = 256


class CapacityTree:
    """Two-level balanced search tree of (remaining capacity, bin): leaves split when full, so a search or a change
    costs two bisections."""

    def __init__(self) -> None:
        self.leaves: list[list[tuple[int, int]]] = [[]]
        self.lows: list[tuple[int, int]] = [(-1, -1)]

    def add(self, capacity: int, at: int) -> None:
        k = max(0, bisect_left(self.lows, (capacity, at + 1)) - 1)
        leaf = self.leaves[k]
        insort(leaf, (capacity, at))
        if len(leaf) > 2 * _LEAF:
            self.leaves[k : k + 1] = [leaf[:_LEAF], leaf[_LEAF:]]
            self.lows[k : k + 1] = [self.lows[k], leaf[_LEAF]]

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the least capacity that is at least size."""
        k = max(0, bisect_left(self.lows, (size, -1)) - 1)
        for leaf in self.leaves[k:]:
            i = bisect_left(leaf, (size, -1))
            if i < len(leaf):
                return leaf.pop(i)
        return None


def best_fit_runs(runs: list[tuple[int, int]], capacity: int) -> list[list[tuple[int, int]]]:
    """For each (size, count), in the order given: (bin, how many) of its items, as best fit would place them one by
    one. Bins hold at most capacity, an item above it has a bin to itself."""
    tree, out, used = CapacityTree(), [[] for _ in runs], 0
    for i in sorted(range(len(runs)), key=lambda i: (-runs[i][0], i)):
        size, left = runs[i]
        while left:
            found = tree.take_tightest(size)
            if found is None:
                found = (max(capacity, size), used)
                used += 1
            n = min(left, found[0] // size)
            out[i].append((found[1], n))
            tree.add(found[0] - n * size, found[1])
            left -= n
    return out


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size; bins hold at most capacity, an item above it has a bin to itself."""
    return [placed[0][0] for placed in best_fit_runs([(s, 1) for s in sizes], capacity)]


def into_shards(runs: list[tuple[int, int]], shards: int) -> list[list[tuple[int, int]]]:
    """Bins 0 .. shards - 1 of nearly equal bytes: the least capacity, by halving, at which best fit needs no more."""
    low = max([-(-sum(s * n for s, n in runs) // shards), *(s for s, _ in runs)], default=0)
    high = 2 * low + 1
    best = best_fit_runs(runs, high)
    while low < high:
        mid = (low + high) // 2
        bins = best_fit_runs(runs, mid)
        if max((b for placed in bins for b, _ in placed), default=0) < shards:
            best, high = bins, mid
        else:
            low = mid + 1
    return best


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and group (a digest of the text) of each row."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.unhex(F.md5(data)).alias("group"))


def shard(docs: DataFrame, shards: int = 8, fineness: int = FINENESS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row; rows of equal text share a shard."""
    spark = docs.sparkSession
    rows = measured(docs)
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes")).checkpoint()
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    large = groups.filter(F.col("bytes") * fineness >= total).select("group", "bytes").collect()  # at most fineness rows
    large.sort(key=lambda r: (r["bytes"], bytes(r["group"])))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size_class = F.expr(f"shiftleft(shiftright(bytes, greatest(length(bin(bytes)) - {_BITS}, 0)), greatest(length(bin(bytes)) - {_BITS}, 0))")
    small = groups.filter(F.col("bytes") * fineness < total).select("group", "bytes", size_class.alias("class"), F.pmod(F.xxhash64("group"), F.lit(4 * parts)).cast("int").alias("part"))
    counts = small.groupBy("class", "part").agg(F.count("*").alias("count"), F.sum("bytes").alias("bytes")).checkpoint()
    classes = counts.groupBy("class").agg(F.sum("count").alias("count"), F.sum("bytes").alias("bytes")).orderBy("class").collect()  # bounded by the bits
    bins = into_shards([(r["bytes"], 1) for r in large] + [(-(-r["bytes"] // r["count"]), r["count"]) for r in classes], shards)
    of_group = spark.createDataFrame([(r["group"], b[0][0]) for r, b in zip(large, bins[: len(large)], strict=True)], "group binary, shard int")
    of_class = spark.createDataFrame([(r["class"], [x for x, _ in b], list(accumulate(n for _, n in b))) for r, b in zip(classes, bins[len(large) :], strict=True)], "class long, shards array<int>, ends array<long>")

    # the rank of a small group in its class, counted over parts, tells its shard
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("class", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    ranked = small.withColumn("rank", F.row_number().over(Window.partitionBy("class", "part").orderBy("group")) - 1).join(starts, ["class", "part"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("start")).join(F.broadcast(of_class), "class")
    ranked = ranked.select("group", F.expr("shards[size(filter(ends, e -> e <= rank))]").alias("shard"))
    own = F.broadcast(of_group)
    # rows of large groups stay out of the shuffle
    placed = rows.join(own, "group").unionByName(rows.join(own, "group", "left_anti").join(ranked, "group").select("group", *rows.drop("group").columns, "shard"))
    placed = placed.select("doc_id", "size", "text_crc32", "shard")

    placed = placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(4 * parts)).cast("int"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "part").count().select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32")
    return placed.withColumn("n", F.row_number().over(within) - 1).join(offsets, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("n") + F.col("offset")).alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
