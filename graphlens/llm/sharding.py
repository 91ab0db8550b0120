"""Sharding by best-fit-decreasing bin packing of indivisible groups.

A group is all rows with equal texts (null as empty); it must not be split. Groups sorted by size enter the bin with the
tightest remaining capacity that holds them, found in a balanced tree (a treap keyed by remaining capacity). Groups of
one size are interchangeable, so the packing runs over the histogram of group sizes: distinct sizes of groups that add
up to T bytes are at most sqrt(2 T), which bounds what the driver sees; no fingerprint of a document is sent there.

``capacity`` given: the fewest shards of that capacity that best fit decreasing finds. ``n_shards`` given: the least
capacity with which it needs no more shards; groups above the mean of what is left get a shard of their own first.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.llm import common

Histogram = list[tuple[int, int]]
Run = tuple[int, int, int, int]


class Treap:
    """A balanced search tree of bins by remaining capacity; each node holds the bins with that capacity."""

    def __init__(self) -> None:
        self.left: list[int] = [-1]
        self.right: list[int] = [-1]
        self.key: list[int] = [-1]
        self.heap: list[int] = [0]
        self.bins: list[deque] = [deque()]
        self.root, self.seed = -1, 1

    def _node(self, key: int, bin_: int) -> int:
        self.seed = (self.seed * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        for column, value in ((self.left, -1), (self.right, -1), (self.key, key), (self.heap, self.seed >> 16), (self.bins, deque([bin_]))):
            column.append(value)
        return len(self.key) - 1

    def _split(self, at: int, key: int) -> tuple[int, int]:
        """Nodes below ``key``, and the others."""
        if at < 0:
            return -1, -1
        if self.key[at] < key:
            low, high = self._split(self.right[at], key)
            self.right[at] = low
            return at, high
        low, high = self._split(self.left[at], key)
        self.left[at] = high
        return low, at

    def _merge(self, a: int, b: int) -> int:
        if a < 0 or b < 0:
            return max(a, b)
        if self.heap[a] > self.heap[b]:
            self.right[a] = self._merge(self.right[a], b)
            return a
        self.left[b] = self._merge(a, self.left[b])
        return b

    def ceiling(self, size: int) -> int:
        """The node of the least remaining capacity of at least ``size``; -1 if there is none."""
        at, best = self.root, -1
        while at >= 0:
            if self.key[at] >= size:
                best, at = at, self.left[at]
            else:
                at = self.right[at]
        return best

    def add(self, room: int, bin_: int) -> None:
        node = self.ceiling(room)
        if node >= 0 and self.key[node] == room:
            self.bins[node].append(bin_)
            return
        low, high = self._split(self.root, room)
        self.root = self._merge(self._merge(low, self._node(room, bin_)), high)

    def take(self, node: int) -> tuple[int, int]:
        """Remaining capacity and number of the first bin of a node, which leaves the tree."""
        room, bin_ = self.key[node], self.bins[node].popleft()
        if not self.bins[node]:
            low, rest = self._split(self.root, room)
            _, high = self._split(rest, room + 1)
            self.root = self._merge(low, high)
        return room, bin_


def best_fit_decreasing(histogram: Histogram, capacity: int, most: int | None = None, first_bin: int = 0) -> tuple[list[Run], int] | None:
    """Runs (size, first rank, groups, bin) and the number of bins; None once more than ``most`` bins are needed.

    The bin that an item has entered stays the tightest that holds one more, so equal items enter it together.
    """
    tree, runs, opened = Treap(), [], 0
    for size, many in sorted(histogram, reverse=True):
        rank = 0
        while rank < many:
            node = tree.ceiling(size)
            if node < 0:
                if opened == most:
                    return None
                room, bin_ = max(capacity, size), opened
                opened += 1
            else:
                room, bin_ = tree.take(node)
            fits = min(room // size if size else many, many - rank)
            runs.append((size, rank, fits, first_bin + bin_))
            rank += fits
            tree.add(room - fits * size, bin_)
    return runs, opened


def pack_groups(histogram: Histogram, n_shards: int) -> tuple[list[Run], int]:
    """``n_shards`` shards of nearly equal size."""
    left, alone = {s: c for s, c in histogram if c > 0}, []
    total = sum(s * c for s, c in left.items())
    taken: dict[int, int] = {}
    while left and n_shards - len(alone) > 1 and (top := max(left)) * (n_shards - len(alone)) > total:
        alone.append((top, taken.get(top, 0), 1, len(alone)))
        taken[top] = taken.get(top, 0) + 1
        total -= top
        left[top] -= 1
        if not left[top]:
            del left[top]
    bins, rest = n_shards - len(alone), list(left.items())
    low = max(-(-total // bins), max(left, default=0))
    slack, found = 0, best_fit_decreasing(rest, low, bins, len(alone))
    if found is None:
        short, slack = 0, 1
        while (found := best_fit_decreasing(rest, low + slack, bins, len(alone))) is None:
            short, slack = slack, slack * 2
        while slack - short > max(1, slack // 64):
            middle = (short + slack) // 2
            better = best_fit_decreasing(rest, low + middle, bins, len(alone))
            short, slack, found = (middle, slack, found) if better is None else (short, middle, better)
    runs = [(s, r + taken.get(s, 0), n, b) for s, r, n, b in found[0]]
    return alone + runs, n_shards


def shard(docs: DataFrame, n_shards: int | None = 24, capacity: int | None = None, per_row: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of ``docs`` (doc_id, text; other columns are ignored).

    A null text counts as empty and is in one group with empty texts. Repeated rows count each. Rows of a shard get
    slots in an order by hash, so no shard is sorted in one task. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # equal hashes of unlike texts would only bring two groups together; equal texts always are
    rows = common.materialize(docs.select("doc_id", (F.octet_length(text) + per_row).cast("long").alias("size"), common.unsigned_crc32(text).alias("text_crc32"), F.xxhash64(text).alias("_group")))
    groups = common.materialize(rows.groupBy("_group").agg(F.sum("size").cast("long").alias("_size")))
    by_size = groups.groupBy("_size").agg(F.count("*").alias("n")).toPandas()
    histogram = list(zip(by_size["_size"].tolist(), by_size["n"].tolist(), strict=True))
    runs = best_fit_decreasing(histogram, capacity)[0] if capacity else pack_groups(histogram, n_shards)[0]
    table = spark.createDataFrame(pa.table({c: pa.array([r[k] for r in runs], pa.int64()) for k, c in enumerate(("_s", "_rank", "_many", "shard"))}).to_pandas(), "_s long, _rank long, _many long, shard long")
    ranked = common.with_rank(groups, ["_size"], ["_group"], common.buckets_for(sum(n for _, n in histogram)), "_at")
    placed = ranked.join(table, (F.col("_size") == F.col("_s")) & (F.col("_at") >= F.col("_rank")) & (F.col("_at") < F.col("_rank") + F.col("_many"))).select("_group", F.col("shard").cast("int").alias("shard"))
    joined = common.materialize(rows.join(placed, "_group").withColumn("_key", F.xxhash64("doc_id", "text_crc32", F.lit("slot"))))
    total = joined.count()
    return common.with_rank(joined, ["shard"], ["_key", "doc_id", "size", "text_crc32"], common.buckets_for(total), "slot").select("doc_id", "size", "text_crc32", "shard", "slot")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard(common.table(spark, sf_dir, "documents"), 24)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
