"""Sharding as a minimax contiguous partition of ordered atomic groups.

Rows of equal text (null counts as empty) form a group that is never split; groups are ordered by a 64-bit hash of
the text. The smallest feasible capacity is found by binary search with a greedy check, and the order is cut there.
The driver never holds the groups: it holds sums over ranges of the hash, at first 4,096, and opens only those ranges
in which a greedy check stops, 4,096 finer ones at a time, until every range that decides is a single group. So the
capacity is exact over all groups. As one large group may leave slack, cuts are then set as near to equal sizes as
that capacity allows.

Defined results: a null text has no bytes, so size 1, checksum 0; an empty table gives no rows; with fewer groups
than shards some shards are empty; repeated rows get slots of their own; null doc_ids sort first; other columns stay as
they are, but own columns named shard or slot give way. Two different texts of one 64-bit hash would count as one group.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm._cluster import checkpoint, small
from tessera.operators.ordered import running

SHARDS = 8
#: Ranges of the hash that one range is opened into: two to the power of this.
BITS = 12
#: Rows that get their slots in one task.
SLOT_ROWS = 500


def order_key(text: Column) -> Column:
    """What orders the groups: equal for equal texts."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


class _Ranges:
    """Ranges of the hash in order: the lowest hash, how many bits are free below it, bytes and groups."""

    def __init__(self, groups: DataFrame):
        self.groups = groups
        self.low = self.free = self.bytes = self.n = np.zeros(0, np.int64)
        self._add(groups, 64 - BITS)

    def _add(self, groups: DataFrame, free: int) -> None:
        rows = groups.groupBy(F.shiftright("key", free).alias("part")).agg(F.sum("bytes"), F.count("*"), F.min("key")).collect()
        if rows:
            part, size, n, key = (np.array(x, np.int64) for x in zip(*rows, strict=True))
            low = np.where(n == 1, key, part << free)
            self.low, self.free = np.concatenate((self.low, low)), np.concatenate((self.free, np.where(n == 1, 0, free)))
            self.bytes, self.n = np.concatenate((self.bytes, size)), np.concatenate((self.n, n))
            order = np.argsort(self.low, kind="stable")
            self.low, self.free, self.bytes, self.n = self.low[order], self.free[order], self.bytes[order], self.n[order]

    def open(self, which: list[int]) -> None:
        """Puts finer ranges in the place of some."""
        chosen = [(int(self.low[i]), int(self.free[i])) for i in which]
        stay = np.ones(len(self.low), bool)
        stay[which] = False
        self.low, self.free, self.bytes, self.n = self.low[stay], self.free[stay], self.bytes[stay], self.n[stay]
        for free in sorted({f for _, f in chosen}):
            inside = F.shiftright("key", free).isin([low >> free for low, f in chosen if f == free])
            self._add(self.groups.filter(inside), max(0, free - BITS))


def _greedy(total: np.ndarray, capacity: int, shards: int) -> tuple[list[int], bool]:
    """Where each shard ends if it takes all that fits, and whether that places everything."""
    ends, at = [], 0
    for _ in range(shards):
        at = int(np.searchsorted(total, total[at] + capacity, "right")) - 1
        ends.append(at)
    return ends, ends[-1] == len(total) - 1


def _capacity(sizes: np.ndarray, shards: int) -> tuple[int, set[int]]:
    """The smallest feasible capacity, and the places that decide it."""
    total = np.concatenate(([0], np.cumsum(sizes)))
    low, high = -(-int(total[-1]) // shards) - 1, int(total[-1])
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if _greedy(total, middle, shards)[1] else (middle, high)
    stops = {e for c in (low, high) for e in _greedy(total, c, shards)[0] if e < len(sizes)}
    return high, stops


def cuts(groups: DataFrame, shards: int = SHARDS) -> tuple[list[int], int]:
    """The lowest key of each shard but the first (some keys may repeat), and the smallest capacity. groups: key, bytes."""
    held = _Ranges(groups)
    if not len(held.low):
        return [], 0
    while True:
        capacity, stops = _capacity(held.bytes, shards)
        coarse = [i for i in sorted(stops) if held.n[i] > 1 and held.free[i] > 0]
        if not coarse:
            break
        held.open(coarse)
    total = np.concatenate(([0], np.cumsum(held.bytes)))
    n, at, found = len(held.bytes), 0, []
    earliest = [n]  # from where so many shards can take the rest
    for _ in range(shards - 1):
        earliest.append(int(np.searchsorted(total, total[earliest[-1]] - capacity, "left")))
    for left in range(shards, 1, -1):
        most = int(np.searchsorted(total, total[at] + capacity, "right")) - 1
        goal = total[at] + (total[-1] - total[at]) / left
        near = int(np.searchsorted(total, goal, "left"))
        if near > at and goal - total[near - 1] < total[min(near, n)] - goal:
            near -= 1
        at = min(most, max(near, earliest[left - 1], min(at + 1, n)))  # a group that is too large for its goal still fills one
        found.append(int(held.low[at]) if at < n else None)
    return [k for k in found if k is not None], capacity


def shard_of(key: Column, found: list[int]) -> Column:
    """The shard of a key: how many cuts are not above it."""
    shard = F.lit(0)
    for k in found:
        shard = shard + F.when(key >= F.lit(k).cast("long"), 1).otherwise(0)
    return shard.cast("int")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_bytes(F.col("text")).alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), order_key(F.col("text")).alias("key"))


def with_slots(rows: DataFrame, n_rows: int, by: list[Column], narrow: DataFrame | None = None) -> DataFrame:
    """Adds slot, gapless from 0 in each shard, ordered by some columns in a bin. rows: shard and others; narrow: the same rows, cheaper to read.

    Rows are dealt into bins by a hash of these columns; each bin is numbered by itself and begins where those before it end.
    """
    bin_, begin, n = (f"_{name}_{uuid.uuid4().hex}" for name in ("bin", "begin", "n"))  # like no column of the rows
    bins = max(1, -(-n_rows // (SHARDS * SLOT_ROWS)))
    binned = lambda df: df.withColumn(bin_, F.pmod(F.xxhash64(*by), F.lit(bins)))
    counts = checkpoint(binned(narrow if narrow is not None else rows).groupBy("shard", bin_).agg(F.count("*").alias(n)))
    begins = running(counts, ["shard"], bin_, n, begin).drop(n)
    rank = F.row_number().over(W.partitionBy("shard", bin_).orderBy(*by))
    return binned(rows).join(small(begins, counts.count()), ["shard", bin_]).withColumn("slot", (F.col(begin) + rank - 1).cast("long")).drop(bin_, begin)


def assignments(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, key, shard, slot."""
    keyed = checkpoint(_keyed(docs))
    groups = checkpoint(keyed.groupBy("key").agg(F.sum("size").alias("bytes")))
    found, _ = cuts(groups, shards)
    return with_slots(keyed.withColumn("shard", shard_of(F.col("key"), found)), keyed.count(), [F.col("doc_id"), F.col("key")])


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The documents with their columns, shard and slot; own columns of these two names give way."""
    docs = docs.drop("shard", "slot")
    narrow = checkpoint(docs.select("doc_id", text_bytes(F.col("text")).alias("bytes"), order_key(F.col("text")).alias("key")))
    found, _ = cuts(checkpoint(narrow.groupBy("key").agg(F.sum("bytes").alias("bytes"))), shards)
    key = f"_key_{uuid.uuid4().hex}"
    narrow = narrow.select("doc_id", F.col("key").alias(key)).withColumn("shard", shard_of(F.col(key), found))
    full = docs.withColumn(key, order_key(F.col("text"))).withColumn("shard", shard_of(F.col(key), found))
    return with_slots(full, narrow.count(), [F.col("doc_id"), F.col(key)], narrow).drop(key)


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    """The contract's columns under the law `bytes`."""
    found = assignments(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
