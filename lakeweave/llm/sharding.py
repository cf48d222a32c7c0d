"""Sharding by best-fit-decreasing bin packing of indivisible groups of equal texts."""

from __future__ import annotations

import random
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lakeweave.llm.common import cut, in_order, join_hot


class RemainingCapacity:
    """A balanced search tree (treap) of (remaining capacity, bin): the tightest bin that fits, in logarithmic time."""

    def __init__(self, seed: int = 5):
        self._root, self._next = None, random.Random(seed).random

    def add(self, key: tuple[int, int]) -> None:
        low, high = self._split(self._root, key)
        self._root = self._join(self._join(low, [self._next(), key, None, None]), high)

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes and returns the smallest key whose capacity is ``least`` or more."""
        low, high = self._split(self._root, (least, -1))
        if high is None:
            self._root = low
            return None
        node, above = high, None
        while node[2] is not None:
            above, node = node, node[2]
        if above is None:
            high = node[3]
        else:
            above[2] = node[3]
        self._root = self._join(low, high)
        return node[1]

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[1] < key:
            node[3], rest = self._split(node[3], key)
            return node, rest
        rest, node[2] = self._split(node[2], key)
        return rest, node

    def _join(self, low, high):
        if low is None or high is None:
            return low or high
        if low[0] > high[0]:
            low[3] = self._join(low[3], high)
            return low
        high[2] = self._join(low, high[2])
        return high


@dataclass
class Packing:
    """Runs of groups in descending order of size class: run i covers ``length[i]`` groups from ``start[i]``."""

    start: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    bins: int = 0


def best_fit_decreasing(histogram: list[tuple[int, int]], capacity: int) -> Packing:
    """Packs ``count`` groups of each ``size`` (any order) into bins of ``capacity``, opening as few as best fit does.

    The tightest bin that takes a group is also the tightest for the next of that size until it is full, so a size
    is placed in runs and the work follows the number of distinct sizes. A group above capacity has a bin of its own.
    """
    out, tree, at = Packing(), RemainingCapacity(), 0
    for size, count in sorted(histogram, reverse=True):
        while count:
            found = tree.take(size)
            if found is None:
                found = (max(capacity, size), out.bins)
                out.bins += 1
            n = min(count, found[0] // size)
            out.start.append(at)
            out.bin.append(found[1])
            tree.add((found[0] - n * size, found[1]))
            at, count = at + n, count - n
    return out


def near_equal(histogram: list[tuple[int, int]], shards: int) -> Packing:
    """Best fit decreasing at the smallest capacity, to a part in 10,000, that needs no more than ``shards`` bins.

    Groups above an equal share have a shard each, and the others share the rest of the shards equally.
    """
    rest, left, alone = dict(histogram), shards, 0
    total = sum(s * n for s, n in histogram)
    for size, count in sorted(histogram, reverse=True):
        for _ in range(count):
            if left <= 1 or size * left < total:
                break
            rest[size] -= 1
            total, left, alone = total - size, left - 1, alone + 1
        else:
            continue
        break
    small = [(s, n) for s, n in rest.items() if n]
    packing = Packing(list(range(alone)), list(range(alone)), alone)
    if small:
        # at an equal share plus the largest group a bin is only opened once all others hold their share, so it fits
        low, high = -(-total // left), -(-total // left) + max(s for s, _ in small)
        step, best = max(1, low // 10_000), None
        while best is None or high - low > step:
            capacity = low if best is None else (low + high) // 2
            tried = best_fit_decreasing(small, capacity)
            if tried.bins <= left:
                best, high = tried, capacity
            elif best is None:
                best, low = best_fit_decreasing(small, high), capacity
            else:
                low = capacity
        packing.start += [alone + s for s in best.start]
        packing.bin += [alone + b for b in best.bin]
        packing.bins += best.bins
    return packing


def size_class(size: Column) -> Column:
    """A size rounded up to 12 significant bits: no more than 2,048 classes per power of two, at most 1/2048 above."""
    shift = F.greatest(F.lit(0), F.length(F.bin(size)) - 12)
    return size + F.pmod(-size, F.pow(F.lit(2.0), shift).cast("long"))


def shard(docs: DataFrame, shards: int = 16, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns ``carry``, and ``size, text_crc32, law, shard, slot, grown_shard`` of each row; law ``bytes``.

    A row's size is its UTF-8 bytes plus 1 (null text: 1, and equal to the empty text). Rows of equal text form a
    group, which is not divided; a group above an equal share fills a shard of its own, so the sizes of the others
    are near equal. Only the histogram of size classes reaches the driver: at most some 100,000 entries at any scale.
    Slots are gapless from 0 in each shard, in order of doc_id (null first; rows that repeat a doc_id in any order).
    An empty table gives no rows. Other columns of ``docs`` play no part, whatever their names.
    """
    docs = docs.select("doc_id", "text", *[c for c in carry if c not in ("doc_id", "text")])
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    sized = docs.withColumns({"size": size, "text_crc32": F.crc32(text.cast("binary")), "_key": F.unhex(F.sha2(text, 256))})
    sized = sized if "text" in carry else sized.drop("text")
    groups = sized.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_bytes"))
    ranked = in_order(groups.withColumn("_class", size_class(F.col("_bytes"))), F.col("_class").desc(), F.col("_key"))
    ranked = cut(ranked)
    histogram = [(r["_class"], r["count"]) for r in ranked.groupBy("_class").count().collect()]
    packing = near_equal(histogram, shards)
    starts, bins = np.array(packing.start, np.int64), np.array(packing.bin, np.int32)

    @F.pandas_udf("int")
    def bin_of(position: pd.Series) -> pd.Series:
        return pd.Series(bins[np.searchsorted(starts, position.to_numpy(np.int64), "right") - 1])

    placed = ranked.select("_key", "_n", bin_of("position").alias("shard"))
    total = ranked.agg(F.sum("_n")).first()[0] or 0
    both = join_hot(sized, placed, ["_key"], "_n", total).drop("_key", "_n")
    ordered = cut(in_order(both, F.col("shard"), F.col("doc_id")))
    begins = ordered.groupBy("shard").agg(F.min("position").alias("_begin"))  # one row per shard
    slotted = ordered.join(F.broadcast(begins), "shard").withColumn("slot", F.col("position") - F.col("_begin"))
    return slotted.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int"), "slot": F.col("slot").cast(LongType())}).drop("position", "_begin")
