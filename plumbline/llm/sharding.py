"""Contiguous shards of near-equal bytes: the minimax partition of ordered atomic groups.

Rows with equal texts form a group and stay together.  Groups are ordered by their text's hash and
lie in `cells` equal ranges of it, so that a bounded number of sizes describes any corpus.  The
smallest capacity at which a greedy walk over the cells needs no more than the given shards is
found by binary search on exact sums; the cuts then follow it.

Edge cases: a null text is a group of its own, with no bytes and no crc; empty texts are a group;
repeated rows keep a slot each; an empty table gives an empty result; with fewer groups than
shards some shards stay empty; a group above the mean has a shard to itself; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import stored

CELLS = 1 << 16
OVERHEAD = 16      # bytes a row counts besides its text


def _ends(prefix: list[int], capacity: int, shards: int) -> list[int] | None:
    """Greedy walk: where each shard ends if filled up to capacity; None if shards run out."""
    ends, done = [], 0
    while done < len(prefix) - 1:
        end = bisect_right(prefix, prefix[done] + capacity) - 1
        if end == done or len(ends) == shards:
            return None
        ends.append(end)
        done = end
    return ends


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The least capacity with which a greedy walk over sizes needs at most `shards` shards."""
    prefix = [0, *accumulate(sizes)]
    low = max([-(-prefix[-1] // shards), *sizes]) if sizes else 0
    high = prefix[-1]
    while low < high:
        mid = (low + high) // 2
        if _ends(prefix, mid, shards):
            high = mid
        else:
            low = mid + 1
    return low


def cuts(sizes: list[int], shards: int) -> list[int]:
    """The index each shard but the first begins at, none above the smallest capacity.

    Within that capacity groups above the mean get a shard each, and the groups between two of
    them are cut into near-equal shards, so that one large group does not leave others empty;
    what is left must always fit the shards left.
    """
    prefix = [0, *accumulate(sizes)]
    capacity, n = smallest_capacity(sizes, shards), len(sizes)
    need = [0] * (n + 1)  # shards that the groups from i on take at least
    for i in range(n - 1, -1, -1):
        need[i] = 1 + need[bisect_right(prefix, prefix[i] + capacity) - 1]
    large = [i for i in range(n) if sizes[i] * shards > prefix[-1]]
    begins, done = [], 0
    for left in range(shards, 1, -1):
        large = [i for i in large if i >= done]
        stop = large[0] if large else n
        if stop == done < n:
            end = done + 1
        else:
            rest = prefix[n] - prefix[done] - sum(sizes[i] for i in large)
            mean = rest / max(1, left - len(large))
            until = prefix[stop] - prefix[done]
            parts = left if not large else max(1, round(until / mean)) if mean else 1
            goal = prefix[done] + until / parts
            most = min(stop, bisect_right(prefix, prefix[done] + capacity) - 1)
            end = min(most, bisect_right(prefix, goal) - 1)
            if end < most and (end == done or prefix[end + 1] - goal < goal - prefix[end]):
                end += 1
        while need[end] > left - 1:
            end += 1
        begins.append(end)
        done = end
    return begins


def assign(docs: DataFrame, shards: int, cells: int = CELLS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): slot counts a shard's rows from 0 in the order of
    cell and doc_id.

    At most `cells` sizes reach the driver.  A cell with very many rows is numbered in parts.
    """
    rows = docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + OVERHEAD).alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64("text", F.lit("shards")), F.lit(cells)).cast("int").alias("cell"))
    count = stored(rows.groupBy("cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")),
                   "cells")
    known = sorted((r["cell"], r["bytes"], r["n"]) for r in count.collect())
    begins = cuts([x[1] for x in known], shards)
    # a cut before the first cell, or behind the last, leaves a shard without rows
    at = [known[i][0] if i < len(known) else cells for i in begins]
    shard = sum(((F.col("cell") >= x).cast("int") for x in at), F.lit(0))
    # no part holds more than about a 2048th of the rows, so hot cells make 4096 parts at most
    quota = max(1000, sum(x[2] for x in known) // 2048)
    parts = count.where(F.col("n") > quota).select(
        "cell", F.ceil(F.col("n") / quota).alias("parts"))
    rows = rows.join(F.broadcast(parts), "cell", "left").withColumn(
        "part", F.when(F.col("parts").isNull(), 0).otherwise(
            F.pmod(F.xxhash64("doc_id", F.lit("parts")), F.col("parts")))).drop("parts")
    counted = rows.groupBy("cell", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell", "part").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = counted.select("cell", "part", "n", shard.alias("shard")).select(
        "cell", "part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("cell", "part").orderBy("doc_id", "size")
    numbered = rows.withColumn("at", F.row_number().over(inside) - 1)
    # offsets has a row per cell and 4096 more at most
    return numbered.join(F.broadcast(offsets), ["cell", "part"]).select(
        "doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"),
        (F.col("offset") + F.col("at")).alias("slot"))
