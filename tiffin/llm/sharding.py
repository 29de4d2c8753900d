"""Sharding by minimax contiguous partition.

Equal texts form an atomic group whose size is the sum of its rows' sizes. Groups are ordered by size, largest
first. A binary search finds the smallest capacity with which a greedy pass needs no more than the shards
there are; the first shard is cut there. The search is repeated on the groups and shards that are left, so
one oversized group takes a shard of its own and the others stay near equal.

The greedy pass needs only how many groups there are of each size. The driver holds one entry per different
size: for S bytes in all there are at most sqrt(2 * S) of them, however many documents there are.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiffin.llm.common import numbered, pinned, text_or_empty


class Runs:
    """Group sizes in descending order, as runs of equal sizes with prefix sums."""

    def __init__(self, runs: list[tuple[int, int]]):
        self.sizes = [size for size, _ in runs]
        self.counts = [count for _, count in runs]
        self.bytes = [0, *accumulate(size * count for size, count in runs)]

    def fill(self, run: int, offset: int, capacity: int) -> tuple[int, int]:
        """Where the next shard begins, if one begins at (run, offset) and holds ``capacity`` bytes."""
        if run == len(self.sizes):
            return run, 0
        limit = self.bytes[run] + offset * self.sizes[run] + capacity
        end = bisect_right(self.bytes, limit) - 1
        if end == len(self.sizes):
            return end, 0
        return end, max((limit - self.bytes[end]) // self.sizes[end], offset if end == run else 0)

    def fits(self, run: int, offset: int, capacity: int, shards: int) -> bool:
        for _ in range(shards):
            if run == len(self.sizes):
                return True
            run, offset = self.fill(run, offset, capacity)
        return run == len(self.sizes)

    def smallest(self, run: int, offset: int, shards: int) -> int:
        """The smallest capacity with which ``shards`` shards hold everything from (run, offset) on."""
        rest = self.bytes[-1] - self.bytes[run] - offset * self.sizes[run]
        low = max(-(-rest // shards), self.sizes[run])
        high = rest
        while low < high:
            middle = (low + high) // 2
            if self.fits(run, offset, middle, shards):
                high = middle
            else:
                low = middle + 1
        return low

    def cuts(self, shards: int) -> list[tuple[int, int]]:
        """(size, rank among the groups of that size) of the first group of shards 1, 2, ..."""
        run, offset, out = 0, 0, []
        for left in range(shards, 1, -1):
            if run == len(self.sizes):
                break
            run, offset = self.fill(run, offset, self.smallest(run, offset, left))
            if run < len(self.sizes):
                out.append((self.sizes[run], offset))
        return out


def minimax_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of ``docs``.

    ``size`` is the UTF-8 length of the text plus 1, so null and empty texts have size 1 and, as one group,
    checksum 0. Rows of equal text share a shard. ``slot`` numbers the rows of a shard from 0 without gaps.
    Shards may stay empty if there are fewer groups than shards. An empty table gives no rows.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    data = text_or_empty().cast("binary")
    rows = pinned(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(data).alias("text_crc32"),
            F.unhex(F.sha2(data, 256)).alias("_text"),
        )
    )
    groups = rows.groupBy("_text").agg(F.sum("size").alias("_weight"))
    # Only the order inside sizes that a cut divides is needed; the rank is by a second key there.
    sizes = groups.groupBy("_weight").agg(F.count("*").alias("_n")).orderBy(F.desc("_weight")).collect()
    cuts = Runs([(s["_weight"], s["_n"]) for s in sizes]).cuts(shards)
    divided = sorted({size for size, offset in cuts if offset})
    whole = groups.withColumn("_rank", F.lit(0).cast("long"))
    if divided:
        among = pinned(groups.filter(F.col("_weight").isin(divided)))
        ranked = numbered(among, ["_weight"], ["_text"], ["_text"], among.count(), "_rank")
        whole = whole.filter(~F.col("_weight").isin(divided)).unionByName(ranked)
    passed = [
        ((F.col("_weight") < size) | ((F.col("_weight") == size) & (F.col("_rank") >= offset))).cast("int")
        for size, offset in cuts
    ]
    placed = whole.select(F.col("_text"), reduce(lambda a, b: a + b, passed, F.lit(0)).alias("shard"))
    dealt = pinned(rows.join(placed, "_text"))
    out = numbered(
        dealt, ["shard"], ["doc_id"], ["doc_id", "_text"], dealt.count(), "slot"
    )
    return out.select("doc_id", "size", "text_crc32", "shard", "slot")
