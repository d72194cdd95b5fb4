"""Minimax contiguous sharding of a corpus over atomic groups of equal texts (DataFrame operations only).

The groups are laid out in the order of their text's digest. The smallest feasible capacity is found by binary
search with a greedy check. The driver never sees the groups: it works on sums over digest prefixes, at most some
ten thousand of them, and asks Spark to split only those prefixes in which a cut may fall. A lower bound (cuts may fall
anywhere in an unsplit prefix) and an upper bound (cuts fall between prefixes) close in on the exact optimum.

Defined cases: a null text counts as empty and shares the empty text's group; a null doc_id is kept; repeated rows are
rows of one group; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stored

#: Hex digits of the first prefixes; a split adds one.
DEPTH = 3
#: Hex digits that identify a text (128 bits of its SHA-256).
DIGITS = 32
#: Slots are numbered within so many cells of each shard.
CELLS = 256


class Blocks:
    """Sums over digest prefixes, in order; a block of one group can't be cut."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.rows = sorted(rows)
        self.edges = [0, *accumulate(size for _, size, _ in self.rows)]
        self.total = self.edges[-1]

    def cuts(self, capacity: int, n: int) -> list[int] | None:
        """Greedy check: indices at which shards end when cuts fall between blocks; None if n shards don't suffice."""
        ends, at = [], 0
        for _ in range(n):
            if at < len(self.rows):
                to = bisect_right(self.edges, self.edges[at] + capacity) - 1
                if to == at:
                    return None
                at = to
            ends.append(at)
        return ends if at == len(self.rows) else None

    def reach(self, capacity: int, n: int) -> list[int]:
        """Farthest bytes at which shards can end when a block of several groups can be cut anywhere."""
        ends, x = [], 0
        for _ in range(n):
            x = min(x + capacity, self.total)
            at = bisect_right(self.edges, x) - 1
            if at < len(self.rows) and self.rows[at][2] == 1:
                x = self.edges[at]
            ends.append(x)
        return ends

    def least(self, capacity: int, n: int) -> list[int]:
        """Bytes that the greedy shards reach at least, whatever the order within blocks."""
        ends, x = [], 0
        for _ in range(n):
            at = bisect_right(self.edges, x) - 1
            x = max(x, self.edges[max(at, bisect_right(self.edges, x + capacity) - 1)])
            ends.append(x)
        return ends

    def smallest(self, low: int, feasible) -> int:
        """Binary search for the smallest feasible capacity from low up."""
        high = max(low, self.total)
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if feasible(mid) else (mid + 1, high)
        return low

    def even(self, capacity: int, n: int) -> list[int]:
        """Cuts within the capacity, each as near to an even share of what is left as the others allow."""
        last, at, latest = len(self.rows), len(self.rows), []
        for _ in range(n):  # how early each shard may begin, from the right
            latest.append(at)
            at = bisect_left(self.edges, self.edges[at] - capacity)
        least, at, ends = latest[::-1], 0, []
        for i in range(n):
            share = self.edges[at] + (self.total - self.edges[at]) / (n - i)
            near = bisect_left(self.edges, share)
            near -= near > at and near <= last and self.edges[near] - share > share - self.edges[near - 1]
            most = bisect_right(self.edges, self.edges[at] + capacity) - 1
            at = min(max(near, least[i], at), most)
            ends.append(at)
        return ends


def digests(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.substring(F.sha2(text, 256), 1, DIGITS).alias("group"),
    )


def summed(groups: DataFrame, depth: int) -> list[tuple[str, int, int]]:
    by = groups.groupBy(F.substring("group", 1, depth).alias("prefix")).agg(F.sum("bytes"), F.count("*"))
    return [(r[0], r[1], r[2]) for r in by.collect()]


def plan(groups: DataFrame, n: int) -> tuple[int, list[str]]:
    """The optimal capacity and the digests at which shards 1 to n-1 begin."""
    spark = groups.sparkSession
    largest = groups.agg(F.max("bytes")).head()[0]
    if largest is None:
        return 0, []
    depth, blocks = DEPTH, Blocks(summed(groups, DEPTH))
    while True:
        low = max(-(-blocks.total // n), largest)
        low = blocks.smallest(low, lambda c: blocks.reach(c, n)[-1] >= blocks.total)
        high = blocks.smallest(low, lambda c: blocks.cuts(c, n) is not None)
        if low == high or depth == DIGITS:
            break
        spans = list(zip(blocks.least(low, n), blocks.reach(high, n), strict=True))
        bulky = blocks.total // (64 * n)
        split = {
            key
            for (key, size, count), start in zip(blocks.rows, blocks.edges, strict=False)
            if count > 1 and len(key) == depth and (size > bulky or any(a <= start + size and start <= b for a, b in spans))
        }
        if not split:
            break
        inside = spark.createDataFrame([(k,) for k in sorted(split)], "prefix string")
        found = groups.join(F.broadcast(inside), F.substring("group", 1, depth) == F.col("prefix"), "left_semi")
        depth += 1
        blocks = Blocks([r for r in blocks.rows if r[0] not in split] + summed(found, depth))
    ends = blocks.even(high, n)
    return high, [blocks.rows[e][0] if e < len(blocks.rows) else "g" for e in ends[:-1]]


def shard_of(group: Column, starts: list[str]) -> Column:
    """The number of shards that begin at or before the group."""
    return sum((F.when(group >= s, 1).otherwise(0) for s in starts), F.lit(0)).cast("int")


def minimax_shards(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """Each document's shard and its slot there, with the size and checksum of its text."""
    rows = stored(digests(docs), "shard-digests")
    groups = stored(rows.groupBy("group").agg(F.sum("size").alias("bytes")), "shard-groups")
    _, starts = plan(groups, n_shards)
    rows = rows.withColumn("shard", shard_of(F.col("group"), starts)).withColumn("cell", F.pmod(F.xxhash64("doc_id", "group"), F.lit(CELLS)).cast("int"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    # at most n_shards * CELLS rows, whatever the input
    cells = rows.groupBy("shard", "cell").count().select("shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    slot = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "group")) - 1
    return rows.withColumn("slot", slot).join(F.broadcast(cells), ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("slot")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "group"
    )
