"""Packing of tokenized documents into sequences by exact-complement hashing.

Longer documents are cut into whole sequences behind a shorter first piece. All pieces are then packed by length: the
number of pieces of each length, at most as many numbers as a sequence has tokens, is all that the driver sees. For each
length, from the longest, single lengths, pairs and triples that fill the gap exactly are consumed under the counts; best
fit packs the rest. A pattern stands for as many sequences as the counts allow, and pieces find their places through their
rank within their length. The tables of lengths, cells and patterns are bounded by the sequence length and CELLS, not by the
data.

Defined cases: a null or empty text is a document of the end id alone; a null doc_id is kept; repeated rows are packed one
by one; ties order by doc_id, piece and checksum; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import stored
from .tokens import encoder, together

#: Ranks within a length are counted in cells: so many of all lengths, of so many pieces at least. Tokens of a sequence at most.
CELLS, LEAST, MOST = 1 << 16, 1 << 14, 1 << 18
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(length: int, size: int) -> list[tuple[int, int]]:
    """Starts and lengths of a document's pieces; only the first may be shorter than a sequence."""
    first = length % size or size
    starts = [0, *range(first, length, size)]
    return [(s, (first if s == 0 else size)) for s in starts]


def pieces(docs: DataFrame, vocabulary: str, size: int, end: int) -> DataFrame:
    tail = np.array([end], "<u4").tobytes()

    def run(batches):
        encode = encoder(vocabulary)
        for batch in together(batches, 1):
            ids = batch.column(0)
            row, number, start, length, crc = [], [], [], [], []
            for i, data in enumerate(encode.many(batch.column(1))):
                data += tail
                for k, (s, n) in enumerate(cut(len(data) // 4, size)):
                    row.append(i)
                    number.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(data[4 * s : 4 * (s + n)]))
            columns = [ids.take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECE)


class Counts:
    """How many pieces of each length are left."""

    def __init__(self, counts: dict[int, int], size: int):
        self.left = np.zeros(size + 1, np.int64)
        for k, n in counts.items():
            self.left[k] = n

    def single(self, gap: int) -> list[int] | None:
        return [gap] if self.left[gap] > 0 else None

    def pair(self, gap: int, most: int) -> list[int] | None:
        """The pair that fills the gap with the longest first part, of at most most tokens."""
        first = np.arange((gap + 1) // 2, min(gap - 1, most) + 1)
        if not len(first):
            return None
        fits = (self.left[first] > 0) & (self.left[gap - first] > (first * 2 == gap))
        at = np.flatnonzero(fits)
        return [int(first[at[-1]]), gap - int(first[at[-1]])] if len(at) else None

    def triple(self, gap: int) -> list[int] | None:
        for a in np.flatnonzero(self.left[: gap - 1] > 0)[::-1].tolist():
            if 3 * a < gap:
                break
            self.left[a] -= 1
            rest = self.pair(gap - a, a)
            self.left[a] += 1
            if rest:
                return [a, *rest]
        return None

    def exact(self, gap: int) -> list[int] | None:
        if gap == 0:
            return []
        return self.single(gap) or self.pair(gap, gap) or self.triple(gap)

    def best(self, gap: int) -> int:
        """The longest piece that fits, or 0."""
        at = np.flatnonzero(self.left[1 : gap + 1] > 0)
        return int(at[-1]) + 1 if len(at) else 0

    def take(self, pattern: list[int]) -> tuple[int, list[int]]:
        """Applies a pattern as often as the counts allow."""
        n = min(int(self.left[k]) // m for k, m in Counter(pattern).items())
        for k in pattern:
            self.left[k] -= n
        return n, pattern


def patterns(counts: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """(sequences, lengths in each): every gap takes its exact complement if there is one, else the best fit and then that of what is left."""
    state, found = Counts(counts, size), []
    for length in range(size, 0, -1):
        while state.left[length] > 0:
            pattern, gap = [length], size - length
            state.left[length] -= 1
            while gap:
                more = state.exact(gap) or [x for x in [state.best(gap)] if x]
                if not more:
                    break
                for k in more:
                    state.left[k] -= 1
                pattern += more
                gap -= sum(more)
            for k in pattern:
                state.left[k] += 1
            found.append(state.take(pattern))
    return found


def places(found: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank behind the last, pieces in each sequence, first sequence, offset there)."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for n, pattern in found:
        offset = 0
        for k, m in sorted(Counter(pattern).items(), reverse=True):
            rows.append((k, used[k], used[k] + n * m, m, sequence, offset))
            used[k] += n * m
            offset += k * m
        sequence += n
    return rows


def placed(found: DataFrame, size: int) -> DataFrame:
    """Adds sequence_id and offset to pieces, a stored table. A piece that fills a sequence needs no rank; each other length has cells in proportion to its pieces, at most size + CELLS in all."""
    if size > MOST:
        raise ValueError(f"sequences of more than {MOST} tokens would make tables by length too large to broadcast")
    spark = found.sparkSession
    full = found.where(F.col("length") == size).withColumn("nth", F.monotonically_increasing_id())
    found = found.where(F.col("length") != size)
    counts = {r[0]: r[1] for r in found.groupBy("length").count().collect()}  # fewer than size rows
    rows = places(patterns(counts, size))
    cell_size = max(LEAST, -(-sum(counts.values()) // CELLS))
    parts = F.broadcast(spark.createDataFrame([(k, -(-n // cell_size)) for k, n in counts.items()], "length long, parts long"))
    found = found.join(parts, "length").withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.col("parts")).cast("int")).drop("parts")
    cells = found.groupBy("length", "cell").count()
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    first = stored(cells.select("length", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first")), "pack-cells")
    at = spark.createDataFrame(rows, "at_length long, from_rank long, to_rank long, each long, first_sequence long, first_offset long")
    within = F.row_number().over(Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = found.withColumn("within", within).join(F.broadcast(first), ["length", "cell"]).withColumn("rank", F.col("first") + F.col("within"))
    on = (F.col("length") == F.col("at_length")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank"))
    nth = F.col("rank") - F.col("from_rank")
    ranked = ranked.join(F.broadcast(at), on)
    sequence, offset = F.col("first_sequence") + F.floor(nth / F.col("each")), F.col("first_offset") + F.pmod(nth, F.col("each")) * F.col("length")
    columns = [c.split()[0] for c in PIECE.split(", ")]
    behind = 1 + max((r[4] + (r[2] - r[1]) // r[3] for r in rows), default=0)
    alone = full.select(*columns, (F.col("nth") + behind).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return ranked.select(*columns, sequence.alias("sequence_id"), offset.alias("offset")).unionByName(alone)


def pack(docs: DataFrame, vocabulary: str, size: int = 2048, end: int = 0) -> DataFrame:
    """One row per piece with its sequence and its place there."""
    return placed(stored(pieces(docs, vocabulary, size, end), "pack-pieces"), size).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
