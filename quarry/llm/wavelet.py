"""Token ids in wavelet-matrix files: one compressed file per shard that supports access, counts and occurrences.

Documents are dealt by ranges of doc_id; each task writes the shards of its range in order, a bounded number of tokens at a
time, and a file's name is unique to the attempt, so that a repeated task can't spoil one. A shard's first position is
the sum of what the ranges and shards before it hold.

Defined cases: a null or empty text is the end id alone; null doc_ids come first; equal doc_ids order by their text's
hash; an empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import folder, stored
from .tokens import encoder, together

MAGIC = b"QWM2"
#: Tokens of a shard; a single longer document makes a longer shard.
SHARD = 2_000_000
#: Bits between two entries of a plane's rank directory.
STEP = 512


class WaveletMatrix:
    """Bit planes of a sequence of ids, from the highest bit; each plane puts zeros before ones, in order. The planes hold the ids' ranks in the sequence's own alphabet, so that there are as few as it needs."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], alphabet: np.ndarray):
        self.n, self.planes, self.zeros, self.alphabet = n, planes, zeros, alphabet
        self.ranks = None

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        here = np.bincount(ids) > 0 if len(ids) else np.zeros(1, bool)
        alphabet = np.flatnonzero(here).astype(np.uint32)
        width = max(1, (len(alphabet) - 1).bit_length())
        kind = np.uint16 if width <= 16 else np.uint32
        at = (np.cumsum(here) - 1).astype(kind).take(ids)
        planes, zeros = [], []
        for bit in range(width - 1, -1, -1):
            ones = (at & kind(1 << bit)).astype(bool)
            planes.append(np.packbits(ones))
            high = at.take(np.flatnonzero(ones))
            low = at.take(np.flatnonzero(np.logical_not(ones, out=ones)))
            zeros.append(len(low))
            at[: len(low)], at[len(low) :] = low, high
        return cls(len(ids), planes, zeros, alphabet)

    def decode(self) -> np.ndarray:
        """All ids in order: from the lowest plane up, zeros and ones go back to their places."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        at, back = np.zeros(self.n, kind), np.empty(self.n, kind)
        for bit, (plane, zeros) in enumerate(zip(self.planes[::-1], self.zeros[::-1], strict=True)):
            ones = np.unpackbits(plane, count=self.n).view(bool)
            np.bitwise_or(at[zeros:], kind(1 << bit), out=at[zeros:])
            back[np.flatnonzero(ones)] = at[zeros:]
            back[np.flatnonzero(np.logical_not(ones, out=ones))] = at[:zeros]
            at, back = back, at
        return self.alphabet.take(at) if self.n else np.zeros(0, np.uint32)

    def rank(self, level: int, i: int) -> int:
        """Ones before position i of a plane."""
        if self.ranks is None:
            self.ranks = []
            for plane in self.planes:
                bits = np.bitwise_count(np.pad(plane, (0, -len(plane) % (STEP // 8)))).reshape(-1, STEP // 8).sum(1, dtype=np.int64)
                self.ranks.append(np.concatenate(([0], np.cumsum(bits))))
        block = i // STEP
        rest = np.unpackbits(self.planes[level][block * STEP // 8 : (i + 7) // 8], count=i - block * STEP) if i % STEP else ()
        return int(self.ranks[level][block]) + int(np.sum(rest))

    def down(self, level: int, bit: int, i: int) -> int:
        ones = self.rank(level, i)
        return self.zeros[level] + ones if bit else i - ones

    def access(self, i: int) -> int:
        value = 0
        for level, plane in enumerate(self.planes):
            bit = int(plane[i >> 3] >> (7 - (i & 7)) & 1)
            value, i = value << 1 | bit, self.down(level, bit, i)
        return int(self.alphabet[value])

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences in [start, end)."""
        end = self.n if end is None else end
        code = int(np.searchsorted(self.alphabet, value))
        if code == len(self.alphabet) or self.alphabet[code] != value:
            return 0
        for level in range(len(self.planes)):
            bit = code >> (len(self.planes) - 1 - level) & 1
            start, end = self.down(level, bit, start), self.down(level, bit, end)
        return end - start

    def select(self, value: int, k: int) -> int:
        """Position of the k-th occurrence, from 0, by binary search on counts; -1 if there are fewer."""
        if self.count(value) <= k:
            return -1
        low, high = 0, self.n - 1
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.count(value, 0, mid + 1) > k else (mid + 1, high)
        return low


def dumped(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """A file: magic, header length, header, then compressed document table, alphabet and planes."""
    codec = pa.Codec("zstd", 1)
    m = WaveletMatrix.build(ids)
    known = np.array([d is not None for d in doc_ids], bool)
    raw = [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.packbits(known).tobytes(), np.array(lengths, "<i8").tobytes(), m.alphabet.astype("<u4").tobytes(), *(p.tobytes() for p in m.planes)]
    parts = [codec.compress(r, asbytes=True) for r in raw]
    head = json.dumps({"docs": len(doc_ids), "tokens": m.n, "zeros": m.zeros, "sizes": [[len(r), len(p)] for r, p in zip(raw, parts, strict=True)]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *parts])


def loaded(data: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """doc_ids, lengths and the matrix of a file."""
    if data[:4] != MAGIC:
        raise ValueError("not a token file")
    size = struct.unpack_from("<I", data, 4)[0]
    head, at, raw, codec = json.loads(data[8 : 8 + size]), 8 + size, [], pa.Codec("zstd")
    for whole, packed in head["sizes"]:
        raw.append(np.frombuffer(codec.decompress(data[at : at + packed], whole, asbytes=True), np.uint8))
        at += packed
    ids, known = raw[0].view("<i8").tolist(), np.unpackbits(raw[1], count=head["docs"]).tolist()
    return [d if k else None for d, k in zip(ids, known, strict=True)], raw[2].view("<i8"), WaveletMatrix(head["tokens"], raw[4:], head["zeros"], raw[3].view("<u4"))


def opened(path: str):
    """File system and path of a URI or path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def write_shards(docs: DataFrame, vocabulary: str, end: int = 0, shard: int = SHARD) -> DataFrame:
    """Writes the files below the shared folder; one row per file: range, number there, path, documents, tokens."""
    spark = docs.sparkSession
    base = folder(spark)
    base = f"{base if '://' in base else 'file://' + base}/tokens-{uuid.uuid4().hex}"
    tail = np.array([end], "<u4").tobytes()

    def run(batches):
        encode, part, number = encoder(vocabulary), TaskContext.get().partitionId(), 0
        files, root = opened(base)
        files.create_dir(root, recursive=True)
        held: list[tuple[int | None, bytes]] = []
        tokens = 0

        def flush():
            nonlocal held, tokens, number
            ids = np.frombuffer(b"".join(d for _, d in held), "<u4")
            name = f"{part:06d}-{number:06d}-{uuid.uuid4().hex}.qwm"
            with files.open_output_stream(f"{root}/{name}") as out:
                out.write(dumped([i for i, _ in held], [len(d) // 4 for _, d in held], ids))
            row = {"part": [part], "number": [number], "path": [f"{base}/{name}"], "docs": [len(held)], "tokens": [len(ids)]}
            held, tokens, number = [], 0, number + 1
            return pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

        for batch in together(batches, 1):
            for i, data in zip(batch.column(0).to_pylist(), encode.many(batch.column(1)), strict=True):
                held.append((i, data + tail))
                tokens += len(data) // 4 + 1
                if tokens >= shard:
                    yield flush()
        if held:
            yield flush()

    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = keyed.repartitionByRange(ranges, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    return stored(dealt.mapInArrow(run, "part int, number int, path string, docs long, tokens long"), "token-files")


def read_shards(files: DataFrame) -> DataFrame:
    """Reads the files back: one row per document, with the checksum of its ids and its first position in its shard."""

    def run(batches):
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, name = opened(path)
                with system.open_input_stream(name) as f:
                    doc_ids, lengths, matrix = loaded(f.read())
                ids = memoryview(matrix.decode()).cast("B")
                ends = np.cumsum(lengths)
                starts = ends - lengths
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts + first), pa.array(lengths), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # ranges and their totals: as many rows as there were tasks
    ranges = files.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("range_start"))
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("range_start") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    placed = files.join(ranges, "part").select("path", first.cast("long").alias("first"))
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(tasks, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
