"""Content-defined chunk store for media payloads.

A payload's text bytes, padded to whole frames, are 8-bit samples behind a short header: the media object. A rolling gear
hash cuts objects into chunks. Objects with equal texts are one object. Chunk digests of all objects meet in Spark joins: a
chunk found in several objects is owned by one of them and borrowed by the others. An object's stored row holds its ordered
chunk list and the bytes of the chunks it owns. Reading joins the borrowed chunks back in, puts the list together and
verifies it against the digest that the list was made with.

Texts that have no copy and borrow nothing, by a bitmap of bounded size, are stored where they are read; of the others each is
dealt once, by its digest, and borrowed chunks travel again. A false hit of the bitmap only moves a text.

Defined cases: a null text counts as empty, and an empty one has one frame of padding; a null doc_id is kept; repeated rows
read the same object; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stored
from .tokens import pieces

#: Bytes of a frame, and what fills the last one.
FRAME, FILL = 576, b"\xff"
#: Header: name, version, bits of a sample, bytes in a frame, samples, text bytes.
HEAD = struct.Struct("<4sBBHQQ")
NAME = b"QMED"
#: Bytes of a chunk: least, most, and the mask whose bits the gear hash must clear, for an average of about 2 KB.
LEAST, MOST, MASK = 512, 8_192, np.uint32(0x7FF << 21)
GEAR = np.random.default_rng(576).integers(0, 1 << 32, 256, np.uint32)
#: Bits of the map that tells which objects may have copies or borrowed chunks; when it fills, more objects travel.
BITS = 1 << 25
#: Bytes of texts or chunks that are held at once.
AT_ONCE = 1_000_000
#: Bytes that the gear hash remembers.
WINDOW = 32


def media(text: str | None) -> bytes:
    """The media object of a text."""
    data = (text or "").encode()
    samples = data + FILL * ((-len(data)) % FRAME or (0 if data else FRAME))
    return HEAD.pack(NAME, 1, 8, FRAME, len(samples), len(data)) + samples


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash behind each byte, h = 2 h + g of the last WINDOW bytes, by doubling the span."""
    h = GEAR[data]
    span = 1
    while span < WINDOW:
        more = h[:-span] << np.uint32(span)
        h[span:] += more
        span *= 2
    return h


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks."""
    candidates = (np.flatnonzero((gear(np.frombuffer(data, np.uint8)) & MASK) == 0) + 1).tolist() if len(data) > LEAST else []
    ends, start = [], 0
    for c in [*candidates, len(data)]:
        while c - start > MOST:
            start += MOST
            ends.append(start)
        if c - start >= LEAST or c == len(data) and c > start:
            start = c
            ends.append(c)
    return ends


def chunked(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def key(text: str | None) -> bytes:
    """Half of the text's SHA-256 names its object."""
    return hashlib.sha256((text or "").encode()).digest()[:16]


def listed(texts: DataFrame) -> DataFrame:
    """media, number, digest of the chunks of each text."""

    def run(batches):
        for batch in slices(batches, 0):
            media_, number, digests = [], [], []
            for text in batch.column(0).to_pylist():
                name = key(text)
                for k, chunk in enumerate(chunked(media(text))):
                    media_.append(name)
                    number.append(k)
                    digests.append(digest(chunk))
            yield pa.RecordBatch.from_arrays([pa.array(media_, pa.binary()), pa.array(number, pa.int32()), pa.array(digests, pa.binary())], names=["media", "number", "digest"])

    return texts.select("text").mapInArrow(run, "media binary, number int, digest binary")


def bitmap(keys: DataFrame) -> np.ndarray:
    """Bits at the hashes of all keys (key binary): BITS of them, whatever the input; Spark builds it and the driver gets it whole."""
    at = F.pmod(F.xxhash64("key"), F.lit(BITS)) + 1  # the functions count from 1
    parts = keys.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(BITS // 8, np.uint8)
    for bucket, bits in parts.collect():  # at most BITS / 32768 rows of 4 KB
        out[(bucket - 1) * len(bits) : bucket * len(bits)] = np.frombuffer(bits, np.uint8)
    return out


def stored_row(text: str | None, absent: set[int]) -> tuple:
    data = media(text)
    parts = chunked(data)
    return key(text), hashlib.sha256(data).hexdigest(), [digest(p) for p in parts], [None if k in absent else p for k, p in enumerate(parts)], sorted(absent)


def slices(batches, column: int):
    """Batches in parts of some bytes of a column: what a part becomes is held only once."""
    for batch in batches:
        yield from pieces(batch, column, AT_ONCE)


STORE = "media binary, sha256 string, digests array<binary>, own array<binary>, borrowed array<int>"


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.string(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["media", "sha256", "digests", "own", "borrowed"])


def write_store(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with the key of their object; and the store: media, sha256 of the object, chunk list, own chunks, numbers of borrowed chunks."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(text.alias("text"))
    # digests first: which chunks several objects hold, who owns them, and which objects several documents have
    found = stored(listed(texts), "media-chunks")
    spot = F.struct("media", "number")
    shared = found.groupBy("digest").agg(F.min(spot).alias("owner"), F.max(spot).alias("last")).where("owner != last").select("digest", "owner")
    shared = stored(shared, "media-shared")
    copies = found.where("number = 0").groupBy("media").count().where("count > 1")
    lists = stored(found.join(shared, "digest").where(spot != F.col("owner")).groupBy("media").agg(F.collect_set("number").alias("borrowed")), "media-lists")
    bits = bitmap(copies.select(F.col("media").alias("key")).union(lists.select("media")))

    def doubtful(text_: str) -> bool:
        h = xxhash.xxh64_intdigest(key(text_), seed=42) % BITS
        return bool(bits[h >> 3] >> (h & 7) & 1)

    def alone(batches):
        for batch in slices(batches, 0):
            yield as_batch([stored_row(t, set()) for t in batch.column(0).to_pylist() if not doubtful(t)])

    def others(batches):
        for batch in slices(batches, 0):
            keep = [t for t in batch.column(0).to_pylist() if doubtful(t)]
            yield pa.RecordBatch.from_arrays([pa.array([key(t) for t in keep], pa.binary()), pa.array(keep, pa.string())], names=["media", "text"])

    def joined(batches):
        for batch in slices(batches, 0):
            yield as_batch([stored_row(t, set(b or ())) for t, b in zip(*(c.to_pylist() for c in batch.columns), strict=True)])

    # objects of one document that own all their chunks are stored where they are read; each of the others comes once to its list
    once = texts.mapInArrow(others, "media binary, text string").groupBy("media").agg(F.min("text").alias("text")).join(lists, "media", "left")
    parts = [stored(texts.mapInArrow(alone, STORE), "media-store"), stored(once.select("text", "borrowed").mapInArrow(joined, STORE), "media-store")]
    of = docs.select("doc_id", F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("media"))
    return of, parts[0].union(parts[1])


def read_store(store: DataFrame) -> DataFrame:
    """media and what is computed from its reconstructed and verified object."""
    wanted = store.where(F.size("borrowed") > 0).select("media", F.explode("borrowed").alias("number"), "digests").select("media", "number", F.get("digests", F.col("number")).alias("digest"))
    needed = stored(wanted, "media-wanted")
    offered = store.select(F.explode(F.arrays_zip("digests", "own")).alias("c")).select(F.col("c.digests").alias("digest"), F.col("c.own").alias("bytes")).where("bytes is not null")
    lent = stored(offered.join(needed.select("digest").distinct(), "digest").dropDuplicates(["digest"]), "media-lent")
    brought = needed.join(lent, "digest").groupBy("media").agg(F.map_from_entries(F.collect_list(F.struct("number", "bytes"))).alias("brought"))
    whole = store.where(F.size("borrowed") == 0).withColumn("brought", F.lit(None).cast("map<int,binary>"))
    joined = store.where(F.size("borrowed") > 0).join(brought, "media", "left")
    ready = whole.unionByName(joined).select("media", "sha256", "digests", "own", "brought")

    def run(batches):
        for batch in slices(batches, 3):
            rows = []
            for key, sha256, digests, own, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                other = dict(other or ())
                parts = [other[k] if p is None else p for k, p in enumerate(own)]
                data = b"".join(parts)
                if [digest(p) for p in parts] != digests or hashlib.sha256(data).hexdigest() != sha256:
                    raise ValueError(f"media object {key.hex()} isn't what was stored")
                rows.append((key, *measured(data, len(parts))))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ("media", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=list(names))

    return ready.mapInArrow(run, "media binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def measured(data: bytes, n_chunks: int) -> tuple:
    """Sizes, digests and features of an object: chunks, mean sample and loudest frame."""
    _, _, _, frame, n_samples, n_text = HEAD.unpack_from(data)
    samples = data[HEAD.size :]
    if len(samples) != n_samples or n_samples % frame:
        raise ValueError("not a media object")
    levels = np.frombuffer(samples, np.uint8).reshape(-1, frame).sum(1, dtype=np.int64)
    feature = f"chunks={n_chunks};frames={len(levels)};sum={int(levels.sum())};loudest={int(levels.argmax())}"
    return n_text, n_samples, hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature


def stored_media(docs: DataFrame) -> DataFrame:
    """Per document: what its object, read back from the store, says."""
    of, store = write_store(docs)
    rows = stored(read_store(store), "media-read")
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return of.join(rows, "media").select("doc_id", *names)
