"""Removal of repeated runs of lines.

A hash rolls over the hashes of neighbouring lines. Chunks are the windows of two lines that it covers, with every line end a
boundary: the densest content-defined cut, which no shift can move. A line goes if it stands in a chunk that isn't the first
of its kind, so each repeated run of two lines and more goes from end to end, whatever stands around it, and each distinct
line stays somewhere. A single line of LONG words and more is a chunk of its own. Sparser cuts lose short passages and the
ends of runs (README has the figures).

A later chunk that overlaps its first one (a line three times in a row) takes only the line beyond it; blank lines between lines
that go, go too; chunks of blank lines and repeated short single lines stay.

Chunks that occur more than once anywhere, by digest, are compared byte by byte with their first occurrence (by doc_id, text
and position); all but the first are cut out. The texts are dealt once, to bring each document its list of repeated chunks;
digests and the repeated chunks travel alone.

Defined cases: null and empty texts, and texts of one short line, have no chunks; a null doc_id sorts last; rows that are equal
in doc_id and text are one document and are rewritten alike; a document that loses all lines keeps its row with an empty text, or
the whole text where copies are spared;
an empty table gives no rows; other columns pass, whatever their names.
"""

from __future__ import annotations

from itertools import groupby

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import carried, stored, with_text
from .tokens import release, sliced

#: Words of a line that is a chunk by itself.
LONG = 50


def rolled(text: str | None, long: int = LONG) -> list[tuple[int, bytes]]:
    """Number and digest of each chunk: 2 k is the window of lines k and k + 1, and 2 k + 1 is the long line k."""
    lines = (text or "").split("\n")
    out, before, blank_before = [], b"", True
    for k, line in enumerate(lines):
        h, blank = xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass")), not line or line.isspace()
        if k and not (blank and blank_before):
            out.append((2 * k - 2, xxhash.xxh3_128_digest(before + h)))
        if len(line) >= 2 * long - 1 and len(line.split(None, long)) >= long:
            out.append((2 * k + 1, xxhash.xxh3_128_digest(h)))
        before, blank_before = h, blank
    return out


def chunk(lines: list[str], number: int) -> str:
    return lines[number // 2] if number % 2 else "\n".join(lines[number // 2 : number // 2 + 2])


def lines_left(text: str, gone: set[int]) -> tuple[list[str], int, int]:
    """Lines that stay without the chunks that go, number of stretches of lines that stay or go, number of those that go."""
    lines = text.split("\n")
    out = [False] * len(lines)
    for number in gone:
        k = number // 2
        if number % 2:
            out[k] = True
            continue
        out[k + 1] = True
        if number - 2 in gone or not k or not lines[k - 1] == lines[k] == lines[k + 1]:
            out[k] = True
    at = 0
    for blank, some in groupby(lines, lambda x: not x or x.isspace()):
        end = at + len(list(some))
        if blank and at and end < len(lines) and out[at - 1] and out[end]:
            out[at:end] = [True] * (end - at)
        at = end
    stretches = [x for x, _ in groupby(out)]
    return [x for x, o in zip(lines, out) if not o], len(stretches), sum(stretches)


def digests(docs: DataFrame, long: int) -> DataFrame:
    """doc, key, chunk, digest of all chunks."""

    def run(batches):
        release()
        for batch in batches:
            for at, texts in sliced(batch.column(2)):
                found = [(at + i, k, d) for i, text in enumerate(texts) for k, d in rolled(text, long)]
                row = pa.array([f[0] for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.binary())], names=["doc", "key", "chunk", "digest"])

    return docs.select("doc", "key", "text").mapInArrow(run, "doc long, key long, chunk int, digest binary")


def cut(docs: DataFrame, long: int = LONG, spare: int | None = None) -> DataFrame:
    """row (all columns of docs), text without its repeated chunks, and the numbers lines, stretches, removed and kept. A document that would lose spare percent of its words and more stays whole."""
    text = F.col("row.text").cast("string")
    docs = carried(docs).withColumns({"doc": F.col("row.doc_id").cast("long"), "key": F.xxhash64(text), "text": text})
    found = stored(digests(docs, long), "line-chunks")
    place = F.struct(F.col("doc").isNull().alias("none"), "doc", "key", "chunk")
    repeated = found.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").select("digest", "first")
    listed = found.join(stored(repeated, "line-repeated"), "digest").groupBy("doc", "key").agg(F.collect_set(F.struct("chunk", "digest", (place == F.col("first")).alias("is_first"))).alias("chunks"))
    on = lambda other: F.col("d.doc").eqNullSafe(other["doc"]) & (F.col("d.key") == other["key"])
    dealt = docs.drop("text").alias("d")
    dealt = stored(dealt.join(listed, on(listed), "left").select("d.*", "chunks"), "line-texts").withColumn("text", text)

    def texts(batches):
        release()
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_(), pa.string())
        for batch in batches:
            for at, some in sliced(batch.column(2)):
                doc, key, chunks = (batch.column(i).slice(at, len(some)).to_pylist() for i in (0, 1, 3))
                table: list[tuple] = []
                for d, k, text, several in zip(doc, key, some, chunks, strict=True):
                    lines = text.split("\n")
                    table += [(d, k, x["chunk"], x["digest"], x["is_first"], chunk(lines, x["chunk"])) for x in several]
                yield pa.RecordBatch.from_arrays([pa.array([t[i] for t in table], k) for i, k in enumerate(kinds)], names=["doc", "key", "chunk", "digest", "is_first", "part"])

    some = dealt.where("chunks is not null").select("doc", "key", "text", "chunks")
    parts = stored(some.mapInArrow(texts, "doc long, key long, chunk int, digest binary, is_first boolean, part string"), "line-parts")
    firsts = stored(parts.where("is_first").select("digest", F.col("part").alias("first_part")).dropDuplicates(["digest"]), "line-firsts")
    same = parts.where("not is_first").join(firsts, "digest").where("part = first_part")
    gone = same.groupBy("doc", "key").agg(F.collect_set("chunk").alias("gone"))
    out = dealt.where("chunks is not null").alias("d").join(gone, on(gone), "left").select("row", "text", "gone")
    out = out.unionByName(dealt.where("chunks is null").select("row", "text", F.lit(None).cast("array<int>").alias("gone")))

    def rewritten(batches):
        release()
        kinds = (pa.string(), *[pa.int64()] * 4)
        for batch in batches:
            for at, some in sliced(batch.column(1)):
                table = []
                for text, out_ in zip(some, batch.column(2).slice(at, len(some)).to_pylist(), strict=True):
                    if text is None:
                        table.append((None, 0, 0, 0, 0))
                        continue
                    kept, stretches, removed = lines_left(text, set(out_ or ()))
                    if spare is not None and out_:
                        words = len(text.split())
                        if 100 * (words - sum(len(x.split()) for x in kept)) >= spare * words:
                            kept, stretches, removed = text.split("\n"), 1, 0
                    table.append(("\n".join(kept) if out_ else text, text.count("\n") + 1, stretches, removed, len(kept)))
                done = [pa.array([t[i] for t in table], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(some)), *done], names=["row", "text", "lines", "stretches", "removed", "kept"])

    schema = out.select("row").schema
    for name, kind in (("text", "string"), ("lines", "long"), ("stretches", "long"), ("removed", "long"), ("kept", "long")):
        schema = schema.add(name, kind)
    return out.mapInArrow(rewritten, schema)


def without_repeats(docs: DataFrame, long: int = LONG, spare: int | None = None) -> DataFrame:
    """docs with their repeated chunks of lines cut out. With spare, a document that would lose so many percent of its words is a copy as a whole and stays for a near-duplicate stage to decide on."""
    return cut(docs, long, spare).select(*with_text(F.col("text"), docs))


def told(docs: DataFrame, long: int = LONG) -> DataFrame:
    """Per document: lines, stretches of lines that stay or go, stretches cut out, lines kept, and the checksum of what is left."""
    return cut(docs.select("doc_id", "text"), long).select(
        "row.doc_id", F.col("lines").alias("n_lines"), F.col("stretches").alias("n_chunks"), F.col("removed").alias("n_removed"), F.col("kept").alias("n_kept_lines"), F.crc32(F.coalesce("text", F.lit(""))).alias("kept_crc32")
    )
