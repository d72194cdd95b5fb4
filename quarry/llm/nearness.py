"""Near-duplicate groups by a signature-coordinate inverted join.

Each distinct shingle set has a MinHash signature. Sets are posted under coordinate-value pairs; two sets above the
similarity agree in at least t of n coordinates but for a chance of one in a million, so they share one of the n - t + 1
rarest pairs of either (prefix), and pairs that no other set has are skipped. The postings of a pair are merged around their
most central set, which meets all others. Where a list still lies in several components after that, its members meet block by
block within tasks. Wherever sets meet, the equal coordinates of their signatures are counted, and a block drops the sets
that can't reach the match threshold any more (skip); what stays above the threshold is confirmed on full shingle sets. Only
signatures meet in numbers: texts travel for what has a pair above the threshold alone, a left text once for many of its pairs.

Equal sets are one class from the start, so copies are never paired. Links, classes and components stay in Spark.

Defined cases: texts without words (and nulls) have no shingles and link with nothing; fewer words than a shingle has are
one shingle; a component's id is its smallest non-null doc_id; rows with equal or null doc_ids are rows of their own; an
empty table gives no rows; other columns are ignored here and pass one_of_each(), whatever their names.
"""

from __future__ import annotations

import math
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import carried, stored
from .tokens import pieces, release, sliced

#: Coordinates of a signature (a byte of each is kept), and those of them under which sets are posted.
COORDINATES, POSTED = 256, 32
#: Chance that a pair exactly at the similarity has fewer matches than the threshold.
MISS = 1e-6
#: Sets on either side of a comparison, coordinates counted between two looks at what can be skipped, and parts of a left set's pairs.
BLOCK, STRIDE, PARTS = 256, 32, 256
#: Words whose hash a task remembers.
MEMO = 100_000
_rng = np.random.default_rng(20_240_601)
FACTORS = (_rng.integers(0, 1 << 31, COORDINATES) * 2 + 1).astype(np.uint32)
OFFSETS = _rng.integers(0, 1 << 32, COORDINATES).astype(np.uint32)
MIX = _rng.integers(0, 1 << 63, 4, np.uint64) * np.uint64(2) + np.uint64(1)
PLACES = MIX[0] + np.arange(0, 2 * COORDINATES, 2, dtype=np.uint64) * MIX[1]


def threshold(percent: int, coordinates: int) -> int:
    """The most coordinates in which sets of this similarity agree but for a chance of MISS, by the exact binomial tail."""
    p, tail, t = percent / 100, 0.0, 0
    while t < coordinates:
        tail += math.comb(coordinates, t) * p**t * (1 - p) ** (coordinates - t)
        if tail > MISS:
            break
        t += 1
    return max(1, t)


class Words(dict):
    """Word bytes to 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 200:
            self[word] = h
        return h


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX[3]
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[str | None], size: int, words: Words) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: words are runs of what is not ASCII white space, A-Z lower-cased."""
    split = [t.encode().lower().split() if t else [] for t in texts]
    flat = np.fromiter((words[w] for s in split for w in s), np.uint64)
    rolled = np.zeros(max(0, len(flat) - size + 1), np.uint64)
    for k in range(size):
        rolled += flat[k : k + len(rolled)] * PLACES[k]
    rolled = scrambled(rolled)
    out, at = [], 0
    for s in split:
        n = len(s)
        if n >= size:
            out.append(np.unique(rolled[at : at + n - size + 1]))
        elif n:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(s), seed=n)], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def sign(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of non-empty sets, one in each row: the posted coordinates as 32-bit integers, and a byte of each coordinate."""
    flat, starts = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32), np.cumsum([0, *map(len, sets[:-1])])
    posted, short = np.empty((len(sets), POSTED), np.int32), np.empty((len(sets), COORDINATES), np.uint8)
    for j in range(COORDINATES):
        least = scrambled(np.minimum.reduceat(flat * FACTORS[j] + OFFSETS[j], starts).astype(np.uint64))
        short[:, j] = least & np.uint64(255)
        if j < POSTED:
            posted[:, j] = (least >> np.uint64(16)).astype(np.uint32).view(np.int32)
    return posted, short


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, key, number of shingles, the set's digest (null if empty), its posted coordinates and its signature."""

    def run(batches):
        release()
        words = Words()
        for batch in batches:
            for a, texts in sliced(batch.column(1), 1_000_000):
                sets = shingle_sets(texts, size, words)
                full = [s for s in sets if len(s)]
                posted, short = sign(full) if full else ((), ())
                rows, marks = iter(posted), iter(short)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, len(texts)),
                        batch.column(2).slice(a, len(texts)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([next(rows) if len(s) else None for s in sets], pa.list_(pa.int32())),
                        pa.array([next(marks).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "key", "n_shingles", "node", "posted", "signature"],
                )

    return docs.select("doc_id", "text", "key").mapInArrow(run, "doc_id long, key long, n_shingles long, node binary, posted array<int>, signature binary")


def postings(classes: DataFrame, percent: int) -> DataFrame:
    """token, node, central: each class under the rarest coordinate-value pairs that it shares with others."""
    token = F.shiftleft(F.col("pos").cast("long"), 32) + F.col("col").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    tokens = classes.select("node", F.posexplode("posted")).select("node", token.alias("token"))
    often = stored(tokens.groupBy("token").count().where("count > 1"), "near-frequencies")
    shared = tokens.join(often, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("count", "token"))).alias("shared"))
    unique = F.lit(POSTED) - F.size("shared")
    prefix = F.slice("shared", 1, F.greatest(F.lit(0), F.lit(POSTED - threshold(percent, POSTED) + 1) - unique))
    central = F.aggregate("shared", F.lit(0.0), lambda s, x: s + F.log2(x["count"]))
    return stored(shared.select("node", central.alias("central"), F.explode(F.transform(prefix, lambda x: x["token"])).alias("token")), "near-postings")


def around_hubs(posts: DataFrame) -> DataFrame:
    """Pairs of each list's most central member with its others."""
    hubs = stored(posts.groupBy("token").agg(F.max(F.struct("central", "node")).alias("top"), F.count("*").alias("size")).where("size > 1").select("token", F.col("top.node").alias("hub")), "near-hubs")
    return posts.join(hubs, "token").where("node != hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def alike(pairs: DataFrame, classes: DataFrame, matches: int) -> DataFrame:
    """Pairs whose signatures agree in enough coordinates."""

    def run(batches):
        release()
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, COORDINATES) for i in (2, 3))
            keep = pa.array((one == two).sum(1) >= matches)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], names=["a", "b"])

    one = classes.select(F.col("node").alias("a"), F.col("signature").alias("sa"))
    two = classes.select(F.col("node").alias("b"), F.col("signature").alias("sb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def collisions(left: np.ndarray, right: np.ndarray, matches: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of left and right whose signatures agree in at least so many coordinates, and in how many."""
    i, j = np.arange(len(left)), np.arange(len(right))
    common = np.zeros((len(i), len(j)), np.uint16)
    for start in range(0, COORDINATES, STRIDE):
        for c in range(start, start + STRIDE):
            common += left[i, c][:, None] == right[j, c][None, :]
        can = common + (COORDINATES - start - STRIDE) >= matches
        rows, columns = can.any(1), can.any(0)
        if not (rows.all() and columns.all()):
            i, j, common = i[rows], j[columns], common[np.ix_(rows, columns)]
    x, y = np.nonzero(common >= matches)
    return i[x], j[y], common[x, y]


def across(posts: DataFrame, classes: DataFrame, roots: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between components that meet in a list. Around a list's largest component gathers a family: its members in such lists (main) and the others there (rest); each block of the rest meets each block of either within a task. Signatures meet first, and say which sets have a pair above the match threshold there; only these bring their texts, and pairs that still join components are confirmed on full sets where they meet, so that no table of pairs is made."""
    matches = threshold(percent, COORDINATES)
    placed = posts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = placed.groupBy("token", "root").count()
    lists = sizes.groupBy("token").agg(F.max(F.struct("count", "root")).alias("main"), F.sum("count").alias("size"), F.count("*").alias("parts"))
    lists = stored(lists.where("parts > 1 and size > 2").select("token", F.col("main.root").alias("family")), "near-lists")
    met = stored(placed.join(lists, "token").select("family", "node", "root").distinct(), "near-families")
    inside = F.col("root") == F.col("family")
    of_family = met.groupBy("family").agg(F.count(F.when(inside, 1)).alias("n_main"), F.count(F.when(~inside, 1)).alias("n_rest"))
    many = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    both = met.join(of_family, "family").withColumn("block", F.pmod(F.xxhash64("node"), F.when(inside, many("n_main")).otherwise(many("n_rest"))).cast("int"))
    rest, main = F.sequence(F.lit(0), many("n_rest") - 1), F.sequence(F.lit(0), many("n_main") - 1)
    # a comparison holds a block of the rest on the left (side 0) against one of the main component or of the rest (side 1; 2 if it is the same block)
    fields = lambda left, right, to_main, side: F.struct(left.alias("left"), right.alias("right"), F.lit(to_main).alias("to_main"), side.alias("side"))
    of_main = F.transform(rest, lambda i: fields(i, F.col("block"), True, F.lit(1)))
    beside = lambda j: F.when(F.col("block") == j, 2).when(F.col("block") < j, 0).otherwise(1)
    of_rest = F.concat(
        F.transform(main, lambda j: fields(F.col("block"), j, True, F.lit(0))),
        F.transform(rest, lambda j: fields(F.least("block", j), F.greatest("block", j), False, beside(j))),
    )
    key = ["family", "left", "right", "to_main"]
    tasks = both.select("family", "node", "root", F.inline(F.when(inside, of_main).otherwise(of_rest))).join(classes.select("node", "signature"), "node").select(*key, "side", "node", "root", "signature")
    parts = int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df: df.repartition(parts, *key).sortWithinPartitions(*key)

    def pairs(side: tuple, root: tuple, signature: tuple) -> list[tuple[int, int, int]]:
        """Rows of pairs of different components above the threshold, most matches first."""
        marks, side = np.frombuffer(b"".join(signature), np.uint8).reshape(-1, COORDINATES), np.array(side)
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        i, j, common = collisions(marks[left], marks[right], matches)
        found = [(-n, x, y) for x, y, n in zip(left[i].tolist(), right[j].tolist(), common.tolist(), strict=True) if root[x] != root[y]]
        return [(x, y, -n) for n, x, y in sorted(found)]

    def blocks(batches):
        release()
        rows = (row for batch in batches for part in pieces(batch, batch.num_columns - 1) for row in zip(*(c.to_pylist() for c in part.columns), strict=True))
        for _, block in groupby(rows, lambda r: r[:4]):
            yield list(block)

    def near(batches):
        names, kinds = [*key, "side", "node", "root", "signature"], (pa.binary(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        for block in blocks(batches):
            keep = sorted({k for x, y, _ in pairs(*zip(*((r[4], r[6], r[7]) for r in block), strict=True)) for k in (x, y)})
            yield pa.RecordBatch.from_arrays([pa.array([block[k][c] for k in keep], kind) for c, kind in enumerate(kinds)], names=names)

    def linked(batches):
        words = Words()
        for block in blocks(batches):
            _, _, _, _, side, node, root, signature, text = zip(*block, strict=True)
            sets = shingle_sets(list(text), size, words)
            join, found = {r: r for r in root}, []

            def find(r):
                while join[r] != r:
                    r = join[r]
                return r

            for x, y, _ in pairs(side, root, signature):
                a, b = find(root[x]), find(root[y])
                if a != b and similar(sets[x], sets[y], percent):
                    join[max(a, b)] = min(a, b)
                    found.append((node[x], node[y]))
            yield pa.RecordBatch.from_arrays([pa.array([f(p) for p in found], pa.binary()) for f in (min, max)], names=["a", "b"])

    kinds = "family binary, left int, right int, to_main boolean, side int, node binary, root binary, signature binary"
    meeting = stored(dealt(tasks).mapInArrow(near, kinds), "near-meetings")
    return dealt(meeting.join(texts, "node").select(*key, "side", "node", "root", "signature", "text")).mapInArrow(linked, "a binary, b binary").distinct()


def similar(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    """Whether two full sets share enough of all their shingles."""
    both = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * both >= percent * (len(one) + len(two) - both)


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs whose full shingle sets are similar enough. A left text travels once for each part of its pairs, before their right texts."""
    pairs = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(PARTS)).cast("int").alias("part"))
    left = pairs.select("a", "part").distinct().join(texts.withColumnRenamed("node", "a"), "a").select("a", "part", F.lit(None).cast("binary").alias("b"), "text")
    right = pairs.join(texts.withColumnRenamed("node", "b"), "b").select("a", "part", "b", "text")
    dealt = left.unionByName(right).repartition("a", "part").sortWithinPartitions("a", "part", "b")

    def run(batches):
        release()
        words, of, one = Words(), None, np.empty(0, np.uint64)
        for batch in batches:
            for at, some in sliced(batch.column(3), 1_000_000):
                a, part, b = (batch.column(i).slice(at, len(some)).to_pylist() for i in range(3))
                keep: list[tuple[bytes, bytes]] = []
                for key, node, two in zip(zip(a, part, strict=True), b, shingle_sets(some, size, words), strict=True):
                    if node is None:
                        of, one = key, two
                        continue
                    assert of == key
                    if similar(one, two, percent):
                        keep.append((key[0], node))
                yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keep], pa.binary()) for i in (0, 1)], names=["a", "b"])

    return dealt.mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each component, by spreading the smallest label and jumping along it."""
    both = stored(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a")).distinct(), "near-edges")
    labels = stored(both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("root")), "near-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("root").alias("far")), "other").groupBy("node").agg(F.min("far").alias("far"))
        spread = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "far").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        after = stored(spread.join(jump, "root", "left").select("node", "was", F.least("root", F.coalesce("next", "root")).alias("root")), "near-labels")
        labels = after.select("node", "root")
        if after.where("was != root").isEmpty():
            return labels


def near_groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per document: number of shingles, component and whether it is kept. Similarity: shared over all shingles, at least percent / 100."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    rows = stored(signatures(docs, size), "near-signatures")
    one_of = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    classes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"), one_of.alias("row"), F.first("posted").alias("posted"), F.first("signature").alias("signature"))
    classes = stored(classes, "near-classes")
    posts = postings(classes, percent)
    # whole texts of the classes that share postings, one row of each
    wanted = posts.select("node").distinct().join(classes.select("node", "row.doc_id", "row.key"), "node").alias("w")
    texts = docs.alias("d").join(wanted, (F.col("d.key") == F.col("w.key")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))).select("node", "text")
    texts = stored(texts.dropDuplicates(["node"]), "near-texts")
    edges = stored(confirmed(alike(around_hubs(posts), classes, threshold(percent, COORDINATES)), texts, size, percent), "near-links")
    roots = components(edges)
    more = stored(across(posts, classes, roots, texts, size, percent), "near-links")
    if not more.isEmpty():
        roots = components(edges.union(more))
    named = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_node = stored(named.select("node", "root").join(ids, "root").select("node", "root", "component_id"), "near-components")
    out = rows.join(of_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "key", "root")


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group: the smallest doc_id, nulls last. Documents without words stay; of rows that are equal in doc_id and text one stays."""
    text = F.col("row.text").cast("string")
    keyed = carried(docs).withColumns({"doc": F.col("row.doc_id").cast("long"), "key": F.xxhash64(text), "blank": ~F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")})
    rows = near_groups(docs.select("doc_id", "text"), size, percent).where("root is not null").groupBy("root", "doc_id", "key").count()
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    chosen = stored(rows.groupBy("root").agg(F.min(place).alias("row"), F.max("count").alias("most")), "near-chosen")
    only = chosen.select(F.col("row.doc_id").alias("c_doc"), F.col("row.key").alias("c_key"))
    kept = keyed.where("not blank").join(only, (F.col("key") == F.col("c_key")) & F.col("doc").eqNullSafe(F.col("c_doc")), "left_semi")
    if not chosen.where("most > 1").isEmpty():
        kept = kept.dropDuplicates(["key", "doc"])
    return kept.unionByName(keyed.where("blank")).select("row.*")
