"""Exact top-k search by inner product over norm-bucketed vectors.

Vectors are dealt by range of length: part 0 holds the longest, and equal lengths spread over as many parts as they need. The
search goes from the longest part on, in waves of growing width; after each wave a query's k-th best score is its bar, and it goes
on only to parts whose greatest length times its own can still reach it. Within a part, buckets of vectors of like length come
in order: a query's bar, divided by both lengths, is the cosine that a vector there must reach; above 1 the bucket and all
shorter ones are done for that query. A high threshold prunes by coordinates (the strongest ones of the query bound those of
any vector within that cosine), a low one by length alone; what is left is verified by exact integer products.

Defined cases: null vectors, vectors with null or non-finite components and vectors of another width than the query's take
no part; zero vectors score 0; rows that share the query's vec_id are its own and no candidates; a null vec_id is no query
and no candidate; ties go to the smaller vec_id; fewer candidates than k give all; repeated rows are candidates of their own, but one query;
products beyond 64 bits count as the limit of a long; other columns are ignored.
"""

from __future__ import annotations

from heapq import nsmallest
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import stored

#: Vectors in a bucket, queries in a block, vectors in a part; few vectors make smaller parts, for as many tasks.
BUCKET, BLOCK, PART = 512, 2_048, 16_384
SMALL, TASKS = 256, 64
#: A wave is so many times as wide as the one before; greatest lengths that a query compares itself with, at most.
WIDER, MARKS = 8, 4_096
#: Coordinates that prune, and the cosine from which they do.
FOCUS, STEEP = 3, 0.5
#: Sums of products below this are exact in doubles.
EXACT = 2.0**53
LONG = 2**63 - 1


def whole(df: DataFrame, scale: int) -> DataFrame:
    """vec_id, the scaled, floored vector and its length, of the rows that take part."""
    scaled = F.transform("embedding", lambda x: F.lit(float(scale)) * x.cast("double"))
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    # doubles from 2^53 up are whole
    vector = F.transform(scaled, lambda y: F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y))
    return df.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).withColumn("length", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)))


class Best:
    """The k best candidates of each query so far: scores descending, ties by ascending id."""

    def __init__(self, queries: int, k: int, bar: np.ndarray | None = None):
        self.score = np.full((queries, k), -np.inf)
        self.id = np.full((queries, k), LONG, np.int64)
        self.least = np.full(queries, -np.inf) if bar is None else bar

    def bar(self) -> np.ndarray:
        """What a score must reach: the k-th so far, here or elsewhere."""
        return np.maximum(self.score[:, -1], self.least)

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: of each row against ids, -inf where no candidate."""
        k = self.score.shape[1]
        score = np.concatenate((self.score[rows], scores), 1)
        every = np.concatenate((self.id[rows], np.where(scores == -np.inf, LONG, np.broadcast_to(ids, scores.shape))), 1)
        order = np.lexsort((every, -score), 1)[:, :k]
        self.score[rows] = np.take_along_axis(score, order, 1)
        self.id[rows] = np.take_along_axis(every, order, 1)


def search(q_id: np.ndarray, q: np.ndarray, v_id: np.ndarray, v: np.ndarray, k: int, exact, bar: np.ndarray | None = None) -> Best:
    """The k best of v for each row of q, as far as they reach the bar; exact(q, v) gives all products."""
    best = Best(len(q), k, bar)
    length = np.sqrt((v * v).sum(1))
    order = np.lexsort((v_id, -length))
    v_id, v, length = v_id[order], v[order], length[order]
    unit = v / np.maximum(length, 1e-300)[:, None]
    q_length = np.sqrt((q * q).sum(1))
    q_unit = q / np.maximum(q_length, 1e-300)[:, None]
    strongest = np.argsort(-np.abs(q_unit), 1, kind="stable")[:, :FOCUS]
    for start in range(0, len(v), BUCKET):
        some = slice(start, start + BUCKET)
        # the cosine that a vector of this bucket must reach; rounding is allowed for
        must = best.bar() / np.maximum(q_length * length[start], 1e-300)
        rows = np.flatnonzero((must <= 1 + 1e-9) | (best.bar() <= 0))
        if not len(rows):
            break
        steep = rows[must[rows] >= STEEP]
        flat = rows[must[rows] < STEEP]
        if len(flat):
            long_enough = length[some][None, :] * q_length[flat][:, None] * (1 + 1e-9) >= best.bar()[flat][:, None]
            verify(best, flat, q, q_id, v[some], v_id[some], long_enough | (best.bar()[flat] <= 0)[:, None], exact)
        if len(steep):
            turn = np.arccos(np.clip(must[steep], -1, 1))  # the angle to the query is at most this
            inside = np.ones((len(steep), len(v_id[some])), bool)
            for f in range(strongest.shape[1]):
                angle = np.arccos(np.clip(q_unit[steep, strongest[steep, f]], -1, 1))
                at = unit[some][:, strongest[steep, f]].T
                inside &= at >= np.cos(np.minimum(np.pi, angle + turn))[:, None] - 1e-7
                inside &= at <= np.cos(np.maximum(0, angle - turn))[:, None] + 1e-7
            verify(best, steep, q, q_id, v[some], v_id[some], inside, exact)
    return best


def verify(best: Best, rows: np.ndarray, q: np.ndarray, q_id: np.ndarray, v: np.ndarray, v_id: np.ndarray, inside: np.ndarray, exact) -> None:
    """Exact products of what the pruning has left."""
    inside = inside & (v_id[None, :] != q_id[rows][:, None])
    columns, lines = np.flatnonzero(inside.any(0)), np.flatnonzero(inside.any(1))
    if len(columns):
        scores = exact(q[rows[lines]], v[columns])
        best.offer(rows[lines], np.where(inside[np.ix_(lines, columns)], scores, -np.inf), v_id[columns])


def by_integers(q_id: np.ndarray, q: np.ndarray, v_id: np.ndarray, v: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query's row, vec_id, score) by integers of any size, for components whose products doubles can't hold."""
    whole_v = [[int(x) for x in row] for row in v.tolist()]
    found = []
    for i, row in enumerate([int(x) for x in r] for r in q.tolist()):
        scores = ((-max(-LONG - 1, min(LONG, sum(map(mul, row, x)))), d) for x, d in zip(whole_v, v_id.tolist(), strict=True) if d != q_id[i])
        found += [(i, d, -s) for s, d in nsmallest(k, scores)]
    return found


def found_in(table: pa.Table, k: int) -> pa.Table:
    """The k best of a part's vectors for each query of a block."""
    query, ids, keys, bars = (table.column(c).to_numpy() for c in ("query", "vec_id", "key", "bar"))
    lists = table.column("vector").combine_chunks()
    starts, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    width, found = np.diff(starts), []
    for w in np.unique(width[query]).tolist():
        q_at, v_at = np.flatnonzero(query & (width == w)), np.flatnonzero(~query & (width == w))
        q, v = (flat[starts[at][:, None] + np.arange(w)] for at in (q_at, v_at))
        if not len(v_at):
            continue
        if w and float(np.abs(q).max()) * float(np.abs(v).max()) * w >= EXACT:
            best = by_integers(ids[q_at], q, ids[v_at], v, k)
        else:
            b = search(ids[q_at], q, ids[v_at], v, k, lambda x, y: x @ y.T, bars[q_at])
            best = [(i, d, int(s)) for i in range(len(q_at)) for d, s in zip(b.id[i].tolist(), b.score[i].tolist(), strict=True) if s != -np.inf]
        found += [(int(ids[q_at[i]]), int(keys[q_at[i]]), d, s) for i, d, s in best]
    return pa.table({name: pa.array([x[i] for x in found], pa.int64()) for i, name in enumerate(("query_id", "key", "vec_id", "score"))})


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score for queries with ids divisible by every."""
    rows = stored(whole(vectors, scale).withColumn("at", F.monotonically_increasing_id()), "topk-vectors")
    key = F.xxhash64("vec_id", "vector")
    queries = rows.where(F.col("vec_id") % every == 0).select("vec_id", "vector", "length", key.alias("key")).distinct()
    n, n_queries = rows.count(), queries.count()
    parts, blocks = max(1, -(-n // PART), min(TASKS, -(-n // SMALL))), max(1, -(-n_queries // BLOCK))
    # equal lengths go by place in the table, so that no part is larger for them
    rows = rows.repartitionByRange(parts, F.col("length").desc(), "at").withColumn("part", F.spark_partition_id())
    rows = stored(rows.select("part", "vec_id", "vector", "length"), "topk-parts")
    last = (rows.agg(F.max("part")).head()[0] or 0) + 1
    stride = -(-last // MARKS)
    of_mark = {r[0]: r[1] for r in rows.groupBy(F.floor(F.col("part") / stride)).agg(F.max("length")).collect()}  # at most MARKS
    marks = F.array(*(F.lit(float(of_mark.get(i, 0.0))) for i in range(-(-last // stride))))
    queries = stored(queries.withColumn("block", F.pmod("key", F.lit(blocks)).cast("int")), "topk-queries")
    best, start, width = None, 0, 1
    top = Window.partitionBy("query_id", "key").orderBy(F.col("score").desc(), "vec_id")
    while start < last:
        end = min(last, start + width)
        asked = queries.withColumn("bar", F.lit(float("-inf")))
        if best is not None:
            bars = best.where(F.col("rank") == k).select("key", F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("bar"))
            asked = queries.join(bars, ["key", "vec_id"], "left").na.fill(float("-inf"), ["bar"])
        # the greatest lengths fall from part to part: a query goes on as far as they reach its bar
        reach = F.when(F.col("bar") <= 0, last).otherwise(stride * F.size(F.filter(marks, lambda m: m * F.col("length") * (1 + 1e-9) >= F.col("bar"))))
        asked = asked.withColumn("reach", F.least(reach, F.lit(end))).where(F.col("reach") > start)
        asked = asked.withColumn("part", F.explode(F.sequence(F.lit(start), F.col("reach") - 1)))
        asked = asked.select("block", "part", F.lit(True).alias("query"), "key", "vec_id", "vector", "bar")
        here = rows.where((F.col("part") >= start) & (F.col("part") < end)).join(asked.select("block", "part").distinct(), "part")
        here = here.select("block", "part", F.lit(False).alias("query"), F.lit(0).cast("long").alias("key"), "vec_id", "vector", F.lit(0.0).alias("bar"))
        found = here.unionByName(asked).groupBy("block", "part").applyInArrow(lambda table: found_in(table, k), "query_id long, key long, vec_id long, score long")
        every_ = found if best is None else found.unionByName(best.drop("rank"))
        best = stored(every_.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k), "topk-best")
        start, width = end, width * WIDER
    return best.select("query_id", "rank", "vec_id", "score") if best is not None else rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
