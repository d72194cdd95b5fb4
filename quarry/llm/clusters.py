"""Exact k-means with ns-bounds.

Every vector keeps its cluster, an upper bound of the distance to it, and a lower bound of the distance to every centroid, each
with the round of its last evaluation. The centroids of all rounds are kept; a bound is loosened by the norm of the total
displacement of its centroid since that round, which is never more than the sum of the drifts round by round. A vector whose
upper bound stays below all other lower bounds keeps its cluster unseen; otherwise the distance to its own centroid is evaluated,
and then those to the centroids whose bounds still don't exclude them, in integers. Vectors never move between partitions:
a round reads and writes the table of vectors with their bounds, and partial sums of clusters are all that is shuffled.

Defined cases: vectors that are null, of another width, or with null or non-finite components take no part; components beyond
LARGEST on either side count as that, sums and distances are integers of any size, and distances beyond 64 bits are given as the
limit of a long; fewer vectors than clusters make each of them a centroid; equal hashes go by vec_id and vector, null vec_ids last;
equal distances go to the smaller number; empty clusters keep their centroid; repeated rows are vectors of their own; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import removed, stored
from .sums import rows_of
from .tokens import release

#: Components are at most this, so that sums of any number of rows fit the decimals that carry them.
LARGEST = 2**62
#: Squares of distances below this are exact in doubles.
EXACT = 2.0**53
#: Vectors that are looked at together.
AT_ONCE = 4_096
LONG = 2**63 - 1
#: Bounds are kept as 32-bit numbers, a little looser; rounding of loosened bounds is far below this.
SLACK = 1e-6
STATE = "vec_id long, x array<double>, cluster int, upper float, upper_round int, lower array<float>, lower_round array<byte>, evaluated long"


def whole(df: DataFrame, width: int, scale: int) -> DataFrame:
    """vec_id and the vector, whole numbers in doubles, of the rows that take part."""
    fine = F.col("embedding").isNotNull() & (F.size("embedding") == width) & F.forall("embedding", lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    limit = float(LARGEST)
    scaled = F.transform("embedding", lambda c: F.least(F.lit(limit), F.greatest(F.lit(-limit), F.lit(float(scale)) * c.cast("double"))))
    # doubles from 2^53 up are whole
    x = F.transform(scaled, lambda y: F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y))
    return df.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


class Centroids:
    """The centroids of every round so far, as whole numbers of any size."""

    def __init__(self, first: list[list[int]]):
        self.rounds = [first]

    def add(self, sums: dict[int, tuple[int, list[int]]]) -> None:
        """The next round's, from the number and the sums of each cluster's vectors."""
        self.rounds.append([[s // sums[j][0] for s in sums[j][1]] if j in sums else c for j, c in enumerate(self.rounds[-1])])

    def now(self) -> list[list[int]]:
        return self.rounds[-1]

    def moved(self) -> np.ndarray:
        """How far each centroid lies from its place in each round, rounded up."""
        if not self.now():
            return np.zeros((len(self.rounds), 0))
        now = np.array(self.now(), float)
        return np.stack([np.sqrt(((np.array(r, float) - now) ** 2).sum(1)) for r in self.rounds]) * (1 + SLACK)


def held(x: np.ndarray, centroids: list[list[int]]) -> bool:
    """Whether doubles hold the squared distances exactly."""
    return not x.size or x.shape[1] * (float(np.abs(x).max()) + float(np.abs(np.array(centroids, float)).max())) ** 2 < EXACT


def squares(x: np.ndarray, centroid: list[int]) -> np.ndarray:
    """Squared distances of vectors to a centroid, exactly: as doubles where they hold them, else as integers of any size."""
    c = np.array(centroid, float)
    if not held(x, [centroid]):
        d = np.array([[int(v) for v in row] for row in x.tolist()], object) - np.array(centroid, object)
        return (d * d).sum(1)
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def least(x: np.ndarray, tried: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest of the centroids that are tried for each vector, its squared distance, and the roots of all that were evaluated."""
    fits = held(x, centroids)
    best, cluster = np.full(len(x), np.inf, float if fits else object), np.full(len(x), -1)
    roots = np.zeros(tried.shape)
    for j in range(len(centroids)):
        at = np.flatnonzero(tried[:, j])
        if len(at):
            square = squares(x[at], centroids[j])
            roots[at, j] = np.sqrt(square.astype(float))
            closer = square < best[at] if fits else np.array([s < b for s, b in zip(square.tolist(), best[at].tolist(), strict=True)], bool)
            best[at[closer]], cluster[at[closer]] = square[closer], j
    return cluster, best, roots


def below(roots: np.ndarray) -> np.ndarray:
    return (roots * (1 - SLACK)).astype(np.float32)


def above(roots: np.ndarray) -> np.ndarray:
    return (roots * (1 + SLACK)).astype(np.float32)


def begun(x: np.ndarray, history: Centroids) -> tuple:
    """The state of vectors that see the centroids for the first time."""
    k = len(history.now())
    cluster, best, roots = least(x, np.ones((len(x), k), bool), history.now())
    upper = above(np.sqrt(best.astype(float)))
    return cluster, upper, np.zeros(len(x), int), below(roots), np.zeros((len(x), k), np.int8), np.full(len(x), k)


def carried_on(x: np.ndarray, cluster, upper, upper_round, lower, lower_round, evaluated, history: Centroids, moved: np.ndarray) -> tuple:
    """The state of vectors after another round of centroids."""
    k, now = len(history.now()), len(history.rounds) - 1
    cluster, upper, upper_round, lower, lower_round, evaluated = (np.array(a) for a in (cluster, upper, upper_round, lower, lower_round, evaluated))
    # bounds stay as they were evaluated; only what they are now is loosened
    loose = lower.astype(float) - moved[lower_round, np.arange(k)[None, :]]
    loose[np.arange(len(x)), cluster] = np.inf
    far = upper.astype(float) + moved[upper_round, cluster]
    open_ = np.flatnonzero(far >= loose.min(1) * (1 - SLACK))
    if len(open_):
        own = np.empty(len(open_))
        for j in np.unique(cluster[open_]).tolist():
            at = cluster[open_] == j
            own[at] = np.sqrt(squares(x[open_[at]], history.now()[j]).astype(float))
        evaluated[open_] += 1
        upper[open_], upper_round[open_] = above(own), now
        lower[open_, cluster[open_]], lower_round[open_, cluster[open_]] = below(own), now
        still = own * (1 + SLACK) >= loose[open_].min(1) * (1 - SLACK)
        open_, own = open_[still], own[still]
    if len(open_):
        tried = own[:, None] * (1 + SLACK) >= loose[open_] * (1 - SLACK)
        tried[np.arange(len(open_)), cluster[open_]] = True
        nearest, best, roots = least(x[open_], tried, history.now())
        evaluated[open_] += tried.sum(1) - 1
        cluster[open_], upper[open_], upper_round[open_] = nearest, above(np.sqrt(best.astype(float))), now
        row, column = np.nonzero(tried)
        lower[open_[row], column], lower_round[open_[row], column] = below(roots[row, column]), now
    return cluster, upper, upper_round, lower, lower_round, evaluated


def assigned(rows: DataFrame, history: Centroids) -> DataFrame:
    """The state of all vectors in the latest round."""
    first, moved, k = len(history.rounds) == 1, history.moved(), len(history.now())

    def run(batches):
        release()
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(at, AT_ONCE)
                x = rows_of(some.column(1))
                if first:
                    state = begun(x, history)
                else:
                    known = [some.column(i).to_numpy() if i not in (5, 6) else rows_of(some.column(i)) for i in range(2, 8)]
                    state = carried_on(x, *known, history, moved)
                kinds = (pa.int32(), pa.float32(), pa.int32(), pa.list_(pa.float32()), pa.list_(pa.int8()), pa.int64())
                columns = [pa.ListArray.from_arrays(np.arange(0, (len(x) + 1) * k, k, dtype=np.int32), pa.array(s.ravel(), t.value_type)) if pa.types.is_list(t) else pa.array(s, t) for s, t in zip(state, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *columns], names=["vec_id", "x", "cluster", "upper", "upper_round", "lower", "lower_round", "evaluated"])

    return rows.mapInArrow(run, STATE)


def cluster_sums(state: DataFrame, width: int) -> dict[int, tuple[int, list[int]]]:
    """Number and exact sums of the vectors of each cluster that has any."""

    def run(batches):
        release()
        found: dict[int, list[int]] = {}
        for batch in batches:
            cluster = batch.column(0).to_numpy()
            for at in range(0, batch.num_rows, AT_ONCE):
                x, c = rows_of(batch.column(1).slice(at, AT_ONCE)), cluster[at : at + AT_ONCE]
                for j in np.unique(c).tolist():
                    y = x[c == j]
                    if float(np.abs(y).max()) * len(y) >= EXACT:
                        y = np.array([[int(v) for v in row] for row in y.tolist()], object)
                    before = found.get(j, [0] * (width + 1))
                    found[j] = [a + int(b) for a, b in zip(before, [len(y), *y.sum(0)], strict=True)]
        table = [(j, i - 1, Decimal(v)) for j, values in found.items() for i, v in enumerate(values)]
        kinds = (pa.int32(), pa.int32(), pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array([t[i] for t in table], kind) for i, kind in enumerate(kinds)], names=["cluster", "at", "value"])

    partial = state.select("cluster", "x").mapInArrow(run, "cluster int, at int, value decimal(38,0)")
    out: dict[int, tuple[int, list[int]]] = {}
    for j, at, value in sorted(partial.groupBy("cluster", "at").agg(F.sum("value").cast("decimal(38,0)")).collect()):  # one for each cluster and dimension
        if at < 0:
            out[j] = int(value), []
        else:
            out[j][1].append(int(value))
    return out


def seeds(rows: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.select(digest.alias("digest"), "vec_id", "x").orderBy(F.col("digest").asc_nulls_last(), "vec_id", "x").limit(clusters)
    return [[int(v) for v in r.x] for r in first.collect()]


def grouped(vectors: DataFrame, clusters: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, seed: int = 2) -> tuple[DataFrame, Centroids]:
    """The state of all vectors after the last assignment, and the centroids of all rounds."""
    rows = whole(vectors, width, scale)
    history = Centroids(seeds(rows, clusters, seed))
    state = stored(assigned(rows, history), "clusters")
    for _ in range(rounds):
        history.add(cluster_sums(state, width))
        state, before = stored(assigned(state, history), "clusters"), state
        removed(before)
    return state, history


def clustered(vectors: DataFrame, clusters: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, seed: int = 2) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, and the distances evaluated for the vector (of clusters for each of all rounds without bounds)."""
    state, history = grouped(vectors, clusters, rounds, width, scale, seed)
    last = history.now()

    def run(batches):
        release()
        for batch in batches:
            cluster = batch.column(1).to_numpy()
            distance = np.zeros(len(cluster), np.int64)
            x = rows_of(batch.column(2))
            for j in np.unique(cluster).tolist():
                at = np.flatnonzero(cluster == j)
                distance[at] = [min(LONG, int(s)) for s in squares(x[at], last[j]).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(distance), batch.column(3)], names=["vec_id", "cluster", "distance", "evaluated"])

    found = state.select("vec_id", "cluster", "x", "evaluated").mapInArrow(run, "vec_id long, cluster int, distance long, evaluated long")
    sums = {r[0]: int(r[1]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}  # one for each cluster
    every = min(LONG, sum(sums.values()))
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in last]
    facts = [(j, min(LONG, s), every, digest[j]) for j, s in sums.items()]
    facts = state.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "evaluated")
