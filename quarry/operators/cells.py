"""A vector index in cells, for exact search by cosine.

Unit vectors lie in the cell of the nearest of some centroids, which are fitted on a bounded sample of the vectors. Of each tenant's
part of a cell the index keeps the least and the greatest angle to the centroid. By the triangle inequality on angles, no vector of
a cell is nearer to a query than the difference between the query's angle to the centroid and that range; so a search reads the
cells that promise most, and then only those that can still reach the k-th best score found there.

Defined cases: null vectors, zero vectors and those of another width than the sample's lie in a cell of their own, whose cosine is 0,
and are read whenever 0 can be among the best; ties go to the smaller vec_id; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from ..functions import vector as V
from ..sources.stored import stored
from .search import near, top

#: Vectors that the centroids are fitted on, at most; rounds of fitting; vectors that are looked at together.
SAMPLE, ROUNDS, AT_ONCE = 8_192, 8, 4_096
#: Cells that are read first must hold so many times k vectors.
AMPLE = 2
#: The cell of what has no direction.
NONE = -1
#: Scores are rounded to this many digits, and bounds are loosened by more than that.
DIGITS, SLACK = 6, 2e-6


def units(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows * rows).sum(1)), 1e-300)[:, None]


def fitted(sample: np.ndarray, cells: int) -> np.ndarray:
    """Unit centroids of unit vectors, by rounds of means from evenly taken rows."""
    centroids = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)]
    for _ in range(ROUNDS):
        own = (sample @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        seen = np.sqrt((sums * sums).sum(1)) > 1e-9
        centroids[seen] = units(sums[seen])
    return centroids


def angles(lists: pa.Array, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the vectors that have a direction, and their angles to all centroids."""
    width = centroids.shape[1]
    values = lists.to_pylist()
    fine = [i for i, v in enumerate(values) if v is not None and len(v) == width and width and None not in v and any(v)]
    rows = units(np.array([values[i] for i in fine], float).reshape(len(fine), width))
    good = np.isfinite(rows).all(1)
    fine, rows = np.array(fine, int)[good], rows[good]
    return fine, np.arccos(np.clip(rows @ centroids.T, -1, 1))


def placed(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Rows of three columns and their vector v with the cell of each, and the angle to its centroid."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                cell, angle = np.full(batch.num_rows, NONE), np.zeros(batch.num_rows)
                fine, to = angles(batch.column(3), centroids)
                if len(fine):
                    cell[fine], angle[fine] = to.argmin(1), to.min(1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cell, pa.int32()), pa.array(angle)], names=[*batch.schema.names[:3], "cell", "angle"])

    return vectors.mapInArrow(run, vectors.drop("v").schema.add("cell", IntegerType()).add("angle", DoubleType()))


def directed(queries: DataFrame, centroids: np.ndarray) -> DataFrame:
    """For each query, a tenant and a vector, its angle to each centroid."""

    def run(batches):
        for batch in batches:
            fine, to = angles(batch.column(1), centroids)
            rows = pa.array(np.repeat(fine, len(centroids)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(np.tile(np.arange(len(centroids)), len(fine)), pa.int32()), pa.array(to.ravel())], names=[batch.schema.names[0], "cell", "turn"])

    return queries.mapInArrow(run, queries.select(queries.columns[0]).schema.add("cell", IntegerType()).add("turn", DoubleType()))


class Cells:
    """Vectors of tenants in cells, stored; visited counts the cells and vectors that searches have read."""

    def __init__(self, vectors: DataFrame, tenant: str, cells: int = 64, key: str = "vec_id", sample: int = SAMPLE):
        self.tenant, self.key, self.visited = tenant, key, (0, 0)
        some = vectors.where(F.coalesce(V.norm(F.col("embedding")), F.lit(0.0)) > 0).orderBy(F.xxhash64(key), key).limit(sample)
        rows = [r[0] for r in some.select(V.doubles("embedding")).collect()]  # at most sample
        widths = [len(r) for r in rows]
        self.width = max(set(widths), key=lambda w: (widths.count(w), -w)) if rows else 0
        self.centroids = fitted(units(np.array([r for r in rows if len(r) == self.width])), cells) if rows else np.zeros((0, 0))
        rows = vectors.select(tenant, key, "embedding", V.doubles("embedding").alias("v"))
        self.vectors = stored(placed(rows, self.centroids), "cells-vectors", ["cell"])
        self.bounds = stored(self.vectors.groupBy(tenant, "cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")), "cells-bounds")

    def similar(self, queries: DataFrame, k: int) -> DataFrame:
        """tenant, vec_id, score, rank of the k vectors of its own that are most like each tenant's query."""
        tenant = self.tenant
        turns = directed(queries.select(tenant, V.doubles("query").alias("v")), self.centroids)
        gap = F.greatest(F.lit(0.0), F.col("turn") - F.col("high"), F.col("low") - F.col("turn"))
        # a cell without an angle to the query holds what has a cosine of 0
        promise = F.when(F.col("turn").isNull(), 0.0).otherwise(F.cos(gap)) + SLACK
        cells = self.bounds.join(near(queries.select(tenant)), tenant).join(turns, [tenant, "cell"], "left").withColumn("promise", promise)
        order = Window.partitionBy(tenant).orderBy(F.col("promise").desc(), "cell")
        before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cells = stored(cells.withColumn("first", before < AMPLE * k).select(tenant, "cell", "n", "promise", "first"), "cells-asked")
        found = stored(self._read(cells.where("first"), queries, k), "cells-found")
        bar = found.where(F.col("rank") == k).select(tenant, F.col("score").alias("bar"))
        more = cells.where("not first").join(near(bar), tenant, "left").where("bar is null or promise >= bar")
        more = stored(more.select(tenant, "cell", "n"), "cells-more")
        seen = cells.where("first").select("n").unionByName(more.select("n")).agg(F.count("*"), F.sum("n")).head()
        self.visited = (self.visited[0] + seen[0], self.visited[1] + (seen[1] or 0))
        every = found.drop("rank").unionByName(self._read(more, queries, k).drop("rank"))
        return top(every, [tenant], [F.col("score").desc(), self.key], k)

    def _read(self, cells: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        """The k best vectors of each query in these cells; folders of other cells aren't read."""
        numbers = [r[0] for r in cells.select("cell").distinct().collect()]  # at most as many as there are cells
        rows = self.vectors.where(F.col("cell").isin(numbers)).join(near(cells.select(self.tenant, "cell")), [self.tenant, "cell"]).join(queries, self.tenant)
        scored = rows.select(self.tenant, self.key, F.round(V.cosine(F.col("query"), F.col("embedding")), DIGITS).alias("score"))
        return top(scored, [self.tenant], [F.col("score").desc(), self.key], k)
