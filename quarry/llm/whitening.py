"""Whitening of embeddings with a weighted multiplicity covariance.

Entries become integers. Equal vectors are grouped, with their number of copies; copies or one each are the weights of the fit.
Sums over the groups are exact integers; the covariance is a weighted product of the centred vectors, summed over partitions.
Its eigenvectors, scaled by the roots of their eigenvalues, whiten each distinct vector once, and the result is joined back to
the rows: vectors that many rows share are few, so they are broadcast, and all others meet their rows by a shuffle.

Defined cases: rows with a null vector or with null or non-finite entries are dropped; integers beyond LARGEST on either side
count as that; each width of vector has a fit of its own, and vectors without entries have no component; components
without variance (an eigenvalue that rounding of the largest one could make) can't be whitened and are left out, so equal vectors
alone give no rows; null vec_ids are rows like others; repeated rows are rows of their own; deviations beyond 64 bits count
as the limit of a long; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stored
from .sums import rows_of, summed
from .tokens import release

#: Integers are at most this, so that they and the sums over a batch are exact.
LARGEST = 2**40
#: A vector that more than this share of all rows have is broadcast: at most so many are.
SHARED = 1_000
#: Vectors that are multiplied at once.
AT_ONCE = 4_096
LONG = 2**63 - 1


def whole(df: DataFrame, scale: int, shift: int) -> DataFrame:
    """vec_id and the vector of integers, of the rows that take part."""
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    limit = float(LARGEST)
    x = F.transform("embedding", lambda c: F.greatest(F.lit(-limit), F.least(F.lit(limit), F.floor(F.greatest(F.lit(-limit), F.least(F.lit(limit), scale * c.cast("double")))) + shift)).cast("long"))
    return df.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def total(groups: DataFrame, width: int) -> tuple[int, list[int]]:
    """Sum of weights, and weighted sums of each dimension, exactly."""

    def run(batches):
        release()
        sums, n = [0] * width, 0
        for batch in batches:
            weight = batch.column(1).to_numpy()
            for at in range(0, batch.num_rows, AT_ONCE):
                some = slice(at, at + AT_ONCE)
                x, w = rows_of(batch.column(0).slice(at, AT_ONCE)), weight[some]
                n += int(w.sum())
                # copies of a vector can be many: such products go by integers of any size
                exact = x.astype(object) if int(w.max()) * LARGEST * len(w) > LONG else x
                sums = [a + int(b) for a, b in zip(sums, (exact * w[:, None]).sum(0), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, width), pa.int32()), pa.array(list(map(Decimal, [n, *sums])), pa.decimal128(38, 0))], names=["at", "value"])

    rows = groups.select("x", "weight").mapInArrow(run, "at int, value decimal(38,0)").groupBy("at").agg(F.sum("value").cast("decimal(38,0)")).collect()  # one for each dimension
    found = {r[0]: int(r[1]) for r in rows}
    return found.get(-1, 0), [found.get(i, 0) for i in range(width)]


def product(groups: DataFrame, column: str, mean: np.ndarray) -> np.ndarray:
    """Weighted sum of the products of centred vectors."""
    width = len(mean)

    def run(batches):
        out = None
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                y = rows_of(batch.column(0).slice(at, AT_ONCE)) - mean
                out = np.zeros((width, width)) if out is None else out
                out += (y * batch.column(1).slice(at, AT_ONCE).to_numpy()[:, None]).T @ y
        return out

    return summed(groups.select(column, "weight"), run, (width, width))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over the dimensions of (n x - S)^2, exactly."""
    if not x.shape[1]:
        return [0] * len(x)
    most = max(max(abs(n * int(x[:, i].max()) - s), abs(n * int(x[:, i].min()) - s)) for i, s in enumerate(sums))
    if most * most * len(sums) <= LONG and n * LARGEST <= LONG:
        d = n * x - np.array(sums, np.int64)
        return (d * d).sum(1).tolist()
    d = n * x.astype(object) - np.array(sums, object)
    return [min(LONG, int(v)) for v in (d * d).sum(1)]


def whitened(vectors: DataFrame, components: int = 16, scale: int = 64, shift: int = 1_000_000, weight: str = "one") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error; weight is one for each distinct vector, or count of its rows."""
    rows = whole(vectors, scale, shift)
    groups = rows.groupBy("x").agg(F.count("*").alias("copies")).withColumn("weight", F.col("copies") if weight == "count" else F.lit(1).cast("long"))
    groups = stored(groups.withColumn("width", F.size("x")), "whitening-groups")
    fits = [white(groups.where(F.col("width") == w), w, components) for (w,) in sorted(groups.select("width").distinct().collect())]
    kind = "x array<long>, copies long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    table = reduce(DataFrame.unionByName, fits) if fits else rows.sparkSession.createDataFrame([], kind)
    many = F.col("copies") * SHARED > (groups.agg(F.sum("copies")).head()[0] or 0)
    # fewer than SHARED vectors have so many copies
    joined = rows.join(F.broadcast(table.where(many).drop("copies")), "x", "left")
    values = ["n", "deviation", "whitened", "explained", "identity_error"]
    met = joined.where("n is not null").select("vec_id", *values)
    met = met.unionByName(joined.where("n is null").select("vec_id", "x").join(table.where(~many), "x").select("vec_id", *values))
    each = met.select("*", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "of"))
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("of.whitened").alias("whitened"), F.col("of.explained").alias("explained"), "identity_error")


def white(groups: DataFrame, width: int, components: int) -> DataFrame:
    """The distinct vectors of a width with their whitened forms."""
    n, sums = total(groups, width)
    mean = np.array([float(Fraction(s, n)) for s in sums])
    covariance = product(groups, "x", mean) / n if width else np.zeros((0, 0))
    value, vector = np.linalg.eigh((covariance + covariance.T) / 2)
    value, vector = value[::-1], vector[:, ::-1]
    some = value[:components] > (value[0] if width else 0.0) * width * 1e-13
    some = np.flatnonzero(some & (value[:components] > 0))
    turn = vector[:, some] / np.sqrt(value[some])
    explained = (value[some] / np.trace(covariance)).tolist()

    def run(batches):
        release()
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                x = rows_of(part.column(0)).reshape(part.num_rows, width)
                # n x - S is whole, so centring loses nothing
                centred = (n * x - np.array(sums, np.int64)) / n if n * LARGEST <= LONG else x - mean
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(deviations(x, n, sums), pa.int64()), pa.array(list(centred @ turn), pa.list_(pa.float64()))],
                    names=["x", "copies", "weight", "deviation", "whitened"],
                )

    table = groups.select("x", "copies", "weight").mapInArrow(run, "x array<long>, copies long, weight long, deviation long, whitened array<double>")
    table = stored(table, "whitening-vectors")
    error = 0.0
    if len(some):
        error = float(np.abs(product(table, "whitened", np.zeros(len(some))) / n - np.eye(len(some))).max())
    explained = F.array(*map(F.lit, explained)) if explained else F.array().cast("array<double>")
    return table.select("x", "copies", F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
