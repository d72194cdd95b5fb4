"""Matrices summed over the partitions of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import release

#: Partial sums that meet in one task, before those sums meet.
TOGETHER = 64


def rows_of(column) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def added(key, table: pa.Table) -> pa.Table:
    """One row of the sum of a few partial ones, in the order of their partitions, so that reruns agree."""
    order = np.argsort(table.column("part").to_numpy(), kind="stable")
    total = rows_of(table.column("cells"))[order].sum(0)
    return pa.table({"at": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int64()), "cells": pa.array([total], pa.list_(pa.float64()))})


def summed(df: DataFrame, partial: Callable[[Iterable[pa.RecordBatch]], np.ndarray | None], shape: tuple[int, int]) -> np.ndarray:
    """The sum of partial(batches), a matrix of this shape, over all partitions of df. Partial sums travel row by row and are added in groups of TOGETHER, and then those sums; the driver gets the rows of one matrix. None counts as zero."""

    def run(batches):
        release()
        cells = partial(batches)
        if cells is not None:
            part = np.full(len(cells), TaskContext.get().partitionId(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells)), pa.int32()), pa.array(part), pa.array(list(cells), pa.list_(pa.float64()))], names=["at", "part", "cells"])

    kind = "at int, part long, cells array<double>"
    rows = df.mapInArrow(run, kind)
    for wide in (TOGETHER, None):
        group = F.floor(F.col("part") / wide) if wide else F.lit(0).cast("long")
        rows = rows.withColumn("group", group).groupBy("at", "group").applyInArrow(lambda key, table: added(key, table), kind)
    table = rows.toArrow()  # as many rows as the matrix has
    out = np.zeros(shape)
    if table.num_rows:
        out[table.column("at").to_numpy()] = rows_of(table.column("cells"))
    return out
