"""Principal directions of vectors, from sums that Spark adds up; shared by the operators on embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Above so many components the second moments (their square) are not gathered; the first components stand in.
MAX_MOMENTS = 512


def sound(vec: Column) -> Column:
    """Whether a vector is there, not empty, and free of null and non-finite components."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vec.isNotNull() & (F.size(vec) > 0) & F.coalesce(fine, F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of an Arrow list column without nulls, all of ``dim`` components, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def principal(rows: DataFrame, vec_col: str, dim: int, leading: int, prepare: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and the ``leading`` principal directions (dim x leading) of the prepared vectors of ``rows``.

    Every task adds up its own moments; at most ``dim * (dim + 1) + 1`` sums reach the driver, whatever the number of rows.
    """
    leading = min(leading, dim)
    if dim > MAX_MOMENTS:
        return np.zeros(dim), np.eye(dim)[:, :leading]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + dim + dim * dim)
        for batch in batches:
            x = prepare(matrix(batch.column(0), dim))
            total += np.concatenate(([len(x)], x.sum(0), (x.T @ x).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "v"])

    parts = rows.select(vec_col).mapInArrow(run, "i int, v double")
    sums = np.zeros(1 + dim + dim * dim)
    for r in parts.groupBy("i").agg(F.sum("v").alias("v")).collect():
        sums[r.i] = r.v
    if not sums[0]:
        return np.zeros(dim), np.eye(dim)[:, :leading]
    mean = sums[1 : dim + 1] / sums[0]
    _, directions = np.linalg.eigh(sums[dim + 1 :].reshape(dim, dim) / sums[0] - np.outer(mean, mean))
    return mean, np.ascontiguousarray(directions[:, ::-1][:, :leading])
