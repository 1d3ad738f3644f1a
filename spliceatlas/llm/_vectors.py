"""Vectors of an embedding table as plain rows, and exact selection of the best scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, id_col: str, vector_col: str, zero: bool = True) -> DataFrame:
    """Columns id (bigint) and v (array<double>), one row for each id: of rows that repeat an id the smallest vector counts.

    Rows with a null id take no part, nor do vectors that are null, empty, hold a null or non-finite component or, with
    zero false, are all zero.
    """
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    good = F.size("v") > 0
    good &= F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    if not zero:
        good &= F.exists("v", lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(good)
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def matrix(column) -> np.ndarray:
    """An Arrow list column of equal lengths as a matrix."""
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(flat), -1) if len(flat) else values.reshape(0, 0)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the k largest finite scores of each row, ties to the smaller id: (row, column) pairs. Columns must be sorted by id."""
    n = scores.shape[1]
    if n > k:
        cut = np.partition(scores, n - k, axis=1)[:, n - k]
        chosen = scores >= cut[:, None]
    else:
        chosen = np.ones(scores.shape, bool)
    chosen &= scores > -np.inf if scores.dtype.kind == "f" else True
    row, column = np.nonzero(chosen)
    order = np.lexsort((ids[column], -scores[row, column], row))
    row, column = row[order], column[order]
    start = np.searchsorted(row, np.arange(len(scores)))
    keep = np.arange(len(row)) - start[row] < k
    return row[keep], column[keep]
