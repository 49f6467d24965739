"""Vectors of array columns as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite(df: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is no null and holds neither null nor non-finite entries."""
    entry_ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return df.filter(F.col(column).isNotNull()).filter(F.forall(F.col(column), entry_ok))


def matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """One row for each list, in the lists' own type; shorter ones are filled up with zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    values = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    if len(values) == len(lists) * dims:
        return values.reshape(len(lists), dims)
    out = np.zeros((len(lists), dims), dtype=values.dtype)
    out[np.arange(dims) < sizes[:, None]] = values
    return out
