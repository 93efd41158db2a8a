"""What the two vector operators share: which vectors take part, and their numpy form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """Neither null nor zero, and without null or non-finite components."""
    inf = F.lit(float("inf"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    return v.isNotNull() & F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def one_row_each(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows (key, value) with usable values; rows that repeat a key count once (their least value). Floats stay floats, which halves what is sent."""
    kind = "array<float>" if df.schema[value].dataType.simpleString() == "array<float>" else "array<double>"
    return df.select(F.col(key).cast("long").alias(key), F.col(value).cast(kind).alias(value)).where(F.col(key).isNotNull() & usable(F.col(value))).groupBy(key).agg(F.min(value).alias(value))


def matrix(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All values in one array, in double precision, and the offsets by row."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    at = col.offsets.to_numpy().astype(np.int64)
    return col.values.to_numpy()[at[0] : at[-1]].astype(np.float64), at - at[0]


def by_length(at: np.ndarray, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length that occurs; vectors of different lengths have nothing to do with each other."""
    size = np.diff(at)
    out = []
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        out.append((rows, flat[at[rows][:, None] + np.arange(d)]))
    return out
