"""Integer matrices from columns of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whole numbers up to here are exact in double precision.
EXACT = 1 << 53


def finite_vectors(df: DataFrame, key: str, vector: str, *more: Column) -> DataFrame:
    """(vec_id, vector array<double>, ...) of the rows whose vector has finite components only."""
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), *more)
    return rows.filter(F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def component_limit(width: int, terms: int = 1) -> int:
    """The greatest component with which the sum of `width` products fits in a long.

    Each factor may be the sum or difference of `terms` components.
    """
    return min(2**31 - 1, int((2**63 / max(1, width)) ** 0.5 * 0.999 / terms))


def integer_rows(column: pa.Array, scale: int, width: int, terms: int = 1) -> np.ndarray:
    """floor(scale * x) of each component; short vectors end in zeros, huge values at the limit."""
    lengths = np.asarray(column.value_lengths(), np.int64)
    x = np.zeros((len(column), width))
    x[np.arange(width) < lengths[:, None]] = np.asarray(column.flatten())
    limit = component_limit(width, terms)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * x), -limit, limit).astype(np.int64)


def exact_kind(largest: int, other: int, width: int) -> type:
    """double if sums of `width` products, four times over, are exact in it, else 64-bit integers."""
    return np.float64 if 4 * max(1, largest) * max(1, other) * width < EXACT else np.int64
