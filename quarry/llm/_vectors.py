"""Vectors as exact integers, shared by the clustering operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REACH = 1 << 26    # larger integers are out of range: squared distances of up to 511 components fit a long


def usable(vector: Column, scale: int) -> Column:
    """Neither null nor empty, no null or non-finite component, every floor(scale * x) below REACH in size."""
    least, most = F.lit(-REACH / scale), F.lit(REACH / scale)
    x_ok = lambda x: F.coalesce((x >= least) & (x < most), F.lit(False))  # noqa: E731 (NaN sorts above all numbers)
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, x_ok), F.lit(False))


def doubles(vector: str) -> Column:
    return F.col(vector).cast("array<double>")


def integers(column: pa.Array, scale: int, dims: int) -> np.ndarray:
    """(rows, dims) floor(scale * x) of an Arrow list column whose lists all hold ``dims`` components."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(flat * float(scale)).astype(np.int64).reshape(-1, dims)


def packed(matrix: np.ndarray) -> pa.Array:
    """One binary value a row, all of the same width."""
    flat = np.ascontiguousarray(matrix)
    width = flat.dtype.itemsize * (flat.size // len(flat) if len(flat) else 0)
    ends = np.arange(len(flat) + 1, dtype=np.int64) * width
    if ends[-1] > np.iinfo(np.int32).max:
        raise ValueError("an Arrow batch of more than 2 GB of state: lower spark.sql.execution.arrow.maxRecordsPerBatch")
    return pa.Array.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])


def unpacked(column: pa.Array, dtype, width: int) -> np.ndarray:
    """(rows, width) values of a binary column written by :func:`packed`."""
    wide = column.cast(pa.large_binary())
    ends = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset: wide.offset + len(wide) + 1]
    data = wide.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0]: ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw.view(dtype).reshape(len(wide), width)


def sums_by(partial: DataFrame, keys: list[str], width: int) -> DataFrame:
    """``keys``, n and total (array): the sums of partial rows (keys, n, sums array<long>), combined before the shuffle."""
    found = partial.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(width)])
    return found.select(*keys, "n", F.array(*[F.col(f"s{d}") for d in range(width)]).alias("total"))
