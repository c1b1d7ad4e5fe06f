"""Vectors as Arrow batches: which take part, numpy views, blocks of sorted rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def takes_part(vector: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def element_type(df: DataFrame, column: str) -> str:
    """``array<float>`` or ``array<double>``: as stored, other numbers as doubles."""
    kind = df.schema[column].dataType.simpleString()
    return kind if kind == "array<float>" else "array<double>"


def rows_of(column: pa.Array) -> list[np.ndarray]:
    """The lists of a list column as numpy arrays."""
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def matrix_of(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def list_column(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A matrix as a column of lists."""
    offsets = np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32) if x.shape[1] else np.zeros(len(x) + 1, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel(), kind))


def by_group(batches: Iterator[pa.RecordBatch], keys: int, work: Callable[[pa.Table], pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    """``work`` on each run of rows that agree in the first ``keys`` columns; rows come sorted by these.

    Runs may cross batches; one run is held at a time.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        changes = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            changes[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(changes).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            at = tuple(c[a] for c in columns)
            if at != last and held:
                out = work(pa.Table.from_batches(held))
                held = []
                if out is not None:
                    yield out
            last = at
            held.append(batch.slice(a, b - a))
    if held:
        out = work(pa.Table.from_batches(held))
        if out is not None:
            yield out


def column_array(table: pa.Table, name: str) -> pa.Array:
    c = table.column(name).combine_chunks()
    return c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
