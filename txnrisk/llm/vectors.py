"""Columns of vectors inside tasks, shared by the operators that read embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def finite_vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length that occurs: the places of its vectors, and the vectors as a matrix. Vectors that are null or hold a null
    or non-finite component are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    known = np.asarray(column.is_valid())
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null becomes NaN
    starts = np.cumsum(lengths) - lengths
    for length in np.unique(lengths[known]):
        places = np.flatnonzero(known & (lengths == length))
        wide = values[starts[places][:, None] + np.arange(length)]
        good = np.isfinite(wide).all(axis=1)
        if good.any():
            yield places[good], wide[good]


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str], work: Callable[[pa.Table], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``work`` on the rows of each run of equal ``keys`` in sorted batches. Many short runs share a batch and one run may span
    several, so a task holds one run and one batch at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changes = np.zeros(batch.num_rows, bool)
        for k in keys:
            values = batch.column(k).to_numpy(zero_copy_only=False)
            changes[1:] |= values[1:] != values[:-1]
            changes[0] |= bool(held) and held[-1].column(k)[-1].as_py() != values[0]
        first = 0
        for cut in np.flatnonzero(changes).tolist():
            if cut > first:
                held.append(batch.slice(first, cut - first))
            if held:
                yield work(pa.Table.from_batches(held))
                held = []
            first = cut
        held.append(batch.slice(first))
    if held:
        yield work(pa.Table.from_batches(held))
