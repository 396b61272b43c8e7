"""Vector columns in blocks: byte packing, and runs of equal keys in a sorted partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows of equal ``keys`` of a partition sorted by them; holds one run at a time."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        part = part if rest is None else pa.concat_tables([rest, part])
        edges = _edges(part, keys)
        for a, b in zip(edges[:-2], edges[1:-1], strict=True):
            yield _key(part, keys, a), part.slice(a, b - a)
        rest = part.slice(edges[-2])
    if rest is not None:
        yield _key(rest, keys, 0), rest


def _edges(part: pa.Table, keys: list[str]) -> list[int]:
    change = np.zeros(part.num_rows, bool)
    change[0] = True
    for k in keys:
        v = part.column(k).to_numpy(zero_copy_only=False)
        change[1:] |= v[1:] != v[:-1]
    return [*np.flatnonzero(change).tolist(), part.num_rows]


def _key(part: pa.Table, keys: list[str], at: int) -> tuple:
    return tuple(part.column(k)[at].as_py() for k in keys)


def packed(column: pa.ChunkedArray | pa.Array, dtype: type = np.float64) -> np.ndarray:
    """A column of equally long binary values as a matrix."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype).reshape(len(values), -1)
