"""String columns of Arrow batches as numpy arrays, without per-row Python strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in slices of about this many bytes (a longer text is a slice of its own), which bounds memory.
SLICE_BYTES = 4 << 20


def bytes_and_offsets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets from 0) of a string array; nulls are empty."""
    a = pc.fill_null(texts, "").cast(pa.large_string())
    _, off, data = a.buffers()
    off = np.frombuffer(off, np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about SLICE_BYTES of text."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // SLICE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(edges, edges[1:]):
        yield batch.slice(lo, hi - lo)


def strings(data: bytes | np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A large_string array over UTF-8 bytes."""
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated index ranges start..start+length."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)
