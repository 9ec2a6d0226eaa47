"""Arrow batches inside Python tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batches: Iterator[pa.RecordBatch], column: str, max_rows: int, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batches again in slices of at most ``max_rows`` rows and about ``max_bytes`` of the
    text or binary ``column`` (one row at least), however many rows an Arrow batch has."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = size.cumsum(), 0
        while at < b.num_rows:
            stop = int(ends.searchsorted(ends[at] - size[at] + max_bytes, side="right"))
            stop = min(max(stop, at + 1), at + max_rows)
            yield b.slice(at, min(stop, b.num_rows) - at)
            at = stop
        pa.default_memory_pool().release_unused()
