"""Arrow batches in small pieces, so that what Python makes of a piece stays small."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20


def byte_slices(batches: Iterable[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices that share the memory of their batch, each of at most ``most`` bytes of ``column``, or of one row that holds more."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        first = 0
        while first < batch.num_rows:
            end = max(first + 1, int(np.searchsorted(ends, ends[first] - sizes[first] + most, side="right")))
            yield batch.slice(first, end - first)
            first = end
